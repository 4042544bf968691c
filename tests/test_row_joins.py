"""Tables with a row or more per sample never pass through the driver, and a sample's rows are made where they are grouped."""
import pytest
from pyspark.sql import functions as F

from glyphmill.operators import folds as fo, metrics as me, probs as pr, ranks, weights as we
from glyphmill.sources import tables
from glyphmill.sources.fixtures import Fixtures


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def customers(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").alias("c_custkey"), F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), (F.col("id") % 3 + 1).cast("int")).alias("c_mktsegment"))
    rows.write.parquet(f"{tmp_path}/customer.parquet")
    return Fixtures(spark, str(tmp_path))


def test_numbering_broadcasts_no_rows(spark, customers):
    samples = customers.samples
    for got in (ranks.numbered_by_hash(samples, ["label"], F.md5(F.col("sid").cast("string")), ["sid"]), fo.stratified_folds(samples),
                ranks.numbered_by_value(samples.withColumn("v", F.col("sid") * 0.5), "v", F.md5(F.col("sid").cast("string")), ["sid"], groups=["label"])):
        assert "BroadcastHashJoin" not in plan(got)


def test_probability_rows_meet_folds_without_broadcast(customers):
    rows = pr.rows_of(customers.prob(["a", "b"], 400), ["a", "b"], customers.classes)
    got = ranks.by_rows(rows, customers.folds().select("sid", "fold"), ["sid"])
    assert "BroadcastHashJoin" not in plan(got)
    assert got.count() == 400 and got.select("sid").distinct().count() == 400


def test_exploded_rows_are_grouped_where_they_are_made(customers):
    prob = customers.prob(["a", "b"], 400)
    rows = pr.rows_of(prob, ["a", "b"], customers.classes)
    assert plan(rows).count("Exchange hashpartitioning") == 1  # the samples themselves
    assert prob.count() == 400 * 2 * 3


def test_tasks_follow_the_rows_they_make(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    df = spark.range(1000).withColumnRenamed("id", "sid")
    assert tables.dealt(df, "sid", 10).rdd.getNumPartitions() == 100
    assert tables.dealt(df, "sid", 10).distinct().count() == 1000


def test_events_broadcast_no_orders_or_parts(spark):
    events = Fixtures(spark, "/root/testdata/sf0.001").events
    assert "BroadcastHashJoin" not in plan(events)


def test_permuted_labels_and_markers_broadcast_no_rows(spark, customers):
    samples = customers.samples
    got = fo.permuted_samples(samples, [1, 2, 3])
    assert "BroadcastHashJoin" not in plan(got) and "BroadcastHashJoin" not in plan(fo.permute_labels(samples, 7))
    per = {r["perm"]: (r["n"], r["ids"]) for r in got.groupBy("perm").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sid").alias("ids")).collect()}
    assert per == {i: (400, 400) for i in range(4)}
    from glyphmill.catalog import all_queries
    assert "[sid" not in "".join(x for x in plan(all_queries()["m25_marker_f1_correlation"](spark, "/root/testdata/sf0.001")).splitlines() if "BroadcastHashJoin" in x)


def test_permutation_scores_are_the_same_by_broadcast_and_by_shuffle(spark, customers, monkeypatch):
    tokens = customers.samples.select("sid", F.explode(F.array(*[F.when(F.pmod(F.xxhash64("sid", F.lit(i)), F.lit(3)) == 0, F.lit(f"t{i}")) for i in range(6)])).alias("token")).filter("token is not null")
    seen = []
    for few in (0, 50_000):
        monkeypatch.setattr(me, "FEW_WEIGHTS", few)
        got = me.permutation_null(tokens, customers.samples, customers.classes, we.log_odds(), [1, 2])
        seen.append(sorted((r["perm"], round(r["macro_f1"], 9), round(r["accuracy"], 9), r["p_value"]) for r in got.collect()))
    assert seen[0] == seen[1] and [x[0] for x in seen[0]] == [0, 1, 2]
