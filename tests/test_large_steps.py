"""Steps that must not grow with the number of times a table is read, or with the bytes that a shuffle happened to make."""
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from glyphmill.catalog import all_queries
from glyphmill.operators import evidence as ev, rollups as ru, weights as we
from glyphmill.plans import compositions as co, designs as de, wide
from glyphmill.sources import fixtures


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two line items for each of 120 orders of 40 samples; the last customer has no orders, one order no customer."""
    path = str(tmp_path_factory.mktemp("stars"))
    tables = {
        "customer": spark.range(41).select(F.col("id").alias("c_custkey"), F.element_at(F.array(F.lit("A"), F.lit("B")), (F.col("id") % 2 + 1).cast("int")).alias("c_mktsegment")),
        "orders": spark.range(120).select(F.col("id").alias("o_orderkey"), F.when(F.col("id") != 7, F.col("id") % 40).alias("o_custkey")),
        "part": spark.range(12).select(F.col("id").alias("p_partkey"), F.concat(F.lit("Brand#"), (F.col("id") % 3 + 1).cast("string")).alias("p_brand")),
        "lineitem": spark.range(240).select(
            F.floor(F.col("id") / 2).alias("l_orderkey"), (F.col("id") * 7 % 12).alias("l_partkey"), (F.col("id") % 5).alias("l_suppkey"), (F.col("id") % 7 + 1).cast("int").alias("l_linenumber")),
    }
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.fixture
def counted(spark):
    """Turns rows into a table that counts how often a row of it is made."""
    def of(rows, schema):
        made = spark.sparkContext.accumulator(0)

        def tick(row):
            made.add(1)
            return row

        return spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(tick), schema), made

    return of


def test_tasks_of_events_follow_the_line_items(spark, folder, monkeypatch):
    monkeypatch.setattr(fixtures, "EVENT_ROWS", 6)
    fx = fixtures.Fixtures(spark, folder)
    assert fx.events.rdd.getNumPartitions() == 40
    rows = [tuple(r) for r in fx.events.collect()]
    assert len(rows) == len(set(rows)) and {r[0] for r in rows} == {*range(40), None}
    fx = fixtures.Fixtures(spark, folder)
    dealt = _plan(fx.events.select("*")).count("Exchange hash")
    assert _plan(ru.letter_counts(fx.typed)).count("Exchange hash") == dealt
    assert _plan(ev.event_documents(fx.typed)).count("Exchange hash") == dealt


def test_samples_of_an_event_are_counted_without_a_second_distinct(spark, folder):
    got = all_queries()["t1_top_k_stable"](spark, folder)
    assert "distinct" not in _plan(got)
    events = fixtures.Fixtures(spark, folder).events
    wanted = events.groupBy("gene", "event").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sid").alias("samples")).orderBy(F.desc("n"), F.desc("samples"), "gene", "event").limit(25)
    assert got.collect() == wanted.collect()


def _samples(n=24):
    return [(s, "AB"[s % 2], s % 3) for s in range(n)]


def _tokens(n=24):
    return [(s, f"t{(s * i) % 5}") for s in range(n) for i in (1, 2, 3)]


def test_cross_fitting_reads_tokens_and_folds_once(counted):
    tokens, made = counted(_tokens(), "sid long, token string")
    folds, placed = counted(_samples(), "sid long, label string, fold int")
    got = we.cross_fitted_scores(tokens, folds, ["A", "B"], we.log_odds(), None)
    assert got.count() == 48
    assert (made.value, placed.value) == (72, 24)


def test_a_design_reads_tokens_and_rows_once(counted):
    tokens, made = counted(_tokens(), "sid long, token string")
    folds, placed = counted(_samples(), "sid long, label string, fold int")
    assert wide.build(folds, tokens, 3, varying=False).select(0).count() == 24
    assert (made.value, placed.value) == (72, 24)


def test_evidence_scores_read_tokens_once(counted):
    tokens, made = counted(_tokens(), "sid long, token string")
    split, placed = counted([(s, c, f != 0) for s, c, f in _samples()], "sid long, label string, fit boolean")
    assert de.evidence_scores(tokens, split, ["A", "B"], we.log_odds()).count() == 24
    assert (made.value, placed.value) == (72, 24)


def test_a_saved_model_reads_its_events_once(spark, counted, tmp_path):
    rows = [(s, f"G{i}", f"A{s % 4}V") for s in range(24) for i in range(2)]
    typed, made = counted(rows, "sid long, gene string, event string")
    fit, _ = counted([r[:2] for r in _samples()], "sid long, label string")
    typed = typed.withColumn("event_type", F.lit("MISSENSE"))
    co.fit_saved_model(typed, fit, ["A", "B"], str(tmp_path / "m"), iterations=5)
    assert made.value == 48
    assert co.apply_saved_model(typed, fit.select("sid"), str(tmp_path / "m")).count() == 48


@pytest.mark.parametrize("name", ["l4_residual_weights", "f8_standardised_scores", "f8_standardised_floor_max", "ml6_feature_views", "c2_structured_columns",
                                  "c6_saved_evidence_bundle", "ml5_truncated_svd"])
def test_queries_that_read_events_more_than_once_keep_them(spark, folder, name):
    got = all_queries()[name](spark, folder)
    assert "l_orderkey" not in _plan(got)  # the joins behind the events are not made again
    got.count()
