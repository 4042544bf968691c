"""What a query leaves on disk while it goes on: shuffles, checkpoints, and how much of the sets moves."""
import os
import time

from pyspark.sql import functions as F

from glyphmill.operators import similarity as si
from glyphmill.operators.ranks import maybe_among
from glyphmill.session import cut_lineage, drop_table


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {str(files.apply(i).getName()) for i in range(files.size()) if files.apply(i).getName().endswith(".data")}


def checkpoint_of(df):
    return df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get().removeprefix("file:")


def test_shuffles_go_with_the_checkpoint(spark):
    before = shuffle_files(spark)
    grouped = spark.range(10_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    kept = cut_lineage(grouped)
    for _ in range(100):  # executors delete on their own threads
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
    assert kept.count() == 1000 and grouped.agg(F.sum("n")).first()[0] == 10_000


def test_dropped_tables_leave_no_files(spark):
    kept, other = cut_lineage(spark.range(100)), cut_lineage(spark.range(5))
    path, still = checkpoint_of(kept), checkpoint_of(other)
    assert os.path.isdir(path)
    drop_table(kept.filter("id > 3"))
    assert not os.path.exists(path) and os.path.isdir(still) and other.count() == 5


def test_filter_of_keys_keeps_all_of_them(spark):
    rows = spark.createDataFrame([(i, i % 7) for i in range(2_000)] + [(None, 1)], "id long, x long")
    keys = spark.range(0, 2_000, 3).unionByName(spark.range(0, 2_000, 3))
    got = sorted(r["id"] for r in maybe_among(rows, "id", keys).collect())
    assert set(range(0, 2_000, 3)) <= set(got) and len(got) == len(set(got)) < 700
    assert maybe_among(rows, "id", keys.limit(0)).count() == 0


def test_pairs_that_cannot_reach_the_threshold_move_no_sets(spark, monkeypatch):
    """Sets that share their rarest members and nothing else."""
    rows = [(i, f"own{i}-{x}") for i in range(40) for x in range(60)] + [(i, f"pair{i // 2}-{x}") for i in range(40) for x in range(20)]
    rows += [(i, f"own{i - 100}-{x}") for i in (100, 101) for x in range(60)] + [(i, f"pair{(i - 100) // 2}-{x}") for i in (100, 101) for x in range(19)]
    counted, original = [], si._count_common
    monkeypatch.setattr(si, "_count_common", lambda pairs, packed: counted.append(pairs.count()) or original(pairs, packed))
    got = {(r["a"], r["partner"]) for r in si.nearest_partners(si.packed_sets(spark.createDataFrame(rows, "id long, member string")), 0.9).collect()}
    assert got == {(0, 100), (100, 0), (1, 101), (101, 1)}
    assert sum(counted) <= 4


def test_few_members_are_broadcast(spark, monkeypatch):
    """Sets are the same whether the numbers of none, some or all members are broadcast; repeated and null members count."""
    rows = [(i, str(x)) for i in range(30) for x in range(i % 5, 60, 1 + i % 4)] + [(3, "3"), (4, None), (99, None), (None, "7")]
    table, seen = spark.createDataFrame(rows, "id long, member string"), []
    for frequent in (1, 30, 1 << 16):
        monkeypatch.setattr(si, "FREQUENT", frequent)
        seen.append(sorted((str(r["id"]), r["size"], r["part"], tuple(r["members"]), r["plain"]) for r in si.packed_sets(table).collect()))
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 31


def test_correlated_tokens_among_some(spark):
    """Tokens that take part, told by a table, give the pairs that their own rows give; dense ones meet only partners of enough odds."""
    n = 60
    sets = {"half": range(0, 30), "other": range(30, 60), "copy": range(0, 30), "most": range(0, 55), "few": range(55, 60), "near": [*range(0, 29), 40], "rare": [1, 2]}
    rows = spark.createDataFrame([(sid, token) for token, sids in sets.items() for sid in sids], "sid long, token string")
    chosen = spark.createDataFrame([(x,) for x in sets if x != "copy"] * 2, "id string")
    got = {(r["a"], r["b"], r["common"]) for r in si.correlated_tokens(rows, n, 0.85, chosen).collect()}
    assert got == {(r["a"], r["b"], r["common"]) for r in si.correlated_tokens(rows.filter("token <> 'copy'"), n, 0.85).collect()}
    assert got == {("half", "other", 0), ("half", "near", 29), ("near", "other", 1), ("few", "most", 0)}


def test_hierarchical_blocks_read_events_that_are_joined_once(spark):
    """Every block of the case reads the kept events; none joins and parses the line items again."""
    from glyphmill.catalog import all_queries

    got = all_queries()["c7_hierarchical_case"](spark, "/root/testdata/sf0.001")
    assert "lineitem" not in got._jdf.queryExecution().executedPlan().toString()


def checkpoints(spark):
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    return {x for x in os.listdir(root) if x.startswith("rdd-")}


def typed_rows(spark, n=60):
    from glyphmill.sources.fixtures import typed_events

    rows = [(i, f"g{(i + j) % 7}", f"{'ACDEF'[(i * j) % 5]}{10 * (i % 4) + j}{'GHIKL'[(i + j) % 5]}") for i in range(n) for j in range(4)]
    placed = spark.createDataFrame([(i, "xyz"[i % 3], i % 5) for i in range(n)], "sid long, label string, fold int")
    return typed_events(spark.createDataFrame(rows, "sid long, gene string, event string")), placed


def test_a_design_leaves_its_rows_and_columns_only(spark):
    from glyphmill.plans import compositions as co

    typed, placed = typed_rows(spark)
    cut_lineage(spark.range(1))
    before = checkpoints(spark)
    made = co.structured(typed, placed)
    drop_table(made.typed)
    assert len(checkpoints(spark) - before) == 2
    assert made.design.select(0).count() == 60
    assert {"entries", "dense"} <= set(made.design.rows.columns) and "array<struct" not in made.design.rows.schema["entries"].dataType.simpleString()


def test_partitions_hold_a_multiple_of_what_they_send(spark):
    from glyphmill.plans.wide import GRADIENTS, MOST_BYTES, PARTITION_BYTES, Wide

    narrow, wide, widest = (Wide(None, None, width, [], 3 << 30, 5) for width in (1_000, 500_000, 5_000_000))
    assert narrow.partitions() == (3 << 30) // PARTITION_BYTES
    assert wide.partitions() * GRADIENTS * 8 * 500_000 * 5 <= (3 << 30) + GRADIENTS * 8 * 500_000 * 5
    assert widest.partitions() == (3 << 30) // MOST_BYTES


def test_saving_a_model_leaves_no_token_rows(spark, tmp_path):
    from glyphmill.plans import compositions as co

    typed, placed = typed_rows(spark)
    cut_lineage(spark.range(1))
    typed, fit = cut_lineage(typed), placed.filter("fold <> 0").select("sid", "label")
    before = checkpoints(spark)
    co.fit_saved_model(typed, fit, ["x", "y", "z"], str(tmp_path / "model"))
    assert checkpoints(spark) == before
    assert co.apply_saved_model(typed, placed.filter("fold = 0").select("sid"), str(tmp_path / "model")).count() == 12 * 3


def test_repeated_rows_meet_as_those_of_the_chosen_tokens_do(spark):
    """Where rows repeat, the tokens that take part are numbered by their own rows."""
    rows = [(sid, f"t{t}") for t in range(12) for sid in range(t % 4, 60, 1 + t % 3)]
    rows += [(sid, "only") for sid in range(0, 60, 2)] + rows[::3]
    tokens, chosen = spark.createDataFrame(rows, "sid long, token string"), spark.createDataFrame([(f"t{t}",) for t in range(12)], "id string")
    seen = [sorted((r["a"], r["b"], r["common"], round(r["phi"], 9)) for r in si.correlated_tokens(x, 60, 0.85, among).collect())
            for x, among in ((tokens, chosen), (tokens.filter("token <> 'only'"), None))]
    assert seen[0] == seen[1]
