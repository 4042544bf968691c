"""Data-quality contracts, coverage audits and exploratory tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphmill.functions import cells
from glyphmill.operators.relational import bucket


def table_contract(samples: DataFrame, key: str = "sid", label: str = "label", folds: int = 5) -> DataFrame:
    """One row of flags: non-empty, key present and unique, label present, every class at least ``folds`` rows."""
    basic = samples.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(key).isNull()).alias("null_keys"),
        F.count_if(F.col(label).isNull()).alias("null_labels"))
    repeated = samples.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, 1)), F.lit(0)))
    least = samples.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n"))
    got = basic.withColumns({"repeated_keys": repeated.scalar(), "smallest_class": least.scalar()})
    ok = ((F.col("rows") > 0) & (F.col("null_keys") == 0) & (F.col("null_labels") == 0) & (F.col("repeated_keys") == 0)
          & (F.col("smallest_class") >= folds))
    return got.withColumn("valid", ok)


def require_columns(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")


def same_schema(fit: DataFrame, apply: DataFrame, key: str = "sid", label: str = "label") -> bool:
    """The apply table has the fit table's columns without the label, in the same order."""
    return apply.columns == [c for c in fit.columns if c != label] and key in apply.columns


def null_cells(cells_long: DataFrame, by: list[str]) -> DataFrame:
    return cells_long.groupBy(*by).agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("cell").isNull()).alias("null_cells"))


def cell_audit(raw: DataFrame) -> DataFrame:
    """One row: reference, null and multi-event cells, delimiters, segments against parsed events, unknown notations."""
    cell = F.col("cell")
    reference = cells.is_reference(cell)
    events = cells.split_grammar(cell)
    x = raw.select(
        cell.isNull().alias("null"), reference.alias("ref"), events.alias("ev"),
        F.when(~reference, cell).alias("live"))
    kinds = F.transform("ev", cells.canonical14)

    def marks(symbol: str) -> Column:
        return F.coalesce(F.length("live") - F.length(F.replace("live", F.lit(symbol), F.lit(""))), F.lit(0))

    return x.agg(
        F.count(F.lit(1)).alias("cells"), F.count_if("null").alias("null_cells"), F.count_if("ref").alias("reference_cells"),
        F.count_if(F.size("ev") > 1).alias("multi_event_cells"),
        F.sum(F.size("ev").cast("bigint")).alias("segments"), F.sum(F.size(kinds).cast("bigint")).alias("parsed_events"),
        F.sum(F.size(F.filter(kinds, lambda k: k == "UNKNOWN")).cast("bigint")).alias("unknown_events"),
        F.sum(marks(";").cast("bigint")).alias("semicolons"), F.sum(marks("|").cast("bigint")).alias("bars"),
        F.sum(marks(",").cast("bigint")).alias("commas"), F.sum(marks("/").cast("bigint")).alias("slashes"),
        F.count_if(F.col("null") & (F.size("ev") > 0)).alias("null_as_event"),
    ).withColumn("segments_conserved", F.col("segments") == F.col("parsed_events"))


def probability_contract(prob: DataFrame, keys: list[str], class_count: int, tolerance: float = 1e-6) -> DataFrame:
    bad = F.col("p").isNull() | F.isnan("p") | (F.abs("p") == float("inf"))
    rows = prob.groupBy(*keys).agg(F.sum("p").alias("s"), F.count(F.lit(1)).alias("k"), F.count_if(bad).alias("bad"))
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("bad") > 0).alias("not_finite"),
        F.count_if(F.abs(F.col("s") - 1) > tolerance).alias("not_normalised"), F.count_if(F.col("k") != class_count).alias("wrong_width"))


def difference(full: DataFrame, part: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows only in either side; both are empty when a transform is row-independent."""
    return full.exceptAll(part), part.exceptAll(full)


def stored_scores(calculated: DataFrame, stored: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    x = calculated.withColumnRenamed("macro_f1", "calculated").join(stored.withColumnRenamed("macro_f1", "stored"), keys, "full")
    return x.withColumn("matches", F.coalesce(F.abs(F.col("calculated") - F.col("stored")) <= tolerance, F.lit(False)))


def compare_labels(a: DataFrame, b: DataFrame, key: str = "sid") -> DataFrame:
    """(label_a, label_b, n, differs) over the shared keys, with null where a side lacks the key."""
    x = a.select(key, F.col("label").alias("label_a")).join(b.select(key, F.col("label").alias("label_b")), key, "full")
    return x.groupBy("label_a", "label_b").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "differs", ~F.col("label_a").eqNullSafe(F.col("label_b")))


def pairs_complete(rows: DataFrame, keys: list[str], variant: str, expected: int) -> DataFrame:
    """Keys that do not have exactly ``expected`` variants, each once."""
    got = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(variant).alias("variants"))
    return got.withColumn("complete", (F.col("rows") == expected) & (F.col("variants") == expected))


def coverage(apply_events: DataFrame, vocabulary: DataFrame, n_apply: Column, by: list[str] | None = None) -> DataFrame:
    """Distinct and occurrence coverage of apply tokens by a fitted vocabulary, and rows with any hit.

    The vocabulary is unique per (by, token), so known tokens are marked by one join.
    """
    by = by or []
    marked = apply_events.join(vocabulary.select(*by, "token", F.lit(True).alias("_known")), [*by, "token"], "left")
    known = F.col("_known").isNotNull()
    per_token = marked.groupBy(*by, "token").agg(F.count(F.lit(1)).alias("n"), F.max(known).alias("known"))
    tokens = per_token.groupBy(*by).agg(
        F.count(F.lit(1)).alias("distinct_tokens"), F.count_if("known").alias("distinct_covered"),
        F.sum("n").alias("occurrences"), F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0)).alias("occurrences_covered"))
    hits = marked.filter(known).select(*by, "sid").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("rows_hit"))
    joined = tokens.join(hits, by, "left") if by else tokens.withColumn("rows_hit", hits.scalar())
    return joined.withColumn("rows_hit", F.coalesce("rows_hit", F.lit(0))).withColumns({
        "distinct_coverage": F.col("distinct_covered") / F.col("distinct_tokens"),
        "occurrence_coverage": F.col("occurrences_covered") / F.col("occurrences"),
        "row_hit_rate": F.col("rows_hit") / n_apply})


def level_coverage(typed: DataFrame, folds: DataFrame, levels: list[str], floors: list[int], held: int = 0) -> DataFrame:
    """Coverage by token level and support floor; all levels and floors in one pass over the events."""
    tokens = F.explode(F.array(*[F.struct(F.lit(v).alias("level"), cells.token(v).alias("token")) for v in levels]))
    long = typed.select("sid", tokens.alias("x")).select("sid", "x.level", "x.token").filter(F.col("token").isNotNull())
    placed = long.join(folds.select("sid", (F.col("fold") == held).alias("held")), "sid")
    at = placed.groupBy("level", "token").agg(
        F.count_if(~F.col("held")).alias("fit_n"), F.count_if("held").alias("apply_n"))
    floor = F.explode(F.array(*[F.lit(f) for f in floors])).alias("floor")
    table = at.select("level", "token", "fit_n", "apply_n", floor)
    ok = F.col("fit_n") >= F.col("floor")
    return table.groupBy("level", "floor").agg(
        F.count_if(ok).alias("columns"), F.sum("apply_n").alias("occurrences"),
        F.coalesce(F.sum(F.when(ok, F.col("apply_n"))), F.lit(0)).alias("covered"),
    ).withColumn("occurrence_coverage", F.col("covered") / F.col("occurrences"))


#: The edges and names of segments; closed edges belong to the lower segment.
SEGMENT_EDGES = {
    "burden": ([0, 1, 2, 5, 10], ["0", "1", "2", "3-5", "6-10", "11+"], True),
    "ratio": ([1e-300, 0.25, 0.5], ["0", "0-0.25", "0.25-0.5", "0.5+"], False),
    "margin": ([0.05, 0.20], ["low", "mid", "high"], False),
}


def segment_of(value: Column, kind: str) -> Column:
    edges, names, closed = SEGMENT_EDGES[kind]
    return bucket(value, edges, names, closed)


def segments(rows: DataFrame, groupings: list[str]) -> DataFrame:
    """Each row once per grouping: (sid, truth, predictions.., grouping, grp)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(g).alias("grouping"), F.col(g).cast("string").alias("grp")) for g in groupings]))
    keep = [c for c in rows.columns if c not in groupings]
    return rows.select(*keep, pairs.alias("x")).select(*keep, "x.grouping", "x.grp")


def token_audit(tokens: DataFrame, folds: DataFrame, rare: int = 10) -> DataFrame:
    """(sid): active tokens and shares unseen or rare in the rows of the other folds; all folds in one pass."""
    placed = tokens.join(folds.select("sid", "fold"), "sid")
    own = placed.groupBy("token", "fold").agg(F.count(F.lit(1)).alias("k"))
    other = own.select("token", "fold", (F.sum("k").over(Window.partitionBy("token")) - F.col("k")).alias("s"))  # a row per fold
    return placed.join(other, ["token", "fold"]).groupBy("sid").agg(
        F.count(F.lit(1)).alias("active_tokens"), F.avg((F.col("s") == 0).cast("double")).alias("unseen_ratio"),
        F.avg((F.col("s") < rare).cast("double")).alias("rare_ratio"))


def class_profile(samples: DataFrame, small: float) -> DataFrame:
    """(cls): rows, share, ratio to the largest class, whether small."""
    counts = samples.groupBy(F.col("label").alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.struct(F.max("n").alias("m"), F.sum("n").alias("t"))).scalar()
    x = counts.withColumn("_t", top)
    return x.select("cls", "n", (F.col("n") / F.col("_t.t")).alias("share"), (F.col("_t.m") / F.col("n")).alias("imbalance"),
                    (F.col("n") / F.col("_t.t") < small).alias("is_small"))
