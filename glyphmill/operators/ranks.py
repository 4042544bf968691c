"""Ranks and cumulative counts that never sort a whole group in one task.

``row_number() over (partition by label ...)`` puts every row of a label into one task, and a label may
hold a third of all rows.  Here rows first fall into many even buckets whose order agrees with the wanted
order; only the small table of bucket sizes is summed up, and rows are numbered inside a bucket.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

HASH_PREFIX = 3  # hex digits: 4,096 even buckets per group


def by_rows(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join of two tables that both grow with the rows: always a sort-merge join.

    Sizes are estimated from compressed files, and exploding rows is not counted, so a table with rows for millions of samples can look small
    enough to pass through the driver; adaptive execution keeps such a broadcast once it is planned, because the other join shuffles more.
    """
    return left.join(right.hint("merge"), keys, how)


def numbered_by_hash(df: DataFrame, groups: list[str], key: Column, ties: list[str], out: str = "rn") -> DataFrame:
    """1-based number of each row inside its group in md5 order of ``key``."""
    keyed = df.withColumn("_h", key).withColumn("_b", F.substring("_h", 1, HASH_PREFIX))
    sizes = keyed.groupBy(*groups, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*groups, "_b").orderBy("_h", *ties)
    return (
        by_rows(keyed, offsets, [*groups, "_b"])  # the window below needs the same shuffle
        .withColumn(out, F.row_number().over(inside) + F.col("_o"))
        .drop("_h", "_b", "_o")
    )


def group_sizes(df: DataFrame, groups: list[str], out: str = "n") -> DataFrame:
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias(out))


def hot_keys(sized: DataFrame, keys: list[str], rows: str, target: int = 200_000) -> DataFrame:
    """(*keys, _salts): the keys with more than ``target`` rows and how many tasks to deal each over."""
    return sized.filter(F.col(rows) > target).select(*keys, F.ceil(F.col(rows) / target).cast("int").alias("_salts"))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, spread: list[str]) -> DataFrame:
    """Inner equi-join in which rows of a hot key are spread over as many tasks as its size asks for.

    Only the right rows of hot keys are copied.  The list of hot keys has at most rows / target entries and is broadcast: a shuffled join with it
    would move all rows once more, by a key that they do not keep.
    """
    salts, hot = F.coalesce(F.col("_salts"), F.lit(1)), F.broadcast(hot)
    l2 = left.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), salts).cast("int")).drop("_salts")
    r2 = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return l2.join(r2, [*keys, "_salt"]).drop("_salt")


#: Bits of a filter, and of one of its rows (fixed by the function that builds bitmaps).
FILTER_BITS, FILTER_ROW = 1 << 24, 32_768


def maybe_among(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column`` may be among ``keys`` (one column, any repeats): all that are, and few others; rows with a null go.

    The filter is a bitmap of fixed size (2 MB), so it can be broadcast whatever the rows; nothing is shuffled by the key.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    found = keys.select(slot(F.col(keys.columns[0])).alias("_s"))
    maps = found.groupBy(F.floor(F.col("_s") / FILTER_ROW).alias("_row")).agg(F.bitmap_construct_agg(F.col("_s") % FILTER_ROW).alias("_map"))
    at = (F.col("_slot") % FILTER_ROW).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_map"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    placed = df.filter(F.col(column).isNotNull()).withColumn("_slot", slot(F.col(column))).withColumn("_row", F.floor(F.col("_slot") / FILTER_ROW))
    hit = F.call_function("shiftright", byte, at % 8).bitwiseAND(F.lit(1)) != 0
    return placed.join(F.broadcast(maps), "_row").filter(hit).select(*df.columns)


def numbered_by_value(df: DataFrame, value: str, key: Column, ties: list[str], out: str = "rn", buckets: int = 512,
                      groups: list[str] | None = None) -> DataFrame:
    """1-based number of each row (of its group) by ``value`` descending, equal values in md5 order of ``key``.

    Quantile edges make buckets of about equal row counts; inside a bucket distinct values are summed up,
    and a value shared by many rows is split further by hash.  The order is exact whatever the edges are.
    """
    from pyspark.ml.feature import Bucketizer

    groups = groups or []
    edges = sorted(set(df.approxQuantile(value, [i / buckets for i in range(1, buckets)], 0.001)))
    splits = [float("-inf"), *(edges or [0.0]), float("inf")]  # no rows, no edges
    keyed = Bucketizer(splits=splits, inputCol=value, outputCol="_b", handleInvalid="keep").transform(
        df.withColumn("_h", key)).withColumn("_s", F.substring("_h", 1, HASH_PREFIX))
    parts = keyed.groupBy(*groups, "_b", value, "_s").agg(F.count(F.lit(1)).alias("_n"))
    outer = groups or [F.lit(0)]
    before = Window.partitionBy(*outer).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy(*groups, "_b").agg(F.sum("_n").alias("_t")).select(
        *groups, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o1"))
    within = Window.partitionBy(*groups, "_b").orderBy(F.desc(value), "_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_rows(parts, starts, [*groups, "_b"]).select(
        *groups, value, "_s", (F.col("_o1") + F.coalesce(F.sum("_n").over(within), F.lit(0))).alias("_o"))
    inside = Window.partitionBy(*groups, value, "_s").orderBy("_h", *ties)
    return by_rows(keyed, offsets, [*groups, value, "_s"]).withColumn(out, F.row_number().over(inside) + F.col("_o")).drop(
        "_h", "_b", "_s", "_o")


def exact_quantiles(df: DataFrame, groups: list[str], value: str, qs: list[float], key: Column, ties: list[str]) -> DataFrame:
    """(*groups, q, value): linearly interpolated quantiles without gathering a group's values anywhere."""
    x = df.filter(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("double"))
    numbered = numbered_by_value(x, value, key, ties, groups=groups)
    sizes = group_sizes(x, groups)
    wanted = F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q")
    targets = sizes.select(*groups, "n", wanted).withColumn("_at", (F.col("n") - 1) * F.col("q")).withColumn(
        "_low", F.floor("_at"))
    # rows are numbered downwards: the k-th smallest (0-based) has number n - k
    places = targets.withColumn("_k", F.explode(F.array(F.col("_low"), F.least(F.col("_low") + 1, F.col("n") - 1)))).select(
        *groups, "q", "_at", "_low", "_k", (F.col("n") - F.col("_k")).alias("rn")).distinct()
    hit = numbered.select(*groups, "rn", F.col(value).alias("_v")).join(places, [*groups, "rn"])
    low = F.max(F.when(F.col("_k") == F.col("_low"), F.col("_v")))
    high = F.max("_v")
    share = F.max(F.col("_at") - F.col("_low"))
    return hit.groupBy(*groups, "q").agg((low + (high - low) * share).alias("value"))
