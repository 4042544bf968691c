"""Joins, crosstabs and summaries that carry a contract of their own."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphmill.operators.ranks import exact_quantiles


def join_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join that fails if a key repeats on either side."""
    for name, side in (("left", left), ("right", right)):
        repeated = side.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
        if repeated:
            raise ValueError(f"{name} side repeats key {repeated[0]}")
    return left.join(right, keys, how)


def lookup(rows: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """Keep rows whose key is known, with the vocabulary's columns."""
    return rows.join(vocabulary, key)


def stack(head: DataFrame, tail: DataFrame, split: str = "split") -> DataFrame:
    """Separately parsed tables on top of each other, marked by origin instead of offset row numbers."""
    return head.withColumn(split, F.lit("fit")).unionByName(tail.withColumn(split, F.lit("apply")))


def crosstab(df: DataFrame, row: str, column: str, domain: list[str]) -> DataFrame:
    """Counts over a fixed column domain; missing combinations are zero."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in domain])


def row_shares(table: DataFrame, columns: list[str]) -> DataFrame:
    total = sum((F.col(c) for c in columns), F.lit(0))
    keys = [c for c in table.columns if c not in columns]
    safe = F.nullif(total, F.lit(0).cast("bigint"))
    return table.select(*keys, *[F.coalesce(F.col(c) / safe, F.lit(0.0)).alias(c) for c in columns])


def describe(df: DataFrame, groups: list[str], value: str, key: Column, ties: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles, max per group; quartiles by distributed rank."""
    basic = df.groupBy(*groups).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).cast("double").alias("min"), F.max(value).cast("double").alias("max"))
    q = exact_quantiles(df, groups, value, [0.25, 0.5, 0.75], key, ties)
    wide = q.groupBy(*groups).agg(*[
        F.max(F.when(F.col("q") == v, F.col("value"))).alias(n) for v, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))])
    return basic.join(wide, groups)


def bucket(value: Column, edges: list[float], labels: list[str], closed: bool = True) -> Column:
    """Buckets: labels[i] for value <= edges[i] (below it unless ``closed``), the last label beyond."""
    out = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges, labels))):
        out = F.when(value <= edge if closed else value < edge, label).otherwise(out)
    return F.when(value.isNotNull(), out)


def best_per_family(df: DataFrame, family: str, order: list) -> DataFrame:
    w = Window.partitionBy(family).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def class_pairs(table: DataFrame, cls: str) -> DataFrame:
    """Ordered pairs i < j of a class-sized table, formed inside one short array."""
    packed = table.agg(F.array_sort(F.collect_list(F.struct(cls, *[c for c in table.columns if c != cls]))).alias("a"))
    x = packed.select("a", F.posexplode("a").alias("i", "x"))
    return x.select("x", F.explode(F.slice("a", F.col("i") + 2, F.size("a"))).alias("y"))
