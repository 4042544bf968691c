import numpy as np
from pyspark.sql import functions as F

from glyphmill.functions.hashing import md5_key
from glyphmill.operators import folds as fo, ranks


def test_hash_numbers_match_a_window(spark):
    df = spark.range(3000).select(F.col("id").alias("sid"), F.when(F.col("id") % 10 < 7, "hot").otherwise("rare").alias("label"))
    got = ranks.numbered_by_hash(df, ["label"], md5_key(1, F.col("sid")), ["sid"])
    from pyspark.sql import Window
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy(md5_key(1, F.col("sid")), "sid")))
    assert got.select("sid", "rn").exceptAll(want.select("sid", "rn")).count() == 0
    folds = fo.stratified_folds(df)
    spread = folds.groupBy("label", "fold").count().groupBy("label").agg(F.max("count") - F.min("count")).collect()
    assert all(r[1] <= 1 for r in spread)


def test_value_numbers_with_heavy_ties(spark):
    df = spark.range(2000).select(
        F.col("id").alias("sid"), F.when(F.col("id") % 3 == 0, 0.5).otherwise((F.col("id") * 37 % 997) / 997.0).alias("v"))
    got = ranks.numbered_by_value(df, "v", F.md5(F.col("sid").cast("string")), ["sid"], buckets=16)
    rows = got.orderBy("rn").collect()
    assert [r.rn for r in rows] == list(range(1, 2001))
    values = [r.v for r in rows]
    assert values == sorted(values, reverse=True)


def test_exact_quantiles(spark):
    df = spark.range(501).select(F.col("id").alias("sid"), (F.col("id") % 2).alias("g"), (F.col("id") * 7 % 113).cast("double").alias("v"))
    got = {(r.g, r.q): r.value for r in ranks.exact_quantiles(df, ["g"], "v", [0.1, 0.5, 0.9], F.md5(F.col("sid").cast("string")), ["sid"]).collect()}
    for g in (0, 1):
        values = [i * 7 % 113 for i in range(501) if i % 2 == g]
        for q in (0.1, 0.5, 0.9):
            assert abs(got[g, q] - np.quantile(values, q)) < 1e-9


def test_salted_join_equals_join(spark):
    left = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 700, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    right = left.select("k").distinct().withColumn("w", F.length("k"))
    hot = ranks.hot_keys(left.groupBy("k").count(), ["k"], "count", target=100)
    assert [r.k for r in hot.collect()] == ["hot"]
    got = ranks.salted_join(left, right, ["k"], hot, ["id"])
    assert got.select("id", "k", "w").exceptAll(left.join(right, "k").select("id", "k", "w")).count() == 0
    assert got.count() == 1000


def test_permutation_keeps_label_counts(spark):
    df = spark.range(500).select(F.col("id").alias("sid"), (F.col("id") % 5).cast("string").alias("label"))
    got = fo.permute_labels(df, 3)
    assert got.groupBy("label").count().filter("count <> 100").count() == 0
    assert got.join(df.withColumnRenamed("label", "old"), "sid").filter("label = old").count() < 250


def test_numbering_takes_no_rows_and_nan(spark):
    none = spark.createDataFrame([], "sid long, v double")
    assert ranks.numbered_by_value(none, "v", F.md5(F.col("sid").cast("string")), ["sid"]).count() == 0
    some = spark.createDataFrame([(1, 2.0), (2, float("nan")), (3, 1.0)], "sid long, v double")
    got = {r.sid: r.rn for r in ranks.numbered_by_value(some, "v", F.md5(F.col("sid").cast("string")), ["sid"]).collect()}
    assert got == {2: 1, 1: 2, 3: 3}
