"""Fold assignment, holdouts, permutations and fold contracts."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glyphmill.functions.hashing import md5_key
from glyphmill.operators.ranks import by_rows, group_sizes, numbered_by_hash


def stratified_folds(samples: DataFrame, k: int = 5, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """fold = (place in the label's md5 order) mod k; per-class fold sizes differ by at most one."""
    numbered = numbered_by_hash(samples, [*(by or []), "label"], md5_key(seed, F.col("sid")), ["sid"])
    return numbered.withColumn("fold", ((F.col("rn") - 1) % k).cast("int")).drop("rn")


def repeated_folds(samples: DataFrame, seeds: list[int], k: int = 5) -> DataFrame:
    """One fold column per (seed, sample), all seeds in one pass."""
    many = samples.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    numbered = numbered_by_hash(many, ["seed", "label"], md5_key(F.col("seed"), F.col("sid")), ["sid"])
    return numbered.withColumn("fold", ((F.col("rn") - 1) % k).cast("int")).drop("rn")


def nested_folds(folds: DataFrame, outer_k: int = 5, inner_k: int = 5, seed: int = 42) -> DataFrame:
    """(outer_fold, sid) -> inner_fold for the rows outside the outer fold."""
    others = F.array_except(F.array(*[F.lit(f) for f in range(outer_k)]), F.array("fold"))
    many = folds.withColumn("outer_fold", F.explode(others)).drop("fold")
    numbered = numbered_by_hash(many, ["outer_fold", "label"], md5_key("inner", seed, F.col("sid")), ["sid"])
    return numbered.withColumn("inner_fold", ((F.col("rn") - 1) % inner_k).cast("int")).drop("rn")


def stratified_holdout(samples: DataFrame, share: float = 0.25, seed: int = 42) -> DataFrame:
    """The first round(share * n) rows of each label in md5 order are held out."""
    numbered = numbered_by_hash(samples, ["label"], md5_key(seed, F.col("sid")), ["sid"])
    sizes = group_sizes(samples, ["label"])
    cut = F.floor(F.col("n") * share + 0.5)
    return numbered.join(sizes, "label").withColumn("held_out", F.col("rn") <= cut).drop("rn", "n")


def stratified_sample(samples: DataFrame, per_class: int, seed: int = 42) -> DataFrame:
    """n rows per label, seeded; the rank filter keeps n rows per task before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy(md5_key(seed, F.col("sid")), "sid")
    return samples.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= per_class).drop("_rn")


def mask_cells(cells: DataFrame, rate: float, seed: int, fit_only=None) -> DataFrame:
    """Set a seeded share of the fit rows' cells to null."""
    from glyphmill.functions.hashing import md5_int

    draw = md5_int(F.concat_ws(":", F.lit(str(seed)), F.col("sid").cast("string"), F.col("gene"))) % 1_000_000
    hit = draw < int(rate * 1_000_000)
    hit = hit if fit_only is None else (hit & fit_only)
    return cells.withColumn("cell", F.when(hit, F.lit(None).cast("string")).otherwise(F.col("cell")))


def permute_labels(samples: DataFrame, seed: int) -> DataFrame:
    """Seeded permutation: the i-th sample in one md5 order gets the label of the i-th in another."""
    left = numbered_by_hash(samples.select("sid"), [], md5_key(seed, "rows", F.col("sid")), ["sid"])
    right = numbered_by_hash(samples, [], md5_key(seed, "labels", F.col("sid")), ["sid"]).select("rn", "label")
    return by_rows(left, right, ["rn"]).select("sid", "label")


def permuted_samples(samples: DataFrame, seeds: list[int]) -> DataFrame:
    """(perm, sid, label): the samples under each seeded permutation of their labels, all in one pass; perm 0 has the labels as they are."""
    many = samples.withColumn("perm", F.explode(F.array(*[F.lit(s) for s in seeds])))
    left = numbered_by_hash(many.select("perm", "sid"), ["perm"], md5_key(F.col("perm"), "rows", F.col("sid")), ["sid"])
    right = numbered_by_hash(many, ["perm"], md5_key(F.col("perm"), "labels", F.col("sid")), ["sid"]).select("perm", "rn", "label")
    return samples.select(F.lit(0).alias("perm"), "sid", "label").unionByName(by_rows(left, right, ["perm", "rn"]).select("perm", "sid", "label"))


def fold_contract(fit: DataFrame, valid: DataFrame, train: DataFrame) -> DataFrame:
    """One row of counters: fit outside train, fit inside valid, train rows without a fold."""
    tagged = (
        fit.select("sid", F.lit(1).alias("f"), F.lit(0).alias("v"), F.lit(0).alias("t"))
        .unionByName(valid.select("sid", F.lit(0).alias("f"), F.lit(1).alias("v"), F.lit(0).alias("t")))
        .unionByName(train.select("sid", F.lit(0).alias("f"), F.lit(0).alias("v"), F.lit(1).alias("t")))
    )
    flags = tagged.groupBy("sid").agg(*[F.max(c).alias(c) for c in "fvt"])
    return flags.agg(
        F.count_if((F.col("f") == 1) & (F.col("t") == 0)).alias("fit_outside_train"),
        F.count_if((F.col("f") == 1) & (F.col("v") == 1)).alias("fit_in_valid"),
        F.count_if((F.col("t") == 1) & (F.col("f") == 0) & (F.col("v") == 0)).alias("train_uncovered"),
        F.count_if(F.col("f") == 1).alias("fit_rows"),
        F.count_if(F.col("v") == 1).alias("valid_rows"),
    )
