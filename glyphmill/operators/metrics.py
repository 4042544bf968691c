"""Classification metrics as aggregates over predictions or long probability tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def ranked_rows(prob: DataFrame, keys: list[str]) -> DataFrame:
    """One row per ``keys`` with its classes from most to least probable (lowest class on ties).

    The array has one entry per class, so it is bounded; top-1, top-2, entropy and the rank of the truth all
    come out of one aggregate.
    """
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("np"), "cls"))).alias("ranked")
    return prob.groupBy(*keys).agg(ordered)


def top1(ranked: str = "ranked") -> Column:
    return F.col(ranked)[0]["cls"]


def p_at(i: int, ranked: str = "ranked") -> Column:
    return -F.get(ranked, F.lit(i))["np"]


def row_entropy(ranked: str = "ranked") -> Column:
    return F.aggregate(
        ranked, F.lit(0.0), lambda acc, x: acc + F.when(x["np"] < 0, x["np"] * F.log(-x["np"])).otherwise(F.lit(0.0)))


def truth_rank(label: Column, ranked: str = "ranked") -> Column:
    """0-based place of the true class."""
    return F.array_position(F.transform(ranked, lambda x: x["cls"]), label) - 1


def predictions(prob: DataFrame, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(*keys, truth, pred): argmax with the lowest class on ties, a mergeable minimum."""
    best = F.min(F.struct((-F.col("p")).alias("np"), "cls"))
    return prob.groupBy(*keys).agg(F.first("label").alias("truth"), best.alias("_b")).select(
        *keys, "truth", F.col("_b.cls").alias("pred"))


def confusion(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    return pred.groupBy(*(by or []), "truth", "pred").agg(F.count(F.lit(1)).alias("n"))


def per_class(cm: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, cls): tp, support, predicted, precision, recall, f1; classes are those seen as truth or prediction."""
    by = by or []
    sides = F.explode(F.array(
        F.struct(F.col("truth").alias("cls"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("q"),
                 F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("q"),
                 F.lit(0).cast("bigint").alias("tp"))))
    x = cm.select(*by, sides.alias("x")).groupBy(*by, "x.cls").agg(
        F.sum("x.tp").alias("tp"), F.sum("x.t").alias("support"), F.sum("x.q").alias("predicted"))
    tp = F.col("tp")
    return x.withColumns({
        "precision": F.coalesce(tp / F.nullif(F.col("predicted"), F.lit(0)), F.lit(0.0)),
        "recall": F.coalesce(tp / F.nullif(F.col("support"), F.lit(0)), F.lit(0.0)),
        "f1": 2 * tp / (F.col("support") + F.col("predicted")),
    })


def overall(cm: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by): accuracy and macro F1."""
    pc = per_class(cm, by)
    return pc.groupBy(*(by or [])).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), F.sum("support").alias("n"))


def macro_f1(pred: DataFrame, by: list[str]) -> DataFrame:
    return overall(confusion(pred, by), by).select(*by, "macro_f1")


def seed_holdout(scores: DataFrame) -> DataFrame:
    """Per held-out seed the weight with the best mean F1 over the other seeds, and what it gives on the held-out one.

    scores: (seed, weight, macro_f1) -- seeds x grid rows.
    """
    from pyspark.sql import Window

    over = Window.partitionBy("weight")
    others = (F.sum("macro_f1").over(over) - F.col("macro_f1")) / (F.count(F.lit(1)).over(over) - 1)
    x = scores.withColumn("mean_f1", F.round(others, 9))
    pick = Window.partitionBy("seed").orderBy(F.desc("mean_f1"), "weight")
    base = scores.filter("weight = 0").select("seed", F.col("macro_f1").alias("baseline_f1"))
    best = x.withColumn("_rn", F.row_number().over(pick)).filter("_rn = 1").join(base, "seed")
    return best.select(
        F.col("seed").alias("held_seed"), "weight", F.round("baseline_f1", 6).alias("baseline_f1"),
        F.round("macro_f1", 6).alias("selected_f1"), F.round(F.col("macro_f1") - F.col("baseline_f1"), 6).alias("delta"))


def pair_comparison(pred: DataFrame, classes: list[str]) -> DataFrame:
    """(class_a, class_b): F1 change, recovered, broken and rows among samples whose truth is in the pair.

    pred: (sid, truth, pa, pb).  Counted once per (truth, pa, pb); class pairs are formed on that small table.
    """
    counts = pred.groupBy("truth", "pa", "pb").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.explode(F.array(*[
        F.struct(F.lit(a).alias("class_a"), F.lit(b).alias("class_b")) for i, a in enumerate(classes) for b in classes[i + 1:]]))
    x = counts.select("*", pairs.alias("q")).select("*", "q.class_a", "q.class_b").filter(
        (F.col("truth") == F.col("class_a")) | (F.col("truth") == F.col("class_b")))

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    def f1(side: str, cls: str) -> Column:
        c = F.col(cls)
        hit, t, q = total((F.col("truth") == c) & (F.col(side) == c)), total(F.col("truth") == c), total(F.col(side) == c)
        return F.coalesce(2 * hit / F.nullif(t + q, F.lit(0).cast("bigint")), F.lit(0.0))

    mean_b, mean_a = ((f1(s, "class_a") + f1(s, "class_b")) / 2 for s in ("pb", "pa"))
    right_a, right_b = F.col("pa") == F.col("truth"), F.col("pb") == F.col("truth")
    return x.groupBy("class_a", "class_b").agg(
        (mean_b - mean_a).alias("delta"), total(~right_a & right_b).alias("recovered"), total(right_a & ~right_b).alias("broken"),
        F.sum("n").alias("n_rows"))


# Ranks of the truth ---------------------------------------------------------------------------


def row_summary(prob: DataFrame, keys: tuple[str, ...] = ("sid", "label")) -> DataFrame:
    """(keys): top-1 class and probability, margin, entropy and 0-based rank of the truth."""
    r = ranked_rows(prob, list(keys))
    return r.select(
        *keys, top1().alias("pred"), p_at(0).alias("p1"), (p_at(0) - p_at(1)).alias("margin"),
        row_entropy().alias("entropy"), truth_rank(F.col("label")).alias("rank"))


def top_k_accuracy(summary: DataFrame, ks: list[int]) -> DataFrame:
    """(k): accuracy, macro recall and macro F1 of an oracle that is right within the first k."""
    points = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    x = summary.select("sid", F.col("label").alias("truth"), "pred", "rank", points)
    hit = F.col("rank") < F.col("k")
    recall = x.groupBy("k", "truth").agg(F.avg(hit.cast("double")).alias("r"), F.count_if(hit).alias("h"), F.count(F.lit(1)).alias("n"))
    basic = recall.groupBy("k").agg((F.sum("h") / F.sum("n")).alias("accuracy"), F.avg("r").alias("macro_recall"))
    oracle = x.withColumn("pred", F.when(hit, F.col("truth")).otherwise(F.col("pred")))
    f1 = overall(confusion(oracle, ["k"]), ["k"]).select("k", F.col("macro_f1").alias("oracle_macro_f1"))
    return basic.join(f1, "k")


def coverage_curve(ranked: DataFrame, levels: list[float]) -> DataFrame:
    """(coverage): accuracy and least confidence of the most confident share of rows.

    ranked: (rn, correct, confidence).  Rows are summed between consecutive cuts; only the few cuts are
    accumulated.
    """
    from pyspark.sql import Window

    n = ranked.agg(F.count(F.lit(1))).scalar()
    x = ranked.withColumn("_n", n)
    cuts = [F.greatest(F.floor(F.col("_n") * level + 0.5), F.lit(1)) for level in levels]
    step = F.lit(None).cast("int")
    for i in reversed(range(len(levels))):
        step = F.when(F.col("rn") <= cuts[i], i).otherwise(step)
    sums = x.select(step.alias("i"), "correct", "confidence").filter("i is not null").groupBy("i").agg(
        F.count(F.lit(1)).alias("k"), F.sum(F.col("correct").cast("bigint")).alias("c"), F.min("confidence").alias("m"))
    upto = Window.partitionBy(F.lit(0)).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # one row per level
    return sums.select(
        F.get(F.array(*[F.lit(v) for v in levels]), F.col("i")).alias("coverage"), F.sum("k").over(upto).alias("n_rows"),
        (F.sum("c").over(upto) / F.sum("k").over(upto)).alias("accuracy"), F.min("m").over(upto).alias("min_confidence"))


# Two models -----------------------------------------------------------------------------------


def diversity(pred: DataFrame, truth: str = "truth", base: str = "pa", other: str = "pb") -> DataFrame:
    """One row: disagreement, recovery, reverse loss, double fault and oracle macro F1 of two predictions."""
    ok_a, ok_b = F.col(base) == F.col(truth), F.col(other) == F.col(truth)
    n = F.count(F.lit(1))
    counts = pred.agg(
        (F.count_if(F.col(base) != F.col(other)) / n).alias("disagreement"),
        (F.count_if(~ok_a & ok_b) / F.greatest(F.count_if(~ok_a), F.lit(1))).alias("recovery_rate"),
        (F.count_if(ok_a & ~ok_b) / F.greatest(F.count_if(ok_a), F.lit(1))).alias("reverse_loss_rate"),
        (F.count_if(~ok_a & ~ok_b) / n).alias("double_fault"),
        F.count_if(~ok_a & ok_b).alias("recovered"), F.count_if(ok_a & ~ok_b).alias("damaged"),
        (F.count_if(~ok_a & ok_b) - F.count_if(ok_a & ~ok_b)).alias("net"))
    oracle = pred.select("sid", F.col(truth).alias("truth"), F.when(ok_b, F.col(other)).otherwise(F.col(base)).alias("pred"))
    return counts.withColumn("oracle_macro_f1", overall(confusion(oracle)).select("macro_f1").scalar())


def agreement(preds: list[Column]) -> Column:
    """Size of the largest group of equal predictions in a row."""
    array = F.array(*preds)
    return F.array_max(F.transform(array, lambda x: F.size(F.filter(array, lambda y: y == x))))


def transition(before: Column, after: Column, truth: Column) -> Column:
    a, b = before == truth, after == truth
    return F.when(~a & b, "recovered").when(a & ~b, "broken").when(a & b, "both_correct").otherwise("both_wrong")


def diagnosis(precision: Column, recall: Column, f1: Column, good: float = 0.50, gap: float = 0.10) -> Column:
    d = recall - precision
    return F.when(f1 >= good, "good").when(d > gap, "over_predicted").when(d < -gap, "missed").otherwise("balanced_weak")


def acceptance(all_positive: Column, mean_delta: Column, least_delta: Column, positive_folds: Column, class_floor: Column,
               mean_floor: float = 0.010, least_floor: float = 0.005, folds_floor: int = 11, class_limit: float = -0.05) -> Column:
    return (all_positive & (mean_delta >= mean_floor) & (least_delta >= least_floor) & (positive_folds >= folds_floor)
            & (class_floor >= class_limit))


def verdict(delta: Column, positive_folds: Column, matched_rate: Column, recovered: Column, broken: Column) -> Column:
    """Tiered outcome of a candidate against its baseline."""
    return (
        F.when((delta >= 0.015) & (positive_folds >= 4) & (matched_rate >= 0.05) & (recovered > broken), "strong_candidate")
        .when((delta >= 0.005) & (positive_folds >= 3) & (recovered > broken), "candidate")
        .when(delta > 0, "not_detected").otherwise("rejected"))


#: Weights (a row of one number per class) that may be broadcast.
FEW_WEIGHTS = 50_000


def permutation_null(tokens: DataFrame, samples: DataFrame, classes: list[str], formula, seeds: list[int], k: int = 5) -> DataFrame:
    """(perm, macro_f1, accuracy, p_value) of a cross-fitted token scorer: perm 0 on the labels, the others on shuffled ones.

    Folds are stratified anew for each permutation, and all permutations are counted and scored in the same jobs.  p_value is the share of scorers,
    the real one included, that reach a permutation's macro F1.
    """
    from glyphmill.operators import folds as fo, weights as we
    from glyphmill.session import cut_lineage

    placed = cut_lineage(fo.stratified_folds(fo.permuted_samples(samples, seeds), k, by=["perm"]).select("perm", "sid", "label", "fold"))
    weighted = cut_lineage(we.weigh(we.supported(we.cross_fit_counts(tokens, placed, classes, outer=["perm"]), 10), formula))
    few = weighted.count() <= FEW_WEIGHTS
    rows = tokens.join(placed.select("perm", "sid", "fold"), "sid")
    scores = we.score_tokens(rows, weighted, classes, ["perm", "fold", "token"], ["perm", "sid", "fold"], every=placed, few=few)
    p = scores.select("perm", "sid", "cls", F.round("score", 9).alias("p")).join(placed.select("perm", "sid", "label"), ["perm", "sid"])
    got = cut_lineage(overall(confusion(predictions(p, ("perm", "sid")), ["perm"]), ["perm"]).select("perm", "macro_f1", "accuracy"))
    every = got.agg(F.collect_list(F.round("macro_f1", 12))).scalar()  # a number per permutation
    reached = got.withColumns({"_own": F.round("macro_f1", 12), "_all": every})
    share = F.size(F.filter("_all", lambda f: f >= F.col("_own"))) / F.size("_all")
    return reached.select("perm", "macro_f1", "accuracy", share.alias("p_value"))
