"""Class-probability tables.

Blending, gating, redistribution and calibration all look at one row's few class probabilities, so the
working form is one row per sample with one array per model variant (class order fixed).  One aggregate
builds it; after that every operator here is a row-local expression and needs no further shuffle.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from glyphmill.operators import metrics as me
from glyphmill.operators.ranks import by_rows
from glyphmill.operators.relational import bucket
from glyphmill.operators.similarity import disjoint_pairs
from glyphmill.session import cut_lineage


def rows_of(prob: DataFrame, variants: list[str], classes: list[str], keys: tuple[str, ...] = ("sid", "label")) -> DataFrame:
    """Long (keys, variant, cls, p) -> one row per keys, one array per variant; a missing class counts as zero."""
    columns = [
        F.array(*[
            F.coalesce(F.max(F.when((F.col("variant") == v) & (F.col("cls") == c), F.col("p"))), F.lit(0.0))
            for c in classes
        ]).alias(v)
        for v in variants
    ]
    return prob.groupBy(*keys).agg(*columns)


def to_long(rows: DataFrame, array: Column, classes: list[str], keys: tuple[str, ...] = ("sid",), name: str = "p") -> DataFrame:
    pairs = F.arrays_zip(F.array(*[F.lit(c) for c in classes]).alias("cls"), array.alias("p"))
    return rows.select(*keys, F.explode(pairs).alias("x")).select(*keys, F.col("x.cls").alias("cls"), F.col("x.p").alias(name))


# Row-local expressions ------------------------------------------------------------------------


def argmax_index(array: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(array, F.array_max(array)) - 1).cast("int")


def argmax_class(array: Column, classes: list[str]) -> Column:
    return F.get(F.array(*[F.lit(c) for c in classes]), argmax_index(array))


def margin(array: Column) -> Column:
    ordered = F.sort_array(array, asc=False)
    return ordered[0] - ordered[1]


def entropy(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log(p)).otherwise(0.0))


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, p: a + p)


def normalise(array: Column) -> Column:
    s = total(array)
    return F.transform(array, lambda p: p / s)


def blend(parts: list[tuple[Column, object]]) -> Column:
    """Weighted sum of arrays, in the order given."""

    def scaled_by(array: Column, w) -> Column:
        return F.transform(array, lambda p: p * w)

    scaled = [scaled_by(a, w) for a, w in parts]
    return reduce(lambda x, y: F.zip_with(x, y, lambda p, q: p + q), scaled)


def gate(fallback: Column, main: Column, threshold: float = 0.05) -> Column:
    """The fallback where the main model's margin is below the threshold."""
    return F.when(margin(main) < threshold, fallback).otherwise(main)


def in_pair(array: Column, classes: list[str], pair: tuple[str, str]) -> Column:
    return argmax_class(array, classes).isin(*pair)


def route(array: Column, classes: list[str], pair: tuple[str, str], how: str, threshold: float | None = None,
          least_mass: float = 0.20, most_confident: float = 0.85) -> Column:
    """Rows a pair specialist is asked about."""
    i, j = classes.index(pair[0]), classes.index(pair[1])
    mass = array[i] + array[j]
    if how == "hard":
        return in_pair(array, classes, pair)
    if how == "pair_margin":
        gap = F.coalesce(F.abs(array[i] - array[j]) / F.nullif(mass, F.lit(0.0)), F.lit(1.0))
        return in_pair(array, classes, pair) & (gap <= threshold)
    if how == "global_margin":
        return in_pair(array, classes, pair) & (margin(array) <= threshold)
    if how == "top_two":
        others = F.filter(array, lambda p, k: (k != i) & (k != j))
        return F.least(array[i], array[j]) > F.array_max(others)
    if how == "mass":
        confident = F.coalesce(F.greatest(array[i], array[j]) / F.nullif(mass, F.lit(0.0)), F.lit(0.0))
        return (mass >= least_mass) & (confident <= most_confident)
    raise ValueError(f"unknown routing {how}")


def redistribute_pair(array: Column, classes: list[str], pair: tuple[str, str], specialist: Column, mode: str = "hard",
                      alpha: float = 1.0, routed: Column | None = None) -> Column:
    """Split the pair's mass anew; ``specialist`` is the share of the first class.

    hard: the specialist's share; soft: a fixed mix; soft_mass: a mix weighted by the pair's mass.
    """
    i, j = classes.index(pair[0]), classes.index(pair[1])
    mass = array[i] + array[j]
    own = F.coalesce(array[i] / F.nullif(mass, F.lit(0.0)), F.lit(0.5))
    if mode == "hard":
        share = specialist
    elif mode == "soft":
        share = own * (1.0 - alpha) + specialist * alpha
    elif mode == "soft_mass":
        share = own * (1.0 - mass * alpha) + specialist * (mass * alpha)
    else:
        raise ValueError(f"unknown mode {mode}")
    new = F.transform(array, lambda p, k: F.when(k == i, mass * share).when(k == j, mass * (1.0 - share)).otherwise(p))
    return new if routed is None else F.when(routed, new).otherwise(array)


def redistribute_group(array: Column, classes: list[str], group: list[str], specialist: Column) -> Column:
    """Split the group's mass by a specialist over the same class order, renormalised inside the group."""
    inside = [classes.index(c) for c in group]
    mass = reduce(Column.__add__, [array[k] for k in inside])
    weight = reduce(Column.__add__, [specialist[k] for k in inside])
    return F.zip_with(
        F.transform(array, lambda p, k: F.struct(p.alias("p"), k.isin(inside).alias("in"))), specialist,
        lambda x, q: F.when(x["in"], mass * (q / weight)).otherwise(x["p"]))


def softmax(array: Column) -> Column:
    top = F.array_max(array)
    return normalise(F.transform(array, lambda z: F.exp(z - top)))


def correct_residual(array: Column, residual: Column, strength: float) -> Column:
    """Softmax of log probability plus a scaled residual."""
    return softmax(F.zip_with(array, residual, lambda p, r: F.log(F.greatest(p, F.lit(1e-12))) + r * strength))


def scale_classes(array: Column, weights: Column) -> Column:
    return F.zip_with(array, weights, lambda p, w: p * w)


def mass_weights(rows: DataFrame, array: str, classes: list[str], alpha: float, low: float = 0.80, high: float = 1.25) -> DataFrame:
    """One row: per class (true share / mean predicted share)^alpha, clipped."""
    out = []
    for i, c in enumerate(classes):
        true = F.count_if(F.col("label") == c) / F.count(F.lit(1))
        ratio = F.coalesce(true / F.nullif(F.avg(F.col(array)[i]), F.lit(0.0)), F.lit(1.0))
        out.append(F.least(F.greatest(F.pow(ratio, F.lit(alpha)), F.lit(low)), F.lit(high)))
    return rows.agg(F.array(*out).alias("weights"))


def two_level(groups: Column, member: Column, group_classes: list[str], classes: list[str], members: dict[str, list[str]]) -> Column:
    """Predicted class: the best group, then the best member of it by the second table."""
    best = argmax_class(groups, group_classes)
    out = best
    for name, inside in members.items():
        index = [classes.index(c) for c in inside]
        local = F.array(*[member[k] for k in index])
        out = F.when(best == name, argmax_class(local, inside)).otherwise(out)
    return out


# Weight grids ---------------------------------------------------------------------------------


def compositions(units: int, parts: int) -> list[tuple[int, ...]]:
    """All ways to hand out ``units`` equal shares to ``parts`` models."""
    if parts == 1:
        return [(units,)]
    return [(k, *rest) for k in range(units + 1) for rest in compositions(units - k, parts - 1)]


def grid_predictions(rows: DataFrame, variants: list[str], grid: list[tuple[float, ...]], classes: list[str],
                     keep: tuple[str, ...] = ("sid", "label")) -> DataFrame:
    """One row per (row, grid point): prediction of the weighted blend; no class row is ever multiplied."""
    points = [
        F.struct(
            *[F.lit(float(w)).alias(f"w_{v}") for v, w in zip(variants, weights)],
            argmax_class(blend([(F.col(v), float(w)) for v, w in zip(variants, weights)]), classes).alias("pred"))
        for weights in grid
    ]
    names = [f"w_{v}" for v in variants]
    x = rows.select(*keep, F.explode(F.array(*points)).alias("x"))
    return x.select(*[F.col(k) for k in keep if k != "label"], F.col("label").alias("truth"),
                    *[F.col(f"x.{n}").alias(n) for n in names], F.col("x.pred").alias("pred"))


def grid_scores(predicted: DataFrame, by: list[str]) -> DataFrame:
    return me.overall(me.confusion(predicted, by), by)


def left_out_weights(rows: DataFrame, base: str, extra: str, grid: list[float], classes: list[str], part: str = "fold") -> DataFrame:
    """(part, weight): the extra model's weight that is best on all rows outside the part.

    Counts per (part, weight, truth, pred) are taken once; a part's training counts are total minus own.
    Ties go to the smaller weight; zero is always in the grid.
    """
    points = sorted({0.0, *grid})
    predicted = grid_predictions(rows, [base, extra], [(1 - w, w) for w in points], classes, ("sid", "label", part))
    weight = F.col(f"w_{extra}").alias("weight")
    counts = predicted.groupBy(part, weight, "truth", "pred").agg(F.count(F.lit(1)).alias("n"))
    parts = counts.select(part).distinct()
    total_counts = counts.groupBy("weight", "truth", "pred").agg(F.sum("n").alias("all_n"))
    every = total_counts.withColumn("_parts", parts.agg(F.collect_set(part)).scalar()).withColumn(
        part, F.explode("_parts")).drop("_parts")
    rest = every.join(counts, [part, "weight", "truth", "pred"], "left").withColumn(
        "n", F.col("all_n") - F.coalesce("n", F.lit(0))).filter("n > 0")
    scored = me.overall(rest, [part, "weight"])
    best = F.min(F.struct((-F.round("macro_f1", 9)).alias("s"), "weight"))
    return scored.groupBy(part).agg(best.alias("b")).select(part, F.col("b.weight").alias("weight"))


def local_blend(rows: DataFrame, base: str, extra: str, grid: list[float], classes: list[str], out: str, part: str = "fold") -> DataFrame:
    """Adds ``out``: each part blended with the weight picked on the others."""
    chosen = left_out_weights(rows, base, extra, grid, classes, part)
    joined = rows.join(chosen, part)
    mixed = F.zip_with(base, extra, lambda p, q: p * (1 - F.col("weight")) + q * F.col("weight"))
    return joined.withColumn(out, mixed).withColumnRenamed("weight", f"{out}_weight")


def staged_blend(rows: DataFrame, base: str, extras: list[str], grid: list[float], classes: list[str], part: str = "fold") -> DataFrame:
    """Blend the extras in one after the other, each with fold-local weights: adds base+1, base+1+2, ...

    A stage's rows are checkpointed: the next stage reads them twice (to pick weights and to blend).
    """
    current = base
    for extra in extras:
        out = f"{current}+{extra}"
        if out not in rows.columns:
            rows = cut_lineage(local_blend(rows, current, extra, grid, classes, out, part).drop(f"{out}_weight"))
        current = out
    return rows


def _extended(rows: DataFrame, stages: dict[tuple, str], extras: list[str], grid: list[float], classes: list[str], part: str) -> tuple[DataFrame, dict[tuple, str]]:
    """Every stage blended with every extra that it does not have yet: the weights of all of them are picked in one pass over the rows."""
    points = sorted({0.0, *grid})
    steps = [(path, extra) for path in stages for extra in extras if extra not in path]
    mixed = [F.struct(F.lit(i).alias("step"), F.lit(w).alias("weight"), argmax_class(blend([(F.col(f"`{stages[path]}`"), 1 - w), (F.col(extra), w)]), classes).alias("pred"))
             for i, (path, extra) in enumerate(steps) for w in points]
    counts = cut_lineage(rows.select(part, F.col("label").alias("truth"), F.explode(F.array(*mixed)).alias("x")).groupBy(part, "x.step", "x.weight", "truth", "x.pred").agg(F.count(F.lit(1)).alias("n")))
    whole = counts.groupBy("step", "weight", "truth", "pred").agg(F.sum("n").alias("all_n"))
    every = whole.withColumn("_parts", counts.agg(F.collect_set(part)).scalar()).withColumn(part, F.explode("_parts")).drop("_parts")
    rest = every.join(counts, [part, "step", "weight", "truth", "pred"], "left").withColumn("n", F.col("all_n") - F.coalesce("n", F.lit(0))).filter("n > 0")
    best = me.overall(rest, [part, "step", "weight"]).groupBy(part, "step").agg(F.min(F.struct((-F.round("macro_f1", 9)).alias("s"), "weight"))["weight"].alias("weight"))
    chosen = best.groupBy(part).agg(F.map_from_entries(F.collect_list(F.struct("step", "weight"))).alias("_w"))
    placed, out = rows.join(chosen, part), {}
    for i, (path, extra) in enumerate(steps):
        name = "+".join([stages[path], extra])
        w = F.element_at("_w", F.lit(i))
        placed = placed.withColumn(name, F.zip_with(F.col(f"`{stages[path]}`"), F.col(extra), lambda p, q: p * (1 - w) + q * w))  # noqa: B023
        out[(*path, extra)] = name
    return cut_lineage(placed.drop("_w")), out


def ordered_blends(rows: DataFrame, base: str, extras: list[str], grid: list[float], classes: list[str], depth: int = 2, part: str = "fold") -> DataFrame:
    """(path, position, gain_total, marginal): blends of the extras over the base in all orders of up to ``depth``, with fold-local weights.

    Orders share their prefixes: each prefix is blended once, all steps of a level in one pass.  ``marginal`` is what the last of the path adds.  A level beyond ``depth``
    goes on from the best path only, with each extra that is left.
    """
    levels, stages = [{(): base}], {(): base}
    for _ in range(min(depth, len(extras))):
        rows, stages = _extended(rows, stages, extras, grid, classes, part)
        levels.append(stages)

    def scored(names: dict[tuple, str]) -> dict[tuple, float]:
        places = list(names)
        pred = F.explode(F.array(*[F.struct(F.lit(i).alias("stage"), argmax_class(F.col(f"`{names[p]}`"), classes).alias("pred")) for i, p in enumerate(places)])).alias("x")
        found = rows.select("sid", F.col("label").alias("truth"), pred).select("sid", "truth", "x.stage", "x.pred")
        return {places[r["stage"]]: r["macro_f1"] for r in me.overall(me.confusion(found, ["stage"]), ["stage"]).collect()}  # a number per path

    scores: dict[tuple, float] = {}
    for names in levels:
        scores |= scored(names)
    full = [p for p in scores if len(p) == len(levels) - 1]
    top = min(full, key=lambda p: (-round(scores[p], 9), p))
    if 0 < len(top) < len(extras):
        rows, last = _extended(rows, {top: levels[-1][top]}, extras, grid, classes, part)
        scores |= scored(last)
    gains = [(list(p), len(p), f - scores[()], f - scores[p[:-1]]) for p, f in sorted(scores.items()) if p]
    return rows.sparkSession.createDataFrame(gains, "path array<string>, position int, gain_total double, marginal double")


def rows_f1(rows: DataFrame, array: str, classes: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    pred = rows.select("sid", *by, F.col("label").alias("truth"), argmax_class(F.col(array), classes).alias("pred"))
    return me.overall(me.confusion(pred, list(by)), list(by))


# Ranker tables --------------------------------------------------------------------------------


def candidate_table(rows: DataFrame, p0: str, p1: str, evidence: str, rare: str, burden: str, classes: list[str]) -> DataFrame:
    """(sid, cls) with nineteen features from two probability arrays and two evidence arrays."""
    e, a, b = F.col(evidence), F.col(p0), F.col(p1)
    log_burden = F.log1p(F.greatest(F.col(burden), F.lit(0)).cast("double"))
    positive = F.transform(e, lambda x: F.greatest(x, F.lit(0.0)))
    negative = F.transform(e, lambda x: F.least(x, F.lit(0.0)))
    ordered = F.sort_array(b, asc=False)
    top3 = total(F.slice(F.sort_array(positive, asc=False), 1, 3))
    i0, i1 = argmax_index(a), argmax_index(b)

    def logit(p):
        q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
        return F.log(q / (1 - q))

    base = rows.select(
        "sid", log_burden.alias("log_burden"), F.array_max(positive).alias("positive_max"), top3.alias("positive_top3"),
        total(negative).alias("negative_sum"), F.array_min(negative).alias("negative_min"),
        F.size(F.filter(e, lambda x: x > 0)).alias("n_positive"), F.size(F.filter(e, lambda x: x < 0)).alias("n_negative"),
        i0.alias("i0"), i1.alias("i1"), ordered[0].alias("t1"), ordered[1].alias("t2"),
        F.posexplode(F.arrays_zip(a.alias("p0"), b.alias("p1"), e.alias("e"), F.col(rare).alias("r"))).alias("k", "x"))
    rival = F.when(F.col("k") == F.col("i1"), F.col("t2")).otherwise(F.col("t1"))
    return base.select(
        "sid", F.get(F.array(*[F.lit(c) for c in classes]), F.col("k")).alias("cls"), F.col("x.p0").alias("p0"), F.col("x.p1").alias("p1"),
        logit(F.col("x.p0")).alias("logit_p0"), logit(F.col("x.p1")).alias("logit_p1"), (F.col("x.p1") - rival).alias("lead"),
        F.col("x.e").alias("evidence"), (F.col("x.e") / F.greatest("log_burden", F.lit(1.0))).alias("evidence_per_burden"),
        F.col("x.r").alias("rare_evidence"), (F.col("x.e") - F.col("x.r")).alias("common_evidence"),
        "positive_max", "positive_top3", "negative_sum", "negative_min", "n_positive", "n_negative", "log_burden",
        (F.col("k") == F.col("i0")).cast("int").alias("is_top_p0"), (F.col("k") == F.col("i1")).cast("int").alias("is_top_p1"),
        (F.col("i0") == F.col("i1")).cast("int").alias("models_agree"))


def symmetric_pairs(features: DataFrame, labels: DataFrame, columns: list[str], class_count: int) -> DataFrame:
    """Truth-minus-other feature differences and their mirror, with a per-row balanced weight.

    A sample has one row per class, so the other classes are read from the sample's own short array.
    """
    packed = by_rows(features.groupBy("sid").agg(F.collect_list(F.struct("cls", *columns)).alias("cs")), labels, ["sid"])
    true = F.filter("cs", lambda x: x["cls"] == F.col("label"))[0]
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n_c"))
    n = labels.agg(F.count(F.lit(1))).scalar()
    x = packed.withColumn("t", true).select("sid", "label", "t", F.explode("cs").alias("o")).filter(F.col("o.cls") != F.col("label"))
    x = x.join(sizes, "label").withColumn("weight", n / (F.col("n_c") * class_count))
    sign = F.explode(F.array(F.lit(1), F.lit(-1))).alias("sign")
    y = x.select("sid", "label", F.col("o.cls").alias("other"), "weight", "t", "o", sign)
    return y.select(
        "sid", "label", "other", (F.col("sign") == 1).cast("int").alias("target"), "weight",
        *[((F.col(f"t.{c}") - F.col(f"o.{c}")) * F.col("sign")).alias(f"d_{c}") for c in columns])


def validated_pairs(candidates: list[tuple], maximum: int = 2) -> list[tuple]:
    """The best class pairs without a shared class among those whose F1 rises and that mend more rows than they break.

    candidates: (class_a, class_b, delta, recovered, broken), one per class pair.
    """
    worth = [c for c in candidates if c[2] > 0 and c[3] > c[4]]
    return disjoint_pairs(sorted(worth, key=lambda c: (-c[2], c[4] - c[3], *c[:2])), maximum)


#: Model sizes by the place of a pair among all pairs, and by its number of rows (up to each edge, then beyond).
SIZE_OF_PLACE = ("small", "medium", "large", "large")
SIZE_OF_SUPPORT = ((600,), ("small", "large"))


def size_of_place(place: Column, sizes: tuple[str, ...] = SIZE_OF_PLACE) -> Column:
    """Model size of the pair at a 0-based place; null beyond the policy."""
    return F.get(F.array(*[F.lit(s) for s in sizes]), place)


def size_of_support(support: Column, policy: tuple[tuple[int, ...], tuple[str, ...]] = SIZE_OF_SUPPORT) -> Column:
    edges, sizes = policy
    return bucket(support, list(edges), list(sizes))
