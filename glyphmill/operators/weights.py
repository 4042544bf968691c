"""Supervised token statistics.

One aggregate turns (sid, token) and the labels into one row per token with an array of per-class counts.
Every weight formula is an expression over that row, every score is one join and one group-by, and
cross-fitting subtracts the counts of a fold from the totals instead of counting k times.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphmill.functions.cells import first_integer
from glyphmill.operators.ranks import hot_keys, salted_join
from glyphmill.session import cut_lineage

Formula = Callable[[Column, Column, Column, Column], Column]  # (positives, class size, support, rows) -> weight


def class_array(classes: list[str]) -> Column:
    return F.array(*[F.lit(c) for c in classes])


def class_sizes(samples: DataFrame, classes: list[str], by: list[str] | None = None) -> DataFrame:
    """(*by, n, ns): labelled rows and rows per class, one row per ``by``."""
    sizes = F.array(*[F.count_if(F.col("label") == c) for c in classes]).alias("ns")
    return samples.groupBy(*(by or [])).agg(F.count("label").alias("n"), sizes)


def token_counts(tokens: DataFrame, samples: DataFrame, classes: list[str], by: list[str] | None = None) -> DataFrame:
    """(*by, token, support, pos, n, ns); ``by`` columns come with the samples."""
    by = by or []
    joined = tokens.join(samples.filter(F.col("label").isNotNull()).select("sid", "label", *by), "sid")
    positives = F.array(*[F.count_if(F.col("label") == c) for c in classes]).alias("pos")
    counted = joined.groupBy(*by, "token").agg(F.count(F.lit(1)).alias("support"), positives)
    sizes = class_sizes(samples, classes, by)
    if by:
        return counted.join(sizes, by)
    z = sizes.select(F.struct("n", "ns")).scalar()
    return counted.withColumn("_z", z).select("token", "support", "pos", "_z.n", "_z.ns")


def cross_fit_counts(tokens: DataFrame, folds: DataFrame, classes: list[str], fold: str = "fold",
                     outer: list[str] | None = None) -> DataFrame:
    """Counts over all rows outside each fold, for the tokens that occur in the fold: total minus fold.

    ``outer`` names columns of ``folds`` (for example outer_fold) inside which the subtraction happens.
    """
    outer = outer or []
    return _counts_outside(tokens.join(folds.select("sid", "label", fold, *outer), "sid"), folds, classes, fold, outer)


def _counts_outside(joined: DataFrame, folds: DataFrame, classes: list[str], fold: str, outer: list[str]) -> DataFrame:
    """``cross_fit_counts`` of tokens that carry their sample's label and fold."""
    own = [F.count_if(F.col("label") == c).alias(f"_c{i}") for i, c in enumerate(classes)]
    counted = joined.groupBy(*outer, fold, "token").agg(F.count(F.lit(1)).alias("_s"), *own)
    w = Window.partitionBy(*outer, "token")  # at most one row per fold
    rest = counted.withColumn("support", F.sum("_s").over(w) - F.col("_s")).withColumn(
        "pos", F.array(*[F.sum(f"_c{i}").over(w) - F.col(f"_c{i}") for i in range(len(classes))])
    ).filter(F.col("support") > 0).select(*outer, fold, "token", "support", "pos")
    sizes = class_sizes(folds, classes, [*outer, fold])
    v = Window.partitionBy(*outer) if outer else Window.partitionBy(F.lit(0))
    per_class = [F.sum(F.col("ns")[i]).over(v) - F.col("ns")[i] for i in range(len(classes))]
    left_out = sizes.select(
        *outer, fold, (F.sum("n").over(v) - F.col("n")).alias("n"), F.array(*per_class).alias("ns"))
    return rest.join(left_out, [*outer, fold])


def priors_outside(folds: DataFrame, classes: list[str]) -> DataFrame:
    """(fold, cls, prior): class shares of the labelled rows outside each fold."""
    every = Window.partitionBy(F.lit(0))  # a row per fold
    rest = [(F.sum(F.col("ns")[i]).over(every) - F.col("ns")[i]) / (F.sum("n").over(every) - F.col("n")) for i in range(len(classes))]
    shares = class_sizes(folds, classes, ["fold"]).select("fold", F.arrays_zip(class_array(classes).alias("cls"), F.array(*rest).alias("prior")).alias("x"))
    return shares.select("fold", F.inline("x"))


def weigh(counts: DataFrame, formula: Formula) -> DataFrame:
    """Adds ``w``: one weight per class."""
    w = F.zip_with(
        "pos", "ns",
        lambda p, size: formula(p.cast("double"), size.cast("double"), F.col("support").cast("double"),
                                F.col("n").cast("double")),
    )
    return counts.withColumn("w", w)


def weights_long(weighted: DataFrame, classes: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
    keys = [c for c in weighted.columns if c not in ("pos", "ns", "w", "n")]
    zipped = F.arrays_zip(class_array(classes).alias("cls"), F.col("pos"), F.col("ns"), F.col("w"))
    x = weighted.select(*keys, "n", F.explode(zipped).alias("x"))
    return x.select(*keys, "n", F.col("x.cls").alias("cls"), F.col("x.pos").alias("pos"),
                    F.col("x.ns").alias("cls_n"), F.col("x.w").alias("w"))


# Formulas ------------------------------------------------------------------------------------


def _clip(x: Column, bound: float | None) -> Column:
    return x if bound is None else F.greatest(F.least(x, F.lit(bound)), F.lit(-bound))


def log_odds(alpha: float = 1.0, shrinkage: float | None = 10.0, clip: float | None = 4.0) -> Formula:
    """Smoothed log-odds in the class minus outside it, shrunk by support."""

    def f(p, size, support, n):
        neg = support - p
        raw = F.log((p + alpha) / (size - p + alpha)) - F.log((neg + alpha) / (n - size - neg + alpha))
        return _clip(raw if shrinkage is None else raw * support / (support + shrinkage), clip)

    return f


def log_rate_ratio(alpha: float = 1.0, shrinkage: float = 20.0, clip: float | None = 4.0) -> Formula:
    def f(p, size, support, n):
        inside = (p + alpha) / (size + 2 * alpha)
        outside = (support - p + alpha) / (n - size + 2 * alpha)
        return _clip(F.log(inside / outside) * support / (support + shrinkage), clip)

    return f


def _logit(rate: Column, floor: float = 1e-6) -> Column:
    rate = F.greatest(F.least(rate, F.lit(1 - floor)), F.lit(floor))
    return F.log(rate / (1 - rate))


def empirical_bayes(prior: float = 20.0, clip: float | None = 4.0, reliability: float | None = None) -> Formula:
    """Rates pulled to the token's overall rate by ``prior`` pseudo-rows; optional support reliability."""

    def f(p, size, support, n):
        overall = (support + 1) / (n + 2)
        inside = (p + prior * overall) / (size + prior)
        outside = (support - p + prior * overall) / (n - size + prior)
        raw = _logit(inside) - _logit(outside)
        return _clip(raw if reliability is None else raw * support / (support + reliability), clip)

    return f


def class_prior_bayes(alpha: float = 1.0, shrinkage: float = 20.0, clip: float = 4.0) -> Formula:
    """Pseudo-count split by the class prior."""

    def f(p, size, support, n):
        prior = size / n
        inside = (p + alpha * prior) / (F.greatest(size, F.lit(1.0)) + alpha)
        outside = (support - p + alpha * (1 - prior)) / (F.greatest(n - size, F.lit(1.0)) + alpha)

        def odds(x):
            return F.log((x + 1e-6) / (1 - x + 1e-6))

        return _clip((odds(inside) - odds(outside)) * support / (support + shrinkage), clip)

    return f


def count_ratio(smoothing: float = 1.0) -> Formula:
    """Naive-Bayes log count ratio."""

    def f(p, size, support, n):
        return F.log((p + smoothing) / (size + 2 * smoothing)) - F.log(
            (support - p + smoothing) / (n - size + 2 * smoothing))

    return f


def supported(counts: DataFrame, floor: int = 10, below_all: bool = True) -> DataFrame:
    """Tokens with enough support; optionally drop tokens that every row has."""
    keep = F.col("support") >= floor
    return counts.filter(keep & (F.col("support") < F.col("n")) if below_all else keep)


# Scores --------------------------------------------------------------------------------------


def score_tokens(tokens: DataFrame, weighted: DataFrame, classes: list[str], keys: list[str] | None = None,
                 rows: list[str] | None = None, all_tokens: bool = False, every: DataFrame | None = None, few: bool = False) -> DataFrame:
    """(*rows, cls, score, tokens): sum of weights over the sample's tokens / sqrt(number of tokens).

    ``keys`` are the join columns (token, or fold and token), ``rows`` identify a scored row.  The count is
    over tokens that have a weight, or over all tokens of the sample with ``all_tokens``.  Weights stay an
    array during the join, so the token table is not multiplied by the classes.  Rows of ``every`` without any
    weighted token score zero; they are added before the classes are spread out.  ``few``: the caller counted the weights, and they can be
    broadcast, so that tokens do not move.
    """
    keys, rows = keys or ["token"], rows or ["sid"]
    right = weighted.select(*keys, "w", "support")
    if few:
        joined = tokens.join(F.broadcast(right), keys, "left" if all_tokens else "inner")
    elif not all_tokens:
        hot = hot_keys(weighted, keys, "support")
        joined = salted_join(tokens, right, keys, hot, rows)
    else:
        joined = tokens.join(right, keys, "left" if all_tokens else "inner")
    sums = [F.sum(F.col("w")[i]).alias(f"_s{i}") for i in range(len(classes))]
    summed = joined.groupBy(*rows).agg(F.count(F.lit(1)).alias("tokens"), *sums)
    if every is not None:
        summed = every.select(*rows).join(summed, rows, "left").na.fill(0, ["tokens"])
    root = F.sqrt(F.greatest(F.col("tokens"), F.lit(1)).cast("double"))
    pairs = F.array(*[
        F.struct(F.lit(c).alias("cls"), F.coalesce(F.col(f"_s{i}"), F.lit(0.0)).alias("total"))
        for i, c in enumerate(classes)
    ])
    long = summed.select(*rows, "tokens", root.alias("_r"), F.explode(pairs).alias("x"))
    return long.select(*rows, F.col("x.cls").alias("cls"), (F.col("x.total") / F.col("_r")).alias("score"), "tokens")


def cross_fitted_scores(tokens: DataFrame, folds: DataFrame, classes: list[str], formula: Formula,
                        floor: int | None = 10) -> DataFrame:
    """Out-of-fold scores (sid, fold, cls, score, tokens): no row meets a weight its own label went into.

    Tokens and folds are made once: the tokens with their folds are counted, and then scored.
    """
    folds = cut_lineage(folds.select("sid", "label", "fold"))
    joined = cut_lineage(tokens.join(folds, "sid"))
    counts = _counts_outside(joined, folds, classes, "fold", [])
    counts = counts if floor is None else supported(counts, floor)
    placed = joined.drop("label")
    return score_tokens(placed, weigh(counts, formula), classes, ["fold", "token"], ["sid", "fold"], every=folds)


def standardise(fit: DataFrame, apply: DataFrame, by: list[str], value: str = "score",
                floor: str = "replace", eps: float = 1e-6) -> DataFrame:
    """z-scores with mean and population deviation of the fit rows; features constant on fit are dropped.

    floor='replace': deviations below eps become one; floor='max': at least eps.
    """
    sd = F.coalesce(F.stddev_pop(value), F.lit(0.0))
    safe = F.when(sd < eps, 1.0).otherwise(sd) if floor == "replace" else F.greatest(sd, F.lit(eps))
    stats = fit.groupBy(*by).agg(
        F.avg(value).alias("_m"), safe.alias("_d"), (F.min(value) != F.max(value)).alias("_keep")
    ).filter("_keep")
    return apply.join(stats, by).withColumn("z", (F.col(value) - F.col("_m")) / F.col("_d")).drop("_m", "_d", "_keep")


# Hierarchy and back-off ----------------------------------------------------------------------


def parent_map(pairs: DataFrame, parents: DataFrame) -> DataFrame:
    """Distinct (token, parent) plus a flag for parents missing from the parent vocabulary."""
    known = parents.select(F.col("token").alias("parent"), F.lit(True).alias("_k")).distinct()
    return pairs.select("token", "parent").distinct().join(known, "parent", "left").select(
        "token", "parent", F.col("_k").isNull().alias("parent_missing"))


def residual_weights(child: DataFrame, parent: DataFrame, mapping: DataFrame, floor: int = 10,
                     backoff: float = 20.0, clip: float = 4.0) -> DataFrame:
    """Child log-odds minus its parent's, by support reliability; inputs are count tables."""
    raw = log_odds(shrinkage=None, clip=None)
    c = weigh(supported(child, floor), raw)
    p = weigh(parent, raw).select(F.col("token").alias("parent"), F.col("w").alias("pw"))
    joined = c.join(mapping.select("token", "parent"), "token").join(p, "parent")
    scale = F.col("support") / (F.col("support") + backoff)
    return joined.withColumn("w", F.zip_with("w", "pw", lambda a, b: _clip((a - b) * scale, clip))).drop("pw")


def position_density(typed: DataFrame, samples: DataFrame, classes: list[str], bandwidth: float = 20.0,
                     position: str = "position", clip: float = 4.0) -> DataFrame:
    """Class density around every (gene, event_type, position): log ratio to the rest, and a local count."""
    counts = typed.filter(F.col(position).isNotNull()).join(samples, "sid").groupBy(
        "gene", "event_type", F.col(position).alias("q")
    ).agg(F.count(F.lit(1)).alias("m"), F.array(*[F.count_if(F.col("label") == c) for c in classes]).alias("ms"))
    return density_of_counts(counts, class_sizes(samples, classes), classes, bandwidth, clip).withColumnRenamed("q", "position")


def density_of_counts(counts: DataFrame, sizes: DataFrame, classes: list[str], bandwidth: float = 20.0,
                      clip: float = 4.0) -> DataFrame:
    """(gene, event_type, q, local_n, w) from (gene, event_type, q, m, ms): events per position, and per class.

    The join is between positions, not between events.  Beyond 39 bandwidths the Gaussian is exactly zero in double
    precision, so positions meet only inside stripes of that width and the neighbouring ones: a position has a bounded
    number of partners.
    """
    stripe = int(39 * bandwidth)
    home = F.floor(F.col("q") / stripe)
    at = counts.select(
        "gene", "event_type", F.col("q").alias("position"),
        F.explode(F.array(home - 1, home, home + 1)).alias("stripe"))
    counts = counts.withColumn("stripe", home)
    delta = (F.col("q") - F.col("position")) / bandwidth
    kernel = F.exp(-0.5 * delta * delta)
    near = at.join(counts, ["gene", "event_type", "stripe"]).groupBy("gene", "event_type", "position").agg(
        F.sum(F.when(F.abs(F.col("q") - F.col("position")) <= bandwidth, F.col("m")).otherwise(0)).alias("local_n"),
        *[F.sum(kernel * F.col("ms")[i]).alias(f"_k{i}") for i in range(len(classes))],
    )
    masses = F.array(*[F.col(f"_k{i}") for i in range(len(classes))])
    all_mass = F.aggregate(masses, F.lit(0.0), lambda a, b: a + b)
    wide = near.withColumn("_z", sizes.select(F.struct("n", "ns")).scalar()).withColumn("_mass", masses).withColumn("_all", all_mass)
    score = F.zip_with(
        "_mass", "_z.ns",
        lambda k, size: _clip(
            F.log((k / size + 1e-5) / ((F.col("_all") - k) / F.greatest(F.col("_z.n") - size, F.lit(1)) + 1e-5)), clip),
    )
    return wide.select("gene", "event_type", F.col("position").alias("q"), "local_n", score.alias("w"))


#: Levels of ``event_levels``.
EXACT, CODON, TYPE = 0, 1, 2


def event_levels(typed: DataFrame, samples: DataFrame, classes: list[str]) -> DataFrame:
    """(level, gene, event, event_type, q, events, support, pos): exact events, codons and types counted in one pass.

    A sample counts once per key; ``events`` also counts samples without a label.  Columns that are not part of a level's key
    are null; an exact event carries its type and its first integer ``q``, which follow from it.  Events without an integer have no
    codon, events without a gene are left out.
    """
    none = F.lit(None)
    keys = F.array(
        F.struct(F.lit(EXACT).alias("level"), F.col("event"), F.col("event_type"), F.col("q")),
        F.struct(F.lit(CODON).alias("level"), none.cast("string").alias("event"), none.cast("string").alias("event_type"), F.col("q")),
        F.struct(F.lit(TYPE).alias("level"), none.cast("string").alias("event"), F.col("event_type"), none.cast("bigint").alias("q")))
    placed = typed.filter(F.col("gene").isNotNull() & F.col("event").isNotNull()).withColumn("q", first_integer(F.col("event")))
    labelled = placed.select("sid", "gene", "event", "event_type", "q").join(samples.select("sid", "label"), "sid", "left")
    many = labelled.select("sid", "label", "gene", F.inline(keys)).filter((F.col("level") != CODON) | F.col("q").isNotNull())
    key = ["level", "gene", "event", "event_type", "q"]
    positives = F.array(*[F.count_if(F.col("label") == c) for c in classes]).alias("pos")
    return many.distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("events"), F.count("label").alias("support"), positives)


def backoff_table(typed: DataFrame, samples: DataFrame, classes: list[str], strength: float = 20.0) -> DataFrame:
    """(gene, event, events, evidence): one row per distinct event with an array of evidence per class.

    Exact -> codon -> local density -> type weights, each taking n/(n+strength) of what the finer ones left.  Codons, types and
    densities first meet the table of positions, where a (gene, type) has at most as many rows as the gene has positions; an exact
    event then meets one row of its position.  What no labelled sample supports weighs zero.
    """
    levels = cut_lineage(event_levels(typed, samples, classes))
    sizes = class_sizes(samples, classes)
    z = sizes.select(F.struct("n", "ns")).scalar()
    seen = weigh(levels.withColumn("_z", z).select("*", "_z.n", "_z.ns").drop("_z"), empirical_bayes())

    def level(code: int, name: str, *keys: str) -> DataFrame:
        return seen.filter((F.col("level") == code) & (F.col("support") > 0)).select(
            *keys, F.col("support").alias(f"{name}_n"), F.col("w").alias(f"{name}_w"))

    exact = levels.filter(F.col("level") == EXACT)
    sums = F.array(*[F.sum(F.col("pos")[i]) for i in range(len(classes))])
    places = exact.groupBy("gene", "event_type", "q").agg(F.sum("support").alias("m"), sums.alias("ms"))
    density = density_of_counts(places.filter("q is not null and m > 0"), sizes, classes).withColumnsRenamed({"w": "density_w", "local_n": "density_n"})
    coarse = (
        places.select("gene", "event_type", "q")
        .join(level(CODON, "codon", "gene", "q"), ["gene", "q"], "left")
        .join(density, ["gene", "event_type", "q"], "left")
        .join(level(TYPE, "type", "gene", "event_type"), ["gene", "event_type"], "left")
    ).withColumnsRenamed({"gene": "_g", "event_type": "_t", "q": "_q"})
    fine = seen.filter(F.col("level") == EXACT).select(
        "gene", "event", "event_type", "q", "events", F.col("support").alias("exact_n"), F.when(F.col("support") > 0, F.col("w")).alias("exact_w"))
    both = fine.join(coarse, (F.col("gene") == F.col("_g")) & F.col("event_type").eqNullSafe(F.col("_t")) & F.col("q").eqNullSafe(F.col("_q")), "left")
    return both.select("gene", "event", "events", _backed_off(classes, strength).alias("evidence"))


def _backed_off(classes: list[str], strength: float) -> Column:
    """Array over classes: the finer a level and the more rows support it, the more of the evidence it takes."""
    left: Column = F.lit(1.0)
    shares = []
    for name in ("exact", "codon", "density"):
        n = F.coalesce(F.col(f"{name}_n").cast("double"), F.lit(0.0))
        share = left * n / (n + strength)
        shares.append((name, share))
        left = left - share
    shares.append(("type", left))

    def mixed(i: int) -> Column:
        return sum((share * F.coalesce(F.col(f"{name}_w")[i], F.lit(0.0)) for name, share in shares), F.lit(0.0))

    return F.array(*[mixed(i) for i in range(len(classes))])


def backed_off_events(typed: DataFrame, table: DataFrame, classes: list[str]) -> DataFrame:
    """(sid, gene, event, cls, e): every event with the evidence of ``backoff_table``; frequent events are dealt over several tasks."""
    keys = ["gene", "event"]
    joined = salted_join(typed.select("sid", *keys), table, keys, hot_keys(table, keys, "events"), ["sid"])
    pairs = F.explode(F.arrays_zip(class_array(classes).alias("cls"), F.col("evidence").alias("e"))).alias("x")
    return joined.select("sid", *keys, pairs).select("sid", *keys, "x.cls", "x.e")


def low_rank(weighted: DataFrame, classes: list[str], rank: int) -> DataFrame:
    """Rank-r reconstruction of the token x class table.

    The class side is small, so the Gram matrix (class x class sums over all tokens) holds all that is
    needed: its leading eigenvectors span the right singular space.  Tokens never leave the executors.
    """
    import numpy as np

    k = len(classes)
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    row = weighted.agg(*[F.sum(F.col("w")[i] * F.col("w")[j]) for i, j in upper]).first()
    gram = np.zeros((k, k))
    for (i, j), value in zip(upper, row):
        gram[i, j] = gram[j, i] = value or 0.0
    _, vectors = np.linalg.eigh(gram)
    top = vectors[:, ::-1][:, :rank]
    projection = top @ top.T
    smoothed = [
        sum((F.col("w")[j] * float(projection[j, i]) for j in range(k)), F.lit(0.0)) for i in range(k)
    ]
    return weighted.withColumn("w", F.array(*smoothed))
