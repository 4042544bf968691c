"""Feature selection on count tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphmill.functions.hashing import set_fingerprint
from glyphmill.operators.rollups import top_per_group


def dominant_class(counts: DataFrame, classes: list[str]) -> DataFrame:
    """Adds dominant (lowest class on ties), n_dominant, purity and lift over the class prior."""
    ranked = F.array_min(F.transform("pos", lambda p, i: F.struct((-p).alias("k"), i.alias("i"))))
    names = F.array(*[F.lit(c) for c in classes])
    x = counts.withColumn("_d", ranked)
    purity = F.col("n_dominant") / F.col("support")
    return x.withColumns({"dominant": F.get(names, F.col("_d.i")), "n_dominant": -F.col("_d.k"),
                          "_size": F.get("ns", F.col("_d.i"))}).withColumns({
        "purity": purity, "lift": purity / (F.col("_size") / F.col("n"))}).drop("_d")


def ranked_tokens(counts: DataFrame, classes: list[str], method: str, k: int, floor: int = 10,
                  small_class: int = 120) -> DataFrame:
    """Top-k tokens by frequency or by lift of the dominant class, with a batch-artefact flag."""
    x = dominant_class(counts.filter(F.col("support") >= floor), classes)
    keys = ["support", "lift"] if method == "freq" else ["lift", "support"]
    flag = (F.col("purity") >= 0.99) & (F.col("_size") <= small_class)
    return x.withColumn("artefact", flag).orderBy(*[F.desc(c) for c in keys], "token").limit(k).select(
        "token", "support", "dominant", "n_dominant", "purity", "lift", "artefact")


def concentrated_tokens(counts: DataFrame, k: int, floor: int = 10, share: float = 0.60) -> DataFrame:
    """Hotspots: enough support, one class holds at least ``share``; by support x share."""
    x = counts.withColumn("share", F.array_max("pos") / F.col("support"))
    kept = x.filter((F.col("support") >= floor) & (F.col("share") >= share))
    return kept.orderBy(F.desc(F.col("support") * F.col("share")), F.desc("support"), "token").limit(k).select(
        "token", "support", "share")


def recurrent_events(typed: DataFrame, kind: str = "MISSENSE", floor: int = 5) -> DataFrame:
    """(gene, event, n): events of one type in at least ``floor`` samples."""
    return typed.filter(F.col("event_type") == kind).groupBy("gene", "event").agg(
        F.count_distinct("sid").alias("n")).filter(F.col("n") >= floor)


def pair_contrasts(counts: DataFrame, pairs: list[tuple[str, str]], classes: list[str], floor: int = 10) -> DataFrame:
    """(class_a, class_b, gene): support in both classes and difference of rates, from (token, pos, ns) with arrays over ``classes``.

    Pairs are formed inside the token's own row, so nothing meets on a class.
    """
    place = {c: i for i, c in enumerate(classes)}
    at = lambda name, c: F.get(name, F.lit(place[c]))
    cells = [F.struct(F.lit(a).alias("class_a"), F.lit(b).alias("class_b"), (at("pos", a) + at("pos", b)).alias("support"),
                      (at("pos", a) / at("ns", a) - at("pos", b) / at("ns", b)).alias("contrast")) for a, b in pairs if a in place and b in place]
    if not cells:
        none = "array<struct<class_a:string,class_b:string,support:bigint,contrast:double>>"
        found = F.array().cast(none)
    else:
        found = F.filter(F.array(*cells), lambda x: x["support"] >= floor)
    return counts.select(F.col("token").alias("gene"), F.explode(found).alias("x")).select("x.class_a", "x.class_b", "gene", "x.support", "x.contrast")


def top_contrasts(contrasts: DataFrame, k: int = 5, ranking: str = "contrast",
                  group: tuple[str, ...] = ("class_a", "class_b")) -> DataFrame:
    """ranking 'contrast': |contrast|, support, gene.  'weighted': support x |contrast|, then support, zeros dropped."""
    size = F.abs("contrast")
    if ranking == "contrast":
        return top_per_group(contrasts, list(group), [F.desc(size), F.desc("support"), "gene"], k)
    order = [F.desc(F.col("support") * size), F.desc("support"), "gene"]
    return top_per_group(contrasts, list(group), order, k).filter("contrast <> 0")


def contrast_features(presence: DataFrame, selected: DataFrame, group: tuple[str, ...] = ("class_a", "class_b")) -> DataFrame:
    """(sid, *group): number of selected genes present and the sum of their contrast signs."""
    signs = selected.select(*group, "gene", F.signum("contrast").alias("sign"))
    return presence.join(signs, "gene").groupBy("sid", *group).agg(
        F.count(F.lit(1)).alias("n_genes"), F.sum("sign").alias("signed_sum"))


def rest_contrasts(long: DataFrame, classes: list[str], floor: int = 10) -> DataFrame:
    """(cls, gene): rate inside the class minus rate outside it."""
    x = long.filter(F.col("cls").isin(classes) & (F.col("support") >= floor))
    inside = F.col("pos") / F.col("cls_n")
    outside = (F.col("support") - F.col("pos")) / (F.col("n") - F.col("cls_n"))
    return x.select("cls", F.col("token").alias("gene"), "support", (inside - outside).alias("contrast"))


def rate_spread(counts: DataFrame, k: int) -> DataFrame:
    """Largest minus smallest class rate."""
    rates = F.zip_with("pos", "ns", lambda p, n: p / n)
    return counts.withColumn("_r", rates).withColumn("spread", F.array_max("_r") - F.array_min("_r")).orderBy(
        F.desc("spread"), F.desc("support"), "token").limit(k).select("token", "support", "spread")


def marker_table(long: DataFrame, floor: int, min_rate: float, min_lift: float) -> DataFrame:
    """(cls, token): prevalence, overall rate, lift and concentration above three thresholds."""
    rate, overall = F.col("pos") / F.col("cls_n"), F.col("support") / F.col("n")
    x = long.select("cls", "token", F.col("pos").alias("n_hit"), "cls_n", rate.alias("rate"), overall.alias("overall"),
                    (rate / overall).alias("lift"), (F.col("pos") / F.col("support")).alias("concentration"))
    return x.filter((F.col("n_hit") >= floor) & (F.col("rate") >= min_rate) & (F.col("lift") >= min_lift))


def pairwise_markers(long: DataFrame, min_rate: float = 0.15, ratio: float = 3.0) -> DataFrame:
    """(class_a, class_b, token): frequent in a and at least ``ratio`` times rarer in b.

    All classes of a token sit in one short row, so class pairs are formed there.
    """
    rates = long.withColumn("rate", F.col("pos") / F.col("cls_n"))
    row = rates.groupBy("token").agg(F.collect_list(F.struct("cls", "rate")).alias("rs"))
    high = row.select("token", "rs", F.explode("rs").alias("a")).filter(F.col("a.rate") >= min_rate)
    both = high.select("token", "a", F.explode("rs").alias("b")).filter(F.col("a.cls") != F.col("b.cls"))
    return both.filter(F.col("a.rate") > ratio * F.greatest(F.col("b.rate"), F.lit(1e-9))).select(
        F.col("a.cls").alias("class_a"), F.col("b.cls").alias("class_b"), "token",
        F.col("a.rate").alias("rate_a"), F.col("b.rate").alias("rate_b"))


def chi_square(counts: DataFrame) -> DataFrame:
    """Adds chi2 of a presence column against the labels, closed form on counts."""
    terms = F.zip_with("pos", "ns", lambda p, size: F.pow(p - F.col("support") * size / F.col("n"), F.lit(2.0))
                       / (F.col("support") * size / F.col("n")))
    return counts.withColumn("chi2", F.aggregate(terms, F.lit(0.0), lambda a, b: a + b))


def k_best_chi_square(counts: DataFrame, k: int) -> DataFrame:
    scored = chi_square(counts).withColumn("chi2", F.round("chi2", 6))
    return scored.orderBy(F.desc("chi2"), "token").limit(k).select("token", "support", "chi2")


def top_tokens(tokens: DataFrame, k: int) -> DataFrame:
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(k)


def auto_events(counts: DataFrame, pool: int, k: int, floor: int = 2) -> DataFrame:
    """The most frequent tokens, then the k best of them by chi-square."""
    frequent = counts.filter(F.col("support") >= floor).orderBy(F.desc("support"), "token").limit(pool)
    return k_best_chi_square(frequent, k)


def varying_counts(values: DataFrame, n_rows: Column, key: str, value: str, floor: int = 1) -> DataFrame:
    """Columns of a sparse count table that are not constant once missing rows count as zero."""
    stats = values.groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"), F.min(value).alias("low"), F.max(value).alias("high"))
    low = F.when(F.col("rows") < n_rows, F.least("low", F.lit(0))).otherwise(F.col("low"))
    return stats.withColumn("low", low).filter((F.col("rows") >= floor) & (F.col("low") != F.col("high")))


def column_filter(cells: DataFrame, n_rows: Column, genes: list[str]) -> DataFrame:
    """(gene, status): keep, duplicate of an earlier column, or constant, on raw cells without reference cells.

    A column's content is a fixed-size fingerprint over (row, cell), so no column is gathered.
    """
    content = set_fingerprint(F.concat_ws("\u0001", F.col("sid").cast("string"), F.col("cell")))
    seen = cells.groupBy("gene").agg(
        content.alias("content"), F.count(F.lit(1)).alias("rows"), F.min("cell").alias("low"), F.max("cell").alias("high"))
    order = F.array_position(F.array(*[F.lit(g) for g in genes]), F.col("gene"))
    constant = (F.col("rows") == n_rows) & (F.col("low") == F.col("high"))
    w = Window.partitionBy("content").orderBy("_o")
    return seen.withColumn("_o", order).withColumn("_rn", F.row_number().over(w)).select(
        "gene", F.when(constant, "constant").when(F.col("_rn") > 1, "duplicate").otherwise("keep").alias("status"))


def class_weights(samples: DataFrame, scheme: str = "balanced") -> DataFrame:
    """(cls, n, weight): n/(K n_c), the square-root variant, or one."""
    counts = samples.groupBy(F.col("label").alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(0))  # one row per class
    total, k = F.sum("n").over(every), F.count(F.lit(1)).over(every)
    size = F.col("n").cast("double")
    weight = {
        "none": F.lit(1.0),
        "balanced": total / (k * size),
        "sqrt_balanced": total / (k * F.sqrt(size)),
    }[scheme]
    return counts.withColumn("weight", weight)
