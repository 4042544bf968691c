"""What the weights of a sample's tokens look like, per class; documents and vector pooling."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphmill.functions.cells import EVENT_TYPES


def token_evidence(tokens: DataFrame, long_weights: DataFrame, extra: tuple[str, ...] = (), keys: tuple[str, ...] = ("token",)) -> DataFrame:
    """(sid, token, cls, w): one row per weighted token and class; ``keys`` may add a fold, so that each sample meets weights of the other folds."""
    return tokens.join(long_weights.select(*keys, "cls", "w", *extra), list(keys))


def evidence_shape(evidence: DataFrame) -> DataFrame:
    """(sid, cls): thirteen summaries of the signed token weights.

    Entropy of the absolute shares comes from two sums (ln S - sum(a ln a)/S); only the three largest
    absolute values need an order, which a streaming rank gives.
    """
    w, a = F.col("w"), F.abs("w")
    order = Window.partitionBy("sid", "cls").orderBy(F.desc("a"), "token")
    ranked = evidence.withColumn("a", a).withColumn("r", F.row_number().over(order))
    total = F.sum("a")
    safe = F.nullif(total, F.lit(0.0))
    xlogx = F.sum(F.when(F.col("a") > 0, F.col("a") * F.log("a")).otherwise(0.0))
    zero = F.lit(0.0)
    return ranked.groupBy("sid", "cls").agg(
        F.sum("w").alias("sum_all"),
        F.coalesce(F.sum(F.when(w > 0, w)), zero).alias("sum_positive"),
        F.coalesce(F.sum(F.when(w < 0, w)), zero).alias("sum_negative"),
        F.coalesce(F.max(F.when(w > 0, w)), zero).alias("max_positive"),
        F.coalesce(F.min(F.when(w < 0, w)), zero).alias("min_negative"),
        F.count_if(w > 0).alias("n_positive"),
        F.count_if(w < 0).alias("n_negative"),
        total.alias("sum_absolute"),
        F.coalesce(F.max("a") / safe, zero).alias("top1_share"),
        F.coalesce(F.sum(F.when(F.col("r") <= 3, F.col("a"))) / safe, zero).alias("top3_share"),
        F.coalesce(F.log(safe) - xlogx / safe, zero).alias("entropy"),
        (F.sum("w") - F.max(F.when(F.col("r") == 1, w))).alias("sum_without_dominant"),
        F.count(F.lit(1)).alias("n_tokens"),
    )


def reliability_shape(evidence: DataFrame) -> DataFrame:
    """(sid, cls): nine summaries with support reliability; entropy scaled by ln(max(n, 2))."""
    w, a = F.col("w"), F.abs("w")
    order = Window.partitionBy("sid", "cls").orderBy(F.desc("a"), "token")
    ranked = evidence.withColumn("a", a).withColumn("r", F.row_number().over(order))
    total = F.sum("a")
    safe = F.nullif(total, F.lit(0.0))
    xlogx = F.sum(F.when(F.col("a") > 0, F.col("a") * F.log("a")).otherwise(0.0))
    zero = F.lit(0.0)
    scale = F.log(F.greatest(F.count(F.lit(1)), F.lit(2)).cast("double"))
    return ranked.groupBy("sid", "cls").agg(
        F.coalesce(F.sum(F.when(w > 0, w)), zero).alias("sum_positive"),
        F.coalesce(F.sum(F.when(w < 0, w)), zero).alias("sum_negative"),
        total.alias("sum_absolute"),
        F.coalesce(F.max(F.when(w > 0, w)), zero).alias("max_positive"),
        F.coalesce(F.min(F.when(w < 0, w)), zero).alias("min_negative"),
        F.coalesce(F.max("a") / safe, zero).alias("top1_share"),
        F.coalesce(F.sum(F.when(F.col("r") <= 3, F.col("a"))) / safe, zero).alias("top3_share"),
        F.coalesce((F.log(safe) - xlogx / safe) / scale, zero).alias("scaled_entropy"),
        F.sum(F.col("a") * F.col("reliability")).alias("reliable_absolute"),
    )


def score_shape(scores: DataFrame) -> DataFrame:
    """(sid): six summaries over the class scores of a row."""
    s = F.col("score")
    return scores.groupBy("sid").agg(
        F.sum(F.greatest(s, F.lit(0.0))).alias("positive_sum"),
        F.sum(F.least(s, F.lit(0.0))).alias("negative_sum"),
        F.sum(F.abs(s)).alias("absolute_sum"),
        F.max(F.greatest(s, F.lit(0.0))).alias("positive_max"),
        F.min(F.least(s, F.lit(0.0))).alias("negative_min"),
        F.max(F.abs(s)).alias("absolute_max"),
    )


def candidate_shape(prob: DataFrame, shape: DataFrame, priors: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The thirteen evidence summaries plus six of the probability table: nineteen per (sid, cls).

    ``by``: columns of ``prob`` (a fold) that say which of the priors belong to a sample.
    """
    w = Window.partitionBy("sid").orderBy(F.desc("p"), "cls")
    every = Window.partitionBy("sid")
    ranked = prob.withColumn("probability_rank", F.row_number().over(w))
    top1 = F.max(F.when(F.col("probability_rank") == 1, F.col("p"))).over(every)
    top2 = F.max(F.when(F.col("probability_rank") == 2, F.col("p"))).over(every)
    base = ranked.select(
        "sid", *by, "cls", "p", F.log(F.greatest("p", F.lit(1e-12))).alias("log_p"), "probability_rank",
        (top1 - F.col("p")).alias("gap_to_top"), (top1 - top2).alias("margin"))
    summaries = [c for c in shape.columns if c not in ("sid", "cls")]
    return base.join(shape, ["sid", "cls"], "left").na.fill(0, summaries).join(priors, [*by, "cls"])


def event_evidence(typed: DataFrame, counts: DataFrame, burden: DataFrame, classes: list[str], keys: tuple[str, ...] = ("token",)) -> DataFrame:
    """One row per (sid, gene, event, cls) with the contribution of its gene-type token; zero where the token has no weight.

    ``keys`` may add a fold that the events and the weights carry.
    """
    keyed = typed.withColumn("token", F.concat_ws("__", "gene", "event_type"))
    joined = keyed.join(counts.select(*keys, "w", "support"), list(keys), "left").join(burden, "sid")
    zipped = F.explode(F.arrays_zip(
        F.array(*[F.lit(c) for c in classes]).alias("cls"),
        F.coalesce("w", F.array(*[F.lit(0.0)] * len(classes))).alias("w")))
    x = joined.select("sid", "gene", "event", "event_type", "mutated_genes",
                      F.coalesce("support", F.lit(0)).alias("support"), zipped.alias("x"))
    w = F.col("x.w")
    return x.select(
        "sid", "gene", "event", F.col("x.cls").alias("cls"),
        w.alias("contribution"), F.abs(w).alias("absolute"), F.log1p("support").alias("log_support"),
        (F.col("support") / (F.col("support") + 20.0)).alias("reliability"),
        (w > 0).cast("int").alias("is_positive"), (w < 0).cast("int").alias("is_negative"),
        (w / F.sqrt(F.greatest("mutated_genes", F.lit(1)).cast("double"))).alias("per_burden"),
        (F.col("event") != "").cast("int").alias("has_allele"),
        (F.col("support") >= 5).cast("int").alias("is_supported"),
        *[(F.col("event_type") == k).cast("int").alias("is_" + k.lower()) for k in EVENT_TYPES],
    )


def event_summary(scored: DataFrame, value: str = "e", ties: tuple[str, ...] = ("gene", "event")) -> DataFrame:
    """(sid, cls): sum, maximum and sum of the two largest event scores."""
    w = Window.partitionBy("sid", "cls").orderBy(F.desc(value), *ties)
    ranked = scored.withColumn("_r", F.row_number().over(w))
    return ranked.groupBy("sid", "cls").agg(
        F.sum(value).alias("sum_evidence"), F.max(value).alias("max_evidence"),
        F.sum(F.when(F.col("_r") <= 2, F.col(value))).alias("top2_evidence"))


def event_documents(typed: DataFrame) -> DataFrame:
    """(sid, token, tf): gene, exact event, type and substitution terms of a sample."""
    changed = F.col("ref").isNotNull() & F.col("alt").isNotNull() & (F.col("ref") != F.col("alt"))
    terms = F.array(
        F.concat(F.lit("G__"), F.col("gene")),
        F.concat(F.lit("E__"), F.col("gene"), F.lit("__"), F.col("event")),
        F.concat(F.lit("TYPE__"), F.col("event_type")),
        F.when(changed, F.concat(F.lit("AA__"), F.col("ref"), F.lit("_"), F.col("alt"))),
    )
    long = typed.select("sid", F.explode(terms).alias("token")).filter(F.col("token").isNotNull())
    return long.groupBy("sid", "token").agg(F.count(F.lit(1)).alias("tf"))


def tf_idf(documents: DataFrame, n_documents: Column, min_df: int = 3) -> DataFrame:
    """Sublinear tf, smooth idf ln((1+n)/(1+df))+1, unit length per row."""
    df = documents.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= min_df)
    idf = F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0
    raw = documents.join(df, "token").withColumn("n", n_documents).select(
        "sid", "token", ((1.0 + F.log(F.col("tf").cast("double"))) * idf).alias("v"))
    norms = raw.groupBy("sid").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return raw.join(norms, "sid").select("sid", "token", (F.col("v") / F.col("norm")).alias("weight"))


def pool_vectors(vectors: DataFrame, group: str, array: str) -> DataFrame:
    """(group, dim): mean and maximum per dimension and log1p of the vector count."""
    long = vectors.select(group, F.posexplode(array).alias("dim", "x"))
    return long.groupBy(group, "dim").agg(
        F.avg(F.col("x").cast("double")).alias("mean"), F.max("x").cast("double").alias("max"),
        F.log1p(F.count(F.lit(1))).alias("log_count"))
