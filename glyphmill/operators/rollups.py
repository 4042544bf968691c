"""Label-free roll-ups of the long event table.

Most of them share one two-level plan: (sid, gene) partial counts, then (sid).  ``sample_profile`` carries
all of the counters through that plan at once, so burden, type counts, shares and topology cost one pass.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphmill.functions.cells import AMINO, EVENT_TYPES, TRUNCATING, amino_pair, first_integer, position_range

BURDEN = ["mutated_genes", "events", "multi_event_genes"]


def type_col(kind: str) -> str:
    return f"n_{kind.lower()}"


TYPE_COUNTS = [type_col(k) for k in EVENT_TYPES]


def gene_presence(events: DataFrame) -> DataFrame:
    return events.select("sid", "gene").distinct()


def truncating_presence(typed: DataFrame) -> DataFrame:
    return gene_presence(typed.filter(F.col("event_type").isin(*TRUNCATING)))


def gene_profile(typed: DataFrame) -> DataFrame:
    """Per (sid, gene): events and one counter per event type."""
    return typed.groupBy("sid", "gene").agg(
        F.count(F.lit(1)).alias("n_events"),
        *[F.count_if(F.col("event_type") == k).alias(type_col(k)) for k in EVENT_TYPES],
    )


def sample_profile(typed: DataFrame, samples: DataFrame) -> DataFrame:
    """One row per sample with every burden, type and topology counter; zeros where a sample has no event."""
    per_gene = gene_profile(typed)
    truncating = reduce(Column.__add__, [F.col(type_col(k)) for k in TRUNCATING])
    types_here = reduce(Column.__add__, [(F.col(c) > 0).cast("int") for c in TYPE_COUNTS])
    n = F.col("n_events")
    rolled = per_gene.groupBy("sid").agg(
        F.count(F.lit(1)).alias("mutated_genes"),
        F.sum("n_events").alias("events"),
        F.count_if(n > 1).alias("multi_event_genes"),
        *[F.sum(c).alias(c) for c in TYPE_COUNTS],
        F.count_if(truncating > 0).alias("truncating_genes"),
        F.sum(truncating).alias("truncating_events"),
        F.count_if(n == 1).alias("one_event_genes"),
        F.count_if(n == 2).alias("two_event_genes"),
        F.count_if(n >= 3).alias("three_plus_genes"),
        F.count_if(types_here >= 2).alias("multi_type_genes"),
        F.max("n_events").alias("max_events"),
    )
    counters = [c for c in rolled.columns if c != "sid"]
    full = samples.select("sid").join(rolled, "sid", "left").na.fill(0, counters)
    shares = [safe_divide(F.col(c), F.col("events")) for c in TYPE_COUNTS]
    entropy = reduce(Column.__add__, [F.when(s > 0, -s * F.log(s)).otherwise(0.0) for s in shares])
    return full.withColumns({
        "type_diversity": reduce(Column.__add__, [(F.col(c) > 0).cast("bigint") for c in TYPE_COUNTS]),
        "type_entropy": entropy,
        "dominant_share": F.greatest(*shares),
    })


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """Zero where the denominator is zero."""
    return F.coalesce(numerator / F.nullif(denominator, F.lit(0).cast("bigint")), F.lit(0.0))


def type_shares(profile: DataFrame) -> DataFrame:
    return profile.select("sid", *[safe_divide(F.col(c), F.col("events")).alias("share_" + c[2:]) for c in TYPE_COUNTS])


def profile_ratios(profile: DataFrame) -> DataFrame:
    genes = F.col("mutated_genes")
    return profile.select(
        "sid",
        safe_divide(F.col("events"), genes).alias("events_per_gene"),
        safe_divide(F.col("multi_event_genes"), genes).alias("multi_event_share"),
        safe_divide(F.col("truncating_genes"), genes).alias("truncating_share"),
    )


def log1p_counts(profile: DataFrame, columns: list[str]) -> DataFrame:
    return profile.select("sid", *[F.log1p(c).alias("log_" + c) for c in columns])


COUNT_BINS = ((0, 0), (1, 1), (2, 2), (3, 4), (5, 7), (8, None))


def count_bins(profile: DataFrame, columns: list[str], with_zero: bool = False) -> DataFrame:
    """One indicator per (column, fixed count range)."""
    out = []
    for name in columns:
        for low, high in COUNT_BINS[0 if with_zero else 1:]:
            label = f"{name}_{low}" + ("" if low == high else "_plus" if high is None else f"_{high}")
            hit = F.col(name) >= low if high is None else F.col(name).between(low, high)
            out.append(hit.cast("int").alias(label))
    return profile.select("sid", *out)


def letter_counts(typed: DataFrame) -> DataFrame:
    """Long (sid, kind, key, n): reference letters, alternative letters, pairs and position ranges."""
    letters = list(AMINO)
    keys = F.array(
        F.struct(F.lit("ref").alias("kind"), F.when(F.col("ref").isin(letters), F.col("ref")).alias("key")),
        F.struct(F.lit("alt").alias("kind"), F.when(F.col("alt").isin(letters), F.col("alt")).alias("key")),
        F.struct(F.lit("pair").alias("kind"), amino_pair(F.col("ref"), F.col("alt")).alias("key")),
        F.struct(F.lit("range").alias("kind"), position_range(F.col("position")).cast("string").alias("key")),
    )
    subs = typed.filter(F.col("ref").isNotNull() & F.col("alt").isNotNull() & F.col("position").isNotNull())
    long = subs.select("sid", F.explode(keys).alias("x")).select("sid", "x.kind", "x.key")
    return long.filter(F.col("key").isNotNull()).groupBy("sid", "kind", "key").agg(F.count(F.lit(1)).alias("n"))


def position_topology(typed: DataFrame, samples: DataFrame) -> DataFrame:
    """Count, genes, types, largest type count and share, mean and population deviation of positions."""
    position = first_integer(F.col("event"))
    per_type = typed.groupBy("sid", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count(position).alias("np"),
        F.sum(position).alias("s1"), F.sum(position * position).alias("s2"),
    )
    genes = gene_presence(typed).groupBy("sid").agg(F.count(F.lit(1)).alias("genes"))
    mean = safe_divide(F.col("s1"), F.col("np"))
    rolled = per_type.groupBy("sid").agg(
        F.sum("n").alias("events"), F.count(F.lit(1)).alias("types"), F.max("n").alias("max_type"),
        F.sum("np").alias("np"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"),
    ).join(genes, "sid")
    full = samples.select("sid").join(rolled, "sid", "left").na.fill(0)
    variance = safe_divide(F.col("s2"), F.col("np")) - mean * mean
    return full.select(
        "sid", "events", "genes", "types", "max_type",
        safe_divide(F.col("max_type"), F.col("events")).alias("max_type_share"),
        mean.alias("mean_position"),
        F.sqrt(F.greatest(variance, F.lit(0.0))).alias("std_position"),
        F.col("np").alias("positions"),
    )


def architecture_tokens(typed: DataFrame) -> DataFrame:
    """Distinct (sid, token) that describe how several events of one gene lie together."""
    per_gene = typed.groupBy("sid", "gene").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("event_type") == "MISSENSE").alias("missense"),
        F.count_if(F.col("event_type").isin(*TRUNCATING)).alias("truncating"),
        F.min("event_type").alias("t_min"), F.max("event_type").alias("t_max"),
        F.count("position").alias("positions"), F.count_distinct("position").alias("distinct_positions"),
    ).filter(F.col("n") >= 2)
    flags = [
        ("EVENT_COUNT_2PLUS", F.col("n") >= 2),
        ("EVENT_COUNT_3PLUS", F.col("n") >= 3),
        ("MULTI_MISSENSE", F.col("missense") >= 2),
        ("MISSENSE_PLUS_TRUNCATING", (F.col("missense") >= 1) & (F.col("truncating") >= 1)),
        ("MULTI_FUNCTIONAL_TYPE", F.col("t_min") != F.col("t_max")),
        ("SAME_POSITION_MULTI_EVENT", (F.col("positions") >= 2) & (F.col("distinct_positions") < F.col("positions"))),
    ]
    names = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in flags]), lambda x: x.isNotNull())
    return per_gene.select("sid", "gene", F.explode(names).alias("flag")).select(
        "sid", F.concat_ws("__", "gene", "flag").alias("token")
    )


def multi_event_support(typed: DataFrame) -> DataFrame:
    """(sid, gene) with at least two events: count, shared codon, span of positions (null below two)."""
    position = first_integer(F.col("event"))
    got = typed.groupBy("sid", "gene").agg(
        F.count(F.lit(1)).alias("event_count"), F.count(position).alias("np"), F.count_distinct(position).alias("dp"),
        (F.max(position) - F.min(position)).alias("span"),
    ).filter(F.col("event_count") >= 2)
    return got.select(
        "sid", "gene", "event_count", (F.col("dp") < F.col("np")).alias("same_codon"),
        F.when(F.col("np") >= 2, F.col("span")).alias("position_span"),
    )


def row_pairs(presence: DataFrame) -> DataFrame:
    """(sid, gene_a < gene_b): every pair of genes of a sample, made inside the sample's own row."""
    rows = presence.groupBy("sid").agg(F.array_sort(F.collect_set("gene")).alias("genes"))
    first = rows.select("sid", "genes", F.posexplode("genes").alias("i", "gene_a"))
    return first.select("sid", "gene_a", F.explode(F.slice("genes", F.col("i") + 2, F.size("genes"))).alias("gene_b"))


def gene_pairs(presence: DataFrame, min_support: int = 1) -> DataFrame:
    """(gene_a < gene_b, n): samples in which both occur.

    With a support floor, genes below it are dropped first: a pair is never more frequent than its rarer
    gene, so nothing above the floor is lost.  Pairs are generated inside the sample's own row (a row has
    at most as many genes as the table has columns) and are counted before they are shuffled.
    """
    kept = presence
    if min_support > 1:
        frequent = presence.groupBy("gene").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_support)
        kept = presence.join(frequent.select("gene"), "gene", "left_semi")
    return row_pairs(kept).groupBy("gene_a", "gene_b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_support)


def domain_features(events: DataFrame, samples: DataFrame, groups: dict[str, list[str]],
                    pairs: list[tuple[str, str]], exact: list[tuple[str, str]]) -> DataFrame:
    """Mutated-gene counts of named gene sets, AND of gene pairs, flags of named events; one aggregate."""
    wanted = sorted({g for v in groups.values() for g in v} | {g for p in pairs for g in p} | {g for g, _ in exact})

    def has(gene: str) -> Column:
        return F.coalesce(F.max((F.col("gene") == gene).cast("int")), F.lit(0))

    columns = [reduce(Column.__add__, [has(g) for g in genes]).alias(f"group_{name}") for name, genes in groups.items()]
    columns += [(has(a) * has(b)).alias(f"pair_{i}") for i, (a, b) in enumerate(pairs)]
    columns += [
        F.coalesce(F.max(((F.col("gene") == g) & (F.col("event") == e)).cast("int")), F.lit(0)).alias(f"exact_{i}")
        for i, (g, e) in enumerate(exact)
    ]
    rolled = events.filter(F.col("gene").isin(wanted)).groupBy("sid").agg(*columns)
    return samples.select("sid").join(rolled, "sid", "left").na.fill(0)


def top_per_group(counts: DataFrame, group: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """First k rows of every group in a total order; Spark limits per task before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return counts.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def gene_states(typed: DataFrame, samples: DataFrame, state: Column, per_class: int = 2,
                codon_floor: int = 5, exact_floor: int = 5) -> DataFrame:
    """Functional and recurrence states of the genes most often hit in some class."""
    labelled = gene_presence(typed).join(samples, "sid")
    counts = labelled.groupBy("label", "gene").agg(F.count(F.lit(1)).alias("n"))
    selected = top_per_group(counts, ["label"], [F.desc("n"), "gene"], per_class).select("gene").distinct()
    inside = typed.join(selected, "gene", "left_semi").withColumn(
        "codon", F.regexp_extract("event", "^([A-Z][0-9]+)", 1))
    exact = inside.groupBy("gene", "event", "codon").agg(F.count(F.lit(1)).alias("n"))
    by_codon = exact.filter(F.col("codon") != "").groupBy("gene", "codon").agg(F.sum("n").alias("n_codon"))
    known = (
        exact.filter(F.col("n") >= exact_floor)
        .join(by_codon.filter(F.col("n_codon") >= codon_floor), ["gene", "codon"], "left_semi")
        .select("gene", "event", F.lit(1).alias("known"))
    )
    marked = inside.join(known, ["gene", "event"], "left").withColumn("state", state)
    flags = marked.groupBy("sid", "gene").agg(
        *[F.max((F.col("state") == s).cast("int")).alias(s) for s in ("missense_like", "truncating", "other")],
        F.coalesce(F.max("known"), F.lit(0)).alias("known_recurrent"),
        (F.count(F.lit(1)) >= 2).cast("int").alias("multi_hit"),
    )
    return flags.withColumn("other_mutation", 1 - F.col("known_recurrent"))
