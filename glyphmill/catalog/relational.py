"""Relational forms, sources and sinks."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from glyphmill.catalog.base import query, r6
from glyphmill.functions.cells import EVENT_TYPES
from glyphmill.operators import metrics as me, ranks, relational as rel, rollups as ru
from glyphmill.sources import tables


def _round(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _n():
    return F.count(F.lit(1))


# Joins ----------------------------------------------------------------------------------------


@query("j1_events_with_labels", "select label, gene, count(*) as n from events join samples using (sid) group by 1, 2")
def _(fx):
    return fx.events.join(fx.samples, "sid").groupBy("label", "gene").agg(_n().alias("n"))


@query("j2_left_join_delta", f"""with b as (select lang, avg(quality) as base from documents join labels using (doc_id) group by 1), s as (select source, lang, count(*) as docs, avg(quality) as q from documents left join labels
 using (doc_id) group by 1, 2) select source, lang, docs, {r6('q')} as quality, {r6('q - base')} as delta from s left join b using (lang)""")
def _(fx):
    docs, labels = fx.t("documents").select("doc_id", "lang", "source"), fx.t("labels").select("doc_id", "quality")
    base = docs.join(labels, "doc_id").groupBy("lang").agg(F.avg("quality").alias("base"))
    by = docs.join(labels, "doc_id", "left").groupBy("source", "lang").agg(_n().alias("docs"), F.avg("quality").alias("quality"))
    return _round(by.join(base, "lang", "left").withColumn("delta", F.col("quality") - F.col("base")).drop("base"), "quality", "delta")


@query("j3_one_to_one_join", "select doc_id, lang, quality, toxic from documents join labels using (doc_id)")
def _(fx):
    return rel.join_one_to_one(fx.t("documents").select("doc_id", "lang"), fx.t("labels").select("doc_id", "quality", "toxic"), ["doc_id"])


@query("j5_semi_joins", """with top as (select gene, event from events group by 1, 2 having count(*) >= 4) select sid, gene, event from events where (gene, event) in (select gene, event from top) and gene in ('Brand#1', 'Brand#2', 'Brand#3')""")
def _(fx):
    top = fx.events.groupBy("gene", "event").agg(_n().alias("n")).filter("n >= 4")
    picked = fx.events.filter(F.col("gene").isin("Brand#1", "Brand#2", "Brand#3"))
    return picked.join(top, ["gene", "event"], "left_semi").select("sid", "gene", "event")


@query("j6_unseen_tokens", """with tr as (select distinct token from tok_exact join folds using (sid) where fold <> 0), ap as (select sid, token from tok_exact join folds using (sid) where fold = 0) select sid, count(*) as unseen from ap where
 token not in (select token from tr) group by 1""")
def _(fx):
    placed = fx.tokens("exact").join(fx.folds().select("sid", "fold"), "sid")
    seen = placed.filter("fold <> 0").select("token").distinct()
    return placed.filter("fold = 0").join(seen, "token", "left_anti").groupBy("sid").agg(_n().alias("unseen"))


@query("j7_vocabulary_lookup", """with v as (select token, count(*) as df from tok_exact group by 1 having count(*) >= 3) select sid, count(*) as known, cast(sum(df) as bigint) as df_sum from tok_exact join v using (token) group by 1""")
def _(fx):
    tokens = fx.tokens("exact")
    vocabulary = tokens.groupBy("token").agg(_n().alias("df")).filter("df >= 3")
    return rel.lookup(tokens, vocabulary, "token").groupBy("sid").agg(_n().alias("known"), F.sum("df").alias("df_sum"))


@query("j8_class_pairs", "select a.cls as class_a, b.cls as class_b, a.cls_n + b.cls_n as rows, abs(a.cls_n - b.cls_n) as gap from csize a join csize b on a.cls < b.cls")
def _(fx):
    sizes = fx.samples.groupBy(F.col("label").alias("cls")).agg(_n().alias("n"))
    return rel.class_pairs(sizes, "cls").select(
        F.col("x.cls").alias("class_a"), F.col("y.cls").alias("class_b"), (F.col("x.n") + F.col("y.n")).alias("rows"),
        F.abs(F.col("x.n") - F.col("y.n")).alias("gap"))


@query("s1_s2_stacked_tables", "select case when fold = 0 then 'apply' else 'fit' end as split, gene, count(*) as n from events join folds using (sid) group by 1, 2")
def _(fx):
    placed = fx.events.join(fx.folds().select("sid", "fold"), "sid")
    stacked = rel.stack(placed.filter("fold <> 0"), placed.filter("fold = 0"))
    return stacked.groupBy("split", "gene").agg(_n().alias("n"))


@query("s3_vocabulary_overlap", """with p as (select distinct fold = 0 as ap, token from tok_exact join folds using (sid)), f as (select token from p where not ap), a as (select token from p where ap) select (select count(*) from (select * from f
 intersect select * from a)) as shared, (select count(*) from (select * from a except select * from f)) as apply_only, (select count(*) from (select * from f except select * from a)) as fit_only""")
def _(fx):
    placed = fx.tokens("exact").join(fx.folds().select("sid", "fold"), "sid")
    fit, ap = placed.filter("fold <> 0").select("token").distinct(), placed.filter("fold = 0").select("token").distinct()
    parts = fit.intersect(ap).select(F.lit("shared").alias("k")).unionByName(ap.exceptAll(fit).select(F.lit("apply_only").alias("k"))).unionByName(
        fit.exceptAll(ap).select(F.lit("fit_only").alias("k")))
    return parts.agg(*[F.count_if(F.col("k") == k).alias(k) for k in ("shared", "apply_only", "fit_only")])


@query("d1_distinct_keys", "select distinct sid, gene, event_type from typed")
def _(fx):
    return fx.typed.select("sid", "gene", "event_type").dropDuplicates(["sid", "gene", "event_type"])


@query("d2_best_per_family", """select lang, source, docs, chars from (select *, row_number() over (partition by lang order by chars desc, source) as rn from (select lang, source, count(*) as docs, cast(sum(n_chars) as bigint) as chars from documents
 group by 1, 2) y) z where rn = 1""")
def _(fx):
    board = fx.t("documents").groupBy("lang", "source").agg(_n().alias("docs"), F.sum("n_chars").alias("chars"))
    return rel.best_per_family(board, "lang", [F.desc("chars"), "source"])


@query("t1_top_k_stable", "select gene, event, count(*) as n, count(distinct sid) as samples from events group by 1, 2 order by 3 desc, 4 desc, 1, 2 limit 25")
def _(fx):
    got = fx.events.groupBy("gene", "event").agg(_n().alias("n"), F.count("sid").alias("samples"))  # events are distinct, so a sample has one once
    return got.orderBy(F.desc("n"), F.desc("samples"), "gene", "event").limit(25)


@query("t2_top_k_per_class", """select label, gene, n, cast(rn as int) as rank from (select *, row_number() over (partition by label order by n desc, gene) as rn from (select label, gene, count(*) as n from tok_gene t join samples using (sid) join (select distinct token,
 token as gene from tok_gene) g using (token) group by 1, 2) y) z where rn <= 10""")
def _(fx):
    counts = ru.gene_presence(fx.events).join(fx.samples, "sid").groupBy("label", "gene").agg(_n().alias("n"))
    return ru.top_per_group(counts, ["label"], [F.desc("n"), "gene"], 10)


@query("t3_global_largest", "select c_custkey as sid, c_acctbal as balance from customer order by c_acctbal desc, c_custkey limit 20")
def _(fx):
    return fx.t("customer").select(F.col("c_custkey").alias("sid"), F.col("c_acctbal").alias("balance")).orderBy(F.desc("balance"), "sid").limit(20)


# Group-bys ------------------------------------------------------------------------------------


@query("g1_named_aggregates", f"""select o_orderpriority as priority, count(*) as n, {r6('avg(o_totalprice)')} as mean, {r6('median(o_totalprice)')} as median, min(o_totalprice) as low, max(o_totalprice) as high, {r6('stddev_samp(o_totalprice)')} as std,
 count(distinct o_custkey) as customers, bool_and(o_totalprice > 0) as all_positive from orders group by 1""")
def _(fx):
    o = fx.t("orders").withColumnRenamed("o_orderpriority", "priority")
    basic = o.groupBy("priority").agg(
        _n().alias("n"), F.round(F.avg("o_totalprice"), 6).alias("mean"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"),
        F.round(F.stddev_samp("o_totalprice"), 6).alias("std"), F.count_distinct("o_custkey").alias("customers"),
        F.bool_and(F.col("o_totalprice") > 0).alias("all_positive"))
    from glyphmill.operators.ranks import exact_quantiles
    q = exact_quantiles(o.select("priority", "o_orderkey", "o_totalprice"), ["priority"], "o_totalprice", [0.5], F.md5(F.col("o_orderkey").cast("string")), ["o_orderkey"])
    return basic.join(q.select("priority", F.round("value", 6).alias("median")), "priority")


@query("g2_two_level_rollup", f"""with g as (select sid, gene, count(*) as k from events group by 1, 2) select sid, count(*) as genes, cast(sum(k) as bigint) as events, max(k) as most, {r6('avg(k)')} as mean from g group by 1""")
def _(fx):
    per = fx.events.groupBy("sid", "gene").agg(_n().alias("k"))
    return per.groupBy("sid").agg(_n().alias("genes"), F.sum("k").alias("events"), F.max("k").alias("most"), F.round(F.avg("k"), 6).alias("mean"))


_CT = ", ".join(f"count(*) filter (event_type = '{k}') as \"{k}\"" for k in EVENT_TYPES)


@query("g3_crosstab", f"select label, {_CT} from typed join samples using (sid) group by 1")
def _(fx):
    return rel.crosstab(fx.typed.join(fx.samples, "sid"), "label", "event_type", list(EVENT_TYPES))


@query("g4_row_normalised_crosstab", f"with c as (select label, {_CT}, count(*) as n from typed join samples using (sid) group by 1) select label, " + ", ".join(
    f"{r6(f'coalesce({k} / nullif(cast(n as double), 0), 0)')} as {k}" for k in EVENT_TYPES) + " from c")
def _(fx):
    got = rel.row_shares(rel.crosstab(fx.typed.join(fx.samples, "sid"), "label", "event_type", list(EVENT_TYPES)), list(EVENT_TYPES))
    return _round(got, *EVENT_TYPES)


@query("g5_value_counts", f"select source, count(*) as n, {r6('count(*) / sum(count(*)) over ()')} as share from documents group by 1")
def _(fx):
    counts = fx.t("documents").groupBy("source").agg(_n().alias("n"))
    total = fx.t("documents").agg(_n()).scalar()
    return counts.withColumn("share", F.round(F.col("n") / total, 6)).orderBy(F.desc("n"), "source")


@query("g6_pivot_metrics", """select o_orderpriority as priority, count(*) filter (o_orderstatus = 'F') as f, count(*) filter (o_orderstatus = 'O') as o, count(*) filter (o_orderstatus = 'P') as p from orders group by 1""")
def _(fx):
    o = fx.t("orders").groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderstatus", ["F", "O", "P"]).agg(_n())
    return o.na.fill(0).select("priority", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("g7_g8_describe", f"""with g as (select sid, count(*) as k from events group by 1) select label, count(k) as count, {r6('avg(k)')} as mean, {r6('stddev_samp(k)')} as std, cast(min(k) as double) as min, {r6('quantile_cont(k, 0.25)')} as q25,
 {r6('quantile_cont(k, 0.5)')} as median, {r6('quantile_cont(k, 0.75)')} as q75, cast(max(k) as double) as max from g join samples using (sid) group by 1""")
def _(fx):
    per = fx.events.groupBy("sid").agg(_n().alias("k")).join(fx.samples, "sid")
    got = rel.describe(per, ["label"], "k", F.md5(F.col("sid").cast("string")), ["sid"])
    return _round(got, "mean", "std", "q25", "median", "q75")


@query("g9_histogram_buckets", """with g as (select sid, count(*) as k from events group by 1) select case when k <= 1 then '1' when k <= 2 then '2' when k <= 5 then '3-5' when k <= 10 then '6-10' when k <= 40 then '11-40' else '41+' end as bucket,
 count(*) as n from g group by 1""")
def _(fx):
    per = fx.events.groupBy("sid").agg(_n().alias("k"))
    label = rel.bucket(F.col("k"), [1, 2, 5, 10, 40], ["1", "2", "3-5", "6-10", "11-40", "41+"])
    return per.groupBy(label.alias("bucket")).agg(_n().alias("n"))


@query("g10_weighted_average", f"select l_returnflag as flag, {r6('sum(l_discount * l_quantity) / sum(l_quantity)')} as weighted_discount from lineitem group by 1")
def _(fx):
    return fx.t("lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 6).alias("weighted_discount"))


@query("g11_correlations", f"""with p as (select s.sid, count(distinct gene) as genes, count(event) as events, c_acctbal as balance from samples s join customer on c_custkey = s.sid left join events e on e.sid = s.sid group by 1, 4) select
 {r6('corr(genes, events)')} as genes_events, {r6('corr(genes, balance)')} as genes_balance, {r6('corr(events, balance)')} as events_balance from p""")
def _(fx):
    p = ru.sample_profile(fx.typed, fx.samples).join(fx.t("customer").select(F.col("c_custkey").alias("sid"), F.col("c_acctbal").alias("balance")), "sid")
    pairs = (("mutated_genes", "events", "genes_events"), ("mutated_genes", "balance", "genes_balance"), ("events", "balance", "events_balance"))
    return p.agg(*[F.round(F.corr(a, b), 6).alias(n) for a, b, n in pairs])


@query("w5_share_of_group", f"select label, gene, {r6('count(*) / cast(sum(count(*)) over (partition by label) as double)')} as share from events join samples using (sid) group by label, gene")
def _(fx):
    counts = fx.events.join(fx.samples, "sid").groupBy("label", "gene").agg(_n().alias("n"))
    w = Window.partitionBy("label")  # genes of a label: bounded by the columns of the table
    return counts.select("label", "gene", F.round(F.col("n") / F.sum("n").over(w), 6).alias("share"))


@query("x1_explode_cells", "select sid, gene, unnest(string_split(upper(replace(cell, 'p.', '')), ';')) as event from cells")
def _(fx):
    from glyphmill.functions.cells import normalise_cell
    return fx.cells.select("sid", "gene", F.explode(normalise_cell(F.col("cell"))).alias("event"))


# Sources and sinks ----------------------------------------------------------------------------


@query("io1_io5_csv_roundtrip", "select c_custkey as sid, c_name as name, c_mktsegment as label from customer")
def _(fx):
    """Write a header CSV in a fixed order, read it back as strings, and hand out what was read."""
    out = fx.t("customer").select(F.col("c_custkey").alias("sid"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("label"))
    path = tables.scratch_path(fx.spark, "customer_csv")
    tables.write_csv_ordered(out, path, ["sid"])
    if tables.roundtrip_difference(fx.spark, out, path):
        raise ValueError("written and read rows differ")
    back = tables.read_wide_csv(fx.spark, path, out.columns)
    return back.select(F.col("sid").cast("bigint").alias("sid"), "name", "label")


_WIDE = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("io7_export_probabilities", "select sid, label, fold, " + ", ".join(f"{r6(f'''max(p) filter (cls = '{c}')''')} as prob_{c}" for c in _WIDE) + " from pr1 join folds using (sid, label) group by 1, 2, 3")
def _(fx):
    prob = ranks.by_rows(fx.prob(["a"]), fx.folds().select("sid", "fold"), ["sid"])
    got = tables.export_probabilities(prob, ["sid", "label", "fold"], fx.classes)
    return _round(got, *[f"prob_{c}" for c in fx.classes])


@query("io8_import_probabilities", f"select sid, cls, {r6('round(p, 3) / sum(round(p, 3)) over (partition by sid)')} as p from pr1")
def _(fx):
    wide = tables.export_probabilities(fx.prob(["a"]), ["sid", "label"], fx.classes)
    rounded = wide.select("sid", "label", *[F.round(f"prob_{c}", 3).alias(f"prob_{c}") for c in fx.classes])
    return _round(tables.import_probabilities(rounded, ["sid"], fx.classes), "p")


@query("io9_probability_families", "select variant as family, count(distinct cls) as n_classes from pr2 group by 1 having count(distinct cls) = (select count(*) from classes)")
def _(fx):
    """Families found in the column names of a wide export; a family must cover every class."""
    prob = fx.prob(["a", "b"], 400)
    named = prob.withColumn("name", F.concat_ws("__", "variant", "cls"))
    names = named.select("name").distinct()
    classes = F.array(*[F.lit(c) for c in fx.classes])
    parts = names.select(F.regexp_extract("name", "^(.*)__[^_]+$", 1).alias("family"), F.regexp_extract("name", "([^_]+)$", 1).alias("cls"))
    covered = parts.filter(F.array_contains(classes, F.col("cls"))).groupBy("family").agg(F.count_distinct("cls").alias("n_classes"))
    return covered.filter(F.col("n_classes") == len(fx.classes))


@query("io10_submission_table", "select s.sid, pred as label from samples s left join (select sid, arg_max(cls, (p, -o)) as pred from (select *, dense_rank() over (order by cls) as o from pr1) z group by 1) p using (sid)")
def _(fx):
    pred = me.predictions(fx.prob(["a"])).select("sid", F.col("pred").alias("label"))
    return tables.labelled_template(fx.samples.select("sid"), pred, "sid")


@query("io10b_template_order", """select s.sid, pred as label, row_number() over (order by md5(s.sid::varchar), s.sid) - 1 as place from samples s join (select sid, arg_max(cls, (p, -o)) as pred from (select *, dense_rank() over (order by cls) as o from pr1) z
 group by 1) p using (sid)""")
def _(fx):
    """A template in shuffled order over several files, labelled, written and read back in that order."""
    path = tables.scratch_path(fx.spark, "template")
    shuffled = fx.samples.select("sid", F.md5(F.col("sid").cast("string")).alias("h"))
    shuffled.repartitionByRange(4, "h", "sid").sortWithinPartitions("h", "sid").select("sid").write.option("header", True).csv(f"{path}/in")
    template = tables.read_placed(fx.spark, f"{path}/in").withColumn("sid", F.col("sid").cast("bigint"))
    pred = me.predictions(fx.prob(["a"])).select("sid", F.col("pred").alias("label"))
    back = tables.write_template(tables.checked_template(template, pred, "sid"), f"{path}/out", "sid")
    return back.select(F.col("sid").cast("bigint").alias("sid"), "label", "place")


@query("io11_leaderboard_upsert", """with o as (select 'exp_' || source as experiment, cast(count(*) as double) as score from documents group by 1), f as (select 'exp_' || source as experiment, cast(max(n_chars) as double) as score from documents where lang = 'fr'
 group by 1 union all select 'exp_new', cast(max(n_chars) as double) from documents) select * from o where experiment not in (select experiment from f) union all select * from f""")
def _(fx):
    docs = fx.t("documents")
    name = F.concat(F.lit("exp_"), F.col("source")).alias("experiment")
    board = docs.groupBy(name).agg(_n().cast("double").alias("score"))
    fresh = docs.filter("lang = 'fr'").groupBy(name).agg(F.max("n_chars").cast("double").alias("score")).unionByName(
        docs.agg(F.max("n_chars").cast("double").alias("score")).select(F.lit("exp_new").alias("experiment"), "score"))
    return tables.upsert(board, fresh, "experiment").orderBy(F.desc("score"), "experiment")
