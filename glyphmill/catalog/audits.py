"""Contracts, coverage, segments and exploratory tables."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from glyphmill.catalog.base import query, r6
from glyphmill.catalog.cells import _CANON
from glyphmill.catalog.metrics import _AB, _PW, _preds
from glyphmill.catalog.probs import _cm_sql
from glyphmill.operators import audits as au, metrics as me, probs as pr, ranks, relational as rel, rollups as ru
from glyphmill.operators.ranks import exact_quantiles
from glyphmill.sources import tables


def _round(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _n():
    return F.count(F.lit(1))


@query("q1_table_contract", """with d as (select count(*) filter (n > 1) as k from (select sid, count(*) as n from samples group by 1) z), l as (select min(cls_n) as m from csize) select count(*) as rows, count(*) filter (sid is null) as null_keys, count(*)
 filter (label is null) as null_labels, max(d.k) as repeated_keys, max(l.m) as smallest_class, count(*) > 0 and max(d.k) = 0 and max(l.m) >= 5 as valid from samples, d, l""")
def _(fx):
    au.require_columns(fx.samples, "sid", "label")
    return au.table_contract(fx.samples)


@query("q2_schema_contract", "select cast(27 as int) as fit_columns, cast(26 as int) as apply_columns, count(*) as rows, true as same_schema, false as swapped_same from samples")
def _(fx):
    """Column lists are compared, order included; rows counted on the pivoted table."""
    wide = fx.wide
    apply = wide.drop("label")
    swapped = apply.select(*reversed(apply.columns))
    return wide.agg(_n().alias("rows")).select(
        F.lit(len(wide.columns)).alias("fit_columns"), F.lit(len(apply.columns)).alias("apply_columns"), "rows",
        F.lit(au.same_schema(wide, apply)).alias("same_schema"), F.lit(au.same_schema(wide, swapped)).alias("swapped_same"))


@query("q3_null_cells_by_column", "select gene, count(*) as cells, count(*) filter (cell is null) as null_cells from raw_cells group by 1")
def _(fx):
    return au.null_cells(fx.raw_cells, ["gene"])


@query("q3_null_cells_by_row", "select sid, count(*) as cells, count(*) filter (cell is null) as null_cells from raw_cells group by 1")
def _(fx):
    return au.null_cells(fx.raw_cells, ["sid"])


_LIVE = "case when upper(trim(cell)) in ('', 'WT') then '' else coalesce(cell, '') end"


@query("q4_q5_cell_audit", f"""with s as (select cell, events, {_LIVE} as live from segs), u as (select count(*) as parsed_events, count(*) filter (k = 'UNKNOWN') as unknown_events from (select {_CANON} as k from sev) z), a as (select count(*) as cells,
 count(*) filter (cell is null) as null_cells, count(*) filter (upper(trim(cell)) in ('', 'WT')) as reference_cells, count(*) filter (len(events) > 1) as multi_event_cells, cast(sum(len(events)) as bigint) as segments, cast(sum(length(live) -
 length(replace(live, ';', ''))) as bigint) as semicolons, cast(sum(length(live) - length(replace(live, '|', ''))) as bigint) as bars, cast(sum(length(live) - length(replace(live, ',', ''))) as bigint) as commas, cast(sum(length(live) -
 length(replace(live, '/', ''))) as bigint) as slashes, count(*) filter (cell is null and len(events) > 0) as null_as_event from s) select a.*, u.*, segments = parsed_events as segments_conserved from a, u""")
def _(fx):
    return au.cell_audit(fx.raw_cells)


@query("q4_unknown_patterns", f"select event, count(*) as n from sev where {_CANON} = 'UNKNOWN' group by 1")
def _(fx):
    from glyphmill.functions import cells
    e = fx.raw_cells.select(F.explode(cells.split_grammar(F.col("cell"))).alias("event"))
    return e.filter(cells.canonical14(F.col("event")) == "UNKNOWN").groupBy("event").agg(_n().alias("n"))


@query("q6_probability_contract", "select (select count(distinct (sid, variant)) from pr3) as rows, 0::bigint as not_finite, (select count(*) from (select sid, variant from pr3 group by 1, 2 having abs(sum(p) - 1) > 1e-6) z) as not_normalised, (select count(*) from (select sid, variant"
       " from pr3 group by 1, 2 having count(*) <> 5) z) as wrong_width")
def _(fx):
    return au.probability_contract(fx.prob(["a", "b", "c"], 400), ["sid", "variant"], len(fx.classes))


@query("q8_row_independence", "select (select count(*) from samples where sid % 2 = 0) as rows, 0::bigint as only_in_full, 0::bigint as only_in_part")
def _(fx):
    """Roll-ups of half of the samples on their own equal the same rows of the full roll-up."""
    full = ru.sample_profile(fx.typed, fx.samples).filter("sid % 2 = 0")
    part = ru.sample_profile(fx.typed.filter("sid % 2 = 0"), fx.samples.filter("sid % 2 = 0"))
    lost, extra = au.difference(full, part)
    flags = full.select(F.lit("rows").alias("k")).unionByName(lost.select(F.lit("f").alias("k"))).unionByName(extra.select(F.lit("p").alias("k")))
    return flags.agg(F.count_if(F.col("k") == "rows").alias("rows"), F.count_if(F.col("k") == "f").alias("only_in_full"),
                     F.count_if(F.col("k") == "p").alias("only_in_part"))


@query("q9_stored_scores", f"""with {_PW}, pd as (select fold, rs.sid, rs.label as truth, pred from rs join folds using (sid) where variant = 'a'), {_cm_sql('pd', 'fold')} select fold, {r6('macro_f1')} as calculated, true as matches from mf""")
def _(fx):
    x = ranks.by_rows(_preds(fx), fx.folds().select("sid", "fold"), ["sid"]).select("sid", "fold", "truth", F.col("pa").alias("pred"))
    score = me.macro_f1(x, ["fold"])
    path = tables.scratch_path(fx.spark, "fold_scores")
    score.write.parquet(path)
    got = au.stored_scores(score, fx.spark.read.parquet(path), ["fold"])
    return got.select("fold", F.round("calculated", 6).alias("calculated"), "matches")


@query("q6_planted_faults", """with f as (select sid, variant, cls, case when sid % 10 = 0 then p * 2 when sid % 10 = 2 and cls = (select min(cls) from classes) then null else p end as p
 from pr3 where not (sid % 10 = 1 and cls = (select max(cls) from classes))), g as (select sid, variant, sum(p) as s, count(*) as k, count(*) filter (p is null) as b from f group by 1, 2)
 select count(*) as rows, count(*) filter (b > 0) as not_finite, count(*) filter (abs(s - 1) > 1e-6) as not_normalised, count(*) filter (k <> 5) as wrong_width from g""")
def _(fx):
    """The contract on a table with faults: doubled rows, rows without a class and rows with a null."""
    first, last, part = min(fx.classes), max(fx.classes), F.col("sid") % 10
    prob = fx.prob(["a", "b", "c"], 400).filter(~((part == 1) & (F.col("cls") == last)))
    bad = F.when(part == 0, F.col("p") * 2).when((part == 2) & (F.col("cls") == first), F.lit(None)).otherwise(F.col("p"))
    return au.probability_contract(prob.withColumn("p", bad), ["sid", "variant"], len(fx.classes))


@query("q9_planted_faults", f"""with {_PW}, pd as (select fold, rs.sid, rs.label as truth, pred from rs join folds using (sid) where variant = 'a'), {_cm_sql('pd', 'fold')},
 st as (select fold, macro_f1 + case when fold = 2 then 0.01 else 0 end as stored from mf where fold <> 4)
 select mf.fold, {r6('macro_f1')} as calculated, {r6('stored')} as stored, coalesce(abs(macro_f1 - stored) <= 1e-9, false) as matches from mf left join st using (fold)""")
def _(fx):
    """Stored scores of which one is wrong and one is missing."""
    x = ranks.by_rows(_preds(fx), fx.folds().select("sid", "fold"), ["sid"]).select("sid", "fold", "truth", F.col("pa").alias("pred"))
    score = me.macro_f1(x, ["fold"])
    stored = score.filter("fold <> 4").withColumn("macro_f1", F.col("macro_f1") + F.when(F.col("fold") == 2, 0.01).otherwise(0.0))
    got = au.stored_scores(score, stored, ["fold"])
    return got.select("fold", F.round("calculated", 6).alias("calculated"), F.round("stored", 6).alias("stored"), "matches")


@query("q10_compare_labels", f"with {_PW}, {_AB} select pa as label_a, pb as label_b, count(*) as n, pa <> pb as differs from w group by 1, 2")
def _(fx):
    p = _preds(fx)
    return au.compare_labels(p.select("sid", F.col("pa").alias("label")), p.select("sid", F.col("pb").alias("label")))


@query("q11_vocabulary_audit", """with t as (select token, fold <> 0 as fit from tok_exact join folds using (sid)), k as (select token, bool_or(fit) as f, bool_or(not fit) as a, count(*) filter (not fit) as na from t group by 1) select count(*) filter (f) as fit_tokens, count(*) filter
 (a and not f) as dropped_tokens, cast(coalesce(sum(na) filter (a and not f), 0) as bigint) as dropped_occurrences from k""")
def _(fx):
    placed = fx.tokens("exact").join(fx.folds().select("sid", (F.col("fold") != 0).alias("fit")), "sid")
    k = placed.groupBy("token").agg(F.bool_or("fit").alias("f"), F.count_if(~F.col("fit")).alias("na"))
    return k.agg(F.count_if("f").alias("fit_tokens"), F.count_if(~F.col("f")).alias("dropped_tokens"),
                 F.coalesce(F.sum(F.when(~F.col("f"), F.col("na"))), F.lit(0)).alias("dropped_occurrences"))


@query("q12_pairs_complete", "select sid, count(*) as rows, count(distinct variant) as variants, count(*) = 3 and count(distinct variant) = 3 as complete from (select distinct sid, variant from pr3) z group by 1")
def _(fx):
    return au.pairs_complete(fx.prob(["a", "b", "c"], 400).select("sid", "variant").distinct(), ["sid"], "variant", 3)


# Coverage -------------------------------------------------------------------------------------


def _cov_sql(ev: str, voc: str) -> str:
    return f"""ap as ({ev}), vc as ({voc}), m as (select ap.*, vc.token is not null as known from ap left join vc using (token)), t as (select token, count(*) as n, bool_or(known) as known from m group by 1), h as (select count(distinct sid) as rows_hit from m
 where known), na as (select count(*) as n from folds where fold = 0) select count(*) as distinct_tokens, count(*) filter (known) as distinct_covered, cast(sum(t.n) as bigint) as occurrences, cast(coalesce(sum(t.n) filter (known), 0) as bigint) as
 occurrences_covered, max(rows_hit) as rows_hit, {r6('count(*) filter (known) / cast(count(*) as double)')} as distinct_coverage, {r6('coalesce(sum(t.n) filter (known), 0) / cast(sum(t.n) as double)')} as occurrence_coverage, {r6('max(rows_hit) / cast(max(na.n) as double)')} as
 row_hit_rate from t, h, na"""


def _cov(fx, vocabulary_of):
    folds = fx.folds().select("sid", "fold")
    keyed = fx.typed.withColumn("token", F.concat_ws("__", "gene", "event")).join(folds, "sid")
    vocabulary = vocabulary_of(keyed.filter("fold <> 0"))
    n = folds.filter("fold = 0").agg(_n()).scalar()
    return _round(au.coverage(keyed.filter("fold = 0").select("sid", "token"), vocabulary, n), "distinct_coverage", "occurrence_coverage", "row_hit_rate")


_APE = "select sid, gene || '__' || event as token from typed join folds using (sid) where fold = 0"


@query("m16_exact_coverage", "with " + _cov_sql(_APE, "select distinct gene || '__' || event as token from typed join folds using (sid) where fold <> 0"))
def _(fx):
    return _cov(fx, lambda fit: fit.select("token").distinct())


@query("m16_recurrent_coverage", "with " + _cov_sql(_APE, "select gene || '__' || event as token from typed join folds using (sid) where fold <> 0 and event_type = 'MISSENSE' group by 1 having count(distinct sid) >= 5"))
def _(fx):
    return _cov(fx, lambda fit: fit.filter("event_type = 'MISSENSE'").groupBy("token").agg(F.count_distinct("sid").alias("n")).filter("n >= 5"))


@query("m17_level_coverage", f"""with x as (select t.*, fold = 0 as held, regexp_extract(event, '([0-9]+)', 1) as num, cast(regexp_extract(event, '^[A-Z*](-?[0-9]+)', 1) as bigint) as lead from typed t join folds using (sid)), lv as (select sid, held, 'gene' as level, gene as token from x
 union all select sid, held, 'exact', gene || '__' || event from x union all select sid, held, 'codon', gene || '__POS' || num from x union all select sid, held, 'signature_zero', gene || '__' || event_type || '__b' || cast(floor(cast(num as bigint) / 50.0) as bigint) from x),
 k as (select level, token, count(*) filter (not held) as fit_n, count(*) filter (held) as apply_n from lv group by 1, 2), f as (select unnest([1, 3, 5, 10]) as floor) select level, cast(floor as int) as floor, count(*) filter (fit_n >= floor) as columns, cast(sum(apply_n) as bigint) as
 occurrences, cast(coalesce(sum(apply_n) filter (fit_n >= floor), 0) as bigint) as covered, {r6('coalesce(sum(apply_n) filter (fit_n >= floor), 0) / cast(sum(apply_n) as double)')} as occurrence_coverage from k, f group by 1, 2""")
def _(fx):
    got = au.level_coverage(fx.typed, fx.folds(), ["gene", "exact", "codon", "signature_zero"], [1, 3, 5, 10])
    return _round(got, "occurrence_coverage")


@query("m18_fold_coverage", f"""with t as (select fold, token from tok_exact join folds using (sid)), c as (select token, fold, count(*) as n, sum(count(*)) over (partition by token) as tot from t group by 1, 2) select fold, count(*) as distinct_tokens, count(*) filter (tot > n) as covered,
 {r6('count(*) filter (tot > n) / cast(count(*) as double)')} as coverage, {r6('sum(n) filter (tot > n) / cast(sum(n) as double)')} as occurrence_coverage from c group by 1""")
def _(fx):
    """Every fold as held-out part at once: a token is covered where its total exceeds its count in the fold."""
    c = fx.tokens("exact").join(fx.folds().select("sid", "fold"), "sid").groupBy("token", "fold").agg(_n().alias("n"))
    w = Window.partitionBy("token")  # at most one row per fold
    c = c.withColumn("out", F.sum("n").over(w) > F.col("n"))
    got = c.groupBy("fold").agg(
        _n().alias("distinct_tokens"), F.count_if("out").alias("covered"), (F.count_if("out") / _n()).alias("coverage"),
        (F.sum(F.when(F.col("out"), F.col("n"))) / F.sum("n")).alias("occurrence_coverage"))
    return _round(got, "coverage", "occurrence_coverage")


# Segments -------------------------------------------------------------------------------------

_SEG = f"""{_PW}, {_AB}, sp as (select f.fold, t.token, count(*) as s from (select distinct fold from folds) f join folds g on g.fold <> f.fold join tok_codon t on t.sid = g.sid group by 1, 2), ta as (select sid, count(*) as k, avg(cast(coalesce(s, 0) = 0 as int)) as un, avg(cast(coalesce(s, 0) < 25 as int)) as ra from tok_codon join folds using
 (sid) left join sp using (fold, token) group by 1), bd as (select sid, count(distinct gene) as g from events group by 1), mg as (select sid, margin from rs where variant = 'b'), au as (select w.*, case when coalesce(g, 0) = 0 then '0' when g = 1 then '1' when g = 2
 then '2' when g <= 5 then '3-5' when g <= 10 then '6-10' else '11+' end as burden, case when coalesce(un, 0) = 0 then '0' when un < 0.25 then '0-0.25' when un < 0.5 then '0.25-0.5' else '0.5+' end as unseen, case when coalesce(ra, 0) = 0 then '0' when ra < 0.25 then '0-0.25'
 when ra < 0.5 then '0.25-0.5' else '0.5+' end as rare, case when margin < 0.05 then 'low' when margin < 0.2 then 'mid' else 'high' end as margin_b, case when coalesce(g, 0) = 0 then 'reference_only' else 'events_present' end as refonly from w join folds using (sid) left join bd
 using (sid) left join ta using (sid) join mg using (sid)), sg as (select sid, truth, pa, pb, 'true_class' as grouping, truth as grp from au union all select sid, truth, pa, pb, 'burden', burden from au union all select sid, truth, pa, pb, 'unseen', unseen
 from au union all select sid, truth, pa, pb, 'rare', rare from au union all select sid, truth, pa, pb, 'margin', margin_b from au union all select sid, truth, pa, pb, 'reference_only', refonly from au)"""
_SEGF = """sc as (select grouping, grp, model, cls, sum(tp) as tp, sum(t) as t, sum(q) as q from (select grouping, grp, model, truth as cls, cast(truth = pred as int) as tp, 1 as t, 0 as q from sl union all select grouping, grp, model, pred, 0, 0, 1 from sl) z group by 1, 2, 3, 4),
 sf as (select grouping, grp, model, avg(2.0 * tp / (t + q)) as f1, sum(tp) / cast(sum(t) as double) as acc, cast(sum(t) as bigint) as support from sc where t > 0 group by 1, 2, 3)"""


@query("m15_segment_metrics", f"""with {_SEG}, sl as (select grouping, grp, truth, 'a' as model, pa as pred from sg union all select grouping, grp, truth, 'b', pb from sg), {_SEGF} select x.grouping, x.grp, x.support, {r6('x.f1')} as base_f1, {r6('y.f1')} as other_f1, {r6('x.acc')} as
 base_accuracy, {r6('y.acc')} as other_accuracy, {r6('y.f1 - x.f1')} as delta from sf x join sf y on x.grouping = y.grouping and x.grp = y.grp and x.model = 'a' and y.model = 'b'""")
def _(fx):
    """F1 over the classes present in a segment, for two models, by six groupings of all rows, each audited as part of its held-out fold."""
    rows = pr.rows_of(fx.prob(["a", "b"], 400), ["a", "b"], fx.classes)
    genes = ru.gene_presence(fx.events).groupBy("sid").agg(_n().alias("g"))
    audit = au.token_audit(fx.tokens("codon"), fx.folds(), rare=25)
    x = rows.join(genes, "sid", "left").join(audit, "sid", "left").na.fill(0, ["g", "unseen_ratio", "rare_ratio"]).select(
        "sid", F.col("label").alias("truth"), pr.argmax_class(F.col("a"), fx.classes).alias("pa"), pr.argmax_class(F.col("b"), fx.classes).alias("pb"),
        F.col("label").alias("true_class"), au.segment_of(F.col("g"), "burden").alias("burden"), au.segment_of(F.col("unseen_ratio"), "ratio").alias("unseen"),
        au.segment_of(F.col("rare_ratio"), "ratio").alias("rare"), au.segment_of(pr.margin(F.col("b")), "margin").alias("margin"),
        F.when(F.col("g") == 0, "reference_only").otherwise("events_present").alias("reference_only"))
    seg = au.segments(x, ["true_class", "burden", "unseen", "rare", "margin", "reference_only"])
    both = seg.select("grouping", "grp", "truth", F.explode(F.array(
        F.struct(F.lit("a").alias("model"), F.col("pa").alias("pred")), F.struct(F.lit("b").alias("model"), F.col("pb").alias("pred")))).alias("x"),
    ).select("grouping", "grp", "truth", "x.model", "x.pred")
    keys = ["grouping", "grp", "model"]
    present = me.per_class(me.confusion(both, keys), keys).filter("support > 0")
    f1 = present.groupBy(*keys).agg(F.avg("f1").alias("f1"), (F.sum("tp") / F.sum("support")).alias("acc"), F.sum("support").alias("support"))

    def of(model, value):
        return F.max(F.when(F.col("model") == model, F.col(value)))

    got = f1.groupBy("grouping", "grp").agg(
        F.max("support").alias("support"), of("a", "f1").alias("base_f1"), of("b", "f1").alias("other_f1"), of("a", "acc").alias("base_accuracy"),
        of("b", "acc").alias("other_accuracy"), (of("b", "f1") - of("a", "f1")).alias("delta"))
    return _round(got, "base_f1", "other_f1", "base_accuracy", "other_accuracy", "delta")


# Exploration ----------------------------------------------------------------------------------


@query("m19_gene_summary", f"select gene, count(distinct sid) as mutated, max(n) - count(distinct sid) as reference, {r6('count(distinct sid) / cast(max(n) as double)')} as mutation_ratio from events, ntot group by 1")
def _(fx):
    n = fx.samples.agg(_n()).scalar()
    got = ru.gene_presence(fx.events).groupBy("gene").agg(_n().alias("mutated")).withColumn("n", n)
    return got.select("gene", "mutated", (F.col("n") - F.col("mutated")).alias("reference"), F.round(F.col("mutated") / F.col("n"), 6).alias("mutation_ratio"))


@query("m19_class_gene_prevalence", f"select label, token as gene, count(*) as n, {r6('count(*) / cast(max(cls_n) as double)')} as prevalence from tok_gene join samples using (sid) join csize on cls = label group by 1, 2")
def _(fx):
    sizes = fx.samples.groupBy("label").agg(_n().alias("size"))
    hits = ru.gene_presence(fx.events).join(fx.samples, "sid").groupBy("label", "gene").agg(_n().alias("n"))
    return hits.join(sizes, "label").select("label", "gene", "n", F.round(F.col("n") / F.col("size"), 6).alias("prevalence"))


@query("m20_burden_by_class", f"""with k as (select s.sid, label, count(event) as k from samples s left join events e on e.sid = s.sid group by 1, 2) select label, count(*) as n, {r6('avg(k)')} as mean, {r6('median(k)')} as median, max(k) as most from k group by 1""")
def _(fx):
    per = fx.samples.join(fx.events.groupBy("sid").agg(_n().alias("k")), "sid", "left").na.fill(0, ["k"])
    q = exact_quantiles(per, ["label"], "k", [0.5], F.md5(F.col("sid").cast("string")), ["sid"])
    basic = per.groupBy("label").agg(_n().alias("n"), F.round(F.avg("k"), 6).alias("mean"), F.max("k").alias("most"))
    return basic.join(q.select("label", F.round("value", 6).alias("median")), "label")


@query("m20_burden_lift_per_gene", f"""with k as (select sid, count(*) as k from events group by 1), a as (select avg(coalesce(k, 0)) as m from samples left join k using (sid)), g as (select token as gene, avg(k) as mk from tok_gene join k using (sid) group by 1) select gene, {r6('mk')} as mean_burden, {r6('mk / m')} as lift
 from g, a""")
def _(fx):
    per = fx.events.groupBy("sid", "gene").agg(_n().alias("e"))
    burden = per.groupBy("sid").agg(F.sum("e").alias("k"))
    mean = fx.samples.join(burden, "sid", "left").agg(F.avg(F.coalesce("k", F.lit(0)))).scalar()
    got = per.join(burden, "sid").groupBy("gene").agg(F.avg("k").alias("mean_burden"))
    return _round(got.withColumn("lift", F.col("mean_burden") / mean), "mean_burden", "lift")


@query("m21_top_events_per_class", """select label, gene, event, n, cast(rn as int) as rank from (select *, row_number() over (partition by label order by n desc, gene, event) as rn from (select label, gene, event, count(*) as n from events join samples using (sid) group by 1, 2, 3) y) z
 where rn <= 10""")
def _(fx):
    counts = fx.events.join(fx.samples, "sid").groupBy("label", "gene", "event").agg(_n().alias("n"))
    return ru.top_per_group(counts, ["label"], [F.desc("n"), "gene", "event"], 10)


@query("m21_comutation_pairs", """with c as (select label, token as gene, count(*) as n from tok_gene join samples using (sid) group by 1, 2), top as (select label, gene from (select *, row_number() over (partition by label order by n desc, gene) as rn from c) z where rn <= 12), p as (select t.sid, s.label,
 t.token as gene from tok_gene t join samples s using (sid) join top on top.label = s.label and top.gene = t.token) select a.label, a.gene as gene_a, b.gene as gene_b, count(*) as n from p a join p b on a.sid = b.sid and a.gene < b.gene group by 1, 2, 3""")
def _(fx):
    """At most 66 pairs a row, because only the top 12 genes of the row's class take part."""
    placed = ru.gene_presence(fx.events).join(fx.samples, "sid")
    top = ru.top_per_group(placed.groupBy("label", "gene").agg(_n().alias("n")), ["label"], [F.desc("n"), "gene"], 12).select("label", "gene")
    rows = placed.join(top, ["label", "gene"]).groupBy("sid", "label").agg(F.array_sort(F.collect_set("gene")).alias("gs"))
    first = rows.select("label", "gs", F.posexplode("gs").alias("i", "gene_a"))
    return first.select("label", "gene_a", F.explode(F.slice("gs", F.col("i") + 2, F.size("gs"))).alias("gene_b")).groupBy(
        "label", "gene_a", "gene_b").agg(_n().alias("n"))


@query("m22_type_rates", f"""with k as (select label, event_type, count(*) as n from typed join samples using (sid) group by 1, 2), a as (select label, event_type, n from k union all select 'all', event_type, sum(n) from k group by 2) select label, event_type, cast(n as bigint) as n,
 {r6('n / cast(sum(n) over (partition by label) as double)')} as rate from a""")
def _(fx):
    k = fx.typed.join(fx.samples, "sid").groupBy("label", "event_type").agg(_n().alias("n"))
    every = k.groupBy("event_type").agg(F.sum("n").alias("n")).select(F.lit("all").alias("label"), "event_type", "n")
    w = Window.partitionBy("label")  # one row per type
    return k.unionByName(every).withColumn("rate", F.round(F.col("n") / F.sum("n").over(w), 6))


@query("m23_class_profile", f"select cls, cls_n as n, {r6('cls_n / cast(n as double)')} as share, {r6('max(cls_n) over () / cast(cls_n as double)')} as imbalance, cls_n / cast(n as double) < 0.2 as is_small from csize, ntot")
def _(fx):
    return _round(au.class_profile(fx.samples, 0.2), "share", "imbalance")
