"""Metrics, comparisons and audits of predictions."""
from __future__ import annotations


from pyspark.sql import Window, functions as F

from glyphmill.catalog.base import query, r6
from glyphmill.catalog.folds import _fit_grid
from glyphmill.catalog.probs import _SEEDED, _cm_sql, _rows
from glyphmill.functions.hashing import md5_key
from glyphmill.operators import folds as fo, metrics as me, probs as pr, ranks, weights as we

_PW = """rk as (select *, row_number() over (partition by sid, variant order by p desc, cls) as rn from pr3), rs as (select sid, label, variant, min(cls)
 filter (rn = 1) as pred, max(p) filter (rn = 1) as p1, max(p) filter (rn = 1) - max(p) filter (rn = 2) as margin, -sum(case when p > 0 then p * ln(p) else
 0 end) as entropy, cast(max(rn) filter (cls = label) - 1 as bigint) as rank from rk group by 1, 2, 3)"""


def _summary(fx):
    return me.row_summary(fx.prob(["a", "b", "c"], 400), ("sid", "label", "variant"))


def _round(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _by_variant(fx):
    return _summary(fx).withColumnRenamed("label", "truth")


@query("m1_accuracy_macro_f1", f"with {_PW}, pd as (select variant, sid, label as truth, pred from rs), {_cm_sql('pd', 'variant')} select variant,"
       f" {r6('accuracy')} as accuracy, {r6('macro_f1')} as macro_f1, (select n from ntot) as n from mf")
def _(fx):
    got = me.overall(me.confusion(_by_variant(fx), ["variant"]), ["variant"])
    return _round(got, "accuracy", "macro_f1").select("variant", "accuracy", "macro_f1", "n")


_CLASSF = """ pd as (select variant, sid, label as truth, pred from rs), sd as (select variant, cls, cast(sum(tp) as bigint) as tp, cast(sum(t) as bigint) as support,
 cast(sum(q) as bigint) as predicted from (select variant, truth as cls, cast(truth = pred as int) as tp, 1 as t, 0 as q from pd union all select variant, pred, 0, 0,
 1 from pd) z group by 1, 2), pc as (select *, coalesce(tp / nullif(predicted::double, 0), 0) as precision, coalesce(tp / nullif(support::double, 0), 0) as recall,
 2.0 * tp / (support + predicted) as f1 from sd)"""


@query("m2_per_class_scores", f"with {_PW}, {_CLASSF} select variant, cls, tp, support, predicted, {r6('precision')} as precision, {r6('recall')} as recall, {r6('f1')} as f1 from pc")
def _(fx):
    return _round(me.per_class(me.confusion(_by_variant(fx), ["variant"]), ["variant"]), "precision", "recall", "f1")


@query("m3_confusion_pairs", f"""with {_PW}, cf as (select label as truth, pred, count(*) as n from rs where variant = 'a' group by 1, 2) select truth, pred, n,
 {r6('100 * n / cast(sum(n) over (partition by truth) as double)')} as percent_of_truth, cast(sum(n) over (partition by least(truth, pred), greatest(truth, pred)) as
 bigint) as two_way from cf""")
def _(fx):
    cm = me.confusion(_by_variant(fx).filter("variant = 'a'"))
    truth = Window.partitionBy("truth")
    both = Window.partitionBy(F.least("truth", "pred"), F.greatest("truth", "pred"))  # class x class table
    return cm.select("truth", "pred", "n", F.round(100 * F.col("n") / F.sum("n").over(truth), 6).alias("percent_of_truth"),
                     F.sum("n").over(both).alias("two_way"))


@query("m4_top_k", f"""with {_PW}, x as (select sid, label as truth, pred, rank, k, rank < k as hit from rs, (select unnest([1, 2, 3, 5]) as k) z where variant = 'a'),
 rc as (select k, truth, avg(cast(hit as double)) as r from x group by 1, 2), bs as (select k, avg(cast(hit as double)) as accuracy from x group by 1), rr as (select
 k, avg(r) as macro_recall from rc group by 1), pd as (select k, sid, truth, case when hit then truth else pred end as pred from x), {_cm_sql('pd', 'k')} select k,
 {r6('bs.accuracy')} as accuracy, {r6('macro_recall')} as macro_recall, {r6('macro_f1')} as oracle_macro_f1 from bs join rr using (k) join mf using (k)""")
def _(fx):
    got = me.top_k_accuracy(_summary(fx).filter("variant = 'a'"), [1, 2, 3, 5])
    return _round(got, "accuracy", "macro_recall", "oracle_macro_f1")


@query("m5_w1_truth_ranks", f"""with {_PW} select variant, coalesce(label, 'all') as cls, count(*) as n, {r6('avg(rank + 1)')} as mean_rank, {r6('median(rank + 1)')} as median_rank from
 rs group by grouping sets ((variant, label), (variant))""")
def _(fx):
    s = _summary(fx)
    two = s.select("variant", F.explode(F.array(F.col("label"), F.lit("all"))).alias("cls"), (F.col("rank") + 1).alias("r"))
    return two.groupBy("variant", "cls").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("r"), 6).alias("mean_rank"), F.round(F.median("r"), 6).alias("median_rank"))


_LEVELS = [0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


@query("m6_w4_coverage_curve", f"""with {_PW}, o as (select p1, pred = label as correct, row_number() over (order by p1 desc, md5('42:' || sid), sid) as rn from rs where variant = 'a'),
 lv as (select * from (values {', '.join(f'({x}::double)' for x in _LEVELS)}) v(coverage)) select coverage, count(*) as n_rows, {r6('avg(cast(correct as double))')} as accuracy,
 {r6('min(p1)')} as min_confidence from o, lv, ntot where rn <= greatest(floor(n * coverage + 0.5), 1) group by 1""")
def _(fx):
    s = _summary(fx).filter("variant = 'a'").select("sid", F.col("p1").alias("confidence"), (F.col("pred") == F.col("label")).alias("correct"))
    ranked = ranks.numbered_by_value(s, "confidence", md5_key(42, F.col("sid")), ["sid"])
    return _round(me.coverage_curve(ranked, _LEVELS), "accuracy", "min_confidence")


@query("m7_w2_margin_entropy", f"with {_PW} select sid, variant, pred, {r6('p1')} as p1, {r6('margin')} as margin, {r6('entropy')} as entropy, rank from rs")
def _(fx):
    return _round(_summary(fx), "p1", "margin", "entropy").select("sid", "variant", "pred", "p1", "margin", "entropy", "rank")


_AB = "w as (select sid, any_value(label) as truth, max(pred) filter (variant = 'a') as pa, max(pred) filter (variant = 'b') as pb, max(pred) filter (variant = 'c') as pc from rs group by 1)"


def _preds(fx, **extra):
    arrays = {"pa": F.col("a"), "pb": F.col("b"), "pc": F.col("c"), **extra}
    return _rows(fx).select("sid", F.col("label").alias("truth"), *[pr.argmax_class(v, fx.classes).alias(k) for k, v in arrays.items()])


_DIV = """count(*) filter (pa <> pb) / cast(count(*) as double) as disagreement, count(*) filter (pa <> truth and pb = truth) / cast(greatest(count(*) filter (pa <> truth), 1) as double) as
 recovery_rate, count(*) filter (pa = truth and pb <> truth) / cast(greatest(count(*) filter (pa = truth), 1) as double) as reverse_loss_rate, count(*) filter (pa <> truth and pb <> truth)
 / cast(count(*) as double) as double_fault, count(*) filter (pa <> truth and pb = truth) as recovered, count(*) filter (pa = truth and pb <> truth) as damaged"""


@query("m8_m9_diversity", f"""with {_PW}, {_AB}, d as (select {_DIV} from w), pd as (select sid, truth, case when pb = truth then pb else pa end as pred from w), {_cm_sql('pd')}, cr as
 (select corr(pa, pb) as c from pv) select {r6('disagreement')} as disagreement, {r6('recovery_rate')} as recovery_rate, {r6('reverse_loss_rate')} as reverse_loss_rate,
 {r6('double_fault')} as double_fault, recovered, damaged, recovered - damaged as net, {r6('macro_f1')} as oracle_macro_f1, {r6('c')} as probability_correlation from d, mf, cr""")
def _(fx):
    got = me.diversity(_preds(fx))
    z = F.explode(F.arrays_zip(F.col("a").alias("x"), F.col("b").alias("y"))).alias("z")
    corr = _rows(fx).select(z).agg(F.corr("z.x", "z.y")).scalar()
    got = got.withColumn("probability_correlation", corr)
    return _round(got, "disagreement", "recovery_rate", "reverse_loss_rate", "double_fault", "oracle_macro_f1", "probability_correlation")


_MIX = "mx as (select sid, label, cls, 0.8 * pa + 0.2 * pb as p from pv), mp as (select sid, any_value(label) as truth, min(cls) filter (rn = 1) as pm from (select *, row_number() over (partition by sid order by p desc, cls) as rn from mx) z group by 1)"


@query("m9_incremental_blend", f"""with {_PW}, {_AB}, {_MIX}, j as (select w.*, pm from w join mp using (sid)) select count(*) filter (pa <> truth and pm = truth) as recovered, count(*) filter
 (pa = truth and pm <> truth) as damaged, count(*) filter (pm = truth) - count(*) filter (pa = truth) as net, {r6("count(*) filter (pa <> truth and pm = truth) / cast(count(*) filter (pa <> truth) as double)")}
 as recovery_rate, {r6("count(*) filter (pa = truth and pm <> truth) / cast(count(*) filter (pa = truth) as double)")} as damage_rate from j""")
def _(fx):
    x = _preds(fx, pm=pr.blend([(F.col("a"), 0.8), (F.col("b"), 0.2)]))
    ok, new = F.col("pa") == F.col("truth"), F.col("pm") == F.col("truth")
    return x.agg(
        F.count_if(~ok & new).alias("recovered"), F.count_if(ok & ~new).alias("damaged"), (F.count_if(new) - F.count_if(ok)).alias("net"),
        F.round(F.count_if(~ok & new) / F.count_if(~ok), 6).alias("recovery_rate"), F.round(F.count_if(ok & ~new) / F.count_if(ok), 6).alias("damage_rate"))


def _long_preds(x, names):
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(n).alias("pred")) for n in names])).alias("q")
    return x.select("sid", "truth", pairs).select("sid", "truth", "q.model", "q.pred")


_PCM = """ pd as (select 'pa' as model, sid, truth, pa as pred from w union all select 'pb', sid, truth, pb from w union all select 'pm', sid, truth, pm from mp), sd as (select model, cls, sum(tp) as tp,
 sum(t) as t, sum(q) as q from (select model, truth as cls, cast(truth = pred as int) as tp, 1 as t, 0 as q from pd union all select model, pred, 0, 0, 1 from pd) z group by 1, 2), fp as (select cls,
 max(t) as support, max(2.0 * tp / (t + q)) filter (model = 'pa') as fa, max(2.0 * tp / (t + q)) filter (model = 'pb') as fb, max(2.0 * tp / (t + q)) filter (model = 'pm') as fm from sd group by 1)"""


@query("m10_class_decomposition", f"""with {_PW}, {_AB}, {_MIX}, {_PCM}, q as (select *, (fm - fa) / count(*) over () as con from fp), rkk as (select *, row_number() over (order by round(con, 12) desc, cls) as
 rn from q) select cls, cast(support as bigint) as support, {r6('fa')} as base_f1, {r6('fb')} as partner_f1, {r6('fm')} as blend_f1, {r6('con')} as contribution, {r6('sum(con) over ()')} as
 total_gain, {r6('sum(con) filter (rn <= 3) over () / nullif(sum(con) over (), 0)')} as top3_share from rkk""")
def _(fx):
    x = _preds(fx, pm=pr.blend([(F.col("a"), 0.8), (F.col("b"), 0.2)]))
    pc = me.per_class(me.confusion(_long_preds(x, ["pa", "pb", "pm"]), ["model"]), ["model"])
    wide = pc.groupBy("cls").agg(F.max("support").alias("support"), *[
        F.max(F.when(F.col("model") == m, F.col("f1"))).alias(n) for m, n in (("pa", "base_f1"), ("pb", "partner_f1"), ("pm", "blend_f1"))])
    every = Window.partitionBy(F.lit(0))  # one row per class
    got = wide.withColumn("contribution", (F.col("blend_f1") - F.col("base_f1")) / F.count(F.lit(1)).over(every))
    got = got.withColumn("rn", F.row_number().over(every.orderBy(F.desc(F.round("contribution", 12)), "cls")))
    total = F.sum("contribution").over(every)
    got = got.withColumn("total_gain", total).withColumn(
        "top3_share", F.sum(F.when(F.col("rn") <= 3, F.col("contribution"))).over(every) / F.nullif(total, F.lit(0.0)))
    return _round(got.drop("rn"), "base_f1", "partner_f1", "blend_f1", "contribution", "total_gain", "top3_share")


# Seeds ----------------------------------------------------------------------------------------

_SP = """sp as (select sid, any_value(label) as truth, cast(substr(variant, 2) as int) as seed, substr(variant, 1, 1) as variant, min(cls) filter (rn = 1) as pred from (select *, row_number() over (partition by
 sid, variant order by p desc, cls) as rn from prs) z group by sid, prs_v, variant)""".replace("group by sid, prs_v, variant", "group by sid, z.variant")
_SF = _SP + "," + _cm_sql("sp", "seed, variant")


def _seed_long(fx):
    return fx.prob([f"{v}{s}" for s in (1, 2, 3) for v in "ab"], 400).withColumn("seed", F.substring("variant", 2, 1).cast("int")).withColumn(
        "variant", F.substring("variant", 1, 1))


def _seed_preds(fx):
    return me.predictions(_seed_long(fx), ("sid", "seed", "variant"))


@query("m11_seed_summary", f"""with {_SF}, av as (select sid, any_value(label) as label, variant[1] as variant, cls, round(avg(p), 12) as p from prs group by 1, 3, 4), ap as (select variant, sid, any_value(label) as truth, min(cls)
 filter (rn = 1) as pred from (select *, row_number() over (partition by variant, sid order by p desc, cls) as rn from av) z group by 1, 2), {_cm_sql('ap', 'variant').replace(' sd as', ' sd2 as').replace('from sd', 'from sd2').replace('mf as', 'mf2 as')}
 select m.variant, count(*) as seeds, {r6('avg(m.macro_f1)')} as f1_mean, {r6('stddev_samp(m.macro_f1)')} as f1_std, {r6('min(m.macro_f1)')} as f1_min, {r6('max(x.macro_f1)')} as averaged_f1 from mf m join
 mf2 x on x.variant = m.variant group by 1""")
def _(fx):
    long = _seed_long(fx)
    f1 = me.macro_f1(me.predictions(long, ("sid", "seed", "variant")), ["seed", "variant"])
    mean = long.groupBy("sid", "label", "variant", "cls").agg(F.round(F.avg("p"), 12).alias("p"))
    averaged = me.macro_f1(me.predictions(mean, ("sid", "variant")), ["variant"]).withColumnRenamed("macro_f1", "averaged_f1")
    got = f1.groupBy("variant").agg(
        F.count(F.lit(1)).alias("seeds"), F.avg("macro_f1").alias("f1_mean"), F.stddev_samp("macro_f1").alias("f1_std"),
        F.min("macro_f1").alias("f1_min")).join(averaged, "variant")
    return _round(got, "f1_mean", "f1_std", "f1_min", "averaged_f1")


_FOLDF = _SP + ", spf as (select sp.*, fold from sp join folds using (sid))"
_DEC = _FOLDF + "," + _cm_sql("sp", "seed, variant") + "," + _cm_sql("spf", "seed, fold, variant").replace(" sd as", " sdf as").replace("from sd", "from sdf").replace("mf as", "mff as") + """,
 sdc as (select seed, variant, cls, sum(tp) as tp, sum(t) as t, sum(q) as q from (select seed, variant, truth as cls, cast(truth = pred as int) as tp, 1 as t, 0 as q from sp union all select seed, variant, pred, 0, 0, 1
 from sp) z group by 1, 2, 3), dl as (select seed, max(macro_f1) filter (variant = 'b') - max(macro_f1) filter (variant = 'a') as d from mf group by 1), fl as (select seed, fold, max(macro_f1) filter (variant = 'b') >
 max(macro_f1) filter (variant = 'a') as up from mff group by 1, 2), cd as (select cls, avg(d) as d from (select seed, cls, max(2.0 * tp / (t + q)) filter (variant = 'b') - max(2.0 * tp / (t + q)) filter (variant = 'a') as d
 from sdc group by 1, 2) z group by 1), dc as (select (select bool_and(d > 0) from dl) as all_seeds_positive, (select avg(d) from dl) as mean_delta, (select min(d) from dl) as min_delta, (select count(*) from fl where up) as
 positive_folds, (select min(d) from cd) as min_class_delta)"""


def _decision(fx):
    pred = ranks.by_rows(_seed_preds(fx), fx.folds().select("sid", "fold"), ["sid"])

    def delta(table, by, value):
        return table.groupBy(*by).agg((F.max(F.when(F.col("variant") == "b", F.col(value))) - F.max(
            F.when(F.col("variant") == "a", F.col(value)))).alias("d"))

    seeds = delta(me.macro_f1(pred, ["seed", "variant"]), ["seed"], "macro_f1").agg(
        F.bool_and(F.col("d") > 0).alias("all_seeds_positive"), F.avg("d").alias("mean_delta"), F.min("d").alias("min_delta"))
    parts = delta(me.macro_f1(pred, ["seed", "fold", "variant"]), ["seed", "fold"], "macro_f1").agg(F.count_if(F.col("d") > 0))
    pc = me.per_class(me.confusion(pred, ["seed", "variant"]), ["seed", "variant"])
    least = delta(pc, ["seed", "cls"], "f1").groupBy("cls").agg(F.avg("d").alias("d")).agg(F.min("d"))
    return seeds.withColumns({"positive_folds": parts.scalar(), "min_class_delta": least.scalar()})


@query("m12_acceptance_decision", f"""with {_DEC} select all_seeds_positive, {r6('mean_delta')} as mean_delta, {r6('min_delta')} as min_delta, positive_folds, {r6('min_class_delta')} as min_class_delta, all_seeds_positive and mean_delta >=
 0.010 and min_delta >= 0.005 and positive_folds >= 11 and min_class_delta >= -0.05 as accepted from dc""")
def _(fx):
    d = _decision(fx)
    accepted = me.acceptance(*[F.col(x) for x in ("all_seeds_positive", "mean_delta", "min_delta", "positive_folds", "min_class_delta")])
    return _round(d.withColumn("accepted", accepted), "mean_delta", "min_delta", "min_class_delta")


@query("m13_class_comparison", f"""with {_SP}, w as (select sid, seed, any_value(truth) as truth, max(pred) filter (variant = 'a') as pa, max(pred) filter (variant = 'b') as pb from sp group by 1, 2), sdc as (select seed, variant, cls, sum(tp)
 as tp, sum(t) as t, sum(q) as q from (select seed, variant, truth as cls, cast(truth = pred as int) as tp, 1 as t, 0 as q from sp union all select seed, variant, pred, 0, 0, 1 from sp) z group by 1, 2, 3), f as (select cls, max(t) as
 support, avg(2.0 * tp / (t + q)) filter (variant = 'a') as fa, avg(2.0 * tp / (t + q)) filter (variant = 'b') as fb from sdc group by 1), rc as (select truth as cls, count(*) filter (pa <> truth and pb = truth) as recovered, count(*)
 filter (pa = truth and pb <> truth) as broken from w group by 1) select cls, cast(support as bigint) as support, {r6('fa')} as base_f1_mean, {r6('fb')} as other_f1_mean, {r6('fb - fa')} as delta_mean, recovered, broken from f join rc
 using (cls)""")
def _(fx):
    pred = _seed_preds(fx)
    pc = me.per_class(me.confusion(pred, ["seed", "variant"]), ["seed", "variant"])
    f1 = pc.groupBy("cls").agg(
        F.max("support").alias("support"), F.avg(F.when(F.col("variant") == "a", F.col("f1"))).alias("base_f1_mean"),
        F.avg(F.when(F.col("variant") == "b", F.col("f1"))).alias("other_f1_mean"))
    both = pred.groupBy("sid", "seed", "truth").agg(*[
        F.max(F.when(F.col("variant") == v, F.col("pred"))).alias("p" + v) for v in "ab"])
    ok_a, ok_b = F.col("pa") == F.col("truth"), F.col("pb") == F.col("truth")
    moved = both.groupBy(F.col("truth").alias("cls")).agg(F.count_if(~ok_a & ok_b).alias("recovered"), F.count_if(ok_a & ~ok_b).alias("broken"))
    got = f1.join(moved, "cls").withColumn("delta_mean", F.col("other_f1_mean") - F.col("base_f1_mean"))
    return _round(got, "base_f1_mean", "other_f1_mean", "delta_mean")


_STAB = f"""{_PW}, {_AB}, bg as (select sid, label, cls, round((pa + pb + pc) / 3, 12) as p from pv), bp as (select sid, min(cls) filter (rn = 1) as bag, max(p) filter (rn = 1) - max(p) filter (rn = 2) as bag_margin from (select *,
 row_number() over (partition by sid order by p desc, cls) as rn from bg) z group by 1), sd0 as (select sid, avg(s) as mean_std from (select sid, cls, stddev_pop(p) as s from pr3 group by 1, 2) z group by 1), st as (select w.*, bag,
 bag_margin, mean_std, case when pa = pb and pb = pc then 3 when pa = pb or pb = pc or pa = pc then 2 else 1 end as agree, case when pa <> truth and bag = truth then 'recovered' when pa = truth and bag <> truth then 'broken' when pa =
 truth and bag = truth then 'both_correct' else 'both_wrong' end as transition from w join bp using (sid) join sd0 using (sid))"""


def _stability(fx):
    rows = _rows(fx)
    bag = F.zip_with(F.zip_with("a", "b", lambda x, y: x + y), "c", lambda x, y: F.round((x + y) / 3, 12))
    three = F.arrays_zip(F.col("a").alias("a"), F.col("b").alias("b"), F.col("c").alias("c"))

    def sd(x):
        m = (x["a"] + x["b"] + x["c"]) / 3
        return F.sqrt(((x["a"] - m) ** 2 + (x["b"] - m) ** 2 + (x["c"] - m) ** 2) / 3)

    spread = pr.total(F.transform(three, sd)) / len(fx.classes)
    p = [pr.argmax_class(x, fx.classes) for x in (F.col("a"), F.col("b"), F.col("c"))]
    return rows.withColumn("bagged", bag).select(
        "sid", F.col("label").alias("truth"), p[0].alias("pa"), p[1].alias("pb"), p[2].alias("pc"),
        pr.argmax_class(F.col("bagged"), fx.classes).alias("bag"), pr.margin(F.col("bagged")).alias("bag_margin"), spread.alias("mean_std"),
    ).withColumns({
        "agree": me.agreement([F.col("pa"), F.col("pb"), F.col("pc")]),
        "transition": me.transition(F.col("pa"), F.col("bag"), F.col("truth"))})


@query("m14_row_stability", f"with {_STAB} select sid, bag, agree, transition, {r6('bag_margin')} as bag_margin, {r6('mean_std')} as mean_std from st")
def _(fx):
    return _round(_stability(fx), "bag_margin", "mean_std").select("sid", "bag", "agree", "transition", "bag_margin", "mean_std")


@query("m14_j4_stability_summary", f"""with {_STAB}, pd as (select agree, sid, truth, bag as pred from st), {_cm_sql('pd', 'agree')}, tr as (select transition, count(*) as row_count from st group by 1), ag as (select agree, count(*) as
 support, avg(mean_std) as mean_std from st group by 1) select ag.agree, support, {r6('macro_f1')} as bagged_macro_f1, {r6('mean_std')} as mean_std, transition, row_count, {r6('row_count / cast(n as double)')} as rate from ag join mf using
 (agree) cross join tr cross join ntot""")
def _(fx):
    """Two small summaries side by side: every stability group meets the few transition counts through one array."""
    s = _stability(fx)
    f1 = me.macro_f1(s.select("sid", "truth", "agree", F.col("bag").alias("pred")), ["agree"])
    groups = s.groupBy("agree").agg(F.count(F.lit(1)).alias("support"), F.avg("mean_std").alias("mean_std")).join(f1, "agree")
    moves = s.groupBy("transition").agg(F.count(F.lit(1)).alias("row_count"))
    packed = moves.agg(F.collect_list(F.struct("transition", "row_count")))  # at most four rows
    got = groups.withColumn("_m", packed.scalar()).select("*", F.explode("_m").alias("x"))
    n = s.agg(F.count(F.lit(1))).scalar()
    return got.select(
        "agree", "support", F.round("macro_f1", 6).alias("bagged_macro_f1"), F.round("mean_std", 6).alias("mean_std"), "x.transition",
        "x.row_count", F.round(F.col("x.row_count") / n, 6).alias("rate"))


# Diagnosis ------------------------------------------------------------------------------------


@query("m24_diagnosis", f"""with {_PW}, {_CLASSF} select variant, cls, {r6('precision')} as precision, {r6('recall')} as recall, case when f1 >= 0.62 then 'good' when recall - precision > 0.01 then 'over_predicted' when recall - precision <
 -0.01 then 'missed' else 'balanced_weak' end as diagnosis from pc""")
def _(fx):
    pc = me.per_class(me.confusion(_by_variant(fx), ["variant"]), ["variant"])
    got = pc.withColumn("diagnosis", me.diagnosis(F.col("precision"), F.col("recall"), F.col("f1"), 0.62, 0.01))
    return _round(got, "precision", "recall").select("variant", "cls", "precision", "recall", "diagnosis")


@query("m25_marker_f1_correlation", f"""with {_PW}, {_CLASSF}, h as (select label as cls, token, count(*) as k from tok_codon join samples using (sid) group by 1, 2), m as (select h.cls, max(k / cast(cls_n as double)) as best_rate, count(*)
 filter (k >= 8) as markers from h join csize on csize.cls = h.cls group by 1) select {r6('corr(best_rate, f1)')} as best_rate_f1, {r6('corr(markers, f1)')} as markers_f1, {r6('corr(support, f1)')} as support_f1 from pc join m using (cls) where
 variant = 'a'""")
def _(fx):
    pc = me.per_class(me.confusion(_by_variant(fx).filter("variant = 'a'")))
    sizes = fx.samples.groupBy(F.col("label").alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    hits = ranks.by_rows(fx.tokens("codon"), fx.samples, ["sid"]).groupBy(F.col("label").alias("cls"), "token").agg(F.count(F.lit(1)).alias("k"))
    best = hits.join(sizes, "cls").groupBy("cls").agg(F.max(F.col("k") / F.col("n")).alias("best_rate"), F.count_if(F.col("k") >= 8).alias("markers"))
    return pc.join(best, "cls").agg(*[F.round(F.corr(x, "f1"), 6).alias(f"{x}_f1") for x in ("best_rate", "markers", "support")])


@query("m28_error_segments", f"""with {_PW}, x as (select r.sid, case when label = 'MACHINERY' and pred = 'MACHINERY' then 'target_correct' when label = 'MACHINERY' then 'target_missed' when pred = 'MACHINERY' then 'false_positive' else 'other' end as
 segment, p.pa from rs r join (select sid, pa from pv where cls = 'MACHINERY') p using (sid) where variant = 'a') select segment, count(*) as n, {r6('avg(pa)')} as mean, {r6('stddev_samp(pa)')} as std, {r6('quantile_cont(pa, 0.1)')} as q10,
 {r6('quantile_cont(pa, 0.25)')} as q25, {r6('quantile_cont(pa, 0.5)')} as median, {r6('quantile_cont(pa, 0.75)')} as q75, {r6('quantile_cont(pa, 0.9)')} as q90 from x group by 1""")
def _(fx):
    i = fx.classes.index("MACHINERY")
    x = _rows(fx).select("sid", "label", pr.argmax_class(F.col("a"), fx.classes).alias("pred"), F.col("a")[i].alias("p"))
    t, q = F.col("label") == "MACHINERY", F.col("pred") == "MACHINERY"
    segment = F.when(t & q, "target_correct").when(t, "target_missed").when(q, "false_positive").otherwise("other")
    x = x.select(segment.alias("segment"), "sid", "p")
    stats = x.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean"), F.round(F.stddev_samp("p"), 6).alias("std"))
    names = {0.1: "q10", 0.25: "q25", 0.5: "median", 0.75: "q75", 0.9: "q90"}
    q = ranks.exact_quantiles(x, ["segment"], "p", list(names), F.md5(F.col("sid").cast("string")), ["sid"])
    wide = q.groupBy("segment").agg(*[F.round(F.max(F.when(F.col("q") == v, F.col("value"))), 6).alias(n) for v, n in names.items()])
    return stats.join(wide, "segment")


@query("m28_score_by_true_class", f"select label as true_class, cls as target, count(*) as n, {r6('avg(pa)')} as mean, {r6('median(pa)')} as median from pv group by 1, 2")
def _(fx):
    long = pr.to_long(_rows(fx), F.col("a"), fx.classes, ("sid", "label")).select(
        "sid", F.col("label").alias("true_class"), F.col("cls").alias("target"), "p")
    keys = ["true_class", "target"]
    stats = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean"))
    q = ranks.exact_quantiles(long, keys, "p", [0.5], F.md5(F.col("sid").cast("string")), ["sid"])
    return stats.join(q.select(*keys, F.round("value", 6).alias("median")), keys)


@query("m29_top_wrong_predictions", f"""with {_PW}, cf as (select label as truth, pred, count(*) as n from rs where variant = 'a' group by 1, 2), s as (select *, n / cast(sum(n) over (partition by truth) as double) as share from cf), k as (select *,
 row_number() over (partition by truth order by n desc, pred) as rank from s where truth <> pred) select truth, pred, n, {r6('share')} as share, cast(rank as int) as rank from k where rank <= 5""")
def _(fx):
    cm = me.confusion(_by_variant(fx).filter("variant = 'a'")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("truth")))
    w = Window.partitionBy("truth").orderBy(F.desc("n"), "pred")
    return _round(cm.filter("truth <> pred").withColumn("rank", F.row_number().over(w)).filter("rank <= 5"), "share")


@query("m30_verdict", f"""with {_PW}, {_AB}, {_MIX}, fa as (select folds.fold, w.sid, truth, 'a' as m, pa as pred from w join folds using (sid) union all select folds.fold, mp.sid, truth, 'm', pm from mp join folds using (sid)),
 {_cm_sql('fa', 'fold, m')}, pf as (select fold, max(macro_f1) filter (m = 'm') > max(macro_f1) filter (m = 'a') as up from mf group by 1), {_cm_sql('fa', 'm').replace(' sd as', ' sd2 as').replace('from sd', 'from sd2').replace('mf as', 'mf2 as')},
 dd as (select max(macro_f1) filter (m = 'm') - max(macro_f1) filter (m = 'a') as delta from mf2), rb as (select count(*) filter (pa <> truth and pm = truth) as recovered, count(*) filter (pa = truth and pm <> truth) as broken from w join mp
 using (sid, truth)), ps as (select count(*) filter (up) as positive_folds from pf) select {r6('delta')} as delta, positive_folds, recovered, broken, case when delta >= 0.015 and positive_folds >= 4 and recovered > broken then
 'strong_candidate' when delta >= 0.005 and positive_folds >= 3 and recovered > broken then 'candidate' when delta > 0 then 'not_detected' else 'rejected' end as verdict from dd, ps, rb""")
def _(fx):
    x = ranks.by_rows(_preds(fx, pm=pr.blend([(F.col("a"), 0.8), (F.col("b"), 0.2)])), fx.folds().select("sid", "fold"), ["sid"])
    both = x.select("fold", "sid", "truth", F.explode(F.array(
        F.struct(F.lit("a").alias("m"), F.col("pa").alias("pred")), F.struct(F.lit("m").alias("m"), F.col("pm").alias("pred")))).alias("q"),
    ).select("fold", "sid", "truth", "q.m", "q.pred")
    gain = F.max(F.when(F.col("m") == "m", F.col("macro_f1"))) - F.max(F.when(F.col("m") == "a", F.col("macro_f1")))
    parts = me.macro_f1(both, ["fold", "m"]).groupBy("fold").agg(gain.alias("d")).agg(F.count_if(F.col("d") > 0).alias("positive_folds"))
    delta = me.macro_f1(both, ["m"]).agg(gain)
    ok, new = F.col("pa") == F.col("truth"), F.col("pm") == F.col("truth")
    moved = x.agg(F.count_if(~ok & new).alias("recovered"), F.count_if(ok & ~new).alias("broken"))
    got = moved.withColumns({"delta": delta.scalar(), "positive_folds": parts.scalar()})
    v = me.verdict(F.col("delta"), F.col("positive_folds"), F.lit(1.0), F.col("recovered"), F.col("broken"))
    return _round(got.withColumn("verdict", v), "delta")


# Permutation null -----------------------------------------------------------------------------

_PERM = """pl as (select a.sid, b.label from (select sid, row_number() over (order by md5('7:rows:' || sid)) as rn from samples) a join (select label, row_number() over (order by md5('7:labels:' || sid)) as rn from samples) b on a.rn = b.rn),
 fo as (select *, cast((row_number() over (partition by label order by md5('42:' || sid)) - 1) % 5 as int) as fold from pl)"""


@query("m26_permutation_null", f"with {_PERM}, " + _fit_grid("tok_gene_type").replace("join folds s", "join fo s").replace("from folds)", "from fo)").replace("from folds join", "from fo join") + f""",
 fw as (select fold, token, cls, greatest(least((ln((pos + 1) / (cn - pos + 1)) - ln((s - pos + 1) / (n - cn - (s - pos) + 1))) * s / (s + 10), 4), -4) as w from fg where s >= 10 and s < n),
 sc as (select sid, fold, cls, sum(w) / sqrt(count(*)) as score from fo join tok_gene_type using (sid) join fw using (fold, token) group by 1, 2, 3), al as (select f.sid, f.label, c.cls, round(coalesce(score, 0), 9) as score from fo f cross join
 classes c left join sc on sc.sid = f.sid and sc.cls = c.cls), pd as (select sid, any_value(label) as truth, min(cls) filter (rn = 1) as pred from (select *, row_number() over (partition by sid order by score desc, cls) as rn from al) z group by 1),
 {_cm_sql('pd')} select {r6('macro_f1')} as macro_f1, {r6('accuracy')} as accuracy, {r6('1 / cast(k as double)')} as chance from mf, (select count(*) as k from classes) q""")
def _(fx):
    """The same cross-fitted scorer on shuffled labels: what is left is chance."""
    shuffled = fo.permute_labels(fx.samples, 7)
    folds = fo.stratified_folds(shuffled)
    scores = we.cross_fitted_scores(fx.tokens("gene_type"), folds, fx.classes, we.log_odds())
    p = scores.select("sid", "cls", F.round("score", 9).alias("p")).join(shuffled, "sid")
    got = me.overall(me.confusion(me.predictions(p)))
    return got.select(F.round("macro_f1", 6).alias("macro_f1"), F.round("accuracy", 6).alias("accuracy"),
                      F.round(F.lit(1 / len(fx.classes)), 6).alias("chance"))


_PERMS = """ps as (select unnest(range(1, 21))::int as perm), pl as (select 0 as perm, sid, label from samples union all select a.perm, a.sid, b.label from
 (select perm, sid, row_number() over (partition by perm order by md5(perm || ':rows:' || sid)) as rn from samples, ps) a join
 (select perm, label, row_number() over (partition by perm order by md5(perm || ':labels:' || sid)) as rn from samples, ps) b on a.perm = b.perm and a.rn = b.rn),
 fo as materialized (select *, cast((row_number() over (partition by perm, label order by md5('42:' || sid)) - 1) % 5 as int) as fold from pl),
 tk as materialized (select perm, fold, token, label as cls, count(*) as c from fo join tok_gene_type using (sid) group by all),
 tt as (select perm, token, cls, sum(c) as c from tk group by all), ft as (select perm, fold, token, sum(c) as s from tk group by all),
 sl as (select perm, fold, label as cls, count(*) as c from fo group by all), sc as (select perm, label as cls, count(*) as c from fo group by all),
 fd as (select distinct perm, fold from fo), nn as (select count(*) as n from samples),
 out_c as (select fd.perm, fd.fold, sc.cls, (sc.c - coalesce(sl.c, 0))::double as cn from fd join sc using (perm) left join sl on sl.perm = fd.perm and sl.fold = fd.fold and sl.cls = sc.cls),
 out_n as (select perm, fold, sum(cn) as n from out_c group by all),
 g as (select ft.perm, ft.fold, ft.token, o.cls, (coalesce(tt.c, 0) - coalesce(tk.c, 0))::double as pos, o.cn, out_n.n, (a.s - ft.s)::double as s from ft join (select perm, token, sum(c) as s from tt group by all) a using (perm, token)
 join out_c o using (perm, fold) join out_n using (perm, fold) left join tt on tt.perm = ft.perm and tt.token = ft.token and tt.cls = o.cls left join tk on tk.perm = ft.perm and tk.fold = ft.fold and tk.token = ft.token and tk.cls = o.cls),
 w as (select perm, fold, token, cls, greatest(least((ln((pos + 1) / (cn - pos + 1)) - ln((s - pos + 1) / (n - cn - (s - pos) + 1))) * s / (s + 10), 4), -4) as w from g where s >= 10 and s < n),
 sco as (select perm, sid, cls, sum(w) / sqrt(count(*)) as score from fo join tok_gene_type using (sid) join w using (perm, fold, token) group by all),
 al as (select fo.perm, fo.sid, fo.label, c.cls, round(coalesce(score, 0), 9) as score from fo cross join classes c left join sco on sco.perm = fo.perm and sco.sid = fo.sid and sco.cls = c.cls),
 pd as (select perm, sid, label as truth, cls as pred from al qualify row_number() over (partition by perm, sid order by score desc, cls) = 1),
 names as (select distinct perm, truth as cls from pd union select distinct perm, pred from pd),
 f1 as (select perm, cls, 2.0 * count(*) filter (truth = cls and pred = cls) / (count(*) filter (truth = cls) + count(*) filter (pred = cls)) as f from names join pd using (perm) group by all),
 mm as (select perm, avg(f) as macro_f1 from f1 group by 1), ac as (select perm, avg((truth = pred)::int) as accuracy from pd group by 1),
 res as (select perm, macro_f1, accuracy from mm join ac using (perm))"""


@query("m26_permutation_distribution", f"""with {_PERMS} select a.perm, {r6('any_value(a.macro_f1)')} as macro_f1, {r6('any_value(a.accuracy)')} as accuracy,
 {r6('(count(*) filter (round(b.macro_f1, 12) >= round(a.macro_f1, 12)))::double / count(*)')} as p_value from res a cross join res b group by 1""")
def _(fx):
    """Twenty shuffles and the labels as they are (perm 0), all in one pass."""
    return _round(me.permutation_null(fx.tokens("gene_type"), fx.samples, fx.classes, we.log_odds(), list(range(1, 21))), "macro_f1", "accuracy", "p_value")
