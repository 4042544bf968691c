"""Blends, gates, specialists, calibration, rankers and fold-local choices."""
from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.catalog.base import query, r6
from glyphmill.functions.hashing import md5_int
from glyphmill.operators import metrics as me, probs as pr, ranks, relational as rel, rollups as ru, weights as we
from glyphmill.catalog.weights import EB, grid
from glyphmill.session import cut_lineage

PAIR = ("AUTOMOBILE", "MACHINERY")


def _rows(fx, folds=False):
    rows = pr.rows_of(fx.prob(["a", "b", "c"], 400), ["a", "b", "c"], fx.classes)
    return ranks.by_rows(rows, fx.folds().select("sid", "fold"), ["sid"]) if folds else rows


def _long(fx, rows, array, *keys):
    got = pr.to_long(rows, array, fx.classes, ("sid", *keys))
    return got.withColumn("p", F.round("p", 6))


@query("b1_align_classes", f"select sid, cls, {r6('case when cls in (' + repr('AUTOMOBILE') + ', ' + repr('HOUSEHOLD') + ') then 0 else p end')}"
       " as p from pr1")
def _(fx):
    partial = fx.prob(["a"]).filter(~F.col("cls").isin("AUTOMOBILE", "HOUSEHOLD"))
    return _long(fx, pr.rows_of(partial, ["a"], fx.classes, ("sid",)), F.col("a"))


@query("b2_weighted_blend", f"select sid, cls, {r6('0.55 * pa + 0.30 * pb + 0.15 * pc')} as p from pv")
def _(fx):
    return _long(fx, _rows(fx), pr.blend([(F.col("a"), 0.55), (F.col("b"), 0.30), (F.col("c"), 0.15)]))


def _cm_sql(pred: str, by: str = "") -> str:
    """CTEs from ``pd(by.., sid, truth, pred)`` to macro F1 per by."""
    b = f"{by}, " if by else ""
    g = f"group by {by}" if by else ""
    return f""" sd as (select {b}cls, sum(tp) as tp, sum(t) as t, sum(q) as q from (select {b}truth as cls, cast(truth = pred as int) as tp,
 1 as t, 0 as q from {pred} union all select {b}pred, 0, 0, 1 from {pred}) z group by {b}cls),
 mf as (select {b}avg(2.0 * tp / (t + q)) as macro_f1, sum(tp) / cast(sum(t) as double) as accuracy from sd {g})"""


_GRID3 = ", ".join(f"({i}, {j}, {5 - i - j})" for i in range(6) for j in range(6 - i) if sum(x > 0 for x in (i, j, 5 - i - j)) >= 2)


@query("b3_simplex_grid", f"""with gd as (select * from (values {_GRID3}) v(i, j, k)), bl as (select sid, label, cls, i, j, k, i / 5.0::double * pa +
 j / 5.0::double * pb + k / 5.0::double * pc as p from pv, gd), pd as (select i, j, k, sid, any_value(label) as truth, min(cls) filter (rn = 1) as
 pred from (select *, row_number() over (partition by i, j, k, sid order by round(p, 14) desc, cls) as rn from bl) z group by 1, 2, 3, 4),
 {_cm_sql('pd', 'i, j, k')} select i / 5.0::double as w_a, j / 5.0::double as w_b, k / 5.0::double as w_c, {r6('macro_f1')} as macro_f1,
 {r6('accuracy')} as accuracy from mf""")
def _(fx):
    points = [tuple(x / 5 for x in w) for w in pr.compositions(5, 3) if sum(x > 0 for x in w) >= 2]
    keys = ["w_a", "w_b", "w_c"]
    got = pr.grid_scores(pr.grid_predictions(_rows(fx), ["a", "b", "c"], points, fx.classes), keys)
    return got.select(*keys, F.round("macro_f1", 6).alias("macro_f1"), F.round("accuracy", 6).alias("accuracy"))


_W1 = [0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35]
_W1SQL = ", ".join(f"({w}::double)" for w in _W1)


@query("b3_m27_weight_curve", f"""with gd as (select * from (values {_W1SQL}) v(w)), bl as (select sid, label, cls, w, (1 - w) * pa + w * pb as p from
 pv, gd), pd as (select w, sid, any_value(label) as truth, min(cls) filter (rn = 1) as pred from (select *, row_number() over (partition by w,
 sid order by p desc, cls) as rn from bl) z group by 1, 2), {_cm_sql('pd', 'w')} select 1 - w as w_a, w as w_b, {r6('macro_f1')} as macro_f1,
 {r6('accuracy')} as accuracy from mf""")
def _(fx):
    got = pr.grid_scores(pr.grid_predictions(_rows(fx), ["a", "b"], [(1 - w, w) for w in _W1], fx.classes), ["w_a", "w_b"])
    return got.select("w_a", "w_b", F.round("macro_f1", 6).alias("macro_f1"), F.round("accuracy", 6).alias("accuracy"))


_W2 = [(1 - c - l, l, c) for c in (0.0, 0.1, 0.2, 0.3) for l in (0.0, 0.1, 0.2, 0.3) if 1 - c - l >= 0.5 - 1e-12]


@query("b3_two_weight_floor", f"""with gd as (select row_number() over () as o, * from (values {', '.join(f'({x}::double, {y}::double, {z}::double)' for x, y, z in _W2)})
 v(wa, wb, wc)), bl as (select sid, label, cls, o, wa, wb, wc, wa * pa + wb * pb + wc * pc as p from pv, gd), pd as (select o, wa, wb, wc, sid,
 any_value(label) as truth, min(cls) filter (rn = 1) as pred from (select *, row_number() over (partition by o, sid order by p desc, cls) as rn
 from bl) z group by 1, 2, 3, 4, 5), {_cm_sql('pd', 'wa, wb, wc')} select wa as w_a, wb as w_b, wc as w_c, {r6('macro_f1')} as macro_f1 from mf
 order by round(macro_f1, 9) desc, wc, wb limit 1""")
def _(fx):
    """Best of a grid with a floor on the first weight; ties to the smaller candidate weight."""
    got = pr.grid_scores(pr.grid_predictions(_rows(fx), ["a", "b", "c"], _W2, fx.classes), ["w_a", "w_b", "w_c"])
    best = got.orderBy(F.desc(F.round("macro_f1", 9)), "w_c", "w_b").limit(1)
    return best.select("w_a", "w_b", "w_c", F.round("macro_f1", 6).alias("macro_f1"))


_GR = [0.1, 0.2, 0.3, 0.4, 0.5]
_GRSQL = ", ".join(f"({w}::double)" for w in [0.0] + _GR)


def fold_local_sql(source: str, p: str, base: str, extra: str, part: str = "fold") -> str:
    """CTEs named with prefix p: {p}best(part, w) and {p}out(sid, label, part, cls, p, pc)."""
    cm = _cm_sql(f"{p}pd", f"left_out, w").replace(" sd as", f" {p}sd as").replace("from sd", f"from {p}sd").replace("mf as", f"{p}mf as")
    return f""" {p}gd as (select * from (values {_GRSQL}) v(w)),
 {p}ar as materialized (select {part}, w, sid, any_value(label) as truth, min(cls) filter (rn = 1) as pred from (select *, row_number() over (partition by w, sid,
  {part} order by {base} * (1 - w) + {extra} * w desc, cls) as rn from {source}, {p}gd) z group by 1, 2, 3),
 {p}pd as (select f.{part} as left_out, {p}ar.* from {p}ar join (select distinct {part} from {source}) f on f.{part} <> {p}ar.{part}), {cm},
 {p}best as materialized (select left_out as {part}, w as weight from (select *, row_number() over (partition by left_out order by round(macro_f1, 9) desc, w)
  as rn from {p}mf) z where rn = 1),
 {p}out as materialized (select s.*, weight, {base} * (1 - weight) + {extra} * weight as {p}p from {source} s join {p}best using ({part}))"""


@query("f9_fold_local_blend", "with " + fold_local_sql("pvf", "x", "pa", "pb")
       + f" select sid, cls, fold, weight, {r6('xp')} as p from xout")
def _(fx):
    got = pr.local_blend(_rows(fx, True), "a", "b", _GR, fx.classes, "mix")
    return _long(fx, got.withColumnRenamed("mix_weight", "weight"), F.col("mix"), "fold", "weight")


def _macro(source: str, p: str, name: str) -> str:
    """CTE {name}(f1): macro F1 of argmax over ``p`` of a long table."""
    cm = _cm_sql(f"{name}pd").replace(" sd as", f" {name}sd as").replace("from sd", f"from {name}sd").replace("mf as", f"{name}mf as")
    return f""" {name}pd as (select sid, any_value(label) as truth, min(cls) filter (rn = 1) as pred from (select *, row_number() over (partition by
 sid order by {p} desc, cls) as rn from {source}) z group by 1), {cm}, {name} as (select macro_f1 as f1 from {name}mf)"""


@query("b4_two_stage_blends", "with " + ",".join([
    fold_local_sql("pvf", "b", "pa", "pb"),
    " s1 as (select sid, label, fold, cls, bp as pa, pc as pb from bout)", fold_local_sql("s1", "bc", "pa", "pb"),
    fold_local_sql("pvf", "c", "pa", "pc"),
    " s2 as (select sid, label, fold, cls, cp as pa, pb as pb from cout)", fold_local_sql("s2", "cb", "pa", "pb"),
    _macro("pvf", "pa", "m0"), _macro("bout", "bp", "mb"), _macro("bcout", "bcp", "mbc"), _macro("cout", "cp", "mc"), _macro("cbout", "cbp", "mcb"),
]) + f""" select 'b' as first, 'c' as second, {r6('mb.f1 - m0.f1')} as gain_first, {r6('mbc.f1 - m0.f1')} as gain_total, {r6('mbc.f1 - mb.f1')} as
 marginal from m0, mb, mbc union all select 'c', 'b', {r6('mc.f1 - m0.f1')}, {r6('mcb.f1 - m0.f1')}, {r6('mcb.f1 - mc.f1')} from m0, mc, mcb""")
def _(fx):
    rows = cut_lineage(_rows(fx, True))
    for order in (["b", "c"], ["c", "b"]):
        rows = pr.staged_blend(rows, "a", order, _GR, fx.classes)
    stages = ["a", "a+b", "a+b+c", "a+c", "a+c+b"]
    pred = rows.select("sid", F.col("label").alias("truth"), F.explode(F.array(*[
        F.struct(F.lit(s).alias("stage"), pr.argmax_class(F.col(f"`{s}`"), fx.classes).alias("pred")) for s in stages])).alias("x"))
    f1 = me.overall(me.confusion(pred.select("sid", "truth", "x.stage", "x.pred"), ["stage"]), ["stage"])
    at = {s: F.max(F.when(F.col("stage") == s, F.col("macro_f1"))) for s in stages}
    out = [F.struct(
        F.lit(x).alias("first"), F.lit(y).alias("second"), F.round(at[f"a+{x}"] - at["a"], 6).alias("gain_first"),
        F.round(at[f"a+{x}+{y}"] - at["a"], 6).alias("gain_total"), F.round(at[f"a+{x}+{y}"] - at[f"a+{x}"], 6).alias("marginal"))
        for x, y in (("b", "c"), ("c", "b"))]
    return f1.agg(F.array(*out).alias("o")).select(F.explode("o").alias("o")).select("o.*")


@query("b4_blends_in_all_orders")
def _(fx):
    """Five candidates over a base: all ordered pairs, and the best pair with each third; what a candidate adds at each place."""
    names = ["a", "b", "c", "d", "e", "f"]
    rows = ranks.by_rows(pr.rows_of(fx.prob(names, 400), names, fx.classes), fx.folds().select("sid", "fold"), ["sid"])
    got = pr.ordered_blends(cut_lineage(rows), "a", names[1:], _GR, fx.classes)
    return got.select(F.array_join("path", "+").alias("path"), "position", F.element_at("path", -1).alias("last"), F.round("gain_total", 6).alias("gain_total"), F.round("marginal", 6).alias("marginal"))


_SEEDED = """sr as (select sid, label, cls, cast(substr(variant, 2) as int) as seed, max(p) filter (variant[1] = 'a') as pa, max(p) filter
 (variant[1] = 'b') as pb from prs group by 1, 2, 3, 4)"""


@query("f10_seed_holdout_weight", f"""with {_SEEDED}, gd as (select * from (values {_GRSQL}) v(w)), pd as (select seed, w, sid, any_value(label) as truth,
 min(cls) filter (rn = 1) as pred from (select *, row_number() over (partition by seed, w, sid order by pa * (1 - w) + pb * w desc, cls) as rn from sr,
 gd) z group by 1, 2, 3), {_cm_sql('pd', 'seed, w')}, mm as (select h.seed as held_seed, w, avg(macro_f1) as mean_f1 from mf join (select distinct seed
 from sr) h on h.seed <> mf.seed group by 1, 2), bs as (select * from (select *, row_number() over (partition by held_seed order by
 round(mean_f1, 9) desc, w) as rn from mm) z where rn = 1) select held_seed, bs.w as weight, {r6('x.macro_f1')} as baseline_f1, {r6('y.macro_f1')} as
 selected_f1, {r6('y.macro_f1 - x.macro_f1')} as delta from bs join mf x on x.seed = held_seed and x.w = 0 join mf y on y.seed = held_seed and y.w =
 bs.w""")
def _(fx):
    variants = [f"{v}{s}" for s in (1, 2, 3) for v in "ab"]
    long = fx.prob(variants, 400).withColumn("seed", F.substring("variant", 2, 1).cast("int")).withColumn(
        "variant", F.substring("variant", 1, 1))
    rows = pr.rows_of(long, ["a", "b"], fx.classes, ("sid", "label", "seed"))
    predicted = pr.grid_predictions(rows, ["a", "b"], [(1 - w, w) for w in [0.0, *_GR]], fx.classes, ("sid", "label", "seed"))
    scores = pr.grid_scores(predicted.withColumnRenamed("w_b", "weight"), ["seed", "weight"]).select("seed", "weight", "macro_f1")
    return me.seed_holdout(scores)


@query("w6_f11_mean_over_seeds", f"with {_SEEDED} select sid, cls, {r6('avg(pa)')} as p from sr group by 1, 2")
def _(fx):
    long = fx.prob(["a1", "a2", "a3"], 400)
    return long.groupBy("sid", "cls").agg(F.round(F.avg("p"), 6).alias("p"))


@query("b5_margin_gate", f"select pv.sid, cls, {r6('case when b1 - b2 < 0.05 then pa else pb end')} as p from pv join pt using (sid)")
def _(fx):
    return _long(fx, _rows(fx), pr.gate(F.col("a"), F.col("b")))


# The specialist of these queries is a hash-derived share of the first class of the pair.
_Q = "((1 + ('0x' || substr(md5('s:' || sid), 1, 8))::bigint % 999) / 1000.0::double)"


def _share():
    return (F.lit(1) + md5_int(F.concat(F.lit("s:"), F.col("sid").cast("string"))) % 999) / 1000.0


_PM = """pq as (select sid, max(pa) filter (cls = 'AUTOMOBILE') as x, max(pa) filter (cls = 'MACHINERY') as y, max(pa) filter (cls not in
 ('AUTOMOBILE', 'MACHINERY')) as o from pv group by 1)"""
_NEWP = "case cls when 'AUTOMOBILE' then (x + y) * ({s}) when 'MACHINERY' then (x + y) * (1 - ({s})) else pa end"
_INP = "acls in ('AUTOMOBILE', 'MACHINERY')"


def _pair_sql(share: str, routed: str) -> str:
    return f"with {_PM} select pv.sid, cls, {r6('case when ' + routed + ' then ' + _NEWP.format(s=share) + ' else pa end')} as p from pv join pq using (sid) join pt using (sid)"


@query("b6_hard_pair_specialist", _pair_sql(_Q, _INP).replace("md5('s:' || sid)", "md5('s:' || pv.sid)"))
def _(fx):
    routed = pr.route(F.col("a"), fx.classes, PAIR, "hard")
    return _long(fx, _rows(fx), pr.redistribute_pair(F.col("a"), fx.classes, PAIR, _share(), "hard", routed=routed))


_QP = _Q.replace("|| sid", "|| pv.sid")


@query("b6b_soft_pair_specialist", _pair_sql(f"x / (x + y) * 0.6 + {_QP} * 0.4", _INP))
def _(fx):
    routed = pr.route(F.col("a"), fx.classes, PAIR, "hard")
    return _long(fx, _rows(fx), pr.redistribute_pair(F.col("a"), fx.classes, PAIR, _share(), "soft", 0.4, routed))


@query("b6b_soft_mass_specialist", _pair_sql(f"x / (x + y) * (1 - (x + y) * 0.5) + {_QP} * ((x + y) * 0.5)", "true"))
def _(fx):
    return _long(fx, _rows(fx), pr.redistribute_pair(F.col("a"), fx.classes, PAIR, _share(), "soft_mass", 0.5))


@query("b6c_routing_rules", f"""with {_PM} select count(*) filter ({_INP}) as hard, count(*) filter ({_INP} and abs(x - y) / (x + y) <= 0.3) as pair_margin,
 count(*) filter ({_INP} and a1 - a2 <= 0.1) as global_margin, count(*) filter (least(x, y) > o) as top_two, count(*) filter (x + y >= 0.2 and
 greatest(x, y) / (x + y) <= 0.85) as mass from pq join pt using (sid)""")
def _(fx):
    rules = (("hard", None), ("pair_margin", 0.3), ("global_margin", 0.1), ("top_two", None), ("mass", None))
    return _rows(fx).agg(*[F.count_if(pr.route(F.col("a"), fx.classes, PAIR, h, t)).alias(h) for h, t in rules])


@query("b6c_top_two_specialist", _pair_sql(_QP, "least(x, y) > o"))
def _(fx):
    routed = pr.route(F.col("a"), fx.classes, PAIR, "top_two")
    return _long(fx, _rows(fx), pr.redistribute_pair(F.col("a"), fx.classes, PAIR, _share(), "hard", routed=routed))


_TRIO = ["AUTOMOBILE", "FURNITURE", "MACHINERY"]


@query("b6d_group_redistribution", f"""select sid, cls, {r6("case when cls in ('AUTOMOBILE', 'FURNITURE', 'MACHINERY') then ma * (pb / mb) else pa end")} as p
 from (select *, sum(pa) filter (cls in ('AUTOMOBILE', 'FURNITURE', 'MACHINERY')) over (partition by sid) as ma, sum(pb) filter (cls in ('AUTOMOBILE',
 'FURNITURE', 'MACHINERY')) over (partition by sid) as mb from pv) z""")
def _(fx):
    return _long(fx, _rows(fx), pr.redistribute_group(F.col("a"), fx.classes, _TRIO, F.col("b")))


@query("b7_matched_blend", f"""with m as (select c_custkey as sid, c_nationkey % 3 = 0 as matched from customer) select pv.sid, cls, {r6('case when matched then 0.8 * pa + 0.2 * pb else pa end')}
 as p from pv join m using (sid)""")
def _(fx):
    matched = fx.t("customer").select(F.col("c_custkey").alias("sid"), (F.col("c_nationkey") % 3 == 0).alias("matched"))
    mixed = F.when(F.col("matched"), pr.blend([(F.col("a"), 0.8), (F.col("b"), 0.2)])).otherwise(F.col("a"))
    return _long(fx, ranks.by_rows(_rows(fx), matched, ["sid"]), mixed)


@query("b8_mass_calibration", f"""with w as (select cls, least(greatest(pow((count(*) filter (label = cls) / cast(count(*) as double)) / avg(pa), 0.5), 0.8), 1.25) as
 w from pv group by 1) select sid, cls, {r6('pa * w / sum(pa * w) over (partition by sid)')} as p from pv join w using (cls)""")
def _(fx):
    rows = _rows(fx)
    weights = pr.mass_weights(rows, "a", fx.classes, 0.5)
    return _long(fx, rows.withColumn("weights", weights.scalar()), pr.normalise(pr.scale_classes(F.col("a"), F.col("weights"))))


@query("b9_class_multiplier", """with m as (select * from (values ('AUTOMOBILE', 1.3::double), ('BUILDING', 0.9), ('FURNITURE', 1.0), ('HOUSEHOLD', 0.8), ('MACHINERY', 1.1)) v(cls,
 m)) select sid, cls as pred from (select sid, cls, row_number() over (partition by sid order by pa * m desc, cls) as rn from pv join m using (cls)) z
 where rn = 1""")
def _(fx):
    scaled = pr.scale_classes(F.col("a"), F.array(*[F.lit(x) for x in (1.3, 0.9, 1.0, 0.8, 1.1)]))
    return _rows(fx).select("sid", pr.argmax_class(scaled, fx.classes).alias("pred"))


@query("b10_residual_correction", f"""with z as (select sid, cls, ln(greatest(pa, 1e-12)) + 0.2 * (pb - pc) as z from pv), e as (select *, exp(z - max(z) over (partition by
 sid)) as e from z) select sid, cls, {r6('e / sum(e) over (partition by sid)')} as p from e""")
def _(fx):
    residual = F.zip_with("b", "c", lambda x, y: x - y)
    return _long(fx, _rows(fx), pr.correct_residual(F.col("a"), residual, 0.2))


_CAND = f"""with {grid('tok_gene_type')}, w as (select token, cls, s, {EB} as w from g), sc as (select sid, cls, sum(w) / sqrt(count(*)) as e,
 coalesce(sum(w) filter (s < 500) / sqrt(count(*) filter (s < 500)), 0) as r from tok_gene_type join w using (token) group by 1, 2), bd as (select sid,
 count(distinct gene) as mg from events group by 1), x as (select pv.sid, pv.label, pv.cls, pa as p0, pb as p1, coalesce(e, 0) as e, coalesce(r, 0) as r,
 ln(1 + coalesce(mg, 0)) as lb, a1, a2, b1, b2, acls, bcls from pv join pt using (sid) left join sc on sc.sid = pv.sid and sc.cls = pv.cls left join bd on
 bd.sid = pv.sid), y as (select *, max(greatest(e, 0)) over (partition by sid) as pmax, sum(least(e, 0)) over (partition by sid) as nsum, min(least(e, 0))
 over (partition by sid) as nmin, count(*) filter (e > 0) over (partition by sid) as np, count(*) filter (e < 0) over (partition by sid) as nn,
 row_number() over (partition by sid order by e desc, cls) as re from x), z as (select *, sum(greatest(e, 0)) filter (re <= 3) over (partition by sid) as
 p3 from y)"""


def _candidates(fx):
    weighted = we.weigh(we.token_counts(fx.tokens("gene_type"), fx.samples, fx.classes), we.empirical_bayes())

    def arrays(table, name):
        got = we.score_tokens(fx.tokens("gene_type"), table, fx.classes).select("sid", "cls", F.lit(name).alias("variant"), F.col("score").alias("p"))
        return pr.rows_of(got, [name], fx.classes, ("sid",))

    burden = ru.gene_presence(fx.events).groupBy("sid").agg(F.count(F.lit(1)).alias("mutated_genes"))
    zero = F.array(*[F.lit(0.0)] * len(fx.classes))
    rows = _rows(fx).join(arrays(weighted, "e"), "sid", "left").join(arrays(weighted.filter("support < 500"), "r"), "sid", "left")
    rows = rows.join(burden, "sid", "left").withColumns({
        "e": F.coalesce("e", zero), "r": F.coalesce("r", zero), "mutated_genes": F.coalesce("mutated_genes", F.lit(0))})
    return pr.candidate_table(rows, "a", "b", "e", "r", "mutated_genes", fx.classes)


@query("b11_w3_candidate_table", _CAND + f""" select sid, cls, {r6('p0')} as p0, {r6('p1')} as p1, {r6('ln(p0 / (1 - p0))')} as logit_p0, {r6('ln(p1 / (1 - p1))')} as logit_p1,
 {r6('p1 - case when cls = bcls then b2 else b1 end')} as lead, {r6('e')} as evidence, {r6('e / greatest(lb, 1)')} as evidence_per_burden, {r6('r')} as rare_evidence,
 {r6('e - r')} as common_evidence, {r6('pmax')} as positive_max, {r6('p3')} as positive_top3, {r6('nsum')} as negative_sum, {r6('nmin')} as negative_min,
 cast(np as int) as n_positive, cast(nn as int) as n_negative, {r6('lb')} as log_burden, cast(cls = acls as int) as is_top_p0, cast(cls = bcls as int) as is_top_p1,
 cast(acls = bcls as int) as models_agree from z""")
def _(fx):
    got = _candidates(fx)
    whole = {"sid", "cls", "n_positive", "n_negative", "is_top_p0", "is_top_p1", "models_agree"}
    return got.select(*[F.col(x) if x in whole else F.round(x, 6).alias(x) for x in got.columns])


@query("b12_symmetric_pairs", f"""with d as (select t.sid, t.label, o.cls as other, t.pa - o.pa as da, t.pb - o.pb as db, (select n from ntot) / cast(cls_n * 5 as double) as w
 from pv t join pv o on t.sid = o.sid and t.cls = t.label and o.cls <> t.label join csize on csize.cls = t.label) select sid, label, other, 1 as target,
 {r6('w')} as weight, {r6('da')} as d_a, {r6('db')} as d_b from d union all select sid, label, other, 0, {r6('w')}, {r6('-da')}, {r6('-db')} from d""")
def _(fx):
    prob = fx.prob(["a", "b"], 400).groupBy("sid", "cls").pivot("variant", ["a", "b"]).agg(F.first("p"))
    got = pr.symmetric_pairs(prob, fx.samples, ["a", "b"], len(fx.classes))
    return got.withColumns({x: F.round(x, 6) for x in ("weight", "d_a", "d_b")})


_PAIRS = """pp as (select a.cls as ca, b.cls as cb from classes a join classes b on a.cls < b.cls), pr as (select sid, any_value(label) as truth, min(cls)
 filter (ra = 1) as ap, min(cls) filter (rb = 1) as bp from (select *, row_number() over (partition by sid order by pa desc, cls) as ra, row_number() over
 (partition by sid order by pb desc, cls) as rb from pv) z group by 1), cs as (select ca, cb, unnest([ca, cb]) as c from pp), f as (select ca, cb, c,
 2.0 * count(*) filter (truth = c and ap = c) / nullif(count(*) filter (truth = c) + count(*) filter (ap = c), 0) as fa, 2.0 * count(*) filter (truth = c
 and bp = c) / nullif(count(*) filter (truth = c) + count(*) filter (bp = c), 0) as fb from cs join pr on truth in (ca, cb) group by 1, 2, 3), g as (select
 ca, cb, avg(coalesce(fb, 0)) - avg(coalesce(fa, 0)) as delta from f group by 1, 2), h as (select ca, cb, count(*) filter (ap <> truth and bp = truth) as
 recovered, count(*) filter (ap = truth and bp <> truth) as broken, count(*) as n_rows from pp join pr on truth in (ca, cb) group by 1, 2)"""


def _pair_table(fx):
    pred = _rows(fx).select("sid", F.col("label").alias("truth"), pr.argmax_class(F.col("a"), fx.classes).alias("pa"), pr.argmax_class(F.col("b"), fx.classes).alias("pb"))
    return me.pair_comparison(pred, fx.classes)


@query("m31_pair_restricted_f1", f"with {_PAIRS} select g.ca as class_a, g.cb as class_b, {r6('delta')} as delta, recovered, broken, n_rows from g join h using (ca, cb)")
def _(fx):
    return _pair_table(fx).withColumn("delta", F.round("delta", 6))


@query("b13_validated_pairs")
def _(fx):
    rows = [tuple(r)[:5] for r in _pair_table(fx).select("class_a", "class_b", "delta", "recovered", "broken").collect()]  # class pairs
    return fx.spark.createDataFrame(pr.validated_pairs(rows), "class_a string, class_b string, delta double, recovered bigint, broken bigint")


@query("b14_capacity_policy", """select class_a, class_b, support, case when support <= 600 then 'small' else 'large' end as by_support, list_extract(['small', 'medium', 'large',
 'large'], cast(rk as int)) as by_rank from (select a.cls as class_a, b.cls as class_b, a.cls_n + b.cls_n as support, row_number() over (order by a.cls_n + b.cls_n desc,
 a.cls, b.cls) as rk from csize a join csize b on a.cls < b.cls) z where rk <= 4""")
def _(fx):
    from pyspark.sql import Window
    sizes = fx.samples.groupBy(F.col("label").alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    pairs = rel.class_pairs(sizes, "cls").select(F.col("x.cls").alias("class_a"), F.col("y.cls").alias("class_b"), (F.col("x.n") + F.col("y.n")).alias("support"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("support"), "class_a", "class_b")) - 1  # class pairs
    got = pairs.withColumn("r", place).filter("r < 4")
    return got.select("class_a", "class_b", "support", pr.size_of_support(F.col("support")).alias("by_support"), pr.size_of_place(F.col("r")).alias("by_rank"))


_MEMBERS = {"G1": ["AUTOMOBILE", "MACHINERY"], "G2": ["BUILDING", "FURNITURE"]}


@query("b15_two_level_prediction", """with m as (select * from (values ('AUTOMOBILE', 'G1'), ('MACHINERY', 'G1'), ('BUILDING', 'G2'), ('FURNITURE', 'G2'), ('HOUSEHOLD',
 'HOUSEHOLD')) v(cls, grp)), gs as (select sid, grp, sum(pa) as p from pv join m using (cls) group by 1, 2), gb as (select sid, grp from (select *, row_number() over
 (partition by sid order by round(p, 12) desc, grp) as rn from gs) z where rn = 1), mb as (select sid, grp, cls, row_number() over (partition by sid, grp order by pb desc, cls) as rn
 from pv join m using (cls)) select gb.sid, gb.grp, mb.cls as pred, case when t.grp = gb.grp then s.label else mf.cls end as oracle_pred from gb join mb on
 mb.sid = gb.sid and mb.grp = gb.grp and mb.rn = 1 join samples s on s.sid = gb.sid join m t on t.cls = s.label join (select grp, min(cls) as cls from m group by 1) mf on mf.grp = gb.grp""")
def _(fx):
    """Group first, then member; the oracle is right whenever the group is right."""
    names = ["G1", "G2", "HOUSEHOLD"]
    sums = F.array(*[F.round(sum((F.col("a")[fx.classes.index(c)] for c in _MEMBERS.get(g, [g])), F.lit(0.0)), 12) for g in names])
    pred = pr.two_level(sums, F.col("b"), names, fx.classes, _MEMBERS)
    lookup = {c: g for g, cs in _MEMBERS.items() for c in cs}
    own = F.lit(None).cast("string")
    first = F.lit(None).cast("string")
    best = pr.argmax_class(sums, names)
    for c in fx.classes:
        own = F.when(F.col("label") == c, lookup.get(c, c)).otherwise(own)
    for g in names:
        first = F.when(best == g, min(_MEMBERS.get(g, [g]))).otherwise(first)
    return _rows(fx).select("sid", best.alias("grp"), pred.alias("pred"), F.when(own == best, F.col("label")).otherwise(first).alias("oracle_pred"))
