"""Token weights, scores, hierarchy, back-off and evidence."""
from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.catalog.base import query, r6
from glyphmill.functions import cells as c
from glyphmill.operators import evidence as ev, ranks, rollups as ru, weights as we
from glyphmill.session import cut_lineage
from glyphmill.sources.fixtures import token_table


def grid(tok: str, name: str = "g") -> str:
    return f"""{name}s as (select token, count(*) as s from {tok} join samples using (sid) group by 1),
 {name}p as (select token, label as cls, count(*) as pos from {tok} join samples using (sid) group by 1, 2),
 {name} as (select x.token, cast(s as double) as s, x.cls, cast(coalesce(pos, 0) as double) as pos, cast(cls_n as double) as cn,
  cast(n as double) as n from (select * from {name}s, csize, ntot) x left join {name}p p on p.token = x.token and p.cls = x.cls)"""


LO = "(ln((pos + 1) / (cn - pos + 1)) - ln((s - pos + 1) / (n - cn - (s - pos) + 1)))"


def clip(x: str, b: float = 4) -> str:
    return f"greatest(least({x}, {b}), -{b})"


def _lg(x: str) -> str:
    x = f"greatest(least({x}, 0.999999), 0.000001)"
    return f"ln({x} / (1 - {x}))"


_P0 = "((s + 1) / (n + 2))"
EBRAW = f"({_lg(f'((pos + 20 * {_P0}) / (cn + 20))')} - {_lg(f'((s - pos + 20 * {_P0}) / (n - cn + 20))')})"
EB = clip(EBRAW)


def _counts(fx, level):
    return we.token_counts(fx.tokens(level), fx.samples, fx.classes)


def _long(fx, counts, formula):
    got = we.weights_long(we.weigh(counts, formula), fx.classes)
    return got.select("token", "cls", "support", "pos", F.round("w", 6).alias("w"))


def _wsql(tok: str, w: str, where: str = "true") -> str:
    return (f"with {grid(tok)} select token, cls, cast(s as bigint) as support, cast(pos as bigint) as pos,"
            f" {r6(w)} as w from g where {where}")


@query("l1_log_odds_weights", _wsql("tok_codon", clip(f"{LO} * s / (s + 10)"), "s >= 10 and s < n"))
def _(fx):
    return _long(fx, we.supported(_counts(fx, "codon")), we.log_odds())


_CASES = ((20.0, 5), (10.0, 10), (50.0, 20))


@query(
    "l1b_log_odds_cases",
    f"with {grid('tok_codon')}, k as (select * from (values (20.0, 5), (10.0, 10), (50.0, 20)) v(shrink, flr))"
    f" select cast(shrink as double) as shrinkage, cast(flr as int) as support_floor, cls, count(*) as tokens,"
    f" {r6('sum(' + clip(LO + ' * s / (s + cast(shrink as double))') + ')')} as total,"
    f" {r6('max(' + clip(LO + ' * s / (s + cast(shrink as double))') + ')')} as largest"
    " from g, k where s >= flr and s < n and cls <> 'BUILDING' group by 1, 2, 3",
)
def _(fx):
    counts = _counts(fx, "codon")
    cases = F.explode(F.array(*[
        F.struct(F.lit(k).alias("shrinkage"), F.lit(f).alias("support_floor")) for k, f in _CASES]))
    many = counts.withColumn("case", cases).select("*", "case.*").filter(
        (F.col("support") >= F.col("support_floor")) & (F.col("support") < F.col("n")))
    raw = we.log_odds(shrinkage=None, clip=None)

    def formula(p, size, s, n):
        return we._clip(raw(p, size, s, n) * s / (s + F.col("shrinkage")), 4.0)

    long = we.weights_long(we.weigh(many.drop("case"), formula), fx.classes)
    return long.filter("cls <> 'BUILDING'").groupBy("shrinkage", "support_floor", "cls").agg(
        F.count(F.lit(1)).alias("tokens"), F.round(F.sum("w"), 6).alias("total"), F.round(F.max("w"), 6).alias("largest"))


@query("l1c_log_rate_ratio", _wsql(
    "tok_codon", clip("ln(((pos + 1) / (cn + 2)) / ((s - pos + 1) / (n - cn + 2))) * s / (s + 20)"), "s >= 10"))
def _(fx):
    return _long(fx, we.supported(_counts(fx, "codon"), below_all=False), we.log_rate_ratio())


@query("l1d_floored_weights", _wsql("tok_codon", f"case when s >= 25 then {clip(f'{LO} * s / (s + 10)')} else 0 end"))
def _(fx):
    base = we.log_odds()

    def formula(p, size, s, n):
        return F.when(s >= 25, base(p, size, s, n)).otherwise(F.lit(0.0))

    return _long(fx, _counts(fx, "codon"), formula)


@query("l2_empirical_bayes", _wsql("tok_codon", EB))
def _(fx):
    return _long(fx, _counts(fx, "codon"), we.empirical_bayes())


@query("l2_empirical_bayes_exact_events", f"with {grid('tok_exact')} select cls, cast(s as bigint) as support, cast(pos as"
       f" bigint) as pos, count(*) as tokens, {r6('max(' + EB + ')')} as w from g group by 1, 2, 3")
def _(fx):
    got = we.weights_long(we.weigh(_counts(fx, "exact"), we.empirical_bayes()), fx.classes)
    return got.groupBy("cls", "support", "pos").agg(F.count(F.lit(1)).alias("tokens"), F.round(F.max("w"), 6).alias("w"))


_IN = "((pos + cn / n) / (greatest(cn, 1) + 1))"
_OUT = "((s - pos + 1 - cn / n) / (greatest(n - cn, 1) + 1))"


@query("l2b_class_prior_bayes", _wsql("tok_gene_type", clip(
    f"(ln(({_IN} + 1e-6) / (1 - {_IN} + 1e-6)) - ln(({_OUT} + 1e-6) / (1 - {_OUT} + 1e-6))) * s / (s + 20)")))
def _(fx):
    return _long(fx, _counts(fx, "gene_type"), we.class_prior_bayes())


_ARCH_TOK = """tok_arch as (with z as (select sid, gene, count(*) as n, count(*) filter (event_type = 'MISSENSE') as mis,
 count(*) filter (event_type in ('NONSENSE', 'FRAMESHIFT', 'SPLICE')) as tr, count(distinct event_type) as ty,
 count(position) as np, count(distinct position) as dp from typed group by 1, 2 having count(*) >= 2)
 select sid, gene || '__EVENT_COUNT_2PLUS' as token from z
 union all select sid, gene || '__EVENT_COUNT_3PLUS' from z where n >= 3
 union all select sid, gene || '__MULTI_MISSENSE' from z where mis >= 2
 union all select sid, gene || '__MISSENSE_PLUS_TRUNCATING' from z where mis >= 1 and tr >= 1
 union all select sid, gene || '__MULTI_FUNCTIONAL_TYPE' from z where ty >= 2
 union all select sid, gene || '__SAME_POSITION_MULTI_EVENT' from z where np >= 2 and dp < np)"""


@query(
    "l2c_architecture_bayes",
    f"with {_ARCH_TOK}, {grid('tok_arch')} select token, cls, cast(s as bigint) as support, cast(pos as bigint) as pos,"
    f" {r6(EBRAW + ' * s / (s + 20)')} as w from g",
)
def _(fx):
    counts = we.token_counts(ru.architecture_tokens(fx.typed), fx.samples, fx.classes)
    return _long(fx, counts, we.empirical_bayes(clip=None, reliability=20.0))


def _score_sql(tok: str, w: str, where: str, denom: str = "count(*)") -> str:
    return f"""with {grid(tok)}, w as (select token, cls, {w} as w from g where {where}),
 a as (select sid, count(*) as all_tokens from {tok} group by 1),
 sc as (select sid, cls, sum(w) as total, count(*) as tokens from {tok} join w using (token) group by 1, 2)"""


@query(
    "l3_scores",
    _score_sql("tok_gene_type", clip(f"{LO} * s / (s + 10)"), "s >= 10 and s < n")
    + f" select s.sid, c.cls, {r6('coalesce(total / sqrt(tokens), 0)')} as score, coalesce(tokens, 0) as tokens from samples s"
    " cross join classes c left join sc on sc.sid = s.sid and sc.cls = c.cls",
)
def _(fx):
    weighted = we.weigh(we.supported(_counts(fx, "gene_type")), we.log_odds())
    got = we.score_tokens(fx.tokens("gene_type"), weighted, fx.classes, every=fx.samples)
    return got.select("sid", "cls", F.round("score", 6).alias("score"), "tokens")


@query(
    "l3b_scores_all_tokens",
    _score_sql("tok_codon", clip(f"{LO} * s / (s + 10)"), "s >= 30")
    + f" select a.sid, c.cls, {r6('coalesce(total, 0) / sqrt(all_tokens)')} as score, all_tokens as tokens from a"
    " cross join classes c left join sc on sc.sid = a.sid and sc.cls = c.cls",
)
def _(fx):
    weighted = we.weigh(we.supported(_counts(fx, "codon"), 30, below_all=False), we.log_odds())
    got = we.score_tokens(fx.tokens("codon"), weighted, fx.classes, all_tokens=True)
    return got.select("sid", "cls", F.round("score", 6).alias("score"), "tokens")


# Hierarchy -----------------------------------------------------------------------------------

_FINE = ("select sid, gene || '__' || event_type || '__P50_' || lpad(cast(cast(floor((position - 1) / 50.0) as bigint) as"
         " varchar), 3, '0') as token, gene || '__' || event_type as parent from typed where position > 0")
_FINE_AA = ("select sid, gene || '__' || ref || '>' || alt as token, gene || '__MISSENSE' as parent from typed where position > 0"
            " and ref <> alt and regexp_matches(ref || alt, '^[ACDEFGHIKLMNPQRSTVWY]+$')")


def _fine(fx, typed=None):
    t = (fx.typed if typed is None else typed).filter("position > 0")
    label = F.format_string("P50_%03d", c.position_bin(F.col("position")))
    return t.select("sid", F.concat_ws("__", "gene", "event_type", label).alias("token"),
                    F.concat_ws("__", "gene", "event_type").alias("parent")).distinct()


@query(
    "l5_parent_map",
    f"with f as (select distinct token, parent from ({_FINE}) x union select distinct token, parent from ({_FINE_AA}) y)"
    " select token, parent, parent not in (select token from tok_gene_type) as parent_missing from f",
)
def _(fx):
    pair = c.amino_pair(F.col("ref"), F.col("alt"))
    amino = fx.typed.filter("position > 0").filter(pair.isNotNull()).select(
        "sid", F.concat_ws("__", "gene", pair).alias("token"),
        F.concat_ws("__", "gene", F.lit("MISSENSE")).alias("parent"))
    return we.parent_map(_fine(fx).unionByName(amino), fx.tokens("gene_type"))


@query(
    "l4_residual_weights",
    f"with f as ({_FINE}), ft as (select distinct sid, token from f), fm as (select distinct token, parent from f),"
    f" {grid('ft', 'gc')}, {grid('tok_gene_type', 'gp')}, a as (select token, cls, s, {LO} as w from gc where s >= 10 and s < n),"
    f" b as (select token as parent, cls, {LO} as w from gp) select token, cls, cast(s as bigint) as support,"
    f" {r6(clip('(a.w - b.w) * s / (s + 20)'))} as w from a join fm using (token) join b using (parent, cls)",
)
def _(fx):
    fine = cut_lineage(_fine(fx, fx.parsed))
    child = we.token_counts(fine.select("sid", "token"), fx.samples, fx.classes)
    parent = we.token_counts(token_table(fx.parsed, "gene_type"), fx.samples, fx.classes)
    got = we.residual_weights(child, parent, fine.select("token", "parent").distinct())
    long = we.weights_long(got.drop("parent"), fx.classes)
    return long.select("token", "cls", "support", F.round("w", 6).alias("w"))


_POS = "select *, cast(regexp_extract(event, '([0-9]+)', 1) as bigint) as q from typed"
_DENS = f"""pc as (select gene, event_type, q, label as cls, count(*) as m from ({_POS}) z join samples using (sid)
 group by 1, 2, 3, 4), pa as (select distinct gene, event_type, q as position from pc),
 kd as (select pa.gene, pa.event_type, pa.position, c.cls, sum(case when pc.cls = c.cls then exp(-0.5 * ((pc.q - position) / 20.0)
 * ((pc.q - position) / 20.0)) * m else 0 end) as k, sum(exp(-0.5 * ((pc.q - position) / 20.0) * ((pc.q - position) / 20.0)) * m)
 as ka, cast(sum(case when abs(pc.q - position) <= 20 then m else 0 end) as bigint) as local_n
 from pa join pc using (gene, event_type) cross join classes c group by 1, 2, 3, 4),
 dens as materialized (select gene, event_type, position, kd.cls, local_n, {clip('ln((k / cls_n + 1e-5) / ((ka - k) / greatest(n - cls_n, 1) + 1e-5))')}
 as w from kd join csize on csize.cls = kd.cls cross join ntot)"""


def _density(fx):
    typed = fx.typed.withColumn("q0", c.first_integer(F.col("event")))
    return we.position_density(typed, fx.samples, fx.classes, position="q0")


@query(
    "l7_position_density",
    f"with {_DENS} select gene, event_type, position, cls, local_n, {r6('w')} as w from dens",
)
def _(fx):
    got = _density(fx)
    x = got.select("gene", "event_type", "position", "local_n",
                   F.explode(F.arrays_zip(we.class_array(fx.classes).alias("cls"), "w")).alias("x"))
    return x.select("gene", "event_type", "position", "local_n", "x.cls", F.round("x.w", 6).alias("w"))


_BACK = f"""with {_DENS}, {grid('tok_exact', 'ge')}, {grid('tok_codon', 'gc')}, {grid('tok_gene_type', 'gt')},
 we as materialized (select token || '~' || cls as k, s, {EB} as w from ge),
 wc as materialized (select token || '~' || cls as k, s, {EB} as w from gc),
 wt as materialized (select token || '~' || cls as k, s, {EB} as w from gt),
 wd as materialized (select gene || '~' || event_type || '~' || position || '~' || cls as k, local_n, w from dens),
 e0 as materialized (select sid, gene, event, c.cls, gene || '__' || event || '~' || c.cls as te,
 gene || '__POS' || q || '~' || c.cls as tc, gene || '__' || event_type || '~' || c.cls as tt,
 gene || '~' || event_type || '~' || q || '~' || c.cls as td from ({_POS}) z cross join classes c),
 e1 as (select e0.*, we.s / (we.s + 20) as ae, we.w as xe, wc.s / (wc.s + 20) as rc, wc.w as xc,
 local_n / (local_n + 20.0) as rd, wd.w as xd, wt.w as xt from e0 join we on we.k = te join wc on wc.k = tc
 join wt on wt.k = tt join wd on wd.k = td),
 e2 as (select *, (1 - ae) * rc as ac from e1), e3 as (select *, (1 - ae - ac) * rd as ad from e2),
 e4 as (select sid, gene, event, cls, ae * xe + ac * xc + ad * xd + (1 - ae - ac - ad) * xt as e from e3)
"""


@query("l6_backoff_evidence", _BACK + f"select gene, event, cls, count(*) as n, {r6('max(e)')} as evidence from e4 group by 1, 2, 3")
def _(fx):
    """Events of a kind share their evidence, so the table of distinct events is the answer."""
    got = we.backoff_table(fx.typed, fx.samples, fx.classes)
    pairs = F.explode(F.arrays_zip(we.class_array(fx.classes).alias("cls"), F.col("evidence").alias("e"))).alias("x")
    return got.select("gene", "event", F.col("events").alias("n"), pairs).select(
        "gene", "event", "x.cls", "n", F.round("x.e", 6).alias("evidence"))


@query(
    "l8_event_evidence_summary",
    _BACK + f""", rk as (select *, row_number() over (partition by sid, cls order by e desc) as rn from e4)
 select sid, cls, {r6('sum(e)')} as sum_evidence, {r6('max(e)')} as max_evidence,
 {r6('sum(e) filter (rn <= 2)')} as top2_evidence from rk group by 1, 2""",
)
def _(fx):
    table = cut_lineage(we.backoff_table(fx.typed, fx.samples, fx.classes))
    got = ev.event_summary(we.backed_off_events(fx.typed, table, fx.classes))
    return got.select("sid", "cls", *[F.round(x, 6).alias(x) for x in got.columns[2:]])


@query("l9_low_rank_weights")
def _(fx):
    weighted = we.weigh(_counts(fx, "codon"), we.empirical_bayes())
    long = we.weights_long(we.low_rank(weighted, fx.classes, rank=3), fx.classes)
    return long.select("token", "cls", F.round("w", 6).alias("w"))


@query(
    "l10_rare_evidence_split",
    f"""with {grid('tok_codon')}, w as (select token, cls, s, {EB} as w from g), sc as (select sid, cls, sum(w) / sqrt(count(*))
 as full_score, coalesce(sum(w) filter (s < 30) / sqrt(count(*) filter (s < 30)), 0) as rare_score from tok_codon join w
 using (token) group by 1, 2) select sid, cls, {r6('full_score')} as full_score, {r6('rare_score')} as rare_score from sc""",
)
def _(fx):
    weighted = we.weigh(_counts(fx, "codon"), we.empirical_bayes())
    full = we.score_tokens(fx.tokens("codon"), weighted, fx.classes).withColumnRenamed("score", "full_score")
    rare = we.score_tokens(fx.tokens("codon"), weighted.filter("support < 30"), fx.classes)
    both = full.join(rare.select("sid", "cls", F.col("score").alias("rare_score")), ["sid", "cls"], "left")
    return both.select("sid", "cls", F.round("full_score", 6).alias("full_score"),
                       F.round(F.coalesce("rare_score", F.lit(0.0)), 6).alias("rare_score"))


@query("l11_count_ratio", _wsql(
    "tok_gene_type", "ln((pos + 1) / (cn + 2)) - ln((s - pos + 1) / (n - cn + 2))"))
def _(fx):
    return _long(fx, _counts(fx, "gene_type"), we.count_ratio())


# Evidence shape ------------------------------------------------------------------------------

def outside_grid(tok: str) -> str:
    """``grid`` for every fold over the rows outside it; tokens that no such row has are left out."""
    return f"""xf as (select fold, token, label as cls, count(*) as k from {tok} join folds using (sid) group by 1, 2, 3),
 xa as (select token, cls, sum(k) as k from xf group by 1, 2), xt as (select token, sum(k) as s from xf group by 1),
 xo as (select fold, token, sum(k) as s from xf group by 1, 2), xd as (select distinct fold from folds),
 xc as (select xd.fold, label as cls, count(*) as cn from xd join folds o on o.fold <> xd.fold group by 1, 2),
 xn as (select fold, sum(cn) as n from xc group by 1),
 g as (select xo.fold, xo.token, xc.cls, cast(xt.s - xo.s as double) as s, cast(coalesce(xa.k, 0) - coalesce(xf.k, 0) as double) as pos,
  cast(cn as double) as cn, cast(n as double) as n from xo join xt using (token) join xc on xc.fold = xo.fold join xn on xn.fold = xo.fold
  left join xa on xa.token = xo.token and xa.cls = xc.cls left join xf on xf.fold = xo.fold and xf.token = xo.token and xf.cls = xc.cls
  where xt.s > xo.s)"""


_OUTSIDE = f"with {outside_grid('tok_gene_type')}, w as (select fold, token, cls, s, {EB} as w from g)"
_SHAPE = f"""{_OUTSIDE}, e as (select sid, token, cls, w, abs(w) as a, s,
 row_number() over (partition by sid, cls order by abs(w) desc, token) as r, sum(abs(w)) over (partition by sid, cls) as ta
 from tok_gene_type join folds using (sid) join w using (fold, token)), sh as (select sid, cls, sum(w) as sum_all, coalesce(sum(w) filter (w > 0), 0) as
 sum_positive, coalesce(sum(w) filter (w < 0), 0) as sum_negative, coalesce(max(w) filter (w > 0), 0) as max_positive,
 coalesce(min(w) filter (w < 0), 0) as min_negative, count(*) filter (w > 0) as n_positive, count(*) filter (w < 0) as n_negative,
 sum(a) as sum_absolute, coalesce(max(a) / nullif(max(ta), 0), 0) as top1_share, coalesce(sum(a) filter (r <= 3) / nullif(max(ta), 0), 0)
 as top3_share, coalesce(-sum(case when a > 0 then a / ta * ln(a / ta) else 0 end), 0) as entropy, sum(w) - max(w) filter (r = 1)
 as sum_without_dominant, count(*) as n_tokens, sum(a * s / (s + 20)) as reliable_absolute from e group by 1, 2)
"""
_SH13 = ["sum_all", "sum_positive", "sum_negative", "max_positive", "min_negative", "n_positive", "n_negative", "sum_absolute",
         "top1_share", "top3_share", "entropy", "sum_without_dominant", "n_tokens"]


def _outside(fx):
    """Weights of every fold from the rows outside it, so no sample meets a weight its own label went into."""
    return we.weigh(we.cross_fit_counts(fx.tokens("gene_type"), fx.folds(), fx.classes), we.empirical_bayes())


def _evidence(fx, extra=()):
    long = we.weights_long(_outside(fx), fx.classes).withColumn(
        "reliability", F.col("support") / (F.col("support") + 20.0))
    placed = fx.tokens("gene_type").join(fx.folds().select("sid", "fold"), "sid")
    return ev.token_evidence(placed, long, extra, ("fold", "token"))


def _rounded(df, keys, keep=()):
    return df.select(*keys, *[
        F.col(x) if x in keep else F.round(x, 6).alias(x) for x in df.columns if x not in keys])


_PROBS = """ pk as (select sid, cls, p, row_number() over (partition by sid order by p desc, cls) as rk from pr1),
 pm as (select sid, max(p) filter (rk = 1) as t1, max(p) filter (rk = 2) as t2 from pk group by 1)"""


@query(
    "l25_evidence_shape",
    _SHAPE + "," + _PROBS + f""" select pk.sid, pk.cls, {', '.join(
        f'coalesce({x}, 0) as {x}' if x[:2] == 'n_' else f'{r6(f"coalesce({x}, 0)")} as {x}' for x in _SH13)},
 {r6('p')} as p, {r6('ln(greatest(p, 1e-12))')} as log_p, cast(rk as int) as probability_rank, {r6('t1 - p')} as gap_to_top,
 {r6('t1 - t2')} as margin, {r6('cn / cast(n as double)')} as prior from pk join pm using (sid) left join sh on sh.sid = pk.sid
 and sh.cls = pk.cls join folds fo on fo.sid = pk.sid join xc on xc.fold = fo.fold and xc.cls = pk.cls join xn on xn.fold = fo.fold""",
)
def _(fx):
    folds = fx.folds()
    prob = ranks.by_rows(fx.prob(["a"]).select("sid", "cls", "p"), folds.select("sid", "fold"), ["sid"])
    got = ev.candidate_shape(prob, ev.evidence_shape(_evidence(fx)), we.priors_outside(folds, fx.classes), ("fold",)).drop("fold")
    return _rounded(got, ["sid", "cls"], ("n_positive", "n_negative", "n_tokens", "probability_rank"))


_SH9 = ["sum_positive", "sum_negative", "sum_absolute", "max_positive", "min_negative", "top1_share", "top3_share"]


@query(
    "l25b_reliability_shape",
    _SHAPE + f"select sid, cls, {', '.join(f'{r6(x)} as {x}' for x in _SH9)},"
    f" {r6('entropy / ln(greatest(n_tokens, 2))')} as scaled_entropy, {r6('reliable_absolute')} as reliable_absolute from sh",
)
def _(fx):
    return _rounded(ev.reliability_shape(_evidence(fx, ("reliability",))), ["sid", "cls"])


@query(
    "l25c_score_shape",
    f"""{_OUTSIDE}, sc as (select sid, cls, sum(w) / sqrt(count(*)) as score from tok_gene_type join folds using (sid) join w using (fold, token) group by 1, 2),
 z as (select f.sid, coalesce(score, 0) as score from folds f cross join classes c left join sc on sc.sid = f.sid and sc.cls = c.cls) select sid, {r6('sum(greatest(score, 0))')} as positive_sum,
 {r6('sum(least(score, 0))')} as negative_sum, {r6('sum(abs(score))')} as absolute_sum, {r6('max(greatest(score, 0))')} as
 positive_max, {r6('min(least(score, 0))')} as negative_min, {r6('max(abs(score))')} as absolute_max from z group by 1""",
)
def _(fx):
    scores = we.cross_fitted_scores(fx.tokens("gene_type"), fx.folds(), fx.classes, we.empirical_bayes(), None)
    return _rounded(ev.score_shape(scores), ["sid"])


@query(
    "l26_event_evidence",
    f"""{_OUTSIDE}, b as (select sid, count(distinct gene) as mg from events group by 1), x as (select gene, event_type, c.cls, mg,
 coalesce(w.w, 0) as w, coalesce(w.s, 0) as s from typed join b using (sid) join folds using (sid) cross join classes c left join w on
 w.fold = folds.fold and w.cls = c.cls and w.token = gene || '__' || event_type) select gene, event_type, cls, count(*) as n, {r6('sum(w)')} as contribution, {r6('sum(abs(w))')} as
 absolute, {r6('sum(ln(1 + s))')} as log_support, {r6('sum(s / (s + 20))')} as reliability, count(*) filter (w > 0) as
 is_positive, count(*) filter (w < 0) as is_negative, {r6('sum(w / sqrt(greatest(mg, 1)))')} as per_burden,
 count(*) filter (s >= 5) as is_supported, count(*) filter (event_type = 'MISSENSE') as is_missense
 from x group by 1, 2, 3""",
)
def _(fx):
    placed = fx.typed.join(fx.folds().select("sid", "fold"), "sid")
    burden = ru.gene_presence(fx.events).groupBy("sid").agg(F.count(F.lit(1)).alias("mutated_genes"))
    got = ev.event_evidence(placed, _outside(fx), burden, fx.classes, ("fold", "token"))
    kind = c.standard7(F.col("event")).alias("event_type")
    sums = [F.round(F.sum(x), 6).alias(x) for x in ("contribution", "absolute", "log_support", "reliability", "per_burden")]
    flags = [F.sum(x).alias(x) for x in ("is_positive", "is_negative", "is_supported", "is_missense")]
    return got.groupBy("gene", kind, "cls").agg(F.count(F.lit(1)).alias("n"), *sums, *flags)


@query(
    "l23_tf_idf",
    f"""with t as (select sid, 'G__' || gene as token from typed union all select sid, 'E__' || gene || '__' || event from typed
 union all select sid, 'TYPE__' || event_type from typed union all select sid, 'AA__' || ref || '_' || alt from typed where ref <> alt),
 tf as (select sid, token, count(*) as tf from t group by 1, 2), df as (select token, count(*) as df from tf group by 1 having
 count(*) >= 3), v as (select sid, token, (1 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1) as v from tf join df using (token)
 cross join ntot) select sid, token, {r6('v / sqrt(sum(v * v) over (partition by sid))')} as weight from v""",
)
def _(fx):
    n = fx.samples.agg(F.count(F.lit(1))).scalar()
    got = ev.tf_idf(ev.event_documents(fx.typed), n)
    return got.select("sid", "token", F.round("weight", 6).alias("weight"))


@query(
    "l28_pooled_vectors",
    f"""with x as (select label, cast(generate_subscripts(embedding, 1) - 1 as int) as dim, unnest(embedding) as x from embeddings)
 select label, dim, {r6('avg(cast(x as double))')} as mean, {r6('max(cast(x as double))')} as max, {r6('ln(1 + count(*))')} as log_count
 from x group by 1, 2""",
)
def _(fx):
    return _rounded(ev.pool_vectors(fx.t("embeddings"), "label", "embedding"), ["label", "dim"])
