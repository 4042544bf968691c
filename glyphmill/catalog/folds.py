"""Fold assignment, cross-fitting, sampling and permutation."""
from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.catalog.base import query, r6
from glyphmill.operators import folds as fo, ranks, weights as we
from glyphmill.session import cut_lineage

_RN = "row_number() over (partition by {p} order by md5({k}))"


@query("f1_stratified_folds", "select sid, label, fold from folds")
def _(fx):
    return fx.folds()


@query(
    "f2_stratified_holdout",
    "select sid, label, rn <= cast(floor(n * 0.25 + 0.5) as bigint) as held_out from (select *,"
    " row_number() over (partition by label order by md5('42:' || sid)) as rn, count(*) over (partition by label) as n"
    " from samples) z",
)
def _(fx):
    return fo.stratified_holdout(fx.samples)


@query(
    "f3_repeated_folds",
    "select sid, label, seed, cast((row_number() over (partition by seed, label order by md5(seed || ':' || sid)) - 1) % 5"
    " as int) as fold from samples, (select unnest([42, 777, 2024]) as seed) z",
)
def _(fx):
    return fo.repeated_folds(fx.samples, [42, 777, 2024])


_NESTED = (
    "select sid, label, outer_fold, cast((row_number() over (partition by outer_fold, label order by"
    " md5('inner:42:' || sid)) - 1) % 5 as int) as inner_fold from folds,"
    " (select unnest([0, 1, 2, 3, 4]) as outer_fold) z where fold <> outer_fold"
)


@query("f4_nested_folds", _NESTED)
def _(fx):
    return fo.nested_folds(fx.folds())


def _fit_grid(tok: str, kind: str = "fold") -> str:
    """Counts over rows outside each fold (for tokens present in the fold)."""
    return f"""fit as (select f.fold, t.token, s.label as cls from (select distinct fold from folds) f
  join folds s on s.fold <> f.fold join {tok} t on t.sid = s.sid),
 fs as (select fold, token, count(*) as s from fit group by 1, 2), fp as (select fold, token, cls, count(*) as pos
  from fit group by 1, 2, 3),
 fn as (select f.fold, count(*) as n from (select distinct fold from folds) f join folds s on s.fold <> f.fold group by 1),
 fc as (select f.fold, s.label as cls, count(*) as cls_n from (select distinct fold from folds) f join folds s on
  s.fold <> f.fold group by 1, 2),
 here as (select distinct fold, token from folds join {tok} using (sid)),
 fg as (select fs.fold, fs.token, cast(s as double) as s, fc.cls, cast(coalesce(pos, 0) as double) as pos,
  cast(cls_n as double) as cn, cast(n as double) as n from fs join here using (fold, token) join fn using (fold) join fc
  using (fold) left join fp on fp.fold = fs.fold and fp.token = fs.token and fp.cls = fc.cls)"""


LOGODDS = "(ln((pos + 1) / (cn - pos + 1)) - ln((s - pos + 1) / (n - cn - (s - pos) + 1)))"
W1 = f"greatest(least({LOGODDS} * s / (s + 10), 4), -4)"
CROSS = "with " + _fit_grid("tok_gene_type") + f""",
 fw as (select fold, token, cls, {W1} as w from fg where s >= 10 and s < n),
 sc as (select sid, fold, cls, sum(w) as total, count(*) as tokens from folds join tok_gene_type using (sid) join fw
  using (fold, token) group by 1, 2, 3),
 oof as (select f.sid, f.fold, c.cls, coalesce(total / sqrt(tokens), 0) as score, coalesce(tokens, 0) as tokens from folds f
  cross join classes c left join sc on sc.sid = f.sid and sc.cls = c.cls)
"""


@query("f7_cross_fitted_scores", CROSS + f"select sid, fold, cls, {r6('score')} as score, tokens from oof")
def _(fx):
    got = we.cross_fitted_scores(fx.tokens("gene_type"), fx.folds(), fx.classes, we.log_odds())
    return got.select("sid", "fold", "cls", F.round("score", 6).alias("score"), "tokens")


@query(
    "f8_standardised_scores",
    CROSS + ", st as (select cls, avg(score) as m, case when stddev_pop(score) < 1e-6 then 1 else stddev_pop(score) end as d"
    f" from oof where fold <> 0 group by 1) select sid, fold, cls, {r6('(score - m) / d')} as z from oof join st using (cls)",
)
def _(fx):
    got = cut_lineage(we.cross_fitted_scores(fx.tokens("gene_type"), fx.folds(), fx.classes, we.log_odds()))  # scaled by itself
    z = we.standardise(got.filter("fold <> 0"), got, ["cls"])
    return z.select("sid", "fold", "cls", F.round("z", 6).alias("z"))


@query(
    "f8_standardised_floor_max",
    CROSS + ", st as (select cls, avg(score) as m, greatest(stddev_pop(score), 1e-6) as d from oof group by 1)"
    f" select sid, cls, {r6('(score - m) / d')} as z from oof join st using (cls)",
)
def _(fx):
    got = cut_lineage(we.cross_fitted_scores(fx.tokens("gene_type"), fx.folds(), fx.classes, we.log_odds()))  # scaled by itself
    z = we.standardise(got, got, ["cls"], floor="max")
    return z.select("sid", "cls", F.round("z", 6).alias("z"))


@query(
    "x2_stratified_sample",
    "select sid, label from (select *, " + _RN.format(p="label", k="'42:' || sid") + " as rn from samples) z where rn <= 20",
)
def _(fx):
    return fo.stratified_sample(fx.samples, 20)


@query(
    "x3_mask_cells",
    "select sid, gene, case when (('0x' || substr(md5('42:' || sid || ':' || gene), 1, 8))::bigint % 1000000) < 100000 and"
    " fold <> 0 then null else cell end as cell from cells join folds using (sid)",
)
def _(fx):
    placed = fx.cells.join(fx.folds().select("sid", "fold"), "sid")
    return fo.mask_cells(placed, 0.10, 42, F.col("fold") != 0).drop("fold")


@query(
    "x4_permute_labels",
    "select a.sid, b.label from (select sid, row_number() over (order by md5('42:rows:' || sid)) as rn from samples) a join"
    " (select label, row_number() over (order by md5('42:labels:' || sid)) as rn from samples) b on a.rn = b.rn",
)
def _(fx):
    return fo.permute_labels(fx.samples, 42)


@query(
    "q7_fold_contract",
    """with n as (""" + _NESTED + """), fit as (select sid from n where outer_fold = 0 and inner_fold <> 1), va as (select sid
 from n where outer_fold = 0 and inner_fold = 1), tr as (select sid from folds where fold <> 0)
 select (select count(*) from fit where sid not in (select sid from tr)) as fit_outside_train,
 (select count(*) from fit where sid in (select sid from va)) as fit_in_valid,
 (select count(*) from tr where sid not in (select sid from fit) and sid not in (select sid from va)) as train_uncovered,
 (select count(*) from fit) as fit_rows, (select count(*) from va) as valid_rows""",
)
def _(fx):
    folds = fx.folds()
    nested = fo.nested_folds(folds).filter("outer_fold = 0")
    return fo.fold_contract(nested.filter("inner_fold <> 1"), nested.filter("inner_fold = 1"), folds.filter("fold <> 0"))
