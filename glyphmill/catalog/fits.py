"""MLlib fits and the named compositions.  Fits depend on the optimiser, so most have no SQL twin."""
from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.catalog.base import query, r6
from glyphmill.catalog.folds import _fit_grid
from glyphmill.operators import probs as pr, weights as we
from glyphmill.session import cut_lineage, drop_table, in_parallel
from glyphmill.plans import compositions as co, designs as de, fits as ft, wide
from glyphmill.sources.tables import scratch_path


def _split(fx):
    return fx.folds().select("sid", "label", "fold", (F.col("fold") != 0).alias("fit"))


def _every_fold(fx, scored):
    """What ``scored`` gives for a split (sid, label, fold, fit), with each of the five folds held out in turn."""
    folds, out = cut_lineage(fx.folds().select("sid", "label", "fold")), None
    for held in range(5):
        part = cut_lineage(scored(folds.withColumn("fit", F.col("fold") != held)))
        out = part if out is None else out.unionByName(part)
    return out


def _design(fx):
    """The structured design alone: the events behind it are not read again."""
    made = co.structured(fx.typed, fx.folds())
    drop_table(made.typed)
    return made.design


def _kinds(fx):
    """Presence of gene and event type, every token that the fit rows have."""
    return wide.build(fx.folds(), fx.tokens("gene_type"), 5, varying=False)


def _out(fx, scored):
    return pr.to_long(scored, F.col("p"), fx.classes).withColumn("p", F.round("p", 4))


@query("ml1_multinomial_logistic")
def _(fx):
    return _out(fx, ft.multinomial()(_design(fx).select(0), fx.classes))


@query("ml2_one_vs_rest_logistic")
def _(fx):
    return _out(fx, ft.one_vs_rest()(_design(fx).select(0), fx.classes))


@query("ml3_naive_bayes_bernoulli")
def _(fx):
    return _out(fx, ft.naive_bayes("bernoulli")(_kinds(fx).select(0), fx.classes))


@query("ml3_naive_bayes_complement")
def _(fx):
    return _out(fx, ft.naive_bayes("complement")(_kinds(fx).select(0), fx.classes))


@query("ml3_naive_bayes_multinomial")
def _(fx):
    return _out(fx, ft.naive_bayes("multinomial")(_kinds(fx).select(0), fx.classes))


@query("ml4_ratio_scaled_one_vs_rest")
def _(fx):
    return _out(fx, ft.one_vs_rest(own_columns=True)(wide.ratio_scaled_rows(_kinds(fx), 0, fx.classes), fx.classes))


@query("ml5_truncated_svd")
def _(fx):
    tokens = cut_lineage(fx.tokens("gene_type"))
    fit = tokens.join(_split(fx).filter("fit").select("sid"), "sid", "left_semi")
    basis, _values = ft.singular_vectors(fit, 6)
    got = ft.project_tokens(tokens, basis, 6)
    return got.select("sid", *[F.round(F.abs(c), 4).alias(c) for c in got.columns[1:]])


_BLK = """bt as (select distinct sid, 'G__' || gene as token from typed union all select distinct sid, 'T__' || gene from typed where event_type in ('NONSENSE', 'FRAMESHIFT', 'SPLICE') union all select sid, 'R__' || gene || '__' || event from typed where event_type = 'MISSENSE'
 union all select sid, 'A_pair__' || ref || '>' || alt from typed where ref <> alt and regexp_matches(ref || alt, '^[ACDEFGHIKLMNPQRSTVWY]+$')), fv as (select sid, token, count(*) as v from bt join folds using (sid) where fold <> 0 group by 1, 2), fs as (select token,
 count(*) as rows, min(v) as lo, max(v) as hi from fv group by 1), nf as (select count(*) as n from folds where fold <> 0), kf as (select token, rows from fs, nf where case when rows < nf.n then least(lo, 0) else lo end <> hi and (token not like 'R\\_\\_%' escape '\\' or rows >= 5))"""


@query("ml6_feature_views", f"""with {_BLK}, sp as (select *, token like 'G\\_\\_%' escape '\\' or token like 'T\\_\\_%' escape '\\' or token like 'R\\_\\_%' escape '\\' as sparse from kf), v as (select 'full' as view, token from sp union all select 'compact', token from sp where not
 sparse union all select 'hybrid64', token from sp where not sparse union all select 'hybrid64', token from (select token from sp where sparse order by rows desc, token limit 64) a union all select 'hybrid128', token from sp where not sparse union all select 'hybrid128', token from
 (select token from sp where sparse order by rows desc, token limit 128) b) select view, token from v""")
def _(fx):
    features = cut_lineage(de.kept_features(de.block_tokens(fx.parsed), _split(fx)))  # every view reads them
    return de.views(features, (64, 128))


@query("ml7_c1_out_of_fold_baseline")
def _(fx):
    oof = co.gene_baseline(fx.typed, fx.folds(), fx.classes)
    return pr.to_long(oof, F.col("p"), fx.classes, ("sid", "label", "fold")).withColumn("p", F.round("p", 4))


@query("c1_baseline_metrics")
def _(fx):
    oof = co.gene_baseline(fx.typed, fx.folds(), fx.classes)
    got = ft.fold_metrics(oof, fx.classes)
    return got.select("fold", "n", F.round("accuracy", 4).alias("accuracy"), F.round("macro_f1", 4).alias("macro_f1"))


@query("ml8_important_columns")
def _(fx):
    return ft.important_columns(_design(fx), 0, fx.classes, 20)


@query("c2_structured_columns", f"with {_BLK} select kf.token as feature, kf.rows as fit_rows, (select count(distinct sid) from bt where bt.token = kf.token) as all_rows from kf")
def _(fx):
    """Columns of the structured design, chosen on fit rows, with their support on all rows."""
    tokens = de.block_tokens(fx.parsed)
    kept = de.kept_features(tokens, _split(fx))
    everywhere = tokens.select("sid", "token").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("all_rows"))
    return kept.join(everywhere, "token").select(F.col("token").alias("feature"), F.col("rows").alias("fit_rows"), "all_rows")


_C3 = "with fo as (select sid, label, cast((row_number() over (partition by label order by md5('42:' || sid)) - 1) % 5 as int) as fold from folds where fold <> 0), " + _fit_grid(
    "tok_gene_type").replace("join folds s", "join fo s").replace("from folds)", "from fo)").replace("from folds join", "from fo join").replace("distinct fold from folds", "distinct fold from fo") + """,
 fw as (select fold, token, cls, greatest(least((ln((pos + 1) / (cn - pos + 1)) - ln((s - pos + 1) / (n - cn - (s - pos) + 1))) * s / (s + 10), 4), -4) as w from fg where s >= 10 and s < n), tsc as (select sid, cls, sum(w) / sqrt(count(*)) as score from fo join tok_gene_type using (sid)
 join fw using (fold, token) group by 1, 2), tr as (select f.sid, c.cls, coalesce(score, 0) as score from fo f cross join classes c left join tsc on tsc.sid = f.sid and tsc.cls = c.cls), gs as (select token, count(*) as s from fo join tok_gene_type using (sid) group by 1), gp as (select
 token, label as cls, count(*) as pos from fo join tok_gene_type using (sid) group by 1, 2), gc as (select label as cls, count(*)::double as cn from fo group by 1), gn as (select count(*)::double as n from fo), gw as (select token, cls, greatest(least((ln((pos + 1) / (cn - pos + 1)) - ln((s -
 pos + 1) / (n - cn - (s - pos) + 1))) * s / (s + 10), 4), -4) as w from (select gs.token, s::double as s, gc.cls, cn, n, coalesce(pos, 0)::double as pos from gs cross join gc cross join gn left join gp on gp.token = gs.token and gp.cls = gc.cls) z where s >= 10 and s < n), va as (select f.sid, c.cls,
 coalesce(score, 0) as score from (select sid from folds where fold = 0) f cross join classes c left join (select sid, cls, sum(w) / sqrt(count(*)) as score from tok_gene_type join gw using (token) group by 1, 2) q on q.sid = f.sid and q.cls = c.cls), st as (select cls, avg(score) as m, case
 when stddev_pop(score) < 1e-6 then 1 else stddev_pop(score) end as d from tr group by 1)"""


@query("c3_enrichment_block", _C3 + f" select sid, cls, {r6('(score - m) / d')} as z from (select * from tr union all select * from va) a join st using (cls)")
def _(fx):
    got = de.evidence_scores(fx.tokens("gene_type"), _split(fx), fx.classes, we.log_odds(), floor=10, deviation="replace")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("cls"), F.round(f"E__{c}", 6).alias("z")) for c in fx.classes])).alias("x")
    return got.select("sid", pairs).select("sid", "x.cls", "x.z")


@query("c4_three_way_vote")
def _(fx):
    """All outer folds, each scored by models that never saw its labels."""
    design = co.structured(fx.typed, fx.folds())
    return _out(fx, _every_fold(fx, lambda split: co.three_way_vote(design, split, fx.classes)))


@query("c5_selective_evidence_bag")
def _(fx):
    """All outer folds; three inner seeds, their probabilities averaged."""
    design = co.structured(fx.typed, fx.folds())
    bag = _every_fold(fx, lambda split: co.seed_bag(co.selective_evidence(design, split, fx.classes, (42, 777, 2024)), fx.classes))
    return bag.withColumn("p", F.round("p", 4))


@query("c6_saved_evidence_bundle")
def _(fx):
    split = cut_lineage(_split(fx))
    folder = scratch_path(fx.spark, "bundle")
    co.fit_bundle(fx.parsed, split.filter("fit").select("sid", "label"), fx.classes, folder)
    got = co.apply_bundle(fx.parsed, split.filter("not fit").select("sid"), fx.classes, folder)
    return got.withColumn("z", F.round("z", 6))


@query("c6b_saved_model")
def _(fx):
    """All outer folds, each scored by a state with its model that was saved and read again."""
    def scored(split):
        folder = scratch_path(fx.spark, "model")
        co.fit_saved_model(fx.parsed, split.filter("fit").select("sid", "label"), fx.classes, folder)
        return co.apply_saved_model(fx.parsed, split.filter("not fit").select("sid"), folder)

    return _every_fold(fx, scored).withColumn("p", F.round("p", 4))


@query("c7_hierarchical_case")
def _(fx):
    got = co.hierarchical_case(fx.parsed, cut_lineage(fx.folds()), fx.classes, "all_residual")
    return got.withColumn("score", F.round("score", 6))


_INNER = """inr as (select sid, label, cast((row_number() over (partition by label order by md5('43:' || sid)) - 1) % 3 as int) as inner_fold from folds where fold <> 0),
 rl as (select sid, label, inner_fold from inr union all select sid, label, -1 from folds where fold = 0),
 src as (select i.inner_fold, o.sid, o.label from (select distinct inner_fold from rl) i join inr o on o.inner_fold <> i.inner_fold),
 sn as (select inner_fold, count(*) as n from src group by 1), sk as (select inner_fold, label as cls, count(*) as k from src group by 1, 2),
 ss as (select inner_fold, token, count(*) as s from src join tok_gene_type using (sid) group by 1, 2),
 sp as (select inner_fold, token, label as cls, count(*) as p from src join tok_gene_type using (sid) group by 1, 2, 3),
 wt as (select inner_fold, ss.token, cls, greatest(-4.0, least(4.0, ln(least(greatest(a, 1e-6), 1 - 1e-6) / (1 - least(greatest(a, 1e-6), 1 - 1e-6))) - ln(least(greatest(b, 1e-6), 1 - 1e-6)
 / (1 - least(greatest(b, 1e-6), 1 - 1e-6))))) as w from (select ss.inner_fold, ss.token, sk.cls, (coalesce(p, 0) + 20.0 * (s + 1.0) / (n + 2)) / (k + 20.0) as a,
 (s - coalesce(p, 0) + 20.0 * (s + 1.0) / (n + 2)) / (n - k + 20.0) as b from ss join sn using (inner_fold) join sk using (inner_fold) left join sp on sp.inner_fold = ss.inner_fold and sp.token = ss.token and sp.cls = sk.cls) ss),
 ev as (select sid, cls, sum(w) as sum_all, sum(abs(w)) as sum_absolute, count(*) filter (w > 0) as n_positive, count(*) as n_tokens from rl join tok_gene_type using (sid) join wt using (inner_fold, token) group by 1, 2)"""


@query("c8_ranker_rows", f"""with {_INNER} select rl.sid, rl.label, rl.inner_fold, x.cls, {r6('coalesce(sum_all, 0)')} as sum_all, {r6('coalesce(sum_absolute, 0)')} as sum_absolute,
 coalesce(n_positive, 0) as n_positive, coalesce(n_tokens, 0) as n_tokens, {r6('pr.p')} as prior from rl cross join classes x left join ev on ev.sid = rl.sid and ev.cls = x.cls
 join (select cls, k / cast(n as double) as p from sk join sn using (inner_fold) where inner_fold = -1) pr on pr.cls = x.cls""")
def _(fx):
    """What the ranker of the first outer fold is fitted on and applied to."""
    got = co.ranker_rows(fx.tokens("gene_type"), fx.folds(), fx.prob(["a"], 400), fx.classes, 0)
    return got.select("sid", "label", "inner_fold", "cls", *[F.round(c, 6).alias(c) for c in ("sum_all", "sum_absolute")], "n_positive", "n_tokens", F.round("prior", 6).alias("prior"))


@query("c8_candidate_ranker")
def _(fx):
    """All outer folds, each scored by a ranker and a strength that never saw its labels."""
    tokens, folds, prob = cut_lineage(fx.tokens("gene_type")), cut_lineage(fx.folds()), cut_lineage(fx.prob(["a"], 400))
    classes, out = fx.classes, None
    for part in in_parallel([lambda held=held: co.candidate_ranker(tokens, folds, prob, classes, held) for held in range(5)], 2):
        out = part if out is None else out.unionByName(part)
    return out.withColumn("p", F.round("p", 4))
