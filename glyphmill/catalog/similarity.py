"""Centroids, confusion pairs, nearest profiles, near-duplicate groups and purity."""
from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.catalog.base import query, r6
from glyphmill.catalog.selection import _DOCW, doc_words
from glyphmill.operators import evidence as ev, metrics as me, similarity as si

_CENT = """cv as (select label as cls, token, count(*) / cast(max(cls_n) as double) as v from {tok} join samples using (sid) join csize on
 cls = label group by 1, 2)"""
_COS = ("select a.cls as class_a, b.cls as class_b, {r} as cosine from {t} a join {t} b on a.token = b.token and a.cls < b.cls"
        " join nm na on na.cls = a.cls join nm nb on nb.cls = b.cls group by 1, 2")


def _round(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("n1_centroid_cosine", "with " + _CENT.format(tok="tok_gene_type") + ", nm as (select cls, sqrt(sum(v * v)) as norm from cv group by 1) "
       + _COS.format(t="cv", r=r6("sum(a.v * b.v) / (max(na.norm) * max(nb.norm))")))
def _(fx):
    return _round(si.class_pair_cosine(si.centroids(fx.tokens("gene_type"), fx.samples)), "cosine")


_CENTRED = "with " + _CENT.format(tok="tok_codon") + """, gd as (select t.token, c.cls, coalesce(v, 0) as v from (select distinct token from
 cv) t cross join classes c left join cv on cv.token = t.token and cv.cls = c.cls), ct as (select token, cls, v - avg(v) over
 (partition by token) as v from gd), nm as (select cls, sqrt(sum(v * v)) as norm from ct group by 1)
"""


@query("n1b_centred_centroid_cosine", _CENTRED + _COS.format(t="ct", r=r6("sum(a.v * b.v) / (max(na.norm) * max(nb.norm))")))
def _(fx):
    return _round(si.class_pair_cosine(si.centroids(fx.tokens("codon"), fx.samples, centred=True)), "cosine")


@query("n1b_disjoint_similar_pairs", _CENTRED + """, ps as materialized (select a.cls as class_a, b.cls as class_b, round(sum(a.v * b.v) / (max(na.norm) *
 max(nb.norm)), 6) as cosine from ct a join ct b on a.token = b.token and a.cls < b.cls join nm na on na.cls = a.cls join nm nb on
 nb.cls = b.cls group by 1, 2), f as materialized (select * from ps order by cosine desc, class_a, class_b limit 1), s as (select ps.* from ps, f where
 ps.class_a not in (f.class_a, f.class_b) and ps.class_b not in (f.class_a, f.class_b) order by ps.cosine desc, ps.class_a, ps.class_b
 limit 1) select class_a, class_b, cosine + 0.0 as cosine from f union all select class_a, class_b, cosine + 0.0 from s""")
def _(fx):
    pairs = _round(si.class_pair_cosine(si.centroids(fx.tokens("codon"), fx.samples, centred=True)), "cosine")
    ranked = [tuple(r) for r in pairs.orderBy(F.desc("cosine"), "class_a", "class_b").collect()]  # class x class rows
    return fx.spark.createDataFrame(si.disjoint_pairs(ranked, 2), "class_a string, class_b string, cosine double")


_PRED = """pd as (select sid, any_value(label) as truth, arg_max(cls, (p, -ord)) as pred from (select pr1.*, dense_rank() over (order by cls)
 as ord from pr1) z group by 1), cf as (select truth, pred, count(*) as n from pd group by 1, 2)"""


def _confusion(fx):
    return me.confusion(me.predictions(fx.prob(["a"])))


_TW = _PRED + """, tw as (select least(truth, pred) as class_a, greatest(truth, pred) as class_b, cast(sum(n) as bigint) as swapped from cf
 where truth <> pred group by 1, 2), sz as (select truth as cls, sum(n) as size from cf group by 1)"""


@query("n2_confusion_pairs", f"""with {_TW} select class_a, class_b, swapped, {r6('swapped / cast(greatest(a.size + b.size, 1) as double)')}
 as rate from tw join sz a on a.cls = class_a join sz b on b.cls = class_b order by swapped / cast(greatest(a.size + b.size, 1) as
 double) desc, class_a, class_b limit 8""")
def _(fx):
    got = si.confusion_rates(_confusion(fx)).orderBy(F.desc("rate"), "class_a", "class_b").limit(8)
    return _round(got, "rate")


@query("n2b_disjoint_confusion_pairs", f"""with {_TW}, f as materialized (select * from tw order by swapped desc, class_a, class_b limit 1), s as (select
 tw.* from tw, f where tw.class_a not in (f.class_a, f.class_b) and tw.class_b not in (f.class_a, f.class_b) order by tw.swapped desc,
 tw.class_a, tw.class_b limit 1) select * from f union all select * from s""")
def _(fx):
    got = si.two_way_confusion(_confusion(fx)).orderBy(F.desc("swapped"), "class_a", "class_b")
    ranked = [tuple(r) for r in got.collect()]  # class x class rows
    return fx.spark.createDataFrame(si.disjoint_pairs(ranked, 3), "class_a string, class_b string, swapped bigint")


@query("n2b_top_confusion_counts", f"with {_TW} select class_a, class_b, swapped from tw order by swapped desc, class_a, class_b limit 5")
def _(fx):
    return si.two_way_confusion(_confusion(fx)).orderBy(F.desc("swapped"), "class_a", "class_b").limit(5)


@query("n3_confusion_groups")
def _(fx):
    pairs = [tuple(r) for r in si.two_way_confusion(_confusion(fx)).collect()]  # class x class rows
    groups = si.confusion_groups(pairs, fx.classes, 3)
    rows = [(c, i) for i, g in enumerate(groups) for c in g]
    return fx.spark.createDataFrame(rows, "cls string, grp int")


_PROTO = """with {cent}, nm as (select cls, sqrt(sum(v * v)) as norm from cv group by 1), x as (select sid, token, 1 / sqrt(count(*) over
 (partition by sid)) as v from tok_gene_type), dt as (select sid, cls, sum(x.v * cv.v / norm) as s from x join cv using (token) join nm
 using (cls) group by 1, 2), al as (select s.sid, c.cls, {score} as z from samples s cross join classes c join csize k on k.cls =
 c.cls cross join ntot left join dt on dt.sid = s.sid and dt.cls = c.cls), ex as (select *, exp(z - max(z) over (partition by sid)) as e
 from al)"""


def _unit(fx):
    tokens = fx.tokens("gene_type")
    sizes = tokens.groupBy("sid").agg(F.count(F.lit(1)).alias("k"))
    return tokens.join(sizes, "sid").select("sid", "token", (1 / F.sqrt(F.col("k").cast("double"))).alias("v"))


@query("n4_prototype_cosine", _PROTO.format(cent=_CENT.format(tok="tok_gene_type"), score="coalesce(s, 0) / 0.1")
       + f" select sid, cls, {r6('e / sum(e) over (partition by sid)')} as p from ex")
def _(fx):
    proto = si.centroids(fx.tokens("gene_type"), fx.samples)
    return _round(si.prototype_probabilities(_unit(fx), proto, fx.classes, fx.samples, 0.10), "p")


@query("n4b_prototype_tf_idf", f"""with df as (select token, count(*) as df from tok_exact group by 1), iv as (select sid, token, ln((1.0 + n) /
 (1.0 + df)) + 1 as v from tok_exact join df using (token) cross join ntot), un as (select sid, token, v / sqrt(sum(v * v) over (partition
 by sid)) as v from iv), cv as (select label as cls, token, sum(v) / max(cls_n) as v from un join samples using (sid) join csize on cls =
 label group by 1, 2), nm as (select cls, sqrt(sum(v * v)) as norm from cv group by 1), dt as (select sid, cls, sum(un.v * cv.v / norm) as
 s from un join cv using (token) join nm using (cls) group by 1, 2), al as (select s.sid, c.cls, coalesce(s, 0) + ln(greatest(k.cls_n /
 cast(n as double), 1e-9)) as z from samples s cross join classes c join csize k on k.cls = c.cls cross join ntot left join dt on dt.sid
 = s.sid and dt.cls = c.cls), ex as (select *, exp(z - max(z) over (partition by sid)) as e from al) select sid, cls,
 {r6('e / sum(e) over (partition by sid)')} as p from ex""")
def _(fx):
    docs = fx.tokens("exact").withColumn("tf", F.lit(1))
    n = fx.samples.agg(F.count(F.lit(1))).scalar()
    unit = ev.tf_idf(docs, n, min_df=1).withColumnRenamed("weight", "v")
    sizes = fx.samples.groupBy("label").agg(F.count(F.lit(1)).alias("cls_n"))
    proto = unit.join(fx.samples, "sid").groupBy("label", "token").agg(F.sum("v").alias("t")).join(sizes, "label").select(
        F.col("label").alias("cls"), "token", (F.col("t") / F.col("cls_n")).alias("v"))
    counts = [F.log(F.greatest(F.count_if(F.col("label") == c) / F.count(F.lit(1)), F.lit(1e-9))) for c in fx.classes]
    prior = fx.samples.agg(F.array(*counts))
    return _round(si.prototype_probabilities(unit, proto, fx.classes, fx.samples, log_prior=prior), "p")


@query("n5_nearest_profiles", f"""with sz as (select sid, count(*) as size from tok_exact group by 1), cm as (select a.sid, b.sid as other, count(*)
 as common from tok_exact a join tok_exact b on a.token = b.token and a.sid <> b.sid group by 1, 2), sm as (select cm.*, x.size as sa,
 y.size as sb, common / sqrt(x.size::double * y.size::double) as cosine from cm join sz x on x.sid = cm.sid join sz y on y.sid = other),
 rk as (select *, row_number() over (partition by sid order by round(cosine, 12) desc, other) as rn from sm)
 select sz.sid as id, other as neighbour, {r6('cosine')} as cosine, {r6('common / cast(sa + sb - common as double)')} as jaccard
 from sz left join (select * from rk where rn = 1) r on r.sid = sz.sid""")
def _(fx):
    sets = fx.tokens("exact").select(F.col("sid").alias("id"), F.col("token").alias("member"))
    return _round(si.nearest_profiles(sets), "cosine", "jaccard")


_GROUPS = f"""with recursive {_DOCW}, pf as (select sid, md5(string_agg(token, ' ' order by token)) as profile, count(*) as size from dw
 group by 1), rp as (select profile, min(sid) as rep, any_value(size) as size from pf group by 1), u as (select sid, token from dw where
 sid in (select rep from rp)), cm as (select a.sid as a, b.sid as b, count(*) as common from u a join u b on a.token = b.token and a.sid
 <> b.sid group by 1, 2), sm as (select a, b, common / sqrt(x.size::double * y.size::double) as cosine from cm join rp x on x.rep = a join
 rp y on y.rep = b), tp as (select a, b from (select *, row_number() over (partition by a order by round(cosine, 12) desc, b) as rn from sm
 where cosine >= 0.9 - 1e-12) z where rn = 1), eg as materialized (select a, b from tp union select b, a from tp), rc as (select rep as id, rep as r from rp union
 select rc.id, eg.b from rc join eg on eg.a = rc.r), co as (select id, min(r) as component from rc group by 1)
"""


def _doc_sets(fx):
    return doc_words(fx).select(F.col("sid").alias("id"), F.col("token").alias("member"))


@query("f6_duplicate_groups", _GROUPS + " select sid as id, component from pf join rp using (profile) join co on co.id = rep")
def _(fx):
    return si.duplicate_groups(_doc_sets(fx), 0.90)


@query("f5_grouped_folds", _GROUPS + """, gr as (select pf.sid, lang as label, component from pf join rp using (profile) join co on co.id = rep
 join documents on doc_id = pf.sid), mj as (select component, label from (select component, label, row_number() over (partition by
 component order by count(*) desc, label) as rn from gr group by 1, 2) z where rn = 1), nb as (select component, cast((row_number() over
 (partition by label order by md5('42:' || component)) - 1) % 5 as int) as fold from mj) select sid, label, component, fold from gr join
 nb using (component)""")
def _(fx):
    groups = si.duplicate_groups(_doc_sets(fx), 0.90).withColumnRenamed("id", "sid")
    labels = fx.t("documents").select(F.col("doc_id").alias("sid"), F.col("lang").alias("label"))
    return si.grouped_folds(groups, labels)


@query("f5_balanced_grouped_folds")
def _(fx):
    """Groups of near-equal documents dealt so that folds hold equally many rows, of each language too."""
    groups = si.duplicate_groups(_doc_sets(fx), 0.90).withColumnRenamed("id", "sid")
    labels = fx.t("documents").select(F.col("doc_id").alias("sid"), F.col("lang").alias("label"))
    return si.balanced_grouped_folds(groups, labels)


# Profiles of documents (word sets) with language as label -------------------------------------

_PROF = f"with {_DOCW}, pf as (select sid, md5(string_agg(token, ' ' order by token)) as profile from dw group by 1)"


def _doc_profiles(fx):
    labels = fx.t("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("label"))
    return si.profiles(_doc_sets(fx)).join(labels, "id")


_PL = _PROF + ", pl as (select pf.sid, profile, source as label from pf join documents on doc_id = sid)"
_DETAIL = _PL + """, n1 as (select profile, label, count(*) as n from pl group by 1, 2), dt as (select profile, cast(sum(n) as bigint) as
 support, max(n) as majority_count, count(*) as label_count, max(n) / cast(sum(n) as double) as purity, log2(sum(n)) - sum(n * log2(n)) /
 sum(n) as entropy_bits from n1 group by 1)"""


@query("n7_profile_purity_summary", _DETAIL + f""" select count(*) as unique_profiles, cast(coalesce(sum(support) filter (support > 1), 0) as
 bigint) as duplicate_rows, {r6('sum(majority_count) / cast(sum(support) as double)')} as weighted_purity, count(*) filter (label_count >
 1) as conflict_profiles from dt""")
def _(fx):
    return _round(si.purity_summary(si.profile_detail(_doc_profiles(fx))), "weighted_purity")


@query("n7_n10_profile_detail", _DETAIL + f""" select support, majority_count, label_count, {r6('purity')} as purity, {r6('entropy_bits')} as
 entropy_bits, count(*) as profiles from dt group by 1, 2, 3, 4, 5""")
def _(fx):
    got = _round(si.profile_detail(_doc_profiles(fx)), "purity", "entropy_bits")
    return got.groupBy("support", "majority_count", "label_count", "purity", "entropy_bits").agg(
        F.count(F.lit(1)).alias("profiles"))


@query("n8_merge_audit", _PROF + """, rw as (select doc_id as sid, md5(text) as raw, source as label from documents), g as (select profile,
 count(*) as row_count, count(distinct raw) as raw_profile_count, count(distinct label) as label_count from pf join rw using (sid) group
 by 1) select row_count, raw_profile_count, label_count, raw_profile_count > 1 as raw_merged, count(*) as profiles from g group by 1, 2, 3, 4""")
def _(fx):
    docs = fx.t("documents")
    raw = docs.select(F.col("doc_id").alias("id"), F.md5("text").alias("profile"))
    labels = docs.select(F.col("doc_id").alias("sid"), F.col("source").alias("label"))
    got = si.merge_audit(raw, si.profiles(_doc_sets(fx)), labels)
    return got.groupBy("row_count", "raw_profile_count", "label_count", "raw_merged").agg(F.count(F.lit(1)).alias("profiles"))


_DF = """ df as (select *, cast((row_number() over (partition by label order by md5('42:' || sid)) - 1) % 5 as int) as fold from (select sid,
 profile, label from pl) q)"""


def _folded_profiles(fx):
    from glyphmill.operators.folds import stratified_folds
    return stratified_folds(_doc_profiles(fx).withColumnRenamed("id", "sid")).withColumnRenamed("sid", "id")


@query("n9_held_out_profile_stats", _DETAIL.replace("from pl group by 1, 2), dt", "from df where fold <> 0 group by 1, 2), dt").replace(
    ", n1 as", "," + _DF + ", n1 as") + f""" select df.sid as id, support is not null as duplicate, {r6('coalesce(purity, 0)')} as purity,
 coalesce(label_count > 1, false) as conflict from df left join dt using (profile) where fold = 0""")
def _(fx):
    rows = _folded_profiles(fx)
    stats = si.profile_detail(rows.filter("fold <> 0"))
    got = rows.filter("fold = 0").join(stats, "profile", "left")
    return got.select("id", F.col("support").isNotNull().alias("duplicate"), F.round(F.coalesce("purity", F.lit(0.0)), 6).alias("purity"),
                      F.coalesce(F.col("label_count") > 1, F.lit(False)).alias("conflict"))


_LANGS = _PL.replace("source as label", "lang as label") + "," + _DF


@query("n6_profile_posterior", _LANGS + f""", ft as (select * from df where fold <> 0), pr as (select label as cls, count(*) / cast((select count(*)
 from ft) as double) as prior from ft group by 1), sp as (select profile, count(*) as support from ft group by 1), ct as (select profile,
 label as cls, count(*) as k from ft group by 1, 2), mx as (select profile, max(k) as mk from ct group by 1) select df.sid as id,
 support is not null as matched, coalesce(support, 0) as support, {r6('coalesce(mk / cast(support as double), 0)')} as purity, pr.cls,
 {r6('coalesce((coalesce(k, 0) + 5 * prior) / (support + 5), prior)')} as posterior from df cross join pr left join sp using (profile)
 left join mx using (profile) left join ct on ct.profile = df.profile and ct.cls = pr.cls where fold = 0""")
def _(fx):
    langs = ["de", "en", "es", "fr"]
    from glyphmill.operators.folds import stratified_folds
    labels = fx.t("documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    rows = stratified_folds(si.profiles(_doc_sets(fx)).join(labels, "id").withColumnRenamed("id", "sid")).withColumnRenamed("sid", "id")
    fit = rows.filter("fold <> 0")
    prior = fit.agg(F.array(*[F.count_if(F.col("label") == c) / F.count(F.lit(1)) for c in langs])).scalar()
    got = si.profile_posterior(rows.filter("fold = 0"), si.profile_lookup(fit, langs), prior, langs, 5.0)
    return _round(got, "purity", "posterior")
