"""Feature selection queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.catalog.base import query, r6
from glyphmill.catalog.weights import grid
from glyphmill.session import cut_lineage
from glyphmill.operators import rollups as ru, selection as se, similarity as si, weights as we


def _counts(fx, level):
    return we.token_counts(fx.tokens(level), fx.samples, fx.classes)


def _long(fx, level):
    counts = _counts(fx, level)
    return we.weights_long(counts.withColumn("w", F.col("pos").cast("array<double>")), fx.classes)


def _round(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


_DOM = f"""with {grid('tok_codon')}, d as (select *, row_number() over (partition by token order by pos desc, cls) as rn from g
 where s >= 10), e as (select token, cast(s as bigint) as support, cls as dominant, cast(pos as bigint) as n_dominant, pos / s as
 purity, (pos / s) / (cn / n) as lift, pos / s >= 0.99 and cn <= 120 as artefact from d where rn = 1)"""


@query("l12_ranked_tokens_by_lift", _DOM + f" select token, support, dominant, n_dominant, {r6('purity')} as purity,"
       f" {r6('lift')} as lift, artefact from (select * from e order by lift desc, support desc, token limit 50) z")
def _(fx):
    return _round(se.ranked_tokens(_counts(fx, "codon"), fx.classes, "disc", 50), "purity", "lift")


@query("l12_ranked_tokens_by_frequency", _DOM + f" select token, support, dominant, n_dominant, {r6('purity')} as purity,"
       f" {r6('lift')} as lift, artefact from (select * from e order by support desc, lift desc, token limit 50) z")
def _(fx):
    return _round(se.ranked_tokens(_counts(fx, "codon"), fx.classes, "freq", 50), "purity", "lift")


@query("l13_concentrated_tokens", _DOM + f""", z as (select token, support, purity as share from e where purity >= 0.4 order by
 support * purity desc, support desc, token limit 30) select token, support, {r6('share')} as share from z""")
def _(fx):
    return _round(se.concentrated_tokens(_counts(fx, "codon"), 30, share=0.40), "share")


@query("l14_recurrent_events", "select gene, event, count(distinct sid) as n from typed where event_type = 'MISSENSE'"
       " group by 1, 2 having count(distinct sid) >= 5")
def _(fx):
    return se.recurrent_events(fx.typed)


_CON = f"""with {grid('tok_gene')}, c as (select a.cls as class_a, b.cls as class_b, a.token as gene, cast(a.pos + b.pos as bigint) as
 support, a.pos / a.cn - b.pos / b.cn as contrast from g a join g b on a.token = b.token and a.cls < b.cls where a.pos + b.pos >= 10)"""


def _contrasts(fx):
    classes = fx.classes
    counts = we.token_counts(fx.tokens("gene"), fx.samples, classes)
    return se.pair_contrasts(counts, [(a, b) for i, a in enumerate(classes) for b in classes[i + 1:]], classes)


@query("l15_pair_contrast_features", _CON + """, t as (select *, row_number() over (partition by class_a, class_b order by
 abs(contrast) desc, support desc, gene) as rn from c) select sid, class_a, class_b, count(*) as n_genes,
 cast(sum(sign(contrast)) as double) as signed_sum from tok_gene join t on token = gene where rn <= 5 group by 1, 2, 3""")
def _(fx):
    selected = se.top_contrasts(_contrasts(fx))
    return se.contrast_features(ru.gene_presence(fx.events), selected)


@query("l15_pair_contrast_weighted", _CON + f""", t as (select *, row_number() over (partition by class_a, class_b order by
 support * abs(contrast) desc, support desc, gene) as rn from c) select class_a, class_b, gene, support, {r6('contrast')} as
 contrast, cast(rn as int) as rank from t where rn <= 5 and contrast <> 0""")
def _(fx):
    selected = se.top_contrasts(_contrasts(fx), ranking="weighted")
    return _round(selected, "contrast").select("class_a", "class_b", "gene", "support", "contrast", "rank")


@query("l16_rest_contrast_features", f"""with {grid('tok_gene')}, c as (select cls, token as gene, s, pos / cn - (s - pos) /
 (n - cn) as contrast from g where s >= 10 and cls in ('AUTOMOBILE', 'MACHINERY')), t as (select *, row_number() over (partition by
 cls order by abs(contrast) desc, s desc, gene) as rn from c) select sid, cls, count(*) as n_genes, cast(sum(sign(contrast)) as
 double) as signed_sum from tok_gene join t on token = gene where rn <= 5 group by 1, 2""")
def _(fx):
    contrasts = se.rest_contrasts(_long(fx, "gene"), ["AUTOMOBILE", "MACHINERY"])
    selected = se.top_contrasts(contrasts, group=("cls",))
    return se.contrast_features(ru.gene_presence(fx.events), selected, ("cls",))


@query("l17_rate_spread", f"""with {grid('tok_codon')}, z as (select token, cast(max(s) as bigint) as support, max(pos / cn) -
 min(pos / cn) as spread from g group by 1 order by 3 desc, 2 desc, 1 limit 100) select token, support, {r6('spread')} as spread from z""")
def _(fx):
    return _round(se.rate_spread(_counts(fx, "codon"), 100), "spread")


@query("l18_marker_table", f"""with {grid('tok_codon')} select cls, token, cast(pos as bigint) as n_hit, cast(cn as bigint) as cls_n,
 {r6('pos / cn')} as rate, {r6('s / n')} as overall, {r6('(pos / cn) / (s / n)')} as lift, {r6('pos / s')} as concentration from g
 where pos >= 8 and pos / cn >= 0.02 and (pos / cn) / (s / n) >= 1.2""")
def _(fx):
    return _round(se.marker_table(_long(fx, "codon"), 8, 0.02, 1.2), "rate", "overall", "lift", "concentration")


@query("l19_pairwise_markers", f"""with {grid('tok_codon')} select a.cls as class_a, b.cls as class_b, a.token, {r6('a.pos / a.cn')}
 as rate_a, {r6('b.pos / b.cn')} as rate_b from g a join g b on a.token = b.token and a.cls <> b.cls where a.pos / a.cn >= 0.03 and
 a.pos / a.cn > 3 * greatest(b.pos / b.cn, 1e-9)""")
def _(fx):
    return _round(se.pairwise_markers(_long(fx, "codon"), 0.03, 3.0), "rate_a", "rate_b")


_CHI = "sum((pos - s * cn / n) * (pos - s * cn / n) / (s * cn / n))"


@query("l20_chi_square_k_best", f"""with {grid('tok_codon')}, z as (select token, cast(max(s) as bigint) as support, {r6(_CHI)} as chi2
 from g group by 1) select * from z order by chi2 desc, token limit 200""")
def _(fx):
    return se.k_best_chi_square(_counts(fx, "codon"), 200)


@query("l21_minimum_support", "select token, count(*) as support from tok_exact group by 1 having count(*) >= 3")
def _(fx):
    return fx.tokens("exact").groupBy("token").agg(F.count(F.lit(1)).alias("support")).filter("support >= 3")


@query("l21_varying_columns", """with v as (select sid, gene, count(*) as k from events group by 1, 2), s as (select gene, count(*) as
 rows, min(k) as lo, max(k) as high from v group by 1) select gene, rows, case when rows < (select n from ntot) then least(lo, 0)
 else lo end as low, high from s where rows >= 3 and case when rows < (select n from ntot) then least(lo, 0) else lo end <> high""")
def _(fx):
    per_gene = fx.events.groupBy("sid", "gene").agg(F.count(F.lit(1)).alias("k"))
    n = fx.samples.agg(F.count(F.lit(1))).scalar()
    return se.varying_counts(per_gene, n, "gene", "k", floor=3)


@query("l22_top_tokens", "select token, count(*) as n from tok_exact group by 1 order by 2 desc, 1 limit 100")
def _(fx):
    return se.top_tokens(fx.tokens("exact"), 100)


_DOCW = ("dw as (select doc_id as sid, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) as token from documents)")


def doc_words(fx):
    """Distinct (sid, token) of whole documents."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))
    return fx.documents.select(F.col("doc_id").alias("sid"), F.explode(words).alias("token"))


def _word_columns(fx):
    """(id): words of documents without those whose column equals an earlier word's: duplicates go before correlations are looked for."""
    return cut_lineage(si.first_of_equal(doc_words(fx)).filter("id = first").select("id"))


def _n_docs(fx):
    return fx.t("documents").count()


_FIRST = f"""{_DOCW}, hs as (select token, count(*) as c, md5(string_agg(cast(sid as varchar), ',' order by sid)) as h from dw group by 1),
 fi as (select token, c, h, min(token) over (partition by h) as first from hs)"""


@query("l24_duplicate_columns", f"with {_FIRST} select token as id, first from fi")
def _(fx):
    """Each word with the first word that has the very same column."""
    return si.first_of_equal(doc_words(fx))


@query("l24_correlated_columns", f"""with {_FIRST}, w as (select sid, token, c from dw join fi using (token) where token = first), n as (select count(*)::double as n from documents),
 p as (select x.token as a, y.token as b, cast(max(x.c) as double) as ca, cast(max(y.c) as double) as cb, count(*) as common from w x
 join w y on x.sid = y.sid and x.token < y.token group by 1, 2), q as (select a, b, common, (n * common - ca * cb) / sqrt(ca * cb *
 (n - ca) * (n - cb)) as phi from p, n where ca < n and cb < n) select a, b, common, {r6('phi')} as phi from q where abs(phi) >= 0.95""")
def _(fx):
    """Positive and negative phi among distinct columns; pairs that never meet cannot reach -0.95 on this data, as the twin assumes."""
    return _round(si.correlated_tokens(doc_words(fx), _n_docs(fx), 0.95, _word_columns(fx)), "phi")


@query("l24_pruned_columns")
def _(fx):
    """Columns left after dropping those correlated with an earlier kept one (sequential rule, no SQL twin)."""
    words = _word_columns(fx)
    edges = si.correlated_tokens(doc_words(fx), _n_docs(fx), 0.95, words)
    return si.keep_earlier(words, edges)


@query("l27_class_weights", f"""with k as (select count(*) as k from classes) select cls, cls_n as n, {r6('n / cast(k * cls_n as double)')}
 as balanced, {r6('n / (k * sqrt(cls_n))')} as sqrt_balanced from csize, ntot, k""")
def _(fx):
    a = se.class_weights(fx.samples).withColumnRenamed("weight", "balanced")
    b = se.class_weights(fx.samples, "sqrt_balanced").select("cls", F.col("weight").alias("sqrt_balanced"))
    return _round(a.join(b, "cls"), "balanced", "sqrt_balanced")


@query("l29_duplicate_columns", """with c as (select sid, gene, cell from cells union all select sid, 'Copy of ' || gene, cell from cells
 where gene in ('Brand#1', 'Brand#2', 'Brand#3')), h as (select gene, md5(string_agg(sid || '=' || cell, '~' order by sid)) as h, count(*)
 as rows, min(cell) as lo, max(cell) as hi from c group by 1) select gene, case when rows = (select n from ntot) and lo = hi then
 'constant' when row_number() over (partition by h order by gene) > 1 then 'duplicate' else 'keep' end as status from h""")
def _(fx):
    copies = fx.cells.filter(F.col("gene").isin("Brand#1", "Brand#2", "Brand#3")).withColumn(
        "gene", F.concat(F.lit("Copy of "), F.col("gene")))
    genes = sorted([f"Brand#{i}" for i in range(1, 26)] + [f"Copy of Brand#{i}" for i in (1, 2, 3)])
    n = fx.samples.agg(F.count(F.lit(1))).scalar()
    return se.column_filter(fx.cells.unionByName(copies), n, genes)


@query("l30_auto_events", f"""with {grid('tok_exact')}, f as (select token from (select token, max(s) as s from g group by 1) y where s >= 2
 order by s desc, token limit 2000), z as (select token, cast(max(s) as bigint) as support, {r6(_CHI)} as chi2 from g where token in
 (select token from f) group by 1) select * from z order by chi2 desc, token limit 20""")
def _(fx):
    return se.auto_events(_counts(fx, "exact"), 2000, 20)
