"""Scans, unpivot, cell parsing, event classifiers and token builders."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glyphmill.catalog.base import TYPE7, query
from glyphmill.functions import cells as c
from glyphmill.functions.hashing import hash_bucket
from glyphmill.sources import tables
from glyphmill.sources.fixtures import Fixtures



def _exploded(fx: Fixtures, events) -> DataFrame:
    return fx.raw_cells.select("sid", "line", "gene", "grp", F.explode(events).alias("event"))


def _type_counts(df: DataFrame, kind) -> DataFrame:
    return df.select(kind.alias("event_type"), "event").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("event").alias("first_event"), F.max("event").alias("last_event")
    )


def _type_sql(case: str, source: str) -> str:
    return (
        f"select event_type, count(*) as n, min(event) as first_event, max(event) as last_event"
        f" from (select {case} as event_type, event from {source}) z group by 1"
    )


# Parsing -------------------------------------------------------------------------------------


@query(
    "p1_normalise_cell",
    "select gene, array_to_string(events, '|') as events, count(*) as n from parsed group by 1, 2",
)
def _(fx):
    return fx.raw_cells.select("gene", F.concat_ws("|", c.normalise_cell(F.col("cell"))).alias("events")).groupBy(
        "gene", "events").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p1b_split_whitespace",
    "select gene, event, count(*) as n, count(distinct sid) as n_samples from split_ws group by 1, 2",
)
def _(fx):
    return _exploded(fx, c.split_whitespace(F.col("cell"))).groupBy("gene", "event").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("sid").alias("n_samples"))


@query(
    "p1c_split_grammar",
    "select gene, array_to_string(events, '~') as events, count(*) as n from segs group by 1, 2",
)
def _(fx):
    return fx.raw_cells.select("gene", F.concat_ws("~", c.split_grammar(F.col("cell"))).alias("events")).groupBy(
        "gene", "events").agg(F.count(F.lit(1)).alias("n"))


_SINGLE = (
    "select gene, case when cell is not null and trim(cell) not in ('', 'WT', 'wt', 'NAN', 'nan')"
    " then upper(trim(cell)) end as event from raw_cells"
)
_DETAIL8 = """case when event is null then 'NONE' when contains(event, 'FS') then 'FRAMESHIFT'
 when contains(event, 'DELINS') or contains(event, 'INS') then 'INFRAME_INS' when contains(event, 'DEL') then 'INFRAME_DEL'
 when contains(event, 'SPLICE') then 'SPLICE' when regexp_matches(event, '\\*|TER|X') then 'NONSENSE'
 when regexp_matches(event, '^[A-Z*][0-9]+[A-Z*]$') then 'MISSENSE' else 'OTHER' end"""


@query(
    "p1d_single_event",
    f"select event_type, count(*) as n, min(event) as first_event, max(event) as last_event from (select event,"
    f" {_DETAIL8} as event_type from ({_SINGLE}) y) z group by 1",
)
def _(fx):
    one = fx.raw_cells.select(c.single_event(F.col("cell")).alias("event"))
    kind = F.when(F.col("event").isNull(), "NONE").otherwise(c.detail8(F.col("event")))
    return _type_counts(one, kind)


# Classifiers ---------------------------------------------------------------------------------


@query("p2_classify_standard7", _type_sql(TYPE7.format(e="event"), "pev"))
def _(fx):
    return _type_counts(_exploded(fx, c.normalise_cell(F.col("cell"))), c.standard7(F.col("event")))


@query(
    "p2b_classify_strict_x",
    _type_sql(
        TYPE7.format(e="event").replace(
            "ends_with(event, 'X')", "regexp_matches(event, '^[A-Z*]-?[0-9]+X$')"), "pev"),
)
def _(fx):
    return _type_counts(_exploded(fx, c.normalise_cell(F.col("cell"))), c.standard7_strict_x(F.col("event")))


_SHAPE = "'(?s)^([A-Z*]+)([0-9]+)(.*)$'"
_COMPACT6 = f"""case when contains(event, '>') then 'other' when contains(event, 'fs') then 'frameshift'
 when contains(event, 'del') or contains(event, 'ins') then 'indel'
 when not regexp_matches(event, {_SHAPE}) then 'other'
 when regexp_extract(event, {_SHAPE}, 1) = '*' and regexp_extract(event, {_SHAPE}, 3) = '*' then 'other'
 when regexp_extract(event, {_SHAPE}, 3) = '*' then 'nonsense'
 when regexp_extract(event, {_SHAPE}, 3) = regexp_extract(event, {_SHAPE}, 1) then 'silent'
 when regexp_extract(event, {_SHAPE}, 3) = '' then 'other' else 'missense' end"""


@query("p2c_classify_compact6", _type_sql(_COMPACT6, "split_ws"))
def _(fx):
    return _type_counts(_exploded(fx, c.split_whitespace(F.col("cell"))), c.compact6(F.col("event")))


@query(
    "p2d_classify_basic5",
    _type_sql(
        "case when contains(lower(event), 'fs') then 'frameshift' when contains(event, '*') then 'nonsense'"
        " when regexp_matches(event, '^[A-Z*][0-9]+[A-Z*]$') then case when left(event, 1) = right(event, 1)"
        " then 'synonymous' else 'missense' end else 'other' end", "split_ws"),
)
def _(fx):
    return _type_counts(_exploded(fx, c.split_whitespace(F.col("cell"))), c.basic5(F.col("event")))


@query(
    "p2e_classify_detail9",
    _type_sql(
        "case when contains(event, 'FS') then 'FRAMESHIFT' when contains(event, 'DELINS') then 'DELINS'"
        " when contains(event, 'INS') then 'INFRAME_INS' when contains(event, 'DEL') then 'INFRAME_DEL'"
        " when contains(event, 'SPLICE') then 'SPLICE' when regexp_matches(event, 'TER|\\*|X') then 'NONSENSE'"
        " when regexp_matches(event, '^[A-Z*][0-9]+[A-Z*]$') then 'MISSENSE' else 'OTHER' end", "pev"),
)
def _(fx):
    return _type_counts(_exploded(fx, c.normalise_cell(F.col("cell"))), c.detail9(F.col("event")))


_V = "replace(upper(event), ' ', '')"
_CANON = f"""case when regexp_matches({_V}, 'SPLICE|IVS|[+-][0-9]+') then 'SPLICE'
 when contains({_V}, 'START') and (contains({_V}, 'LOSS') or contains({_V}, 'LOST')) then 'START_LOSS'
 when contains({_V}, 'STOP') and (contains({_V}, 'LOSS') or contains({_V}, 'LOST')) then 'STOP_LOSS'
 when regexp_matches({_V}, 'FS|FRAMESHIFT') then case when contains({_V}, 'INS') then 'FRAMESHIFT_INS' else 'FRAMESHIFT_DEL' end
 when contains({_V}, 'DELINS') or contains({_V}, 'COMPLEX') or regexp_matches({_V}, '^[0-9]+_[0-9]+[A-Z*]+>[A-Z*]+$') then 'DELINS_COMPLEX'
 when contains({_V}, 'DUP') then 'DUPLICATION' when contains({_V}, 'INS') then 'INFRAME_INS'
 when contains({_V}, 'DEL') then 'INFRAME_DEL'
 when regexp_matches({_V}, '^[A-Z*][0-9]+[A-Z*]$') then case when right({_V}, 1) = '*' then 'NONSENSE'
   when left({_V}, 1) = right({_V}, 1) then 'SYNONYMOUS' else 'MISSENSE' end
 when regexp_matches({_V}, '^[A-Z*]?[0-9]+$') then 'OTHER_VALID' else 'UNKNOWN' end"""
_LEGACY = """case when k in ('FRAMESHIFT_INS', 'FRAMESHIFT_DEL') then 'FRAMESHIFT'
 when k in ('INFRAME_INS', 'INFRAME_DEL', 'DUPLICATION', 'DELINS_COMPLEX') then 'INFRAME_DEL'
 when k in ('STOP_LOSS', 'START_LOSS') then 'NONSENSE'
 when k in ('MISSENSE', 'SYNONYMOUS', 'NONSENSE', 'SPLICE') then k else 'OTHER' end"""


@query(
    "p2f_classify_canonical14",
    f"select k as canonical_type, {_LEGACY} as legacy_type, count(*) as n, min(event) as first_event,"
    f" cast(min(position) as bigint) as min_position from (select event, {_CANON} as k,"
    " try_cast(nullif(regexp_extract(replace(upper(event), ' ', ''), '([0-9]+)', 1), '') as bigint) as position"
    " from sev) z group by 1, 2",
)
def _(fx):
    e = _exploded(fx, c.split_grammar(F.col("cell"))).withColumn("canonical_type", c.canonical14(F.col("event")))
    return e.groupBy("canonical_type", c.legacy_type(F.col("canonical_type")).alias("legacy_type")).agg(
        F.count(F.lit(1)).alias("n"), F.min("event").alias("first_event"),
        F.min(c.first_integer(F.col("event"))).alias("min_position"))


@query(
    "p2g_classify_state3_eda7",
    "select state, label, count(*) as n from (select case when regexp_matches(lower(event), 'fs|\\*|ter')"
    " then 'truncating' when regexp_matches(event, '^[A-Z][0-9]+[A-Z*]$') then 'missense_like' else 'other' end as state,"
    " case when event = 'WT' then 'WT' when regexp_matches(lower(event), 'fs|frameshift') then 'Frameshift'"
    " when contains(lower(event), 'splice') then 'Splice' when regexp_matches(lower(event), '\\*|stop|ter') then 'Nonsense'"
    " when regexp_matches(lower(event), 'del|ins|dup') then 'Indel'"
    " when regexp_matches(lower(event), 'p\\.[a-z][0-9]+[a-z]|^[a-z][0-9]+[a-z]$') then 'Missense_like' else 'Other' end"
    " as label from split_ws) z group by 1, 2",
)
def _(fx):
    e = F.col("event")
    return _exploded(fx, c.split_whitespace(F.col("cell"))).groupBy(
        c.state3(e).alias("state"), c.eda7(e).alias("label")).agg(F.count(F.lit(1)).alias("n"))


# Parts of an event ---------------------------------------------------------------------------


@query(
    "p3_substitution_parts",
    "select ref, alt, count(*) as n, min(position) as min_position, max(position) as max_position from ("
    "select nullif(regexp_extract(event, '^([A-Z*])(-?[0-9]+)([A-Z*])$', 1), '') as ref,"
    " try_cast(nullif(regexp_extract(event, '^([A-Z*])(-?[0-9]+)([A-Z*])$', 2), '') as bigint) as position,"
    " nullif(regexp_extract(event, '^([A-Z*])(-?[0-9]+)([A-Z*])$', 3), '') as alt from pev) z group by 1, 2",
)
def _(fx):
    e = F.col("event")
    return _exploded(fx, c.normalise_cell(F.col("cell"))).select(
        c.substitution_ref(e).alias("ref"), c.substitution_position(e).alias("position"),
        c.substitution_alt(e).alias("alt"),
    ).groupBy("ref", "alt").agg(
        F.count(F.lit(1)).alias("n"), F.min("position").alias("min_position"), F.max("position").alias("max_position"))


@query(
    "p4_p5_positions",
    "select first_integer, leading_position, count(*) as n from (select"
    " try_cast(nullif(regexp_extract(event, '([0-9]+)', 1), '') as bigint) as first_integer,"
    " try_cast(nullif(regexp_extract(event, '^[A-Z*](-?[0-9]+)', 1), '') as bigint) as leading_position from pev) z"
    " group by 1, 2",
)
def _(fx):
    e = F.col("event")
    return _exploded(fx, c.normalise_cell(F.col("cell"))).groupBy(
        c.first_integer(e).alias("first_integer"), c.leading_position(e).alias("leading_position")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p6_position_ranges",
    "select grp, bin, count(*) as n from (select grp, case when p between 1 and 50 then 0 when p between 51 and 100 then 1"
    " when p between 101 and 250 then 2 when p between 251 and 500 then 3 when p between 501 and 1000 then 4"
    " when p >= 1001 then 5 end as bin from (select grp, try_cast(nullif(regexp_extract(event,"
    " '^([A-Z*])(-?[0-9]+)([A-Z*])$', 2), '') as bigint) as p from pev) y) z group by 1, 2",
)
def _(fx):
    return _exploded(fx, c.normalise_cell(F.col("cell"))).groupBy(
        "grp", c.position_range(c.substitution_position(F.col("event"))).alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p6b_position_bins",
    "select one, zero, label, count(*) as n from (select cast(floor((p - 1) / 50.0) as bigint) as one,"
    " cast(floor(p / 50.0) as bigint) as zero, (cast(floor((greatest(p, 1) - 1) / 50.0) as bigint) * 50 + 1) || '_' ||"
    " (cast(floor((greatest(p, 1) - 1) / 50.0) as bigint) * 50 + 50) as label from (select"
    " try_cast(nullif(regexp_extract(event, '^[A-Z*](-?[0-9]+)', 1), '') as bigint) as p from pev) y"
    " where p is not null) z group by 1, 2, 3",
)
def _(fx):
    p = c.leading_position(F.col("event"))
    got = _exploded(fx, c.normalise_cell(F.col("cell"))).select(p.alias("p")).filter(F.col("p").isNotNull())
    return got.groupBy(
        c.position_bin(F.col("p"), "one").alias("one"), c.position_bin(F.col("p"), "zero").alias("zero"),
        c.position_bin(F.col("p"), "label").alias("label"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p7_codon_keys",
    f"select codon, count(*) as n, count(distinct sid) as n_samples from (select sid, case when {_COMPACT6} in"
    f" ('missense', 'nonsense') then gene || '__' || regexp_extract(event, {_SHAPE}, 1) ||"
    f" regexp_extract(event, {_SHAPE}, 2) end as codon from split_ws) z where codon is not null group by 1",
)
def _(fx):
    key = c.codon_key(F.col("gene"), F.col("event")).alias("codon")
    return _exploded(fx, c.split_whitespace(F.col("cell"))).select("sid", key).filter(F.col("codon").isNotNull()).groupBy(
        "codon").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sid").alias("n_samples"))


_LEAD = "try_cast(nullif(regexp_extract(event, '^[A-Z*](-?[0-9]+)', 1), '') as bigint)"
_LABEL = ("(cast(floor((greatest(lead, 1) - 1) / 50.0) as bigint) * 50 + 1) || '_' ||"
          " (cast(floor((greatest(lead, 1) - 1) / 50.0) as bigint) * 50 + 50)")
_AA = "'^[ACDEFGHIKLMNPQRSTVWY]$'"


@query(
    "p8_token_levels",
    f"""with x as (select *, {_LEAD} as lead, regexp_extract(event, '([0-9]+)', 1) as num from typed),
 t as (select sid, 'gene' as level, gene as token from x
 union select sid, 'exact', gene || '__' || event from x
 union select sid, 'gene_type', gene || '__' || event_type from x
 union select sid, 'codon', gene || '__POS' || num from x where num <> ''
 union select sid, 'locus', gene || '__P' || lead from x where lead is not null
 union select sid, 'gene_bin', gene || '__BIN_' || {_LABEL} from x where lead is not null
 union select sid, 'signature', gene || '__' || event_type || '__BIN_' || {_LABEL} from x where lead is not null
 union select sid, 'signature_zero', gene || '__' || event_type || '__b' || cast(floor(cast(num as bigint) / 50.0) as bigint) from x where num <> ''
 union select sid, 'substitution', gene || '__' || ref || '>' || alt from x where regexp_matches(ref, {_AA}) and regexp_matches(alt, {_AA}) and ref <> alt
 union select sid, 'type', 'TYPE__' || event_type from x)
 select level, count(*) as rows, count(distinct token) as tokens, min(token) as first_token, max(token) as last_token from t group by 1""",
)
def _(fx):
    levels = F.array(*[
        F.struct(F.lit(level).alias("level"), c.token(level).alias("token")) for level in c.TOKEN_LEVELS
    ])
    long = fx.typed.select("sid", F.explode(levels).alias("x")).select("sid", "x.level", "x.token")
    return long.filter(F.col("token").isNotNull()).distinct().groupBy("level").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("token").alias("tokens"),
        F.min("token").alias("first_token"), F.max("token").alias("last_token"))


@query(
    "p9_p10_row_profiles",
    "select sid, profile, substr(sha256(profile), 1, 16) as profile_hash from (select sid,"
    " string_agg(gene || '=' || event, '|' order by gene || '=' || event) as profile from events group by 1) z",
)
def _(fx):
    """The profile text is one row of the wide table, written as a string."""
    member = F.concat(F.col("gene"), F.lit("="), F.col("event"))
    text = F.concat_ws("|", F.array_sort(F.collect_set(member))).alias("profile")
    return fx.events.groupBy("sid").agg(text).withColumn("profile_hash", F.substring(F.sha2("profile", 256), 1, 16))


@query(
    "p11_hashed_tokens",
    "select bucket, count(distinct sid) as n_samples from (select sid, ('0x' || substr(md5(token), 1, 8))::bigint % 4096"
    " as bucket from tok_gene_type) z group by 1",
)
def _(fx):
    hashed = fx.tokens("gene_type").select("sid", hash_bucket(F.col("token"), 4096).alias("bucket")).distinct()
    return hashed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_samples"))


@query(
    "p12_amino_pairs",
    f"select ref || '>' || alt as pair, count(*) as n from typed where regexp_matches(ref, {_AA}) and"
    f" regexp_matches(alt, {_AA}) and ref <> alt group by 1",
)
def _(fx):
    pair = c.amino_pair(F.col("ref"), F.col("alt")).alias("pair")
    return fx.typed.select(pair).filter(F.col("pair").isNotNull()).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p13_event_sentences",
    "select 'gene ' || gene || ' type ' || event_type || ' ref ' || coalesce(ref, 'NONE') || ' position ' ||"
    " coalesce(cast(position as varchar), 'NONE') || ' alt ' || coalesce(alt, 'NONE') as sentence, count(*) as n"
    " from typed group by 1",
)
def _(fx):
    text = c.event_sentence(*[F.col(x) for x in ("gene", "event_type", "ref", "position", "alt")])
    return fx.typed.groupBy(text.alias("sentence")).agg(F.count(F.lit(1)).alias("n"))


# Scans and reshaping -------------------------------------------------------------------------


@query(
    "io2_head_per_class",
    "select sid, label from (select *, row_number() over (partition by label order by sid) as rn from samples) z"
    " where rn <= 12",
)
def _(fx):
    return tables.head_per_group(fx.samples, "label", ["sid"], 12)


@query("io2_row_limited_scan", "select c_custkey as sid, c_mktsegment as label from customer order by 1 limit 64")
def _(fx):
    return fx.samples.orderBy("sid").limit(64)


@query(
    "io3_io4_unpivot_wide",
    "select sid, gene, cell from cells",
)
def _(fx):
    wide = fx.wide
    genes = tables.feature_columns(wide, "sid", "label")
    return tables.unpivot_cells(wide, ["sid"], genes).select("sid", "gene", "cell")


@query(
    "io6_json_records",
    "select label, '{\"label\":\"' || label || '\",\"rows\":' || count(*) || ',\"first\":' || min(sid) || '}' as record"
    " from samples group by 1",
)
def _(fx):
    got = fx.samples.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.min("sid").alias("first"))
    return got.select("label", F.to_json(F.struct("label", "rows", "first")).alias("record"))
