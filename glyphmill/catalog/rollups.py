"""Per-sample roll-ups."""
from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.catalog.base import query, r6
from glyphmill.functions.cells import EVENT_TYPES, state3
from glyphmill.operators import rollups as ru

_TC = ", ".join(f"count(*) filter (event_type = '{k}') as n_{k.lower()}" for k in EVENT_TYPES)
_SUMS = ", ".join(f"cast(sum(n_{k.lower()}) as bigint) as n_{k.lower()}" for k in EVENT_TYPES)
_TN = [f"n_{k.lower()}" for k in EVENT_TYPES]
_TRUNC = "(n_nonsense + n_frameshift + n_splice)"
_HERE = " + ".join(f"(case when {c} > 0 then 1 else 0 end)" for c in _TN)
_BASE = f"""with g as (select sid, gene, count(*) as n_events, {_TC} from typed group by 1, 2),
 r as (select sid, count(*) as mutated_genes, cast(sum(n_events) as bigint) as events,
  count(*) filter (n_events > 1) as multi_event_genes, {_SUMS},
  count(*) filter ({_TRUNC} > 0) as truncating_genes, cast(sum({_TRUNC}) as bigint) as truncating_events,
  count(*) filter (n_events = 1) as one_event_genes, count(*) filter (n_events = 2) as two_event_genes,
  count(*) filter (n_events >= 3) as three_plus_genes, count(*) filter ({_HERE} >= 2) as multi_type_genes,
  max(n_events) as max_events from g group by 1),
 p as (select s.sid, {", ".join(f"coalesce({c}, 0) as {c}" for c in [
     "mutated_genes", "events", "multi_event_genes", *_TN, "truncating_genes", "truncating_events", "one_event_genes",
     "two_event_genes", "three_plus_genes", "multi_type_genes", "max_events"])}
  from samples s left join r on s.sid = r.sid)
"""
_SHARE = [f"coalesce({c} / nullif(cast(events as double), 0), 0)" for c in _TN]
_ENTROPY = " + ".join(f"(case when {s} > 0 then -{s} * ln({s}) else 0 end)" for s in _SHARE)


def _profile(fx):
    return ru.sample_profile(fx.typed, fx.samples)


@query("flagship_burden_and_types", _BASE + f"select sid, mutated_genes, events, multi_event_genes, {', '.join(_TN)} from p")
def _(fx):
    return _profile(fx).select("sid", *ru.BURDEN, *ru.TYPE_COUNTS)


@query("a1_gene_presence", "select gene, count(distinct sid) as n_samples from events group by 1")
def _(fx):
    return ru.gene_presence(fx.events).groupBy("gene").agg(F.count(F.lit(1)).alias("n_samples"))


@query(
    "a2_truncating_presence",
    "select distinct sid, gene from typed where event_type in ('NONSENSE', 'FRAMESHIFT', 'SPLICE')",
)
def _(fx):
    return ru.truncating_presence(fx.typed)


@query("a3_burden", _BASE + "select sid, mutated_genes, events, multi_event_genes from p")
def _(fx):
    return _profile(fx).select("sid", *ru.BURDEN)


@query("a4_event_type_counts", _BASE + f"select sid, {', '.join(_TN)} from p")
def _(fx):
    return _profile(fx).select("sid", *ru.TYPE_COUNTS)


@query("a5_event_type_shares", _BASE + "select sid, " + ", ".join(
    f"{r6(s)} as share_{c[2:]}" for s, c in zip(_SHARE, _TN)) + " from p")
def _(fx):
    shares = ru.type_shares(_profile(fx))
    return shares.select("sid", *[F.round(c, 6).alias(c) for c in shares.columns[1:]])


@query("a6_truncating_counts", _BASE + "select sid, truncating_genes, truncating_events from p")
def _(fx):
    return _profile(fx).select("sid", "truncating_genes", "truncating_events")


@query(
    "a7_letter_counts",
    """with s as (select * from typed where ref is not null and alt is not null and position is not null),
 k as (select sid, 'ref' as kind, ref as key from s where ref <> '*' union all select sid, 'alt', alt from s where
 regexp_matches(alt, '^[ACDEFGHIKLMNPQRSTVWY]$') union all select sid, 'pair', ref || '>' || alt from s where ref <> alt
 and regexp_matches(ref || alt, '^[ACDEFGHIKLMNPQRSTVWY]+$') union all select sid, 'range', case
 when position between 1 and 50 then '0' when position between 51 and 100 then '1' when position between 101 and 250 then '2'
 when position between 251 and 500 then '3' when position between 501 and 1000 then '4' when position > 1000 then '5' end from s)
 select sid, kind, key, count(*) as n from k where key is not null group by 1, 2, 3""",
)
def _(fx):
    return ru.letter_counts(fx.typed)


_TOPO = ["one_event_genes", "two_event_genes", "three_plus_genes", "multi_type_genes", "max_events"]


@query(
    "a8_topology",
    _BASE + f"select sid, {', '.join(_TOPO)}, cast({_HERE} as bigint) as type_diversity, {r6(_ENTROPY)} as type_entropy,"
    f" {r6('greatest(' + ', '.join(_SHARE) + ')')} as dominant_share from p",
)
def _(fx):
    return _profile(fx).select(
        "sid", *_TOPO, "type_diversity", F.round("type_entropy", 6).alias("type_entropy"),
        F.round("dominant_share", 6).alias("dominant_share"))


@query(
    "a8b_topology_variants",
    _BASE + """, q as (select sid, count(*) as np, avg(v) as m, sqrt(greatest(sum(v * v) / count(*) - avg(v) * avg(v), 0))
 as sd from (select sid, cast(regexp_extract(event, '([0-9]+)', 1) as double) as v from typed) z group by 1)
 select p.sid, events, mutated_genes as genes, cast(""" + _HERE + f""" as bigint) as types,
 greatest({', '.join(_TN)}) as max_type, {r6('greatest(' + ', '.join(_SHARE) + ')')} as max_type_share,
 round(coalesce(m, 0), 4) as mean_position, round(coalesce(sd, 0), 4) as std_position, coalesce(np, 0) as positions
 from p left join q on p.sid = q.sid""",
)
def _(fx):
    got = ru.position_topology(fx.typed, fx.samples)
    return got.withColumns({
        "max_type_share": F.round("max_type_share", 6),
        "mean_position": F.round("mean_position", 4),
        "std_position": F.round("std_position", 4),
    })


@query(
    "a9_profile_ratios",
    _BASE + "select sid, " + ", ".join(
        f"{r6(f'coalesce({a} / nullif(cast(mutated_genes as double), 0), 0)')} as {b}" for a, b in (
            ("events", "events_per_gene"), ("multi_event_genes", "multi_event_share"),
            ("truncating_genes", "truncating_share"))) + " from p",
)
def _(fx):
    got = ru.profile_ratios(_profile(fx))
    return got.select("sid", *[F.round(c, 6).alias(c) for c in got.columns[1:]])


@query(
    "a10_log1p_counts",
    _BASE + "select sid, " + ", ".join(f"{r6(f'ln(1 + {c})')} as log_{c}" for c in
                                       ["mutated_genes", "events", "multi_event_genes", *_TN]) + " from p",
)
def _(fx):
    got = ru.log1p_counts(_profile(fx), [*ru.BURDEN, *ru.TYPE_COUNTS])
    return got.select("sid", *[F.round(c, 6).alias(c) for c in got.columns[1:]])


_BIN_SQL = ", ".join(
    f"cast({c} between {lo} and {hi} as int) as {c}_{lab}" for c in ["mutated_genes", "events", "multi_event_genes"]
    for lo, hi, lab in ((0, 0, "0"), (1, 1, "1"), (2, 2, "2"), (3, 4, "3_4"), (5, 7, "5_7"), (8, 10**15, "8_plus")))


@query("a11_count_bins", _BASE + f"select sid, {_BIN_SQL} from p")
def _(fx):
    return ru.count_bins(_profile(fx), ru.BURDEN, with_zero=True)


_ARCH = """select sid, gene, count(*) as n, count(*) filter (event_type = 'MISSENSE') as mis,
 count(*) filter (event_type in ('NONSENSE', 'FRAMESHIFT', 'SPLICE')) as tr, count(distinct event_type) as ty,
 count(position) as np, count(distinct position) as dp from typed group by 1, 2 having count(*) >= 2"""


@query(
    "a12_architecture_tokens",
    f"""with z as ({_ARCH}), t as (select sid, gene || '__EVENT_COUNT_2PLUS' as token from z
 union all select sid, gene || '__EVENT_COUNT_3PLUS' from z where n >= 3
 union all select sid, gene || '__MULTI_MISSENSE' from z where mis >= 2
 union all select sid, gene || '__MISSENSE_PLUS_TRUNCATING' from z where mis >= 1 and tr >= 1
 union all select sid, gene || '__MULTI_FUNCTIONAL_TYPE' from z where ty >= 2
 union all select sid, gene || '__SAME_POSITION_MULTI_EVENT' from z where np >= 2 and dp < np) select sid, token from t""",
)
def _(fx):
    return ru.architecture_tokens(fx.typed)


@query(
    "a13_multi_event_support",
    """select sid, gene, count(*) as event_count, count(distinct v) < count(v) as same_codon,
 case when count(v) >= 2 then max(v) - min(v) end as position_span from (select sid, gene,
 cast(regexp_extract(event, '([0-9]+)', 1) as bigint) as v from typed) z group by 1, 2 having count(*) >= 2""",
)
def _(fx):
    return ru.multi_event_support(fx.typed)


@query(
    "a14_gene_pairs",
    "select a.token as gene_a, b.token as gene_b, count(*) as n from tok_gene a join tok_gene b on a.sid = b.sid and"
    " a.token < b.token group by 1, 2",
)
def _(fx):
    return ru.gene_pairs(ru.gene_presence(fx.events))


@query(
    "a14_row_pairs",
    "select a.sid, a.token as gene_a, b.token as gene_b from tok_gene a join tok_gene b on a.sid = b.sid and a.token < b.token",
)
def _(fx):
    return ru.row_pairs(ru.gene_presence(fx.events))


@query(
    "a15_domain_features",
    """with h as (select sid, max(cast(gene = 'Brand#1' as int)) as b1, max(cast(gene = 'Brand#2' as int)) as b2,
 max(cast(gene = 'Brand#3' as int)) as b3, max(cast(gene = 'Brand#7' as int)) as b7,
 max(cast(gene = 'Brand#7' and event = 'A101C' as int)) as e0 from events group by 1)
 select s.sid, coalesce(b1 + b2 + b3, 0) as group_core, coalesce(b3 + b7, 0) as group_edge, coalesce(b1 * b7, 0) as pair_0,
 coalesce(e0, 0) as exact_0 from samples s left join h on s.sid = h.sid""",
)
def _(fx):
    return ru.domain_features(
        fx.events, fx.samples,
        groups={"core": ["Brand#1", "Brand#2", "Brand#3"], "edge": ["Brand#3", "Brand#7"]},
        pairs=[("Brand#1", "Brand#7")], exact=[("Brand#7", "A101C")])


@query(
    "a16_gene_states",
    """with cnt as (select label, gene, count(*) as n from (select distinct sid, gene from events) e join samples using (sid)
 group by 1, 2), sel as (select distinct gene from (select *, row_number() over (partition by label order by n desc, gene)
 as rn from cnt) z where rn <= 2), ins as (select *, regexp_extract(event, '^([A-Z][0-9]+)', 1) as codon from typed where
 gene in (select gene from sel)), ex as (select gene, event, codon, count(*) as n from ins group by 1, 2, 3),
 cod as (select gene, codon from ex where codon <> '' group by 1, 2 having sum(n) >= 5),
 kn as (select ex.gene, ex.event from ex join cod on ex.gene = cod.gene and ex.codon = cod.codon where n >= 5),
 m as (select ins.*, kn.event is not null as known, case when regexp_matches(lower(ins.event), 'fs|\\*|ter') then 'truncating'
 when regexp_matches(ins.event, '^[A-Z][0-9]+[A-Z*]$') then 'missense_like' else 'other' end as st from ins left join kn
 on ins.gene = kn.gene and ins.event = kn.event)
 select sid, gene, max(cast(st = 'missense_like' as int)) as missense_like, max(cast(st = 'truncating' as int)) as truncating,
 max(cast(st = 'other' as int)) as other, max(cast(known as int)) as known_recurrent,
 cast(count(*) >= 2 as int) as multi_hit, 1 - max(cast(known as int)) as other_mutation from m group by 1, 2""",
)
def _(fx):
    return ru.gene_states(fx.typed, fx.samples, state3(F.col("event")))
