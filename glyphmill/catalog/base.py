"""Registry of queries with their engine-neutral SQL twins."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphmill.functions.cells import ATOMIC
from glyphmill.sources.fixtures import CELL, NOTATION, Fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(fixtures) -> DataFrame`` under a name, with its SQL twin."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Fixtures(spark, folder))
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn

    return wrap


def r6(expression: str) -> str:
    """Six decimals, without a negative zero."""
    return f"(round({expression}, 6) + 0.0)"


_L = "substr('ACDEFGHIKLMNPQRSTVWY', cast({} % 20 as int) + 1, 1)"
TYPE7 = """case when contains({e}, 'FS') then 'FRAMESHIFT'
 when regexp_matches({e}, 'SPLICE|IVS|[+-][0-9]+') then 'SPLICE'
 when regexp_matches({e}, 'DEL|INS|DUP') then 'INFRAME_INDEL'
 when contains({e}, '*') or ends_with({e}, 'X') then 'NONSENSE'
 when regexp_matches({e}, '^[A-Z*]-?[0-9]+[A-Z*]$') and left({e}, 1) = right({e}, 1) then 'SYNONYMOUS'
 when regexp_matches({e}, '^[A-Z*]-?[0-9]+[A-Z*]$') then 'MISSENSE' else 'OTHER' end"""
_SUB = "'^([A-Z*])(-?[0-9]+)([A-Z*])$'"
_FOLD = (
    "select *, cast((row_number() over (partition by label order by md5('{seed}:' || sid)) - 1) % {k} as int)"
    " as fold from samples"
)


def _weights(signal: int) -> str:
    return (
        "1 + ('0x' || substr(md5(variant || ':' || sid || ':' || cls), 1, 8))::bigint % 1000"
        f" + case when label = cls then {signal} else 0 end"
    )


def _prob(variants: list[str], signal: int) -> str:
    names = ", ".join(f"'{v}'" for v in variants)
    return (
        "select sid, label, variant, cls, w / sum(w) over (partition by sid, variant) as p from ("
        f" select sid, label, variant, cls, cast({_weights(signal)} as double) as w from samples,"
        f" (select unnest([{names}]) as variant) v, classes) z"
    )


CTES: dict[str, str] = {
    "samples": "select c_custkey as sid, c_mktsegment as label from customer",
    "classes": "select distinct label as cls from samples",
    "csize": "select label as cls, count(*) as cls_n from samples group by 1",
    "ntot": "select count(*) as n from samples",
    "events": (
        "select distinct o_custkey as sid, p_brand as gene, concat("
        + _L.format("l_partkey") + ", cast(l_partkey % 1500 + 1 as varchar),"
        " case when l_linenumber = 7 then 'FS' when l_linenumber = 6 then '*' else "
        + _L.format("l_suppkey") + " end) as event"
        " from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey"
    ),
    "typed": (
        "select *, " + TYPE7.format(e="event") + " as event_type,"
        f" nullif(regexp_extract(event, {_SUB}, 1), '') as ref,"
        f" try_cast(nullif(regexp_extract(event, {_SUB}, 2), '') as bigint) as position,"
        f" nullif(regexp_extract(event, {_SUB}, 3), '') as alt from events"
    ),
    "tok_gene": "select distinct sid, gene as token from events",
    "tok_gene_type": "select distinct sid, gene || '__' || event_type as token from typed",
    "tok_exact": "select distinct sid, gene || '__' || event as token from events",
    "tok_codon": (
        "select distinct sid, gene || '__POS' || regexp_extract(event, '([0-9]+)', 1) as token from events"
    ),
    "cells": (
        "select sid, gene, case when sid % 7 = 0 then lower(cell) when sid % 7 = 1 then 'p.' || cell else cell end"
        " as cell from (select sid, gene, string_agg(event, ';' order by event) as cell from events group by 1, 2) z"
    ),
    "raw_base": (
        "select l_orderkey, l_partkey, l_suppkey, l_linenumber, " + _L.format("l_partkey") + " as a, "
        + _L.format("l_suppkey") + " as b, cast(l_partkey % 1500 + 1 as varchar) as p from lineitem"
    ),
    "raw_named": f"select *, {NOTATION} as n from raw_base",
    "raw_cells": (
        f"select l_orderkey as sid, l_linenumber as line, concat('G', l_partkey % 40) as gene, {CELL} as cell,"
        " n as notation, l_partkey % 5 as grp from raw_named"
    ),
    "parsed0": (
        "select *, case when cell is null or upper(trim(cell)) in ('', 'WT') then []::varchar[] else"
        " list_transform(list_filter(string_split_regex(regexp_replace(upper(trim(cell)), '[;,|]+', ' ', 'g'),"
        " '\\s+'), lambda x: x <> ''), lambda x: regexp_replace(x, '^P\\.', '')) end as lst from raw_cells"
    ),
    "parsed": (
        "select sid, line, gene, cell, notation, grp,"
        " list_filter(lst, lambda x, i: list_position(lst, x) = i) as events from parsed0"
    ),
    "pev": "select sid, line, gene, grp, unnest(events) as event from parsed",
    "split_ws": (
        "select sid, line, gene, grp, unnest(case when cell is null or trim(cell) in ('', 'WT') then []::varchar[] else"
        " list_filter(string_split_regex(trim(cell), '\\s+'), lambda x: x <> '') end) as event from raw_cells"
    ),
    "seg0": (
        "select sid, line, gene, grp, cell, case when cell is null or upper(trim(cell)) in ('', 'WT', 'NAN')"
        " then []::varchar[] else list_transform(string_split_regex(trim(cell), '\\s*[;|/,]\\s*'),"
        " lambda x: trim(x)) end as segs from raw_cells"
    ),
    "seg1": (
        "select sid, line, gene, grp, cell, flatten(list_transform(segs, lambda s:"
        f" case when len(regexp_extract_all(s, '{ATOMIC}', 0)) >= 2 and trim(regexp_replace(s, '{ATOMIC}', '', 'g'))"
        f" = '' then regexp_extract_all(s, '{ATOMIC}', 0) else [s] end)) as lst from seg0"
    ),
    "segs": (
        "select sid, line, gene, grp, cell, list_filter(lst, lambda x, i: x <> '' and upper(x) not in ('WT', 'NAN')"
        " and list_position(lst, x) = i) as events from seg1"
    ),
    "sev": "select sid, line, gene, grp, unnest(events) as event from segs",
    "folds": _FOLD.format(seed=42, k=5),
    "folds3": _FOLD.format(seed=42, k=3),
    "pr1": _prob(["a"], 0),
    "pr2": _prob(["a", "b"], 400),
    "pr3": _prob(["a", "b", "c"], 400),
    "prs": _prob(["a1", "b1", "a2", "b2", "a3", "b3"], 400),
    "pv": (
        "select sid, label, cls, max(p) filter (variant = 'a') as pa, max(p) filter (variant = 'b') as pb,"
        " max(p) filter (variant = 'c') as pc from pr3 group by 1, 2, 3"
    ),
    "pvf": "select pv.*, fold from pv join folds using (sid)",
    "pt": (
        "select sid, max(pa) as a1, max(pa) filter (ra = 2) as a2, max(cls) filter (ra = 1) as acls, max(pb) as b1,"
        " max(pb) filter (rb = 2) as b2, max(cls) filter (rb = 1) as bcls from (select *, row_number() over (partition by sid"
        " order by pa desc, cls) as ra, row_number() over (partition by sid order by pb desc, cls) as rb from pv) z group by 1"
    ),
}


def with_ctes(body: str) -> str:
    """Prefix the body with the CTEs it (transitively) names, in definition order."""
    own = set(re.findall(r"([a-z_0-9]+) as (?:materialized )?\(", body))
    need: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in need and name not in own and re.search(rf"\b{name}\b", text):
                need.add(name)
                visit(CTES[name])

    visit(body)
    parts = [f"{name} as ({CTES[name]})" for name in CTES if name in need]
    stripped = body.strip()
    if not parts:
        return stripped
    head = "with " + ",\n".join(parts)
    if stripped.lower().startswith("with "):
        return head + ",\n" + stripped[5:]
    return head + "\n" + stripped
