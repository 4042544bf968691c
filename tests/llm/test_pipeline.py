from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from glyphmill.llm import quality
from glyphmill.llm.base import read
from tools.check import rows_of

from test_dedup import components, exact_brute, shingles
from test_decontaminate import brute as hits
from test_packing_and_sharding import check_places

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = read(spark, SF, "documents").cache()
    bench = [(r["item_id"], r["text"]) for r in read(spark, SF, "benchmark").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        out = stage(spark, docs, SF).cache()
        rows = out.collect()
        if name == "quality":
            model = quality.fit(docs, read(spark, SF, "labels"))
            want = {r["doc_id"] for r in quality.score(docs, model).collect() if r["accepted"]}
        elif name == "exact_dedup":
            want = {i for i, _, _, kept in exact_brute(list(before.items())) if kept}
        elif name == "near_dedup":
            own = components({i: shingles(t, 5) for i, t in before.items()}, 80)
            want = {i for i, c in own.items() if i == c}
        elif name == "decontamination":
            want = {i for i, n, h, _ in hits(list(before.items()), bench) if not (h and 20 * h >= n)}
        else:
            check_places(rows, 2048)
            assert {r["doc_id"] for r in rows} == set(before)
            break
        assert out.columns == columns
        assert sorted(r["doc_id"] for r in rows) == sorted(want), name
        docs = out
    assert corpus_pipeline.run(spark, SF).count() == len(rows)


def test_every_operator_has_its_query():
    names = entry.queries()
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names


def test_twins_are_sql():
    assert all(isinstance(sql, str) for sql in entry.oracle_sql().values())


def test_stages_on_messy_and_empty_tables(spark, messy, empty):
    """Every stage takes what its predecessor kept of awkward rows; the last one packs each kept row."""
    docs = messy
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == messy.columns, name
        assert not out.exceptAll(docs).count(), name
        docs = out
    rows = docs.count()
    assert 0 < rows < messy.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sum(r["piece"] == 0 for r in packed) == rows
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert not docs.count()


@pytest.mark.parametrize("name", ["op1_near_dedup", "op2_decontaminate", "op3_exact_dedup", "op6_chat_format", "op11_hard_negatives", "op12_lexical"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    rel = con.sql(entry.oracle_sql()[name])
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows_of(rel.columns, rel.fetchall())
