from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, bench):
    out = []
    for i, t in docs:
        w, hit, items = words(t), set(), set()
        for item, text in bench:
            b = words(text)
            n = min(len(b), 13)
            for p in range(len(b) - n + 1) if n else ():
                for s in range(len(w) - n + 1):
                    if w[s:s + n] == b[p:p + n]:
                        hit |= set(range(s, s + n))
                        items.add("" if item is None else str(item))
        out.append((i, len(w), len(hit), sorted(items)))
    return sorted(out, key=str)


BENCH = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away from here today"),
    (2, "Short item, five words!"), (3, "solo"), (4, None), (5, "---"), (6, "Six words are in this one"),
    (2, "Short item, five words!"), (None, "a null named item of ten words is a window too"),
    (11, " ".join(f"x{i}" for i in range(40))),
]
DOCS = [
    (1, "Intro. THE QUICK brown fox jumps over the lazy dog and runs far away! from here today. outro"),
    (2, "the quick brown fox jumps over the lazy cat and runs far away from here today"),
    (3, "short item five words short item five words"), (4, None), (5, ""), (6, "solo solo x solo"), (7, "six words are in this one six words are in this"),
    (8, " ".join(f"x{i}" for i in range(5, 30)) + " gap " + " ".join(f"x{i}" for i in range(20, 40))), (None, "a null named item of ten words is a window too"),
    (9, "über " * 50), (1, "another text with the same id solo"), (3, "short item five words short item five words"),
    (10, "x3 " + " ".join(f"x{i}" for i in range(3, 16))),
]


@pytest.mark.parametrize("limit", [500_000, 0])
def test_hits_match_brute_force(spark, limit):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("g", "item", "spans", "_th", "cur", "need")})
    bench = spark.createDataFrame(BENCH, "item_id long, text string").withColumn("block", F.lit("x"))
    got = decontaminate.find_windows(docs, bench, broadcast_rows=limit).collect()
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got], key=str) == brute(DOCS, BENCH)


def test_documents_and_spans_go(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("g", F.lit(1))
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    bad = {(i, t) for (i, t), (_, n, h, _) in zip(sorted(DOCS, key=str), [brute([d], BENCH)[0] for d in sorted(DOCS, key=str)]) if h and 20 * h >= n}
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted([(r["doc_id"], r["text"]) for r in kept.collect()], key=str) == sorted([d for d in DOCS if d not in bad], key=str)
    cut = decontaminate.cut_spans(docs, bench)
    assert cut.count() == len(DOCS)
    assert all(h == 0 for _, _, h, _ in brute([(r["doc_id"], r["text"]) for r in cut.filter("doc_id in (1, 8, 10)").collect()], BENCH))


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert decontaminate.find_windows(empty, bench).count() == 0
    found = decontaminate.find_windows(docs, none).collect()
    assert len(found) == len(DOCS) and all(r["n_hit"] == 0 for r in found)
    assert decontaminate.drop_contaminated(docs, none).count() == len(DOCS)
