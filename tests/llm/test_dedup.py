from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from glyphmill.llm import exact_dedup, near_dedup

WHITE = re.compile(r"[\x20\x09-\x0D]")


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[WHITE.sub("", t or "")].append((i, t or ""))
    out = []
    for i, t in rows:
        g = groups[WHITE.sub("", t or "")]
        best = min(g, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))[0]
        out.append((i, best, len(g), i == best))
    return sorted(out, key=str)


@pytest.mark.parametrize("slot_bits", [2, 24])
def test_exact_groups_match_brute_force(messy, slot_bits):
    got = exact_dedup.refine(messy, slot_bits=slot_bits).collect()
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got], key=str) == exact_brute(rows)


def test_exact_drop_keeps_one_row_of_each_text_and_all_columns(messy):
    kept = exact_dedup.drop_copies(messy)
    assert kept.columns == messy.columns
    bare = [WHITE.sub("", r["text"] or "") for r in kept.collect()]
    assert len(bare) == len(set(bare))
    assert set(bare) == {WHITE.sub("", r["text"] or "") for r in messy.collect()}


def test_empty_tables(empty):
    assert exact_dedup.refine(empty).count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0
    assert near_dedup.groups(empty).count() == 0
    assert near_dedup.drop_near_copies(empty).count() == 0


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    if not words:
        return set()
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))}


def components(sets, percent):
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_groups_of_documents_match_brute_force(documents, texts):
    sets = {i: shingles(t, 3) for i, t in texts.items()}
    want = components(sets, 85)
    got = {r["doc_id"]: r for r in near_dedup.groups(documents, k=3, percent=85).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())


def test_a_spread_cluster_is_linked_as_brute_force_links_it(spark):
    """Copies with ever more edits: some pairs are linked, some only through others, some not at all."""
    rng = np.random.default_rng(5)
    rows = []
    for g in range(3):
        base = rng.integers(0, 5000, 120)
        for i in range(40):
            words = base.copy()
            words[rng.choice(120, rng.integers(0, 6), replace=False)] = rng.integers(5000, 9000)
            rows.append((g * 100 + i, " ".join(map(str, words))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = components({i: shingles(t, 3) for i, t in rows}, 85)
    for m in (near_dedup.REGISTERS,):
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.groups(df, k=3, percent=85, m=m).collect()}
        assert got == want
    assert 3 < len(set(want.values())) < 100


def test_near_handles_nulls_repeats_and_clashing_names(messy):
    rows = near_dedup.groups(messy, k=3, percent=85).collect()
    assert len(rows) == messy.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert [by[i]["component_id"] for i in (1, 2, 3, 4, 5, 8, 9, 10)] == [1, 1, 3, 4, 5, 8, 8, 10]
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    kept = near_dedup.drop_near_copies(messy, k=3, percent=85)
    assert kept.columns == messy.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 7, 8, 10]


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 2**63, 900).astype(np.uint64)) for _ in range(2))
    ra, rb, rab = near_dedup.registers([a, b, np.union1d(a, b)])
    assert (np.maximum(ra, rb) == rab).all()
    shared = np.union1d(a[:300], b)
    x, y = near_dedup.registers([shared, b], 4096)
    ok, est = near_dedup.passes(x[None], y[None], np.array([1200.0]), np.array([900.0]), 0.7)
    assert ok[0] and abs(est[0] - 0.75) < 0.04
    assert not near_dedup.passes(x[None], y[None], np.array([1200.0]), np.array([900.0]), 0.95)[0][0]


def test_band_rows_keep_the_promised_recall():
    for t in (0.8, 0.85, 0.9):
        r = near_dedup.band_rows(near_dedup.REGISTERS, t)
        assert (1 - t**r) ** (near_dedup.REGISTERS // r) <= 1e-6


def test_shingle_sets_follow_the_word_rule():
    texts = pa.array(["A b  c\x0bd", "a B c d", "", " ", "one two", "ONE\ttwo", "x\x1cy z q"])
    s = near_dedup.shingle_sets(texts, 3)
    assert (s[0] == s[1]).all() and len(s[0]) == 2 and len(s[2]) == len(s[3]) == 0
    assert (s[4] == s[5]).all() and len(s[4]) == 1 and len(s[6]) == 1


def test_columns_named_like_the_filter_stay_as_they_are(spark):
    from pyspark.sql import functions as F

    from glyphmill.llm.base import drop_rows

    names = ["_gm_in", "_GM_k0", "_gm_slot", "_gm_row", "_gm_map"]
    docs = spark.range(4).withColumns({c: F.lit("own") for c in names})
    got = drop_rows(docs, {"id": F.col("id")}, spark.range(1), once=spark.range(1, 2))
    assert sorted(tuple(r) for r in got.collect()) == [(i, *["own"] * 5) for i in (1, 2, 3)]
