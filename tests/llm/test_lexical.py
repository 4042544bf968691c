from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from glyphmill.llm import lexical


def brute(docs, items, k):
    """Ranked rows by the definition: docs and items are (id, text)."""
    spoken = [(i, Counter(lexical.terms_of(t))) for i, t in docs if lexical.terms_of(t)]
    n, total = len(spoken), sum(sum(c.values()) for _, c in spoken)
    df = Counter(t for _, c in spoken for t in c)
    out = []
    for item, text in items:
        asked = Counter(lexical.terms_of(text))
        scored = []
        for place, (i, c) in enumerate(spoken):
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in asked.items() if t in c)
            if score > 0:
                scored.append((-score, (i is not None, i or 0), place))
        out += [(item, rank + 1, i[1] if i[0] else None, -s) for rank, (s, i, _) in enumerate(sorted(scored)[:k])]
    return out


def got(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def drawn(seed, docs, words=30, longest=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    pick = lambda: vocabulary[min(int(rng.expovariate(0.15)), words - 1)]
    texts = [" ".join(pick() for _ in range(rng.randint(0, longest))) for _ in range(docs)]
    return [(i * 7 % docs, t) for i, t in enumerate(texts)], [(100 + i, " ".join(pick() for _ in range(rng.randint(1, 12)))) for i in range(15)]


@pytest.mark.parametrize("seed,k,parts", [(1, 20, 3), (2, 3, 1), (3, 1, 4), (4, 5, 2), (5, 50, 3)])
def test_results_match_brute_force(spark, seed, k, parts):
    docs, items = drawn(seed, 400)
    own = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), spark.createDataFrame(items, "item_id long, text string"), k)
    assert got(own) == sorted(brute(docs, items, k), key=str)


def test_messy_rows(spark, messy, empty):
    items = spark.createDataFrame([(1, "Alpha beta w3 W3 x"), (1, "Alpha beta w3 W3 x"), (2, None), (3, ""), (4, "?!"), (None, "gamma ünïcode"), (5, "nowhere")], "item_id long, text string")
    docs = [(r["doc_id"], r["text"]) for r in messy.collect()]
    own = lexical.search(messy, items)
    assert own.columns == ["item_id", "rank", "doc_id", "score"]
    assert got(own) == sorted(brute(docs, [tuple(r) for r in items.collect()], 20), key=str)
    assert lexical.search(empty, items).count() == 0
    assert lexical.search(messy, items.limit(0)).count() == 0
    named = spark.createDataFrame([("b", "alpha"), ("a", "alpha"), ("c", "beta")], "doc_id string, text string")
    assert [tuple(r) for r in lexical.search(named, spark.createDataFrame([("q", "alpha")], "item_id string, text string")).orderBy("rank").select("rank", "doc_id").collect()] == [(1, "a"), (2, "b")]


def test_many_goes_give_the_same(spark, monkeypatch):
    docs, items = drawn(8, 120)
    monkeypatch.setattr(lexical, "ITEM_BYTES", 60)
    own = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 4)
    assert got(own) == sorted(brute(docs, items, 4), key=str)


def test_words_of_a_batch():
    import pyarrow as pa

    texts = ["", "Ab1 c", "c", "ñ-x", "x", " ", "y\x00z", "", "É"]
    for array in (pa.array(texts), pa.array(["zz", *texts, "q"]).slice(1, len(texts))):
        words, n = lexical._words(array, *lexical._byte_tables())
        assert words.to_pylist() == [t for x in texts for t in lexical.terms_of(x)] and n.tolist() == [len(lexical.terms_of(x)) for x in texts]


@pytest.mark.parametrize("seed", range(40))
def test_bounds_hold_and_pairs_tighten_them(seed):
    """No document exceeds the bound of any prefix, and joint maxima never make it looser than the terms' own maxima."""
    rng = random.Random(seed)
    terms, docs = 9, 40
    impact = np.array([[rng.choice([0, 0, rng.randint(1, 1000)]) for _ in range(terms)] for _ in range(docs)])
    item = [(t, rng.randint(1, 3)) for t in range(terms)]
    weights = impact.max(axis=0)
    joint = {}
    for a, b in lexical.neighbours(item, weights):
        both = (impact[:, a] > 0) & (impact[:, b] > 0)
        joint[a, b] = int((impact[both, a] + impact[both, b]).max()) if both.any() else 0
    order, bounds = lexical.prefix_bounds(item, weights, joint)
    loose = 0
    for j in range(len(order) + 1):
        most = max(int(sum(impact[d, t] * times for t, times in order[:j])) for d in range(docs))
        assert most <= bounds[j] <= loose
        if j < len(order):
            loose += int(weights[order[j][0]]) * order[j][1]
    assert bounds[-1] < loose


def test_weak_terms_are_left_out_and_scores_stay_whole(spark):
    """With a threshold from the rare terms, documents that have common terms only are never scored in full."""
    import pyarrow as pa

    rng = random.Random(4)
    docs = [" ".join(["common", "usual"] * rng.randint(1, 3) + (["rare", "odd"] if i % 50 == 0 else [])) for i in range(1000)]
    vocabulary = ["common", "odd", "rare", "usual"]
    rows = []
    for i, t in enumerate(docs):
        c = Counter(t.split())
        rows.append((i, sum(c.values()), np.array([(vocabulary.index(w), n) for w, n in sorted(c.items())], "<u4").tobytes()))
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["doc_id", "n", "postings"])
    df = Counter(w for t in docs for w in set(t.split()))
    weights = np.array([math.floor(1000 * math.log(2002 / (2 * df[w] + 1))) for w in vocabulary])
    block = lexical.Block(batch, weights, 1000, sum(r[1] for r in rows))
    item = [(i, 1) for i in range(4)]
    order, bounds = lexical.prefix_bounds(item, block.most, {})
    docs_found, scores, full = lexical.best_of(block, order, bounds, 0, 5)
    assert full == 1000 or full == 20
    _, again, full = lexical.best_of(block, order, bounds, int(scores[-1]), 5)
    assert again.tolist() == scores.tolist() and full <= 20
