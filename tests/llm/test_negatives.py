from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, is_anchor, n_pos=5, n_neg=3, low=50, high=95):
    rows = [(i, label, [int(x) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, label, v in sorted({(i, x, tuple(v)) for i, x, v in rows if is_anchor(i)}):
        scored = sorted((-dot(v, w), i, other) for i, other, w in rows)
        same = [(-s, i) for s, i, other in scored if other == label and i != a][:n_pos]
        for p, i in same:
            hit = [(-s, j) for s, j, other in scored if other != label and low * p <= -100 * s <= high * p][:n_neg]
            out += [(a, i, rank + 1, j, p, s) for rank, (s, j) in enumerate(hit)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def drawn(seed, n=600, dims=6, scale=40, clusters=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, scale, (clusters, dims))
    return [(i, int(rng.integers(0, 4)), [float(round(x)) for x in centres[rng.integers(0, clusters)] + rng.normal(0, scale / 12, dims)]) for i in range(n)]


@pytest.fixture
def small_leaves(monkeypatch):
    monkeypatch.setattr(negatives, "LEAF_ROWS", 20)
    monkeypatch.setattr(negatives, "NODE_SAMPLE", 4)
    monkeypatch.setattr(negatives, "FANOUT", 4)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 16)
    monkeypatch.setattr(negatives, "CHUNK_ROWS", 7)


@pytest.mark.parametrize("seed", range(3))
def test_results_match_brute_force(spark, small_leaves, seed):
    rows = drawn(seed, 300 + 100 * seed)
    own = negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 20 == 0)
    assert got(own) == brute(rows, lambda i: i % 20 == 0)


def test_ties_copies_and_a_rare_label(spark, small_leaves):
    """A third of all rows are one vector; scores tie; one label has a single row; some products are below zero."""
    rng = random.Random(1)
    rows = [(i, i % 3, [3.0, -1.0, 2.0]) for i in range(100)] + [(100 + i, i % 3, [float(rng.randint(-3, 3)) for _ in range(3)]) for i in range(199)] + [(400, 9, [3.0, 3.0, 3.0])]
    own = negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)
    assert got(own) == brute(rows, lambda i: i % 10 == 0)


def test_messy_rows(spark, small_leaves):
    nan, inf = float("nan"), float("inf")
    rows = drawn(5, 60, 3) + [(None, 1, [1.0, 2.0, 3.0]), (70, None, [1.0, 2.0, 3.0]), (80, 1, None), (90, 1, [1.0, None, 3.0]), (100, 1, [nan, 1.0, 1.0]), (110, 2, [inf, 1.0, 1.0]),
                              (120, 1, []), (130, 1, [50.0]), (10, 1, [9.0, 9.0, 9.0]), (11, 2, [9.0, 9.0, 9.0]), (11, 2, [9.0, 9.0, 9.0])]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("leaf", "id", "anchor", "vector", "low", "rows", "targets", "block", "rank", "score")})
    assert got(negatives.mine(table, F.col("vec_id") % 10 == 0)) == brute(rows, lambda i: i % 10 == 0)
    assert negatives.mine(table.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.mine(table, F.lit(False)).count() == 0
    assert negatives.mine(spark.createDataFrame([(1, 1, [])], SCHEMA), F.lit(True)).count() == 0


def test_large_components_stay_exact(spark, small_leaves):
    rows = [(i, i % 2, [float(random.Random(i).randint(-(1 << 29), 1 << 29)) for _ in range(4)]) for i in range(80)]
    assert got(negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 8 == 0)) == brute(rows, lambda i: i % 8 == 0)


def test_tree_leaves_out_subtrees_but_never_a_row_of_the_annulus(small_leaves):
    rows = np.array([v for _, _, v in drawn(7, 2000)])
    tree = negatives.Tree(rows[:500], len(rows), float((rows**2).sum(axis=1).max()))
    shape = (len(tree.points), tree.width, tree.width)
    low, high = np.full(shape, np.inf), np.full(shape, -np.inf)
    lifted = tree.lifted(rows)
    leaf = tree.place(lifted, low, high)
    tree.low, tree.high = low, high
    assert tree.leaves > 50 and len(set(leaf.tolist())) > 30
    anchors = rows[::40]
    query = np.hstack([anchors, np.zeros((len(anchors), 1))])
    scores = np.sort(anchors @ rows.T, axis=1)[:, ::-1]
    distance = lambda s: np.sqrt(np.maximum((anchors**2).sum(axis=1)[:, None] + tree.longest - 2 * s, 0))
    for most, least in ((scores[:, :1], scores[:, 10:11]), (0.95 * scores[:, :1], 0.8 * scores[:, :1])):
        seen = np.zeros((len(anchors), tree.leaves), bool)
        for at, who in tree.visits(query, distance(most), distance(least)):
            seen[who, at] = True
        products = anchors @ rows.T
        for i in range(len(anchors)):
            inside = (products[i] <= most[i, 0]) & (products[i] >= least[i, 0])
            assert seen[i, leaf[inside]].all()
        assert seen.mean() < 0.5
    everywhere = np.zeros((len(anchors), tree.leaves), bool)
    for at, who in tree.visits(query, np.zeros((len(anchors), 1)), np.full((len(anchors), 1), 1e9)):
        everywhere[who, at] = True
    held = sorted(set(leaf.tolist()))
    assert everywhere[:, held].all()
    assert not list(tree.visits(query, np.ones((len(anchors), 1)), np.zeros((len(anchors), 1))))
