import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from glyphmill.operators import similarity as si


def random_sets(seed=1, n=60):
    rng = random.Random(seed)
    sets = {}
    for i in range(n):
        sets[i] = set(rng.sample(range(40), rng.randint(1, 12)))
    for i in range(n, n + 15):  # near copies and exact copies
        base = set(sets[i - n])
        if i % 2:
            base ^= {rng.randrange(40)}
        sets[i] = base or {1}
    return sets


def frame(spark, sets):
    return spark.createDataFrame([(i, f"m{x:02d}") for i, s in sets.items() for x in s], "id long, member string")


def cosine(a, b):
    return len(a & b) / np.sqrt(len(a) * len(b))


def test_similar_pairs_are_complete(spark):
    sets = random_sets()
    ordered = si.ordered_members(frame(spark, sets))
    for t in (0.9, 0.6):
        got = {(r.a, r.b) for r in si.similar_pairs(ordered, t).collect()}
        want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if cosine(sets[a], sets[b]) >= t - 1e-12}
        assert got == want


def test_nearest_profiles(spark):
    sets = random_sets(2, 40)
    got = {r.id: r for r in si.nearest_profiles(frame(spark, sets), (0.8,)).collect()}
    for i, s in sets.items():
        best = max(cosine(s, o) for j, o in sets.items() if j != i)
        if best == 0:
            assert got[i].neighbour is None
        else:
            assert abs(got[i].cosine - best) < 1e-9
            other = sets[got[i].neighbour]
            assert abs(got[i].jaccard - len(s & other) / len(s | other)) < 1e-9


def test_correlated_tokens_both_signs(spark):
    rng = np.random.default_rng(3)
    n = 80
    base = rng.random((n, 12)) < 0.5
    base[:, 6] = base[:, 0]
    base[:, 7] = ~base[:, 1]
    base[:, 8] = base[:, 2] ^ (np.arange(n) % 29 == 0)
    base[:, 9] = np.arange(n) < 5
    base[:, 10] = ~base[:, 9]
    tokens = spark.createDataFrame([(int(i), f"c{j:02d}") for i, j in zip(*np.nonzero(base))], "sid long, token string")
    got = {(r.a, r.b): r.phi for r in si.correlated_tokens(tokens, n, 0.85).collect()}
    corr = np.corrcoef(base.T.astype(float))
    want = {(f"c{i:02d}", f"c{j:02d}"): corr[i, j] for i, j in itertools.combinations(range(12), 2) if abs(corr[i, j]) >= 0.85}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    kept = {r.id for r in si.keep_earlier(tokens.select(F.col("token").alias("id")), si.correlated_tokens(tokens, n, 0.85)).collect() if r.kept}
    expected = []
    for name in sorted({f"c{j:02d}" for j in range(12)}):
        if not any((e, name) in want for e in expected):
            expected.append(name)
    assert kept == set(expected)


def test_components_of_a_chain(spark):
    nodes = spark.range(40)
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 35)], "a long, b long")
    got = {r.id: r.component for r in si.connected_components(nodes, edges).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[35] == 30 and got[25] == 25


def test_groups_and_folds(spark):
    sets = random_sets(4, 30)
    groups = si.duplicate_groups(frame(spark, sets), 0.9)
    got = {r.id: r.component for r in groups.collect()}
    for a, b in itertools.combinations(sets, 2):
        if sets[a] == sets[b]:
            assert got[a] == got[b]
    samples = spark.createDataFrame([(i, "AB"[i % 2]) for i in sets], "sid long, label string")
    folds = si.grouped_folds(groups.withColumnRenamed("id", "sid"), samples)
    assert folds.groupBy("component").agg(F.count_distinct("fold").alias("k")).filter("k > 1").count() == 0


def test_confusion_groups():
    pairs = [("a", "b", 9), ("c", "d", 5), ("a", "c", 1)]
    assert si.confusion_groups(pairs, list("abcde"), 3) == [("a", "b"), ("c", "d"), ("e",)]
    assert si.disjoint_pairs([("a", "b", 3), ("b", "c", 2), ("c", "d", 1)], 2) == [("a", "b", 3), ("c", "d", 1)]


def clusters(seed, groups, members, base=60, noise=6, words=4000):
    """Near-equal sets: each of a cluster's sets is the cluster's base and a few words of its own."""
    rng = random.Random(seed)
    sets, i = {}, 0
    for g in range(groups):
        core = {f"b{g}_{j}" for j in range(base)}
        for _ in range(members):
            sets[i] = core | {f"n{rng.randrange(words)}" for _ in range(rng.randint(1, noise))}
            i += 1
    return sets


def nearest_by_hand(sets, least=0.0):
    out = {}
    for i, s in sets.items():
        best = min(((-round(cosine(s, o), 12), j) for j, o in sets.items() if j != i and s & o), default=None)
        if best and -best[0] >= round(least, 12):
            out[i] = (-best[0], best[1])
    return out


def words_frame(spark, sets):
    return spark.createDataFrame([(i, str(x)) for i, s in sets.items() for x in s], "id long, member string")


def test_nearest_partners_match_brute_force(spark):
    for sets in (clusters(1, 3, 40), random_sets(5, 70), clusters(2, 1, 60, base=12, noise=8, words=40), {1: {"a"}, 2: {"a"}, 3: {"b"}, 4: {"a", "b"}, 5: {"z"}}):
        for least in (0.0, 0.9):
            got = {r.a: (r.best, r.partner) for r in si.nearest_partners(si.ordered_members(words_frame(spark, sets)), least).collect()}
            want = nearest_by_hand(sets, least)
            assert got.keys() == want.keys()
            for i in want:
                assert abs(got[i][0] - want[i][0]) < 1e-9 and got[i][1] == want[i][1], (i, got[i], want[i])


def test_work_in_a_cluster_is_linear_in_its_size(spark, monkeypatch):
    """Pairs that are counted exactly, in clusters of near-equal sets: a fixed number per set, whatever the cluster's size."""
    counted, original = [], si._count_common

    def watched(pairs, ordered):
        pairs = si.cut_lineage(pairs)
        counted.append(pairs.count())
        return original(pairs, ordered)

    monkeypatch.setattr(si, "_count_common", watched)
    per_set = []
    for members in (50, 200, 800):
        counted.clear()
        sets = clusters(3, 1, members, words=members * 40)
        assert si.nearest_partners(si.ordered_members(words_frame(spark, sets)), 0.9).count() == members
        per_set.append(sum(counted) / members)
    assert max(per_set) < 6 and per_set[2] < 1.5 * per_set[0] + 1


def test_large_sets_are_numbered_in_cells(spark, monkeypatch):
    sets = {0: set(range(500)), 1: set(range(0, 500, 2)), 2: set(range(0, 500, 5)), 3: {1, 2, 3}}
    table = words_frame(spark, sets)
    whole = {(r.id, r.member): (r.size, r.place) for r in si.ordered_members(table).collect()}
    monkeypatch.setattr(si, "CELL_ROWS", 50)
    assert {(r.id, r.member): (r.size, r.place) for r in si.ordered_members(table).collect()} == whole
    for i, s in sets.items():
        assert sorted(p for (j, _), (_, p) in whole.items() if j == i) == list(range(1, len(s) + 1))


def greedy(ids, edges, block=None):
    kept = []
    near = {i: {b if a == i else a for a, b in edges if i in (a, b)} for i in ids}
    for i in sorted(ids):
        if not any(j in near[i] and (block is None or block[i] == block[j]) for j in kept):
            kept.append(i)
    return set(kept)


def test_pruning_walks_components(spark, monkeypatch):
    rng = random.Random(8)
    ids = [f"c{i:04d}" for i in range(420)]
    edges = [(ids[i], ids[i + 1]) for i in range(300)] + [(ids[rng.randrange(305, 420)], ids[rng.randrange(305, 420)]) for _ in range(200)]
    edges = [(a, b) for a, b in edges if a != b]
    block = {i: rng.randrange(3) for i in ids}
    nodes, links = spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(edges, "a string, b string")
    blocks = spark.createDataFrame(list(block.items()), "id string, block int")
    rounds, original = [], si.cut_lineage
    monkeypatch.setattr(si, "cut_lineage", lambda df: rounds.append(1) or original(df))
    assert {r.id for r in si.keep_earlier(nodes, links).collect() if r.kept} == greedy(ids, edges)
    assert len(rounds) <= 20  # a chain of 300
    assert {r.id for r in si.keep_earlier(nodes, links, blocks).collect() if r.kept} == greedy(ids, edges, block)
    monkeypatch.setattr(si, "WALKED", 30)  # the random part is one component and goes by rounds
    free = [(a, b) for a, b in edges if min(a, b) > ids[304]]
    assert {r.id for r in si.keep_earlier(nodes, links.filter(F.least("a", "b") > ids[304])).collect() if r.kept} == greedy(ids, free)
    assert {r.id for r in si.keep_earlier(nodes, links.limit(0)).collect() if r.kept} == set(ids)


def test_balanced_folds_keep_groups_and_balance_labels(spark):
    rng = random.Random(2)
    rows, groups, i = [], [], 0
    for g in range(400):
        for _ in range(2000 if g == 0 else rng.choice([1, 1, 2, 3, 20])):
            rows.append((i, "ABC"[(g + rng.randrange(2)) % 3]))
            groups.append((i, g))
            i += 1
    n = len(rows)
    assert 2000 > n / 3
    got = si.balanced_grouped_folds(spark.createDataFrame(groups, "sid long, component long"), spark.createDataFrame(rows, "sid long, label string"))
    assert got.count() == n and got.groupBy("component").agg(F.count_distinct("fold").alias("k")).filter("k > 1").count() == 0
    sizes = {r["fold"]: r["count"] for r in got.groupBy("fold").count().collect()}
    assert len(sizes) == 5 and max(sizes.values()) <= max(2000, 1.05 * n / 5)
    rest = got.filter("component <> 0").groupBy("fold", "label").count().collect()
    free = [f for f in sizes if sizes[f] != max(sizes.values())]
    for label in "ABC":
        own = [r["count"] for r in rest if r["label"] == label and r["fold"] in free]
        assert max(own) <= 1.15 * min(own), (label, own)


def test_units_are_dealt_as_a_plain_search_would():
    rng = random.Random(4)
    rows = [(f"u{u}", label, rng.randint(1, 30)) for u in range(60) for label in "AB" if rng.random() < 0.8]
    got = si._deal_units(rows, 4)
    total = {x: sum(n for _, label, n in rows if x in (label, "*")) or sum(n for *_, n in rows) for x in "AB"}
    every = sum(n for *_, n in rows)
    share = {}
    for u, label, n in rows:
        own = share.setdefault(u, {"A": 0.0, "B": 0.0, "*": 0.0})
        own[label] += n / total[label] * 4
        own["*"] += n / every * 4
    held, want = [{"A": 0.0, "B": 0.0, "*": 0.0} for _ in range(4)], {}
    for u in sorted(share, key=lambda u: (-max(share[u].values()), u)):
        cost = [round(sum((h[x] + share[u][x]) ** 2 - h[x] ** 2 for x in h), 9) for h in held]
        room = [h["*"] + share[u]["*"] <= 1.02 for h in held]
        cost = [c if r else float("inf") for c, r in zip(cost, room)] if any(room) else [round(h["*"], 9) for h in held]
        want[u] = cost.index(min(cost))
        for x in share[u]:
            held[want[u]][x] += share[u][x]
    assert got == want


def test_overlaps_of_packed_sets(spark, monkeypatch):
    """Sets in one and in several rows, a repeated member, members and ids that are null."""
    monkeypatch.setattr(si, "CELL_ROWS", 40)
    sets = {0: set(range(300)), 1: set(range(0, 300, 2)), 2: set(range(0, 300, 7)), 3: {1, 2, 3}, 4: {2, 3, 999}, 5: {777}}
    rows = [(i, str(x)) for i, s in sets.items() for x in s] + [(3, "2"), (5, None)] + [(None, str(x)) for x in range(100)]
    packed = si.packed_sets(spark.createDataFrame(rows, "id long, member string"))
    held = {r["id"]: (r["size"], r["parts"]) for r in packed.groupBy("id", "size").agg(F.count(F.lit(1)).alias("parts")).collect()}
    assert {i: size for i, (size, _) in held.items()} == {0: 300, 1: 150, 2: 43, 3: 4, 4: 3, 5: 2, None: 100}
    assert held[0][1] > held[1][1] > 1 and held[None][1] > 1 and held[3][1] == 1
    pairs = [(a, b) for a in sets for b in sets if a < b]
    size = {i: held[i][0] for i in sets}
    frame_of = spark.createDataFrame([(a, b, size[a], size[b]) for a, b in pairs], "a long, b long, size_a long, size_b long")
    got = {(r["a"], r["b"]): r["common"] for r in si._count_common(frame_of, packed).collect()}
    copies = lambda a, b: sum(1 + (x == 2 and 3 in (a, b)) for x in sets[a] & sets[b])
    assert got == {(a, b): copies(a, b) for a, b in pairs if copies(a, b)}


def test_sets_move_packed(spark):
    """A checkpointed set takes one row, and only members that a partner of the wanted cosine could share are looked up."""
    packed = si.packed_sets(words_frame(spark, clusters(6, 2, 30)))
    assert packed.count() == 60
    looked, original = [], si.salted_join
    try:
        si.salted_join = lambda left, *rest: looked.append(left) or original(left, *rest)
        assert si.nearest_partners(packed, 0.9).count() == 60
    finally:
        si.salted_join = original
    assert looked[0].count() < 0.3 * si._members(packed).count()
