from __future__ import annotations

import itertools

import numpy as np

from glyphmill.operators import probs as pr


def macro(truth, pred, classes):
    names = set(truth) | set(pred)
    f = []
    for c in classes:
        if c in names:
            tp = sum(t == c == p for t, p in zip(truth, pred))
            both = sum(t == c for t in truth) + sum(p == c for p in pred)
            f.append(2 * tp / both)
    return sum(f) / len(f)


def predicted(p, classes):
    return [classes[int(np.argmax(np.round(row, 12)))] for row in p]


def blended(base, extra, truth, folds, grid, classes):
    out = base.copy()
    for fold in set(folds):
        rest = [i for i, f in enumerate(folds) if f != fold]
        scores = []
        for w in sorted({0.0, *grid}):
            mix = base * (1 - w) + extra * w
            pred = predicted(mix[rest], classes)
            scores.append((-round(macro([truth[i] for i in rest], pred, classes), 9), w))
        w = min(scores)[1]
        own = [i for i, f in enumerate(folds) if f == fold]
        out[own] = base[own] * (1 - w) + extra[own] * w
    return out


def test_all_orders_match_brute_force(spark):
    rng = np.random.default_rng(5)
    classes, names, n = ["x", "y", "z"], ["base", "m1", "m2", "m3", "m4", "m5"], 90
    truth = [classes[i % 3] for i in range(n)]
    folds = [i % 4 for i in range(n)]
    p = {}
    for name in names:
        raw = rng.random((n, 3)) + 0.35 * np.eye(3)[[classes.index(t) for t in truth]]
        p[name] = raw / raw.sum(axis=1, keepdims=True)
    rows = [(i, truth[i], folds[i], *[p[x][i].tolist() for x in names]) for i in range(n)]
    table = spark.createDataFrame(rows, "sid long, label string, fold int, " + ", ".join(f"{x} array<double>" for x in names))
    grid = [0.1, 0.3, 0.5]
    got = {tuple(r["path"]): r for r in pr.ordered_blends(table, "base", names[1:], grid, classes).collect()}
    score = lambda x: macro(truth, predicted(x, classes), classes)
    start, total = score(p["base"]), {}
    for path in [(a,) for a in names[1:]] + list(itertools.permutations(names[1:], 2)):
        mix = p["base"]
        for x in path:
            mix = blended(mix, p[x], truth, folds, grid, classes)
        total[path] = score(mix) - start
    best = min((path for path in total if len(path) == 2), key=lambda path: (-round(total[path] + start, 9), path))
    for x in names[1:]:
        if x not in best:
            mix = p["base"]
            for y in (*best, x):
                mix = blended(mix, p[y], truth, folds, grid, classes)
            total[(*best, x)] = score(mix) - start
    assert got.keys() == total.keys() and len(got) == 5 + 20 + 3
    for path, gain in total.items():
        assert abs(got[path]["gain_total"] - gain) < 1e-9 and got[path]["position"] == len(path)
        assert abs(got[path]["marginal"] - (gain - total.get(path[:-1], 0.0))) < 1e-9
