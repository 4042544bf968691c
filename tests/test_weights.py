import numpy as np
from pyspark.sql import functions as F

from glyphmill.operators import folds as fo, probs as pr, weights as we

CLASSES = ["A", "B"]
ROWS = [(i, "AB"[i % 2], ["BRAF", "TP53", "IDH1"][: 1 + i % 3]) for i in range(24)]


def tables(spark, rows=ROWS):
    samples = spark.createDataFrame([(i, c) for i, c, _ in rows], "sid long, label string")
    tokens = spark.createDataFrame([(i, t) for i, _, ts in rows for t in ts], "sid long, token string")
    return samples, tokens


def test_empirical_bayes_against_numpy(spark):
    samples, tokens = tables(spark)
    counts = we.token_counts(tokens, samples, CLASSES)
    got = {(r.token, r.cls): r.w for r in we.weights_long(we.weigh(counts, we.empirical_bayes()), CLASSES).collect()}
    n = len(ROWS)
    for token in ("BRAF", "TP53", "IDH1"):
        s = sum(token in ts for _, _, ts in ROWS)
        for cls in CLASSES:
            size, pos = sum(c == cls for _, c, _ in ROWS), sum(c == cls and token in ts for _, c, ts in ROWS)
            p0 = (s + 1) / (n + 2)
            inside, outside = (pos + 20 * p0) / (size + 20), (s - pos + 20 * p0) / (n - size + 20)
            want = np.log(inside / (1 - inside)) - np.log(outside / (1 - outside))
            assert abs(got[token, cls] - np.clip(want, -4, 4)) < 1e-9


def test_cross_fit_equals_refitting_per_fold(spark):
    samples, tokens = tables(spark)
    folds = fo.stratified_folds(samples, 4)
    quick = we.weigh(we.cross_fit_counts(tokens, folds, CLASSES), we.log_odds())
    for fold in range(4):
        fit = folds.filter(F.col("fold") != fold).select("sid", "label")
        direct = we.weigh(we.token_counts(tokens, fit, CLASSES), we.log_odds())
        a = {r.token: (r.support, r.n, list(np.round(r.w, 9))) for r in quick.filter(F.col("fold") == fold).collect()}
        b = {r.token: (r.support, r.n, list(np.round(r.w, 9))) for r in direct.collect()}
        assert a and all(b[t] == v for t, v in a.items())


def test_held_out_rows_never_change_their_own_score(spark):
    samples, tokens = tables(spark)
    folds = fo.stratified_folds(samples, 4)
    base = we.cross_fitted_scores(tokens, folds, CLASSES, we.empirical_bayes(), None)
    flipped = folds.withColumn("label", F.when(F.col("fold") == 0, F.when(F.col("label") == "A", "B").otherwise("A")).otherwise(F.col("label")))
    other = we.cross_fitted_scores(tokens, flipped, CLASSES, we.empirical_bayes(), None)
    a = {(r.sid, r.cls): r.score for r in base.filter("fold = 0").collect()}
    b = {(r.sid, r.cls): r.score for r in other.filter("fold = 0").collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_unseen_tokens_do_not_enter_the_state(spark):
    samples, tokens = tables(spark)
    extra = tokens.unionByName(spark.createDataFrame([(99, "ONLY_HELD_OUT")], "sid long, token string"))
    a = we.token_counts(tokens, samples, CLASSES).select("token", "support")
    b = we.token_counts(extra, samples, CLASSES).select("token", "support")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_residual_weights_are_finite_and_clipped(spark):
    rows = [(i, "AABBABAB"[i % 8], ["P"] + (["P__1"] if i % 2 else [])) for i in range(40)]
    samples, tokens = tables(spark, rows)
    samples = samples.unionByName(spark.createDataFrame([(100, "A"), (101, "B")], "sid long, label string"))
    child = we.token_counts(tokens.filter("token = 'P__1'"), samples, CLASSES)
    parent = we.token_counts(tokens.filter("token = 'P'"), samples, CLASSES)
    mapping = spark.createDataFrame([("P__1", "P")], "token string, parent string")
    w = we.residual_weights(child, parent, mapping).first()["w"]
    assert len(w) == 2 and all(np.isfinite(w)) and max(map(abs, w)) <= 4


def test_low_rank_is_the_best_projection(spark):
    rng = np.random.default_rng(0)
    matrix = rng.normal(size=(30, 3)) @ rng.normal(size=(3, 5)) + 0.1 * rng.normal(size=(30, 5))
    df = spark.createDataFrame([(f"t{i}", [float(x) for x in r]) for i, r in enumerate(matrix)], "token string, w array<double>")
    got = {r.token: r.w for r in we.low_rank(df, list("abcde"), 2).collect()}
    u, s, v = np.linalg.svd(matrix, full_matrices=False)
    want = (u[:, :2] * s[:2]) @ v[:2]
    assert np.allclose([got[f"t{i}"] for i in range(30)], want, atol=1e-8)


def test_position_density_has_no_cut_off(spark):
    rows = [(i, "AB"[i % 2], 5 + (i * 53) % 1900) for i in range(60)]
    typed = spark.createDataFrame([(i, "g", "MISSENSE", p) for i, _, p in rows], "sid long, gene string, event_type string, position long")
    samples = spark.createDataFrame([(i, c) for i, c, _ in rows], "sid long, label string")
    got = {r.position: r.w for r in we.position_density(typed, samples, CLASSES).collect()}
    for x in {p for _, _, p in rows}:
        k = np.array([sum(np.exp(-0.5 * ((p - x) / 20) ** 2) for _, c, p in rows if c == cls) for cls in CLASSES])
        want = np.log((k / 30 + 1e-5) / ((k.sum() - k) / 30 + 1e-5))
        assert np.allclose(got[x], np.clip(want, -4, 4), atol=1e-9)


def rows_df(spark):
    data = [(1, [0.5, 0.3, 0.2], [0.34, 0.33, 0.33]), (2, [0.1, 0.6, 0.3], [0.8, 0.1, 0.1]), (3, [0.4, 0.4, 0.2], [0.2, 0.2, 0.6])]
    return spark.createDataFrame(data, "sid long, a array<double>, b array<double>")


def test_gate_and_mass(spark):
    a, b = F.col("a"), F.col("b")
    classes = ["x", "y", "z"]
    df = rows_df(spark)
    gated = [r.g for r in df.select(pr.gate(a, b, 0.05).alias("g")).collect()]
    assert gated[0] == [0.5, 0.3, 0.2] and gated[1] == [0.8, 0.1, 0.1]
    routed = pr.route(a, classes, ("x", "y"), "top_two")
    new = pr.redistribute_pair(a, classes, ("x", "y"), F.lit(0.9), "hard", routed=routed)
    for r in df.select(a.alias("old"), new.alias("new")).collect():
        assert abs(sum(r.new) - 1) < 1e-12 and abs(r.old[0] + r.old[1] - r.new[0] - r.new[1]) < 1e-12
    group = pr.redistribute_group(a, classes, ["y", "z"], b)
    for r in df.select(a.alias("old"), group.alias("new")).collect():
        assert abs(r.old[0] - r.new[0]) < 1e-12 and abs(sum(r.new) - 1) < 1e-12
    assert [r.p for r in df.select(pr.argmax_class(a, classes).alias("p")).collect()] == ["x", "y", "x"]
    soft = pr.correct_residual(a, b, 0.2)
    assert all(abs(sum(r.s) - 1) < 1e-12 for r in df.select(soft.alias("s")).collect())


def test_validated_pairs_and_grid():
    rows = [("a", "b", 0.3, 5, 1), ("b", "c", 0.2, 5, 1), ("c", "d", 0.1, 5, 9), ("c", "e", 0.05, 3, 1)]
    assert [r[:2] for r in pr.validated_pairs(rows)] == [("a", "b"), ("c", "e")]
    grid = pr.compositions(5, 3)
    assert len(grid) == 21 and all(sum(g) == 5 for g in grid)


def test_backed_off_evidence_against_brute_force(spark):
    """Events without an integer, of unlabelled samples, and many events of one codon."""
    rng = np.random.default_rng(3)
    kinds = [("R5C", "MISSENSE"), ("R5H", "MISSENSE"), ("Q9*", "NONSENSE"), ("K30N", "MISSENSE"), ("SPLICE", "SPLICE"), ("K900N", "MISSENSE")]
    labels = {i: [*CLASSES, None][int(rng.integers(0, 7)) % 3] for i in range(60)}
    rows = sorted({(i, "AB"[int(rng.integers(0, 2))] + "1", *kinds[int(rng.integers(0, len(kinds)))]) for i in range(60) for _ in range(4)})
    typed = spark.createDataFrame(rows, "sid long, gene string, event string, event_type string")
    samples = spark.createDataFrame(list(labels.items()), "sid long, label string")
    table = we.backoff_table(typed, samples, CLASSES)
    got = {(r.gene, r.event): (r.events, r.evidence) for r in table.collect()}

    size = {c: sum(v == c for v in labels.values()) for c in CLASSES}
    n = sum(size.values())
    place = {e: int("".join(ch for ch in e if ch.isdigit()) or -1) for e, _ in kinds}

    def weight(sids, c):
        s, pos = sum(labels[i] is not None for i in sids), sum(labels[i] == c for i in sids)
        if not s:
            return 0, 0.0
        p0 = (s + 1) / (n + 2)
        logit = lambda x: np.log(x / (1 - x))
        return s, float(np.clip(logit((pos + 20 * p0) / (size[c] + 20)) - logit((s - pos + 20 * p0) / (n - size[c] + 20)), -4, 4))

    assert set(got) == {(g, e) for _, g, e, _ in rows}
    for gene, event, kind in {r[1:] for r in rows}:
        for i, c in enumerate(CLASSES):
            q = place[event]
            levels = [weight({r[0] for r in rows if r[1] == gene and r[2] == event}, c)]
            levels.append(weight({r[0] for r in rows if r[1] == gene and place[r[2]] == q}, c) if q >= 0 else (0, 0.0))
            near = [(labels[r[0]], abs(place[r[2]] - q)) for r in rows if r[1] == gene and r[3] == kind and labels[r[0]] is not None]
            mass = {k: sum(np.exp(-0.5 * (d / 20) ** 2) for label, d in near if label == k) for k in CLASSES}
            ratio = np.log((mass[c] / size[c] + 1e-5) / ((sum(mass.values()) - mass[c]) / max(n - size[c], 1) + 1e-5))
            known = q >= 0 and any(d == 0 for _, d in near)
            levels.append((sum(d <= 20 for _, d in near), float(np.clip(ratio, -4, 4))) if known else (0, 0.0))
            left, want = 1.0, 0.0
            for s, w in levels:
                want, left = want + left * s / (s + 20) * w, left - left * s / (s + 20)
            want += left * weight({r[0] for r in rows if r[1] == gene and r[3] == kind}, c)[1]
            assert abs(got[gene, event][1][i] - want) < 1e-9
        assert got[gene, event][0] == len([r for r in rows if r[1:3] == (gene, event)])
    placed = we.backed_off_events(typed, table, CLASSES)
    assert placed.count() == len(rows) * len(CLASSES)
    assert we.backoff_table(typed.limit(0), samples, CLASSES).count() == 0


def test_relabelling_a_held_fold_changes_none_of_its_evidence(spark):
    from glyphmill.operators import evidence as ev

    samples, tokens = tables(spark)
    folds = fo.stratified_folds(samples, 4)
    flipped = folds.withColumn("label", F.when(F.col("fold") == 1, F.lit("A")).otherwise(F.col("label")))
    prob = samples.select("sid", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("cls")).withColumn("p", F.lit(0.5))

    def shape(f):
        long = we.weights_long(we.weigh(we.cross_fit_counts(tokens, f, CLASSES), we.empirical_bayes()), CLASSES)
        found = ev.evidence_shape(ev.token_evidence(tokens.join(f.select("sid", "fold"), "sid"), long, (), ("fold", "token")))
        rows = ev.candidate_shape(prob.join(f.select("sid", "fold"), "sid"), found, we.priors_outside(f, CLASSES), ("fold",))
        return {(r.sid, r.cls): tuple(np.round(r[3:], 9)) for r in rows.collect()}, {(r.sid, r.cls): r.fold for r in rows.collect()}

    (a, fold), (b, _) = shape(folds), shape(flipped)
    assert a.keys() == b.keys() and len(a) == 48
    assert all(a[k] == b[k] for k in a if fold[k] == 1) and any(a[k] != b[k] for k in a if fold[k] != 1)
