from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import quality, toxicity


def brute_segments(s, at=0):
    """The highest-scoring run, then the same to its left and to its right."""
    sums, best, arg = np.concatenate([[0], np.cumsum(s)]), 1e-12, None
    for i in range(len(s)):
        for j in range(i + 1, len(s) + 1):
            if sums[j] - sums[i] > best + 1e-12:
                best, arg = sums[j] - sums[i], (i, j)
    if arg is None:
        return []
    i, j = arg
    return brute_segments(s[:i], at) + [(at + i, at + j, round(best, 6))] + brute_segments(s[j:], at + j)


@pytest.mark.parametrize("seed", range(60))
def test_maximal_segments(seed):
    rng = random.Random(seed)
    s = np.array([rng.choice([-3, -2, -1, 1, 2, 3, 5]) + rng.random() / 7 for _ in range(rng.randint(0, 25))], dtype=float)
    assert [(x.start, x.end, round(x.score, 6)) for x in toxicity.maximal_segments(s)] == brute_segments(s)


@pytest.fixture(scope="module")
def corpus(spark):
    """1,200 texts, a tenth with insults; half of them rated, plus awkward rows."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(800)]
    rows, labels = [], []
    for i in range(1200):
        own = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        bad = i % 10 == 0
        if bad:
            for _ in range(3):
                own.insert(rng.randrange(len(own)), rng.choice(["vileness", "wretched", "scoundrel"]))
        rows.append((i, " ".join(own)))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    rows += [(2000, None), (2001, ""), (None, "plain words"), (3, rows[3][1]), (2002, "z " * 50_000)]
    labels += [(None, 1), (4000, 1), (2001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("label", "half", "score", "grade", "k")})
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("quality", 1 - F.col("toxic"))


def test_toxicity_finds_held_out_documents(corpus):
    docs, labels = corpus
    out = ~toxicity.held_out(F.col("doc_id"))
    model = toxicity.fit(toxicity.labelled_rows(docs, labels, "doc_id", "text", "toxic", out, 40_000))
    rows = toxicity.score(docs, model).withColumn("held_out", ~out).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    unseen = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 1200 and (r["held_out"] or r["doc_id"] % 2)]
    toxic = [r for r in unseen if r["doc_id"] % 10 == 0]
    clean = [r for r in unseen if r["doc_id"] % 10]
    assert len(toxic) > 20
    assert np.mean([r["predicted"] for r in toxic]) > 0.9 and np.mean([r["predicted"] for r in clean]) < 0.03
    text = {r["doc_id"]: r["text"].split() for r in docs.filter("doc_id < 1200").collect()}
    found = [w for r in toxic for p in r["passages"] for w in text[r["doc_id"]][p["first"]:p["last"] + 1]]
    assert {"vileness", "wretched", "scoundrel"} <= set(found)


def test_labels_of_held_out_rows_do_not_matter(corpus, spark):
    docs, labels = corpus
    held = toxicity.held_out(F.col("doc_id"))
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    fits = [toxicity.fit(toxicity.labelled_rows(docs, x, "doc_id", "text", "toxic", ~held, 40_000)) for x in (labels, turned)]
    assert fits[0][1:] == fits[1][1:] and (fits[0].counts == fits[1].counts).all()


def test_without_labels_or_rows(corpus, empty, spark):
    docs, labels = corpus
    none = labels.limit(0)
    assert toxicity.fit(toxicity.labelled_rows(docs, none, "doc_id", "text", "toxic", None, 10)) is None
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(empty, None).count() == 0
    assert quality.fit(docs, none) is None
    assert all(r["accepted"] for r in quality.score(docs, None).collect())
    model = quality.fit(docs, labels)
    assert quality.score(empty, model).count() == 0 and quality.keep_accepted(empty, model).count() == 0


def test_ordinal_fit_recovers_weights_and_order():
    rng = np.random.default_rng(0)
    n, width = 3000, 50
    index, w = rng.integers(0, width, (n, 10)), rng.normal(0, 2, width)
    y = np.digitize(w[index].mean(axis=1) * 5 + rng.logistic(0, 0.3, n), [-1, 0.5, 1.5])
    got, thresholds = quality.fit_ordinal(index.ravel(), np.full(n * 10, 0.1), np.arange(0, n * 10 + 1, 10), y, 4, width)
    assert np.corrcoef(got, w)[0, 1] > 0.98
    assert (np.diff(thresholds) > 0).all()


def test_quality_separates_graded_junk(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, ratings = [], []
    for i in range(900):
        grade = i % 3
        share = (0.9, 0.4, 0.0)[grade]
        rows.append((i, " ".join(w.upper() + "!!" if rng.random() < share else w for w in (word() for _ in range(60)))))
        if i < 600:
            ratings.append((i, grade))
    docs, rated = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(ratings, "doc_id long, quality int")
    model = quality.fit(docs, rated)
    assert model.grades == [0, 1, 2] and (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    mean = [np.mean([got[i]["expected_grade"] for i in range(600, 900) if i % 3 == g]) for g in range(3)]
    assert mean[0] < 0.6 < mean[1] < 1.5 < mean[2]
    assert np.mean([got[i]["accepted"] == (i % 3 == 2) for i in range(600, 900)]) > 0.95
    middle = {r["doc_id"]: r["accepted"] for r in quality.score(docs, model, wanted=1).collect()}
    assert np.mean([middle[i] == (i % 3 >= 1) for i in range(600, 900)]) > 0.95


def test_quality_keeps_columns_and_all_rows_decided(corpus):
    docs, labels = corpus
    model = quality.fit(docs, labels)
    kept = quality.keep_accepted(docs, model)
    assert kept.columns == docs.columns
    accepted = quality.score(docs, model).filter("accepted")
    key = lambda r: str(r["doc_id"])
    assert sorted(map(key, kept.collect())) == sorted(map(key, accepted.collect()))


def test_quality_scores_follow_from_the_weights(spark):
    """Expected grade and tail probability of every text, computed by hand from the model's weights and thresholds."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["Aa", "b!", "c", "D1", "ee"]) for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(100, None), (None, "c c"), (101, "b! " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(i, i % 4) for i in range(60)], "doc_id long, quality int"))
    import pyarrow as pa

    got = {r["doc_id"]: r for r in quality.score(docs, model, wanted=2).collect()}
    for i, text in rows:
        buckets, _ = quality._features(pa.array([text or ""]))
        f = sum(model.weights[b] for token in buckets for b in token) / max(1, len(buckets))
        tails = [1 / (1 + np.exp(-(f - t))) for t in model.thresholds]
        assert got[i]["expected_grade"] == pytest.approx(sum(tails)) and got[i]["tail_probability"] == pytest.approx(tails[1])
        assert got[i]["accepted"] == (got[i]["tail_probability"] >= 0.5)
    assert {r["tail_probability"] for r in quality.score(docs, model, wanted=-3).collect()} == {1.0}
    assert {r["tail_probability"] for r in quality.score(docs, model, wanted=9).collect()} == {0.0}


def test_odd_ratings(spark):
    docs = spark.createDataFrame([(i, f"w{i} w") for i in range(40)], "doc_id long, text string")
    words = spark.createDataFrame([(i, ["1", "2", "good", None][i % 4]) for i in range(40)], "doc_id long, quality string")
    assert quality.fit(docs, words).grades == [1, 2]
    with pytest.raises(ValueError):
        quality.fit(docs, spark.createDataFrame([(i, i) for i in range(40)], "doc_id long, quality int"))


def test_fit_takes_the_rows_that_fit(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 7 + 1))) for i in range(200)], "doc_id long, text string")
    rated = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 2000)
    assert quality.fit(docs, rated).grades == [0, 1]


def test_statistic_as_a_column(spark):
    rng = random.Random(3)
    rows = [([rng.uniform(0, 9) for _ in range(rng.randint(0, 40))], rng.randint(0, 500)) for _ in range(200)] + [([], 0), ([1.0], 0), ([100.0] * 300, 10)]
    table = spark.createDataFrame(rows, "s array<double>, n long")
    got = [r["x"] for r in table.select(toxicity.column_statistic(F.col("s"), F.col("n"), 0.7, 1.5).alias("x")).collect()]
    assert got == pytest.approx([toxicity.statistic(np.array(s), n, 0.7, 1.5) for s, n in rows])


def test_word_memory_keeps_frequent_words():
    from glyphmill.llm.base import WordMemory

    memory, other = WordMemory(100 * WordMemory.ENTRY), WordMemory(1 << 20)
    memory.open()
    for i in range(10_000):
        if memory.get("often") is None:
            memory.put("often", b"x")
            assert i == 0
        memory.put(f"word{i}", b"yy")
        assert len(memory.young) + len(memory.old) < 120
    memory.put("z" * 65, b"")
    assert memory.get("z" * 65) is None
    other.open()
    assert memory.get("often") is None
