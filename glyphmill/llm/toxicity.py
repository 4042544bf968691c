"""Toxic passages by maximum-scoring segments.

Token scores are log-odds of the toxic against the clean share, with Dirichlet priors in a chain: the corpus' base rate is
the prior of a token's first letters, these of more of its letters, these of the whole token.  Minus a drift, scores of
clean text fall on average, and a linear scan (Ruzzo and Tompa) finds every maximal segment of positive score: the
passages.  Segment scores S follow an extreme-value law in clean text, so ``lambda S - ln(K n)`` is comparable between
documents of any length n; the documents' statistic adds up the segments for which it is positive.  A logistic curve
turns it into a probability.

Learning takes at most ``sample_rows`` labelled rows (those with the smallest hash), whose labels are broadcast.  Scores
of rows that serve to fit drift, lambda, K and the curve come from tables learned on the other half of the rows.  Tables
have 2**BITS hashed entries per level, so what reaches the driver and the tasks has a fixed size.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glyphmill.llm.base import WordMemory, checkpointed, read, release_arrow, ship, text_slices

BITS = 18
#: Letters that the levels of the chain look at; None is the whole token.
LEVELS = (4, 5, None)
#: Weight of a prior, in occurrences.
PRIOR = 2.0
SAMPLE_ROWS = 40_000
THRESHOLD = 0.3
#: Below minus this the statistic says no more.
LEAST = 6.0
#: Bytes of words that a Python worker remembers, about.
REMEMBERED = 48 << 20
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_GRID = np.linspace(-12, 12, 961)


class Segment(NamedTuple):
    start: int
    end: int
    score: float


class Model(NamedTuple):
    counts: np.ndarray  # (levels, 2**BITS, 2): documents with the token, clean and toxic
    base: float
    drift: float
    scale: float
    log_k: float
    intercept: float
    slope: float


def maximal_segments(scores: np.ndarray) -> list[Segment]:
    """All maximal segments of positive total, in order (Ruzzo and Tompa, linear time); start inclusive, end exclusive."""
    done: list[list[float]] = []  # left sum, right sum, start, end, and the last earlier one with a smaller left sum
    sums = np.concatenate([[0.0], np.cumsum(scores)]).tolist()
    for i in np.flatnonzero(scores > 0).tolist():
        item = [sums[i], sums[i + 1], i, i + 1, -1]
        while True:
            j = len(done) - 1
            while j >= 0 and done[j][0] >= item[0]:
                j = done[j][4]
            item[4] = j
            if j < 0 or done[j][1] >= item[1]:
                done.append(item)
                break
            item = [done[j][0], item[1], done[j][2], item[3], done[j][4]]
            del done[j:]
    return [Segment(int(a), int(b), r - l) for l, r, a, b, _ in done]


def _buckets(word: str) -> tuple[int, ...]:
    import xxhash

    word = _EDGES.sub("", word)
    return tuple(xxhash.xxh3_64_intdigest(word[:n] if n else word, seed=i) & ((1 << BITS) - 1) for i, n in enumerate(LEVELS))


class _Words:
    """Buckets of the tokens of texts, each distinct token once; a worker remembers them."""

    def __init__(self):
        self.known = WordMemory(REMEMBERED)

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Buckets (tokens x levels) and the token bounds of each text of an Arrow array without nulls."""
        import pyarrow.compute as pc

        runs = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        coded = runs.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        table, known = np.empty((len(words), len(LEVELS)), np.int64), self.known
        known.open()
        for i, w in enumerate(words):
            found = known.get(w)
            if found is None:
                found = _buckets(w)
                known.put(w, found)
            table[i] = found
        return table[coded.indices.to_numpy()] if len(words) else np.zeros((0, len(LEVELS)), np.int64), runs.offsets.to_numpy().astype(np.int64)


_words = _Words()


def scores_of(buckets: np.ndarray, counts: np.ndarray, base: float) -> np.ndarray:
    """Log-odds of each token (rows of ``buckets``) against the base rate, through the chain of priors."""
    share = np.full(len(buckets), base)
    for level in range(len(LEVELS)):
        own = counts[level, buckets[:, level]]
        share = (own[:, 1] + PRIOR * share) / (own.sum(axis=1) + PRIOR)
    share = np.clip(share, 1e-6, 1 - 1e-6)
    return np.log(share / (1 - share)) - math.log(base / (1 - base))


def drifted(buckets: np.ndarray, scores: np.ndarray, drift: float) -> np.ndarray:
    """Scores of one document's tokens minus the drift; a token that was there before adds no more evidence."""
    first = np.zeros(len(scores), bool)
    first[np.unique(buckets[:, -1], return_index=True)[1]] = True
    return np.where(first, scores, np.minimum(scores, 0.0)) - drift


def statistic(segments: np.ndarray, n: int, scale: float, log_k: float) -> float:
    """Sum of ``lambda S - ln(K n)`` over segments where it is positive, or its largest value."""
    if not len(segments) or n <= 0:
        return -log_k - math.log(max(n, 1))
    each = scale * segments - log_k - math.log(n)
    return float(each[each > 0].sum()) if (each > 0).any() else float(each.max())


def column_statistic(segments: Column, n: Column, scale: float, log_k: float) -> Column:
    """``statistic`` as a column."""
    length = F.ln(F.greatest(n, F.lit(1)))
    each = F.transform(segments, lambda s: scale * s - log_k - length)
    above = F.filter(each, lambda x: x > 0)
    none = (F.size(segments) == 0) | (n <= 0)
    return F.when(none, -log_k - length).when(F.size(above) > 0, F.aggregate(above, F.lit(0.0), lambda a, x: a + x)).otherwise(F.array_max(each))


def levelled(x: np.ndarray) -> np.ndarray:
    """The statistic, positive values on a logarithmic scale: long documents full of evidence should not bend the curve."""
    return np.where(x > 0, np.log1p(np.maximum(x, 0)), np.maximum(x, -LEAST))


def chance(x: np.ndarray, intercept: float, slope: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(intercept + slope * levelled(x), -30, 30)))


def _root(grid: np.ndarray, weight: np.ndarray) -> float:
    """The positive lambda at which the mean of exp(lambda s) is 1."""
    lo, hi = 1e-6, 1.0
    mean = lambda t: float((weight * np.exp(np.clip(t * grid, -700, 700))).sum())
    while mean(hi) < 1 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mean(mid) < 1 else (lo, mid)
    return (lo + hi) / 2


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps with a small ridge; the slope is not negative."""
    raw, x = x, levelled(x)
    a, b = math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)), 0.1
    for _ in range(50):
        p = chance(raw, a, b)
        g = np.array([(y - p).sum() - 1e-3 * a, ((y - p) * x).sum() - 1e-3 * b])
        w = p * (1 - p) + 1e-9
        h = np.array([[w.sum() + 1e-3, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(max(b, 0.0))


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, eligible: Column | None, sample_rows: int) -> DataFrame:
    """doc_id, text, label (0 or 1), half: at most ``sample_rows`` labelled rows; their ids and labels are broadcast."""
    own = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    if eligible is not None:
        own = own.filter(eligible)
    taken = own.withColumn("_h", F.xxhash64("doc_id", F.lit(11))).orderBy("_h", "doc_id", "label").limit(sample_rows)
    half = F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(2)).cast("int")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(taken.select("doc_id", "label")), "doc_id").select("doc_id", "text", "label", half.alias("half"))


def fit(rows: DataFrame) -> Model | None:
    """The model of labelled rows (see `labelled_rows`); None without rows of both labels."""
    ship(rows.sparkSession)
    size, levels = 1 << BITS, len(LEVELS)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros((2, 2, levels, size), np.int64)  # half, label
        docs = np.zeros((2, 2), np.int64)
        for batch in batches:
            for part in text_slices(batch, 0):
                buckets, bounds = _words(part.column(0))
                for lo, hi, label, half in zip(bounds[:-1], bounds[1:], part.column(1).to_pylist(), part.column(2).to_pylist()):
                    docs[half, label] += 1
                    for level in range(levels):
                        total[half, label, level, np.unique(buckets[lo:hi, level])] += 1
        flat = total.reshape(4, levels * size)
        at = np.flatnonzero(flat.any(axis=0))
        columns = [pa.array(np.append(at, -1))] + [pa.array(np.append(flat[k, at], docs.reshape(4)[k])) for k in range(4)]
        yield pa.RecordBatch.from_arrays(columns, names=["slot", "c0", "c1", "c2", "c3"])

    texts = rows.select("text", "label", "half")
    found = texts.mapInArrow(count, "slot long, c0 long, c1 long, c2 long, c3 long").groupBy("slot").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(4)]).toPandas()
    slots = found["slot"].to_numpy()
    values = found[["c0", "c1", "c2", "c3"]].to_numpy().T.astype(np.float32)
    docs = values[:, slots == -1].sum(axis=1).reshape(2, 2) if (slots == -1).any() else np.zeros((2, 2))
    if docs.sum(axis=0).min() < 1:
        return None
    flat = np.zeros((4, levels * size), np.float32)
    flat[:, slots[slots >= 0]] = values[:, slots >= 0]
    counts = flat.reshape(2, 2, levels, size).transpose(0, 2, 3, 1)  # half, level, slot, label
    base = float(docs[:, 1].sum() / docs.sum())

    context = rows.sparkSession.sparkContext
    shared = context.broadcast(counts)

    def spread(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hist = np.zeros(len(_GRID), np.int64)
        for batch in batches:
            for part in text_slices(batch, 0):
                buckets, bounds = _words(part.column(0))
                for lo, hi, label, half in zip(bounds[:-1], bounds[1:], part.column(1).to_pylist(), part.column(2).to_pylist()):
                    if label == 0 and hi > lo:
                        s = scores_of(buckets[lo:hi], shared.value[1 - half], base)
                        hist += np.bincount(np.clip(np.rint((s - _GRID[0]) / (_GRID[1] - _GRID[0])), 0, len(_GRID) - 1).astype(int), minlength=len(_GRID))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(_GRID))), pa.array(hist)], names=["step", "n"])

    seen = texts.mapInArrow(spread, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).toPandas().sort_values("step")
    weight = seen["n"].to_numpy(dtype=float)
    weight = weight / weight.sum() if weight.sum() else np.eye(1, len(_GRID), len(_GRID) // 2)[0]
    mean = float((weight * _GRID).sum())
    drift = mean + max(0.05, 0.5 * math.sqrt(max(0.0, float((weight * _GRID**2).sum()) - mean**2)))
    scale = _root(_GRID - drift, weight)

    def segment(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in text_slices(batch, 0):
                buckets, bounds = _words(part.column(0))
                top = []
                for lo, hi, half in zip(bounds[:-1], bounds[1:], part.column(2).to_pylist()):
                    s = drifted(buckets[lo:hi], scores_of(buckets[lo:hi], shared.value[1 - half], base), drift)
                    top.append([x.score for x in maximal_segments(s)])
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(np.diff(bounds)), pa.array(top, pa.list_(pa.float64()))], names=["label", "n", "scores"])

    table = checkpointed(texts.mapInArrow(segment, "label int, n long, scores array<double>"))
    shared.unpersist()
    largest = table.filter("label = 0 and n > 0 and size(scores) > 0").select((scale * F.array_max("scores") - F.ln("n")).alias("x")).toPandas()["x"]
    log_k = float(largest.mean()) - 0.5772156649 if len(largest) else 0.0
    own = table.select("label", column_statistic(F.col("scores"), F.col("n"), scale, log_k).alias("x")).orderBy("x", "label").toPandas()
    x, y = own["x"].to_numpy(dtype=float), own["label"].to_numpy(dtype=float)
    return Model(counts.sum(axis=0), base, drift, scale, log_k, *_logistic(x, y))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score, predicted, passages (first and last token, extreme-value score).

    A null text counts as empty; its score is that of no evidence at all.  Without a model (no labels of both kinds)
    every score is 0.  Null ids and repeated rows are rows like others; no rows give no rows; other columns are not looked at.
    """
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double, predicted int, passages array<struct<first:int,last:int,score:double>>"
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))
        m = shared.value
        for batch in batches:
            for part in text_slices(batch, 1):
                if m is None:
                    values, passages = np.zeros(part.num_rows), [[]] * part.num_rows
                else:
                    buckets, bounds = _words(part.column(1))
                    every = scores_of(buckets, m.counts, m.base)
                    x, passages = np.zeros(part.num_rows), []
                    for i, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                        found = maximal_segments(drifted(buckets[lo:hi], every[lo:hi], m.drift))
                        x[i] = statistic(np.array([s.score for s in found]), hi - lo, m.scale, m.log_k)
                        limit = m.log_k + math.log(max(1, hi - lo))
                        passages.append([{"first": s.start, "last": s.end - 1, "score": m.scale * s.score - limit} for s in found if m.scale * s.score > limit])
                    values = chance(x, m.intercept, m.slope)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(values), pa.array((values >= THRESHOLD).astype(np.int32)), pa.array(passages, kind)],
                    names=["doc_id", "score", "predicted", "passages"])
        release_arrow()

    return texts.mapInArrow(work, schema)


def held_out(id_: Column) -> Column:
    return F.crc32(id_.cast("string")) % 4 == 2


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = labelled_rows(docs, read(spark, sf_dir, "labels"), "doc_id", "text", "toxic", ~held_out(F.col("doc_id")), SAMPLE_ROWS)
    return score(docs, fit(rows)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))
