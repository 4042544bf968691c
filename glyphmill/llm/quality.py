"""Quality by ordinal regression on graded ratings: a cumulative-link model over hashed text.

``P(grade >= k) = sigmoid(f(text) - threshold_k)`` with ordered thresholds and one weight vector f for all of them.
Features are hashed from the text alone: each token's letters, its shape (capitals, small letters, digits and other
characters, runs collapsed), the shapes of neighbouring tokens, and whether a token repeats the one before; a feature's value is its share of the
text's tokens.  f is a mean over tokens, so scoring is linear in the text and any text is scored as a whole.

Fitting takes at most ``sample_rows`` rated rows (those with the smallest hash), whose ratings are broadcast, and at most ``SAMPLE_BYTES``
of their features, which are fitted by L-BFGS on the driver.  Scoring is local to a row.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphmill.llm.base import WordMemory, checkpointed, read, release_arrow, ship, text_slices

BITS = 14
SAMPLE_ROWS = 10_000
MAX_GRADES = 20
RIDGE = 2e-4
#: Below this probability of the wanted grade a document is rejected.
ACCEPT = 0.5
#: Bytes of the features that are fitted; where the sample has more, the rows with the smallest hash that fit.
SAMPLE_BYTES = 128 << 20
#: Bytes of words that a Python worker remembers, about, and UTF-8 bytes of texts handled at a time (one text at least).
REMEMBERED, AT_A_TIME = 32 << 20, 2 << 20

_SHAPES = ((re.compile(r"[^\W\d_]+"), None), (re.compile(r"\d+"), "0"), (re.compile(r"([^\w\s])\1+"), r"\1"))


class Model(NamedTuple):
    weights: np.ndarray
    thresholds: np.ndarray
    grades: list[int]


def shape(word: str) -> str:
    """Letters become A (capitals), a (small), B (both, capital first) or b; digits 0; runs of a sign one sign."""
    letters = lambda m: "A" if m.group().isupper() else "a" if m.group().islower() else "B" if m.group()[0].isupper() else "b"
    for pattern, to in _SHAPES:
        word = pattern.sub(to if to is not None else letters, word)
    return word[:8]


class _Features:
    """Hashed features of each token; a worker remembers the tokens it has met."""

    def __init__(self):
        self.known = WordMemory(REMEMBERED)

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Buckets (tokens x 4) and the token bounds of each text of an Arrow array without nulls."""
        import pyarrow.compute as pc
        import xxhash

        runs = pc.ascii_split_whitespace(texts)
        coded = runs.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        table, known = np.empty((len(words), 2), np.uint64), self.known
        known.open()
        for i, w in enumerate(words):
            found = known.get(w)
            if found is None:
                found = (xxhash.xxh3_64_intdigest(w.lower(), seed=1), xxhash.xxh3_64_intdigest(shape(w), seed=2))
                known.put(w, found)
            table[i] = found
        at = coded.indices.to_numpy() if len(words) else np.zeros(0, np.int64)
        bounds = runs.offsets.to_numpy().astype(np.int64)
        own = table[at]
        starts = np.zeros(len(at), bool)
        starts[bounds[:-1][bounds[:-1] < len(at)]] = True
        before = np.concatenate([[0], at[:-1]]) if len(at) else at
        shape_before = np.where(starts, np.uint64(0), table[before, 1]) if len(at) else np.zeros(0, np.uint64)
        again = (~starts) & (before == at)
        pair = (own[:, 1] ^ (shape_before * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)
        mask = np.uint64((1 << BITS) - 1)
        return np.stack([own[:, 0] & mask, own[:, 1] & mask, pair, np.where(again, np.uint64(1), np.uint64(2))], axis=1).astype(np.int64), bounds


_features = _Features()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _minimise(loss, x: np.ndarray, rounds: int = 300, memory: int = 10, tolerance: float = 1e-6) -> np.ndarray:
    """L-BFGS with a halving line search; ``loss`` gives value and gradient."""
    value, grad = loss(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, held = -grad, []
        for s, y in reversed(steps):
            a = (s @ d) / (s @ y)
            held.append(a)
            d = d - a * y
        if steps:
            s, y = steps[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(steps, reversed(held)):
            d = d + (a - (y @ d) / (s @ y)) * s
        slope, size = grad @ d, 1.0
        while size > 1e-10:
            to = x + size * d
            new_value, new_grad = loss(to)
            if new_value <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        if (new_grad - grad) @ (to - x) > 1e-12:
            steps = [*steps[-memory + 1:], (to - x, new_grad - grad)]
        done = value - new_value <= tolerance * max(1.0, abs(value)) * 1e-2
        x, value, grad = to, new_value, new_grad
        if done:
            break
    return x


def fit_ordinal(index: np.ndarray, share: np.ndarray, bounds: np.ndarray, y: np.ndarray, grades: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the cumulative-link model; rows are given by bounds into (index, share).

    The gaps between thresholds are exponentials, so their order holds throughout.
    """
    n = len(y)
    row = np.repeat(np.arange(n), np.diff(bounds))

    def split(x):
        return x[:width], np.cumsum(np.concatenate([x[width:width + 1], np.exp(x[width + 1:])]))

    def loss(x):
        w, t = split(x)
        f = np.bincount(row, share * w[index], minlength=n)
        tail = np.concatenate([np.ones((n, 1)), _sigmoid(f[:, None] - t[None, :]), np.zeros((n, 1))], axis=1)
        own = np.maximum(tail[np.arange(n), y] - tail[np.arange(n), y + 1], 1e-12)
        slope = tail * (1 - tail)
        df = (slope[np.arange(n), y] - slope[np.arange(n), y + 1]) / own
        dt = np.zeros(grades - 1)
        for k in range(grades - 1):
            dt[k] = (np.where(y == k + 1, slope[:, k + 1] / own, 0) - np.where(y == k, slope[:, k + 1] / own, 0)).sum() / n
        gw = -np.bincount(index, share * df[row], minlength=width) / n + RIDGE * w
        gt = np.concatenate([[dt.sum()], [dt[k:].sum() * np.exp(x[width + k]) for k in range(1, grades - 1)]])
        return float(-np.log(own).mean() + RIDGE / 2 * (w @ w)), np.concatenate([gw, gt])

    start = np.zeros(width + grades - 1)
    above = np.array([(y > k).mean() for k in range(grades - 1)])
    first = -np.log(np.clip(above, 1e-3, 1 - 1e-3) / np.clip(1 - above, 1e-3, 1))
    start[width] = first[0]
    start[width + 1:] = np.log(np.maximum(np.diff(first), 1e-2))
    return split(_minimise(loss, start))


def fit(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """The model of the rated rows; None where they do not have two grades.

    Grades are whole numbers, at most MAX_GRADES of them, else ValueError; ratings without an id, or whose grade is null or no number, are left aside.  A
    document that is rated twice counts twice, and so does a repeated document; null and empty texts have no features.
    """
    spark = docs.sparkSession
    ship(spark)
    own = ratings.select(F.col(id_col).alias("doc_id"), F.col(grade_col).try_cast("int").alias("grade")).filter("doc_id is not null and grade is not null")
    taken = own.withColumn("_h", F.xxhash64("doc_id", F.lit(9))).orderBy("_h", "doc_id", "grade").limit(sample_rows).drop("_h")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(taken), "doc_id").select("text", "grade", F.xxhash64("doc_id", "text", "grade").alias("k"))

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in text_slices(batch, 0, AT_A_TIME):
                buckets, bounds = _features(part.column(0))
                index, share = [], []
                for lo, hi in zip(bounds[:-1], bounds[1:]):
                    at, n = np.unique(buckets[lo:hi], return_counts=True)
                    index.append(at.astype("<u2").tobytes())
                    share.append((n / max(1, hi - lo)).astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(1), pa.array(index, pa.binary()), pa.array(share, pa.binary())], names=["k", "grade", "i", "s"])

    features = checkpointed(rows.mapInArrow(work, "k long, grade int, i binary, s binary"))
    held, cut = 0, None
    for r in sorted(features.select("k", (F.octet_length("i") + F.octet_length("s")).alias("bytes")).collect()):
        held += r["bytes"]
        if held > SAMPLE_BYTES and cut is not None:
            break
        cut = r["k"]
    found = sorted(features.filter(F.col("k") <= (cut or 0)).collect(), key=lambda r: (r["k"], r["grade"]))
    grades = sorted({r["grade"] for r in found})
    if len(grades) < 2:
        return None
    if len(grades) > MAX_GRADES:
        raise ValueError(f"ratings have more than {MAX_GRADES} grades")
    index = np.frombuffer(b"".join(bytes(r["i"]) for r in found), "<u2").astype(np.int64)
    share = np.frombuffer(b"".join(bytes(r["s"]) for r in found), "<f4").astype(float)
    bounds = np.concatenate([[0], np.cumsum([len(r["i"]) // 2 for r in found])])
    y = np.array([grades.index(r["grade"]) for r in found])
    weights, thresholds = fit_ordinal(index, share, bounds, y, len(grades), 1 << BITS)
    return Model(weights, thresholds, grades)


def _tails(model: Model, texts) -> np.ndarray:
    """P(grade >= k) for all grades but the lowest; a row per text.  A text without tokens has f = 0."""
    buckets, bounds = _features(texts)
    each = model.weights[buckets].sum(axis=1)
    sums = np.concatenate([[0.0], np.cumsum(each)])
    f = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(1, np.diff(bounds))
    return _sigmoid(f[:, None] - model.thresholds[None, :])


def _place(model: Model, wanted: int | None) -> int:
    """How many of the model's grades lie below the wanted one."""
    return len(model.grades) - 1 if wanted is None else sum(g < wanted for g in model.grades)


def _tail(tails: np.ndarray, at: int) -> np.ndarray:
    return np.ones(len(tails)) if at == 0 else tails[:, at - 1] if at <= tails.shape[1] else np.zeros(len(tails))


def score(docs: DataFrame, model: Model | None, wanted: int | None = None, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """One row per row of ``docs``: doc_id, expected_grade, tail_probability (of ``wanted``, default the top grade, or better), accepted.

    ``wanted`` may be any number: the probability is that of the model's grades from there on (1 below all of them, 0 above).
    A null text counts as empty; without tokens the thresholds alone decide.  Without a model nothing is known: the numbers are null and
    every row is accepted.  Null ids and repeated rows are rows like others; no rows give no rows; other columns are not looked at.
    """
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, expected_grade double, tail_probability double, accepted boolean"
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if model is None:
        none = F.lit(None).cast("double")
        return texts.select("doc_id", none.alias("expected_grade"), none.alias("tail_probability"), F.lit(True).alias("accepted"))
    spark = docs.sparkSession
    ship(spark)
    shared, at = spark.sparkContext.broadcast(model), _place(model, wanted)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = shared.value
        gaps = np.diff(np.array(m.grades, dtype=float))
        for batch in batches:
            for part in text_slices(batch, 1, AT_A_TIME):
                tails = _tails(m, part.column(1))
                p = _tail(tails, at)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(m.grades[0] + tails @ gaps), pa.array(p), pa.array(p >= accept)],
                                                 names=["doc_id", "expected_grade", "tail_probability", "accepted"])
        release_arrow()

    return texts.mapInArrow(work, schema)


def keep_accepted(docs: DataFrame, model: Model | None, wanted: int | None = None, text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """The accepted rows of ``docs``, all columns as they are; each row is decided where it is read."""
    if model is None:
        return docs
    spark = docs.sparkSession
    ship(spark)
    shared, at = spark.sparkContext.broadcast(model), _place(model, wanted)
    place = docs.columns.index(text_col)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            whole = pa.RecordBatch.from_arrays([*batch.columns[:place], pc.fill_null(batch.column(place), ""), *batch.columns[place + 1:]], names=batch.schema.names)
            at_row = 0
            for part in text_slices(whole, place, AT_A_TIME):
                tails = _tails(shared.value, part.column(place))
                p = _tail(tails, at)
                yield batch.slice(at_row, part.num_rows).filter(pa.array(p >= accept))
                at_row += part.num_rows
        release_arrow()

    return docs.mapInArrow(work, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))
