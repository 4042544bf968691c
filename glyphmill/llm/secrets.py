"""Secrets: known forms, and strings that a battery of randomness tests takes for keys.

Known forms (assign, access, hex) stand as they are.  Every other run of 20 or more key characters is a candidate; '='
belongs to a run only as padding at its end, so a value after 'name=' is a run of its own.  A run that mixes the signs of base64 and
base64url is split at either's signs and at all of them; of parts that overlap, one that the battery lets pass goes first, then the longer.  A candidate's
encoding is the smallest alphabet that has all its characters, and three tests compare it with random symbols of that alphabet:
chi-squared uniformity (over symbols and over classes of symbols), Wald-Wolfowitz runs and lag-1 serial correlation.  A candidate that these reject is no key.
Whether it could be text instead is judged with the corpus' own byte frequencies (counted over all documents): how
small its chi-squared distance from uniformity is, and how often it changes between small letters, capitals and
digits, against what text would give.  The two p-values are combined by Fisher's rule, and the false-discovery rate is controlled by
Benjamini and Hochberg's rule within each stratum of encoding and length class, so that many short candidates do
not lend their significance to long ones or the other way round.

Only byte counts and histograms of p-values on a fixed grid are gathered; both have a fixed size.
"""
from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphmill.llm.base import checkpointed, read, ship, text_slices

#: The known forms, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
RANDOM = "random"
_HINTS = ("passw", "secret", "token", "api")

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{20,})(?:=+(?![A-Za-z0-9+/_=-]))?")
#: Parts of a run of mixed alphabets: without the signs of base64, without those of base64url, without any.
PARTS = tuple(re.compile(p) for p in (r"[A-Za-z0-9_-]{20,}", r"[A-Za-z0-9+/]{20,}", r"[A-Za-z0-9]{20,}"))
ALPHABETS = (
    ("decimal", "0123456789"), ("hex", "0123456789abcdef"), ("HEX", "0123456789ABCDEF"), ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"), ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Below this combined p-value the uniformity battery rejects a candidate.
REJECT = 0.001
FALSE_DISCOVERY_RATE = 0.01
#: The grid of p-values: steps of a quarter of a power of ten.
STEPS_A_DECADE, GRID = 4, 240


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _fisher(*ps: float) -> float:
    """Fisher's combination of independent p-values (a chi-squared tail of even degrees)."""
    half = -sum(math.log(max(p, 1e-300)) for p in ps)
    term, total = 1.0, 1.0
    for i in range(1, len(ps)):
        term *= half / i
        total += term
    return min(1.0, math.exp(-half) * total)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) by start, then by kind as listed."""
    found = [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def encoding(key: str) -> tuple[int, str] | None:
    """Number and characters of the smallest alphabet with all characters of ``key`` (padding aside)."""
    own = set(key)
    return next(((i, a) for i, (_, a) in enumerate(ALPHABETS) if own <= set(a)), None)


def uniform_battery(key: str, alphabet: str) -> float:
    """Combined p-value of the three tests under random symbols of the alphabet."""
    n, k = len(key), len(alphabet)
    code = np.array([alphabet.index(c) for c in key], dtype=float)
    counts = np.bincount(code.astype(int), minlength=k)
    x = k / n * float((counts**2).sum()) - n
    # moments of the statistic under uniform symbols are exact; few symbols make the usual approximation poor
    chi = _normal_tail((x - (k - 1)) / math.sqrt(max(2 * (k - 1) * (n - 1) / n, 1e-9)))
    high = code >= k / 2
    up, down = int(high.sum()), int(n - high.sum())
    if up and down:
        mean = 1 + 2 * up * down / n
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        runs = 2 * _normal_tail(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var))
    else:
        runs = 2.0 ** (1 - n)
    centred = code - code.mean()
    spread = float((centred**2).sum())
    serial = 2 * _normal_tail(abs(float((centred[1:] * centred[:-1]).sum()) / spread + 1 / n) * math.sqrt(n)) if spread else 0.0
    return _fisher(chi, _class_uniformity(key, alphabet), runs, serial)


def _class_uniformity(key: str, alphabet: str) -> float:
    """Chi-squared over small letters, capitals, digits and signs, which a short key can fill where 64 symbols are too many cells."""
    sizes, seen = np.zeros(4), np.zeros(4)
    for c in alphabet:
        sizes[_kind(c)] += 1
    for c in key:
        seen[_kind(c)] += 1
    there = sizes > 0
    cells = int(there.sum())
    if cells < 2:
        return 1.0
    expected = len(key) * sizes[there] / len(alphabet)
    x, degrees = float(((seen[there] - expected) ** 2 / expected).sum()), cells - 1
    cube = ((x / degrees) ** (1 / 3) - (1 - 2 / (9 * degrees))) / math.sqrt(2 / (9 * degrees))
    return _normal_tail(cube)


def text_p_value(key: str, alphabet: str, freq: np.ndarray, change: float) -> float:
    """How likely text with byte frequencies ``freq`` and this rate of class changes is to look as random as the key."""
    n, k = len(key), len(alphabet)
    q = freq[[ord(c) for c in alphabet]] + 1.0
    q = q / q.sum()
    counts = np.array([key.count(c) for c in alphabet], dtype=float)
    s = float((counts**2).sum())
    q2, q3 = float((q**2).sum()), float((q**3).sum())
    mean = n + n * (n - 1) * q2
    var = max(2 * n * (n - 1) * (q2 + 2 * (n - 2) * q3 - (2 * n - 3) * q2**2), 1e-9)
    even = _normal_tail((mean - s) / math.sqrt(var))
    changes = sum(_kind(a) != _kind(b) and 3 not in (_kind(a), _kind(b)) for a, b in zip(key, key[1:]))  # names and paths have signs
    expected = max(change, 1e-6) * (n - 1)
    return _fisher(even, _poisson_tail(changes, expected))


def _poisson_tail(seen: int, expected: float) -> float:
    """P(at least ``seen``) of a Poisson count, by logarithms: keys of any length have a tail that neither vanishes nor rounds to nothing."""
    if seen <= expected:
        return 1.0  # at least about a half: no sign of a key
    first = seen * math.log(expected) - expected - math.lgamma(seen + 1)
    total, ratio, i = 1.0, 1.0, seen
    while ratio > 1e-17:
        i += 1
        ratio *= expected / i
        total += ratio
    return min(1.0, max(math.exp(max(first + math.log(total), -690.0)), 1e-300))


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def _class_table() -> np.ndarray:
    """Class of each byte: small letter, capital, digit; 9 for everything else."""
    table = np.full(256, 9, np.uint8)
    for i, (a, z) in enumerate((("a", "z"), ("A", "Z"), ("0", "9"))):
        table[ord(a):ord(z) + 1] = i
    return table


def survey(docs: DataFrame) -> DataFrame:
    """A row per document (doc_id, base, candidates), and a row per batch with byte counts, and class changes and pairs in words."""
    schema = (f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base array<struct<start:int,rank:int,end:int,kind:string>>, "
              "candidates array<struct<start:int,end:int,key:string,alphabet:int,uniform:double>>, counts array<long>, changes long, pairs long")

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        base_type = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        cand_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("key", pa.string()), ("alphabet", pa.int32()), ("uniform", pa.float64())]))
        names = ["doc_id", "base", "candidates", "counts", "changes", "pairs"]
        classes = _class_table()
        for batch in batches:
            for part in text_slices(batch, 1):
                texts = part.column(1).to_pylist()
                base = [base_spans(t) for t in texts]
                found = [_candidates(t, b) for t, b in zip(texts, base)]
                raw = np.frombuffer("\n".join(texts).encode(), np.uint8)
                kinds = classes[raw]
                inside = (kinds[1:] < 9) & (kinds[:-1] < 9) if len(kinds) > 1 else np.zeros(0, bool)
                changed = int((inside & (kinds[1:] != kinds[:-1])).sum()) if len(inside) else 0
                n = len(texts)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([[{"start": s, "rank": KINDS.index(k), "end": e, "kind": k} for s, k, e in b] for b in base], base_type),
                    pa.array(found, cand_type), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names)
                yield pa.RecordBatch.from_arrays([
                    pa.nulls(1, part.column(0).type), pa.nulls(1, base_type), pa.nulls(1, cand_type),
                    pa.array([np.bincount(raw, minlength=128)[:128].tolist()], pa.list_(pa.int64())), pa.array([changed], pa.int64()), pa.array([int(inside.sum())], pa.int64())], names=names)

    return docs.mapInArrow(work, schema)


def _candidates(text: str, base: list) -> list[dict]:
    out = []
    if any(len(w) >= 20 for w in text.split()):
        starts, ends = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))  # by start; the furthest end so far
        for m in CANDIDATE.finditer(text):
            parts = [m.span(1)] if encoding(m.group(1)) else sorted({p.span() for pattern in PARTS for p in pattern.finditer(text, *m.span(1))})
            found = []
            for start, end in parts:
                before = bisect_right(starts, (m.end() if end == m.end(1) else end) - 1)  # known forms that start in front of its end
                if not before or ends[before - 1] <= start:
                    key = text[start:end]
                    alphabet, symbols = encoding(key)
                    found.append({"start": start, "end": m.end() if end == m.end(1) else end, "key": key, "alphabet": alphabet, "uniform": uniform_battery(key, symbols)})
            kept: list[dict] = []
            for c in sorted(found, key=lambda c: (c["uniform"] < REJECT, -len(c["key"]), c["start"])):
                if all(c["end"] <= k["start"] or k["end"] <= c["start"] for k in kept):
                    kept.append(c)
            out += sorted(kept, key=lambda c: c["start"])
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = FALSE_DISCOVERY_RATE) -> DataFrame:
    """One row per row of ``docs``: doc_id, spans (start, rank, end, kind; by start, then kind as listed, random ones last).

    Offsets are code points, end exclusive; an assign span is the whole match.  A null text counts as empty and has no
    spans; null ids and repeated rows are rows like others.  No rows give no rows; other columns are not looked at.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ship(docs.sparkSession)
    seen = checkpointed(survey(texts))  # spans and counts only: no later step reads a text
    rows = seen.filter("counts is null").select("doc_id", "base", "candidates")
    summed = seen.filter("counts is not null").agg(*[F.sum(F.col("counts")[i]) for i in range(128)], F.sum("changes"), F.sum("pairs")).first()
    freq = np.array([x or 0 for x in summed[:128]], dtype=float)
    change = (summed[128] or 0) / max(1, summed[129] or 0)

    def judge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("stratum", pa.int32()), ("step", pa.int32())]))
        for batch in batches:
            out = []
            for row in batch.column(2).to_pylist():
                found = []
                for c in row:
                    p = text_p_value(c["key"], ALPHABETS[c["alphabet"]][1], freq, change) if c["uniform"] >= REJECT else 1.0
                    step = min(GRID - 1, int(-math.log10(max(p, 1e-300)) * STEPS_A_DECADE))
                    found.append({"start": c["start"], "end": c["end"], "stratum": c["alphabet"] * 32 + len(c["key"]).bit_length(), "step": step})
                out.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["doc_id", "base", "judged"])

    schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, base array<struct<start:int,rank:int,end:int,kind:string>>, judged array<struct<start:int,end:int,stratum:int,step:int>>"
    judged = rows.mapInArrow(judge, schema)
    cells = judged.select(F.explode("judged").alias("j")).groupBy("j.stratum", "j.step").agg(F.count(F.lit(1)).alias("n")).collect()
    least = discovery_steps([(c["stratum"], c["step"], c["n"]) for c in cells], rate)
    limit = F.create_map(*[F.lit(x) for pair in least.items() for x in pair]) if least else None
    base = F.col("base")
    if limit is None:
        return judged.select("doc_id", F.array_sort(base).alias("spans"))
    taken = F.transform(F.filter("judged", lambda c: c["step"] >= F.coalesce(F.element_at(limit, c["stratum"]), F.lit(GRID))),
                        lambda c: F.struct(c["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), c["end"].alias("end"), F.lit(RANDOM).alias("kind")))
    return judged.select("doc_id", F.array_sort(F.concat(base, taken)).alias("spans"))


def discovery_steps(cells: list[tuple[int, int, int]], rate: float) -> dict[int, int]:
    """For each stratum the lowest grid step whose candidates are discoveries at this rate; strata without any are left out.

    A step's p-value is its upper end, so the rate holds for the values before rounding too.
    """
    out: dict[int, int] = {}
    for stratum in {c[0] for c in cells}:
        own = {step: n for s, step, n in cells if s == stratum}
        total, above = sum(own.values()), 0
        for step in range(GRID - 1, -1, -1):
            above += own.get(step, 0)
            if above and 10.0 ** (-step / STEPS_A_DECADE) * total <= rate * above:
                out[stratum] = step
    return out


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != RANDOM)
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(written(base), 256).alias("base_sha256"), written("spans").alias("spans"), count(RANDOM))
