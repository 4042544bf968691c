"""Near-duplicate groups with SetSketch registers.

Sketch.  Every shingle of a document is the seed of a Poisson process whose points fall on ``m`` registers at random; a
register keeps its earliest point, on an exponential scale of base b and truncated to 16 bits.  Registers of a union are the maxima of the
registers, so sketches merge, and two sets agree in a register with a probability close to their Jaccard similarity.

Search.  Documents with equal shingle sets are one class, and only classes go on.  Bands of r registers give buckets;
r is the largest for which a pair right at the threshold is missed with a probability below ``miss``.  A pair that
shares a bucket is estimated from all registers and both set sizes by maximum likelihood; it is set aside only when the
likelihood at the threshold is e**-SLACK of the best one or less.  Whatever is left is verified on the full sets.

Groups.  Links are wanted for the components they make, so pairs inside a component need no look:

* hub rounds: every member of a bucket meets the bucket's hub only, and keeps its best estimated hub that is in another
  component.  Rounds go on while they join a fair share of the open members;
* the rest is exact: in every bucket that still holds several components, each member outside the bucket's largest
  component (stated query rows) meets all members, block against block inside tasks.  A pair is looked at in the first bucket
  it shares, estimated, and verified on the full sets right there; only links that join components which the block has
  not joined yet are looked for and leave the task.

So a large group costs rows in proportion to its size, a hot bucket is dealt over many tasks, and no pair of different
texts that share a bucket is lost to a cap.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphmill.llm.base import checkpointed, drop_rows, narrowed, read, release, release_arrow, ship, slot_filter, slot_of, text_slices

REGISTERS = 256
BASE = 1.001
RATE = 20.0
#: UTF-8 bytes of texts that a worker sketches at a time (one text at least).
AT_A_TIME = 2 << 20
#: Members of a side of a block in the last step and shingles of theirs, about, and pairs whose registers are compared at once.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
AT_ONCE = 16_384
#: Log-likelihood below the best that a pair right at the threshold exceeds with a probability of 4e-6.
SLACK = 10.0

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_sets(texts, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of an Arrow array (no nulls).

    Words are separated by ASCII white space, A-Z count as a-z.  Fewer than ``k`` words are one shingle.
    """
    import pyarrow.compute as pc
    import xxhash

    runs = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = runs.values
    coded = flat.dictionary_encode()
    words = coded.dictionary.to_pylist()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    real = np.fromiter((w != "" for w in words), bool, len(words))
    code = coded.indices.to_numpy()
    hashes, keep = (table[code], real[code]) if len(code) else (np.zeros(0, np.uint64), np.zeros(0, bool))
    bounds = np.concatenate([[0], np.cumsum(keep)])[runs.offsets.to_numpy()]
    hashes = hashes[keep]
    rolled = np.full(max(0, len(hashes) - k + 1), k, np.uint64)
    for j in range(k):
        rolled = _mix(rolled * _GOLDEN + hashes[j:len(hashes) - k + 1 + j])
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo >= k:
            out.append(np.unique(rolled[lo:hi - k + 1]))
        elif hi > lo:
            whole = np.full(1, hi - lo, np.uint64)
            for h in hashes[lo:hi]:
                whole = _mix(whole * _GOLDEN + h)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """SetSketch registers, a row of ``m`` 16-bit values per set."""
    best = np.full(len(sets) * m, np.inf)
    seed = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at, step = np.zeros(len(seed)), 0
    while len(seed):
        points = int(np.clip(65_536 // len(seed), 1, 64))
        turns = (np.arange(step, step + points, dtype=np.uint64) + _U(1)) * _GOLDEN
        bits = _mix(seed[:, None] + turns[None, :])
        wait = -np.log(((bits >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53)
        when = at[:, None] + np.cumsum(wait, axis=1)
        slot = (_mix(bits ^ _U(0xD6E8FEB86659FD93)) % _U(m)).astype(np.int64) + doc[:, None] * m
        np.minimum.at(best, slot.ravel(), when.ravel())
        latest = best.reshape(-1, m).max(axis=1)
        open_ = when[:, -1] < latest[doc]
        seed, doc, at, step = seed[open_], doc[open_], when[open_, -1], step + points
    with np.errstate(divide="ignore", invalid="ignore"):
        level = np.floor(1 - np.log(best / (RATE * m)) / np.log(BASE))
    return np.nan_to_num(np.clip(level, 0, 65_535), nan=0, posinf=0, neginf=0).astype(np.uint16).reshape(len(sets), m)


def passes(ra: np.ndarray, rb: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether similarity ``threshold`` is not ruled out by the registers, and the likelihood's estimate.

    ra, rb: registers, a row per pair; n_a, n_b: sizes of the sets.  A pair that agrees in so few registers that even
    a binomial tail of 1e-15 at the threshold excludes it is not estimated further.
    """
    m = ra.shape[1]
    ok, best_of_all = np.zeros(len(n_a), bool), np.zeros(len(n_a))
    same = (ra == rb).sum(axis=1)
    at = np.flatnonzero((same >= m * threshold - 8 * np.sqrt(m * threshold * (1 - threshold)) - 1)
                        & (np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b) - 1e-9))
    if not len(at):
        return ok, best_of_all
    plus, minus, n_a, n_b = (ra[at] > rb[at]).sum(axis=1), (ra[at] < rb[at]).sum(axis=1), n_a[at], n_b[at]
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    top = np.minimum(u / v, v / u)
    chance = lambda x: -np.log1p(-np.maximum(x, 1e-12) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        p, q = chance(u - v * j), chance(v - u * j)
        return plus * np.log(p) + minus * np.log(q) + (m - plus - minus) * np.log(np.maximum(1 - p - q, 1e-12))

    lo, hi = np.zeros_like(top), top.copy()
    for _ in range(24):  # the likelihood is concave: a golden section finds its top
        a, b = hi - (hi - lo) * 0.618, lo + (hi - lo) * 0.618
        left = likelihood(a) > likelihood(b)
        hi, lo = np.where(left, b, hi), np.where(left, lo, a)
    best = (lo + hi) / 2
    close = (best >= threshold) | (likelihood(best) - likelihood(np.minimum(threshold, top)) <= SLACK)
    ok[at], best_of_all[at] = close, best
    return ok, best_of_all


def band_rows(m: int, threshold: float, miss: float = 1e-6) -> int:
    """The largest number of registers per band at which a pair at the threshold is missed with at most ``miss``."""
    fit = [r for r in range(1, 17) if (1 - threshold**r) ** (m // r) <= miss]
    return max(fit, default=1)


def sketches(docs: DataFrame, k: int, m: int = REGISTERS) -> DataFrame:
    """doc_id, _th (hash of the text), n, f1, f2 (fingerprint of the set), regs (m 16-bit values as bytes)."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in text_slices(batch, 2, AT_A_TIME):
                sets = shingle_sets(part.column(2), k)
                regs = registers(sets, m)
                n = np.array([len(s) for s in sets], np.int64)
                f1 = np.array([s.sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                f2 = np.array([_mix(s ^ _GOLDEN).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n), pa.array(f1), pa.array(f2), pa.array([r.tobytes() for r in regs], pa.binary())],
                    names=["doc_id", "_th", "n", "f1", "f2", "regs"])
        release_arrow()

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("_th"), text.alias("text")).mapInArrow(
        work, "doc_id long, _th long, n long, f1 long, f2 long, regs binary")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """rep, items: the shingle hashes of each document."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in text_slices(batch, 1, AT_A_TIME):
                sets = shingle_sets(part.column(1), k)
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                values = (np.concatenate(sets) if sets else np.zeros(0, np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["rep", "items"])

    return docs.select(F.col("doc_id").alias("rep"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(work, "rep long, items array<long>")


def _estimated(pairs: DataFrame, regs: DataFrame, m: int, threshold: float) -> DataFrame:
    """a, b, estimate of the pairs that the registers do not rule out."""
    one = lambda end: regs.select(F.col("rep").alias(end), F.col("n").alias("n" + end), F.col("regs").alias("r" + end))
    both = pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "na", "nb", "ra", "rb")

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for x in batches:
            ra, rb = (np.frombuffer(b"".join(x.column(i).to_pylist()), np.uint16).reshape(-1, m) for i in (4, 5))
            na, nb = (x.column(i).to_numpy().astype(float) for i in (2, 3))
            ok, best = passes(ra, rb, na, nb, threshold)
            at = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([x.column(0).take(at), x.column(1).take(at), pa.array(best[ok])], names=["a", "b", "estimate"])

    return both.mapInArrow(work, "a long, b long, estimate double")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, looked: DataFrame | None) -> DataFrame:
    """(a, b, linked) of the pairs: is 100 * common >= percent * union?  Together with the pairs looked at before."""
    one = lambda end: sets.select(F.col("rep").alias(end), F.col("items").alias("s" + end))
    both = pairs.select("a", "b").join(one("a"), "a").join(one("b"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    done = both.select("a", "b", common.alias("_i"), (F.size("sa") + F.size("sb")).alias("_s")).select(
        "a", "b", (100 * F.col("_i") >= percent * (F.col("_s") - F.col("_i"))).alias("linked"))
    return checkpointed(done if looked is None else narrowed(looked.unionByName(done)))


def _blocks(active: DataFrame, regs: DataFrame, sets: DataFrame, m: int, r: int, percent: int) -> DataFrame:
    """a, b: verified links between ``active`` rows (bucket, band, rep, comp, n) of one bucket but not one component.

    ``outside`` rows are those that are not in their bucket's largest component.  They meet all rows of the bucket, cut in
    blocks of about BLOCK by BLOCK rows, fewer where their sets are large; a block is one group of a repartitioned and sorted stream.
    """
    per = active.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    largest = per.groupBy("bucket").agg(F.max(F.struct("c", "comp", "s")).alias("x"), F.sum("c").alias("size"), F.sum("s").alias("shingles")).select(
        "bucket", F.col("x.comp").alias("main"), "size", "shingles", (F.col("size") - F.col("x.c")).alias("outside"), (F.col("shingles") - F.col("x.s")).alias("shingles_outside"))
    largest = checkpointed(largest)  # a row per bucket; as a table of its own the join can split a hot bucket
    placed = checkpointed(active.join(largest, "bucket"))
    # buckets with the same outside rows: a member of several needs to be in the first of them only, which holds all pairs it can have there
    same = placed.filter("comp <> main").groupBy("bucket").agg(F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("o1"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("o2"))
    rows = placed.join(checkpointed(same), "bucket").withColumns({
        "cols": F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int"),
        "lines": F.greatest(F.ceil(F.col("outside") / BLOCK), F.ceil(F.col("shingles_outside") / BLOCK_SHINGLES)).cast("int")})
    pick = lambda n: F.pmod(F.xxhash64("rep", "bucket"), F.col(n)).cast("int")
    first = rows.groupBy("rep", "outside", "o1", "o2").agg(F.min_by(F.struct("bucket", "band", "comp", "cols", "lines"), F.struct("band", "bucket")).alias("x")).select("rep", "x.*")
    member = first.select("bucket", "band", "rep", "comp", pick("cols").alias("c"), F.explode(F.sequence(F.lit(0), F.col("lines") - 1)).alias("l"), F.lit(0).alias("query"))
    query = rows.filter("comp <> main").select("bucket", "band", "rep", "comp", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("c"), pick("lines").alias("l"), F.lit(1).alias("query"))
    sent = member.unionByName(query).join(regs.join(sets, "rep"), "rep").select(
        "bucket", "c", "l", "band", "query", "rep", "comp", "n", "regs", "items")
    dealt = sent.repartition(F.col("bucket"), F.col("c"), F.col("l")).sortWithinPartitions("bucket", "c", "l", "query")
    threshold = percent / 100

    def compare(rows: list) -> tuple[list[int], list[int]]:
        """Links of the rows of one block: (band, query, rep, comp, n, sketch, items) each."""
        band, query, rep, comp, n = (np.array([x[i] for x in rows]) for i in range(5))
        q, other = np.flatnonzero(query == 1), np.flatnonzero(query == 0)
        if not len(q) or not len(other):
            return [], []
        sketch = np.stack([x[5] for x in rows])
        a, b, code, step = [], [], None, max(1, AT_ONCE // len(other))
        up = np.unique(comp, return_inverse=True)[1]  # label of each row: components that this block has joined share one
        for k in range(0, len(q), step):
            i, j = np.nonzero(up[q[k:k + step]][:, None] != up[other][None, :])
            i, j = q[k:k + step][i], other[j]
            if not len(i):
                continue
            near, _ = passes(sketch[i], sketch[j], n[i].astype(float), n[j].astype(float), threshold)
            i, j = i[near], j[near]
            before = band[0] * r
            if before and len(i):
                same = (sketch[i, :before] == sketch[j, :before]).reshape(len(i), -1, r).all(axis=2).any(axis=1)
                i, j = i[~same], j[~same]
            if not len(i):
                continue
            if code is None:
                ends = np.cumsum([len(x[6]) for x in rows])
                code = np.unique(np.concatenate([x[6] for x in rows]), return_inverse=True)[1]
                mark, starts = np.zeros(int(code.max()) + 1, bool), ends - n
            for x in np.unique(i):
                y = j[i == x]
                y = y[up[y] != up[x]]
                if not len(y):
                    continue
                mine = code[starts[x]:ends[x]]
                mark[mine] = True
                common = np.array([np.count_nonzero(mark[code[starts[z]:ends[z]]]) for z in y])
                mark[mine] = False
                for z in y[100 * common >= percent * (n[x] + n[y] - common)]:
                    if up[z] != up[x]:
                        up[up == up[z]] = up[x]
                        a.append(int(min(rep[x], rep[z])))
                        b.append(int(max(rep[x], rep[z])))
        return a, b

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, held = None, []
        for x in batches:
            a, b = [], []
            keys = list(zip(*(x.column(i).to_pylist() for i in range(3))))
            columns = [x.column(i).to_pylist() for i in range(3, 8)]
            sketch = np.frombuffer(b"".join(x.column(8).to_pylist()), np.uint16).reshape(-1, m)
            offsets, values = x.column(9).offsets.to_numpy(), x.column(9).values.to_numpy()
            for i, own in enumerate(keys):
                if own != key:
                    found = compare(held) if held else ([], [])
                    a, b, key, held = a + found[0], b + found[1], own, []
                held.append((*(c[i] for c in columns), sketch[i], values[offsets[i]:offsets[i + 1]]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        if held:
            a, b = compare(held)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(work, "a long, b long").distinct()


def groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", m: int = REGISTERS,
           slot_bits: int = 24) -> DataFrame:
    """One row per row of ``docs``: doc_id, _th, n_shingles, component_id, kept.

    Documents are linked when ``100 * common >= percent * union`` of their sets of ``k``-word shingles; component_id is
    the smallest id reachable, and kept is whether that is the document's own.  A null or empty text has no shingles
    and links with nothing.  A null id cannot name a component: such rows are reported with component_id null and kept, and
    link nothing.  Rows that share an id are one document; repeated rows all carry its component.  No rows give no
    rows; other columns are not looked at.
    """
    ship(docs.sparkSession)
    threshold = percent / 100
    r = band_rows(m, threshold)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    every = checkpointed(sketches(texts, k, m))
    named = every.filter("doc_id is not null and n > 0")
    classes = named.groupBy("n", "f1", "f2").agg(F.min(F.struct("doc_id", "regs")).alias("x")).select(
        F.col("x.doc_id").alias("rep"), "n", "f1", "f2", F.col("x.regs").alias("regs"))

    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("regs", 2 * r * i + 1, 2 * r)) for i in range(m // r)])
    bands = classes.select("rep", "n", F.posexplode(keys).alias("band", "bucket"))
    shared = bands.groupBy("bucket").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo <> hi").select("bucket")
    crowded = checkpointed(bands.join(shared, "bucket").select("bucket", "band", "rep", "n"))
    regs = checkpointed(classes.join(crowded.select("rep").distinct(), "rep", "left_semi").select("rep", "n", "regs"))
    involved = regs.select("rep")

    passing = slot_filter(texts, involved.select(slot_of(F.col("rep"), slot_bits).alias("s")), slot_of(F.coalesce("doc_id", F.lit(0)), slot_bits), slot_bits, "_in")
    wanted = passing.filter("_in").join(involved, F.col("doc_id") == F.col("rep"), "left_semi").select("doc_id", "text")
    sets = checkpointed(full_sets(wanted, k))
    release(docs.sparkSession)

    looked, settled, comps, before = None, None, None, None
    while True:
        at = crowded.withColumn("comp", F.col("rep")) if comps is None else crowded.join(comps, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        span = at.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("rep").alias("a"), F.max("rep").alias("b"),
                                        F.count(F.lit(1)).alias("members"), F.min_by(F.struct("rep", "comp", "n"), F.xxhash64("rep", F.lit(before or 0))).alias("hub")).filter("lo <> hi")
        if settled is not None:  # a bucket of two whose pair is decided needs no further look
            span = span.filter("members > 2").unionByName(span.filter("members = 2").join(settled, ["a", "b"], "left_anti").select(span.columns))
        span = checkpointed(span.select("bucket", "hub"))
        active = checkpointed(at.join(span, "bucket"))
        count = active.count()
        if not count or before is not None and count > 0.75 * before:
            break
        alike = 100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")  # sets of too different sizes are never linked
        met = checkpointed(active.filter(alike & F.expr("comp <> hub.comp")).select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b"), "rep").distinct())
        likely = checkpointed(_estimated(met.select("a", "b").distinct(), regs, m, threshold))
        ends = met.join(likely, ["a", "b"])
        best = ends.groupBy("rep").agg(F.max_by(F.struct("a", "b"), F.struct("estimate", "a", "b")).alias("x")).select("x.a", "x.b").distinct()
        looked = _verified(best, sets, percent, looked)
        decided = met.select("a", "b").distinct().join(likely, ["a", "b"], "left_anti").unionByName(looked.select("a", "b")).distinct()
        settled = checkpointed(decided if settled is None else narrowed(settled.unionByName(decided)))
        comps = _near_labels(looked.filter("linked"))
        before = count
        del met, likely, ends, best, decided, at
        release(docs.sparkSession)
    if count:
        rest = _blocks(active.select("bucket", "band", "rep", "comp", "n"), regs, sets, m, r, percent).withColumn("linked", F.lit(True))
        looked = checkpointed(rest if looked is None else narrowed(looked.unionByName(rest)))
        del rest, active, at
    del sets, crowded, settled
    release(docs.sparkSession)
    comps = None if looked is None else _components(looked.filter("linked").select("a", "b"))

    named_classes = classes.select("rep", "n", "f1", "f2")
    labelled = named_classes if comps is None else named_classes.join(comps, "rep", "left")
    labelled = checkpointed(labelled.select("n", "f1", "f2", (F.coalesce("comp", "rep") if comps is not None else F.col("rep")).alias("_component")))
    slim = every.select("doc_id", "_th", "n", "f1", "f2")
    known = slim.filter("doc_id is not null and n > 0").join(labelled, ["n", "f1", "f2"]).select("doc_id", "_th", "n", "_component")
    other = slim.filter("doc_id is null or n = 0").select("doc_id", "_th", "n", F.col("doc_id").alias("_component"))
    return known.unionByName(other).select(
        "doc_id", "_th", F.col("n").alias("n_shingles"), F.col("_component").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("_component"), F.lit(True)).alias("kept"))


def _near_labels(links: DataFrame) -> DataFrame:
    """(rep, comp): a label that only linked documents share; not yet the smallest one of the whole component.

    Hub rounds need no more: labels that are too fine cost looks, not links.
    """
    ends = links.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    label = ends.groupBy("rep").agg(F.least(F.min("other"), F.col("rep")).alias("comp"))
    for _ in range(2):
        up = label.select(F.col("rep").alias("comp"), F.col("comp").alias("next"))
        label = checkpointed(label.join(up, "comp").select("rep", F.col("next").alias("comp")))
    return label


def _components(links: DataFrame) -> DataFrame:
    """(rep, comp): the smallest document reachable over the links, for documents that have any.

    Each round every document joins the neighbour (or itself) that comes first in a hashed order, links are then drawn
    between those, and the ones that have become loops are gone.  The hashed order makes chains of any kind shrink by a constant share per
    round.
    """
    left, comps = checkpointed(links.distinct()), None
    while not left.isEmpty():
        ends = left.select(F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x in "ab" for y in "ab"])).alias("e")).select("e.*")
        mapped = checkpointed(ends.groupBy(F.col("a").alias("from")).agg(F.min_by("b", F.xxhash64("b")).alias("to")))
        if comps is None:
            comps = mapped.select(F.col("from").alias("rep"), F.col("to").alias("comp"))
        else:
            comps = checkpointed(comps.join(mapped, comps["comp"] == mapped["from"], "left").select("rep", F.coalesce("to", "comp").alias("comp")))
        first = left.join(mapped, left["a"] == mapped["from"]).select(F.col("to").alias("a"), "b")
        both = first.join(mapped, first["b"] == mapped["from"]).select("a", F.col("to").alias("b"))
        left = checkpointed(both.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        del ends, mapped, first, both
        release(links.sparkSession)
    if comps is None:
        return links.sparkSession.createDataFrame([], "rep long, comp long")
    smallest = comps.groupBy("comp").agg(F.min("rep").alias("_least"))
    return comps.join(checkpointed(smallest), "comp").select("rep", F.col("_least").alias("comp"))


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group (the smallest id), all columns as they are; repeated rows of it become one."""
    found = checkpointed(groups(docs, k, percent, id_col, text_col))
    repeated = found.filter("kept and doc_id is not null").groupBy("doc_id", "_th").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    key = {"doc_id": F.col(id_col).cast("long"), "_th": F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))}
    return drop_rows(docs, key, found.filter("not kept"), once=repeated)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "documents"), k=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), s as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda p: array_to_string(w[p:p + 2], ' ')) end) as sh from d
), n as (select doc_id, len(sh) as n from s
), sig as (select list_sort(sh) as k, min(doc_id) as rep, any_value(len(sh)) as n from s where len(sh) > 0 group by 1
), cls as (select s.doc_id, sig.rep from s join sig on list_sort(s.sh) = sig.k
), e as (select rep, n, unnest(k) as t from sig
), f as (select t, count(*) as df from e group by 1
), ranked as (select rep, n, e.t, row_number() over (partition by rep order by df, e.t) as r from e join f using (t)
), prefix as (select rep, n, t from ranked where r <= n - ceil(0.85 * n) + 1
), cand as (
  select distinct a.rep as a, b.rep as b from prefix a join prefix b using (t) where a.rep < b.rep and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
), common as (select a, b, count(*) as i from cand join e x on x.rep = a join e y on y.rep = b and x.t = y.t group by 1, 2
), link as (select a, b from common join sig p on p.rep = a join sig q on q.rep = b where 100 * i >= 85 * (p.n + q.n - i)
), ends as (select a, b from link union all select b, a from link
), reach as (select distinct a as id, a as lab from ends union select r.id, ends.b from reach r join ends on ends.a = r.lab
), comp as (select id, min(lab) as c from reach group by 1)
select n.doc_id, cast(n.n as bigint) as n_shingles, coalesce(comp.c, cls.rep, n.doc_id) as component_id,
       n.doc_id = coalesce(comp.c, cls.rep, n.doc_id) as kept
from n left join cls using (doc_id) left join comp on comp.id = cls.rep
"""
