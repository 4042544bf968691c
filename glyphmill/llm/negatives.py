"""Hard-negative mining with a multiway hyperplane tree (GNAT) over distances.

Scores are inner products of whole-number vectors.  With one more component, which brings every row to the length of the longest
(and is 0 for an anchor), a score s is a distance: d(s)^2 = |a|^2 + longest^2 - 2 s.  So the first rows by score are the nearest ones, and
a window of scores is an annulus around the anchor.

The tree is fitted on a bounded sample and holds every row.  A node has several split points, spread out greedily; a row goes to the nearest
one, that is, into one cell of their hyperplanes.  For each pair of split points the node keeps the range of distances from the one to all rows below the
other, taken over all rows.  An anchor at distance D from a split point can only find rows of an annulus (r, R) in a sibling whose range meets
[max(D - R, r - D), D + R]; all other siblings are left out with everything below them.  Rows of the leaves that remain are compared exactly.

An anchor first looks into its own leaf, whose k-th row narrows the annulus, and then into the leaves that the narrowed one still meets.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from glyphmill.llm.base import checkpointed, read, ship

#: The tree is fitted on at most so many rows, those with the smallest hash, and at most so many bytes of them.
SAMPLE_ROWS, SAMPLE_BYTES = 8192, 16 << 20
#: Split points of a node, rows of a leaf at which splitting ends (estimated from the sample), and rows of the sample that a node needs.
FANOUT, LEAF_ROWS, NODE_SAMPLE = 16, 512, 32
#: Rows of a leaf, and anchors, that are compared in one go.
BLOCK_ROWS, CHUNK_ROWS = 2048, 256
FAR = (1 << 62)


class Tree:
    """Split points by node; ``child`` is a node's number, or -1 - leaf."""

    def __init__(self, sample: np.ndarray, rows: int, longest: float):
        self.longest = longest
        self.points: list[np.ndarray] = []
        self.child: list[list[int]] = []
        self.leaves = 0
        self.low: np.ndarray | None = None
        self.high: np.ndarray | None = None
        lifted = self.lifted(sample)
        self.root = self._grow(lifted, max(rows, 1), np.random.default_rng(11))
        self.width = max([len(p) for p in self.points], default=0)

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        """Rows with the component that makes all of them equally long."""
        own = vectors.astype(float)
        return np.hstack([own, np.sqrt(np.maximum(self.longest - (own**2).sum(axis=1), 0.0))[:, None]])

    def _grow(self, sample: np.ndarray, rows: float, rng) -> int:
        if rows > LEAF_ROWS and len(sample) >= NODE_SAMPLE:
            points = self._spread(sample, min(FANOUT, max(2, -(-int(rows) // LEAF_ROWS))), rng)
            if len(points) > 1:
                node = len(self.points)
                self.points.append(points)
                self.child.append([])
                nearest = distances(sample, points).argmin(axis=1)
                for j in range(len(points)):
                    part = sample[nearest == j]
                    self.child[node].append(self._grow(part, rows * len(part) / len(sample), rng))
                return node
        self.leaves += 1
        return -self.leaves

    @staticmethod
    def _spread(sample: np.ndarray, k: int, rng) -> np.ndarray:
        """Up to k different points, each the farthest from those before among three times as many candidates."""
        candidates = np.unique(sample[rng.choice(len(sample), min(3 * k, len(sample)), replace=False)], axis=0)
        chosen = [0]
        gap = distances(candidates, candidates[:1])[:, 0]
        while len(chosen) < k and gap.max() > 0:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, distances(candidates, candidates[chosen[-1:]])[:, 0])
        return candidates[chosen]

    def place(self, lifted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Each row's leaf; ``low`` and ``high`` (node, split point, child) take in its distances."""
        leaf = np.zeros(len(lifted), np.int64)
        todo = [(self.root, np.arange(len(lifted)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                leaf[rows] = -1 - node
                continue
            d = distances(lifted[rows], self.points[node])
            nearest = d.argmin(axis=1)
            for j, child in enumerate(self.child[node]):
                own = nearest == j
                if own.any():
                    k = len(self.points[node])
                    low[node, :k, j] = np.minimum(low[node, :k, j], d[own].min(axis=0))
                    high[node, :k, j] = np.maximum(high[node, :k, j], d[own].max(axis=0))
                    todo.append((child, rows[own]))
        return leaf

    def visits(self, query: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, which queries) for each leaf that may hold a row of a query's annuli ``inner`` .. ``outer`` (query, annulus); empty ones have inner > outer."""
        slack = 1e-6 * np.sqrt(self.longest) + 1e-9
        todo = [(self.root, np.flatnonzero((inner <= outer).any(axis=1)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -1 - node, rows
                continue
            d = distances(query[rows], self.points[node])  # (query, split point)
            r, R = inner[rows][:, :, None], outer[rows][:, :, None]
            least = np.maximum(d[:, None, :] - R, r - d[:, None, :]) - slack  # (query, annulus, split point)
            most = d[:, None, :] + R + slack
            for j, child in enumerate(self.child[node]):
                low, high = self.low[node, :d.shape[1], j], self.high[node, :d.shape[1], j]
                meets = ((high >= least) & (low <= most)).all(axis=2) & (inner[rows] <= outer[rows])
                todo.append((child, rows[meets.any(axis=1)]))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, (len(a), len(b)), without the cancellation of the product form."""
    return np.stack([np.sqrt(((a - p) ** 2).sum(axis=1)) for p in b], axis=1)


def _matrix(cells, kind: str, dims: int) -> np.ndarray:
    """Rows of packed components, from an Arrow binary array without nulls."""
    return np.frombuffer(b"".join(c.as_buffer() for c in cells), kind).reshape(len(cells), dims)


def _placed(rows: DataFrame, tree: Tree, kind: str, dims: int) -> DataFrame:
    """(leaf, id, label, anchor, vector) of each row, and a row of distance ranges per task."""
    shape = (len(tree.points), tree.width, tree.width)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        low, high = np.full(shape, np.inf), np.full(shape, -np.inf)
        for batch in batches:
            lists = batch.column(3)
            vectors = np.zeros((batch.num_rows, dims), np.int64)
            size = np.diff(lists.offsets.to_numpy())
            vectors[np.repeat(np.arange(batch.num_rows), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
            leaf = tree.place(tree.lifted(vectors), low, high) if batch.num_rows else np.zeros(0, np.int64)
            raw, step = vectors.astype(kind).tobytes(), dims * np.dtype(kind).itemsize
            cells = pa.array([raw[i:i + step] for i in range(0, step * batch.num_rows, step)] if step else [b""] * batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), *batch.columns[:3], cells, *[pa.nulls(batch.num_rows, pa.list_(pa.float64()))] * 2],
                                             names=["leaf", "id", "label", "anchor", "vector", "low", "high"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, t) for t in (pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.binary())]
                                         + [pa.array([x.ravel().tolist()], pa.list_(pa.float64())) for x in (low, high)], names=["leaf", "id", "label", "anchor", "vector", "low", "high"])

    return rows.select("id", "label", "anchor", "vector").mapInArrow(
        work, "leaf int, id long, label string, anchor boolean, vector binary, low array<double>, high array<double>")


def _extremes(rows: DataFrame, column: str, how, shape: tuple, start: float) -> np.ndarray:
    out = np.full(int(np.prod(shape)), start)
    for place, value in rows.select(F.posexplode(column).alias("place", "v")).groupBy("place").agg(how("v")).collect():
        out[place] = value
    return out.reshape(shape)


KEY = ["anchor_id", "anchor_hash"]
TARGETS = "array<struct<slot:int,least:long,most:long>>"


class Index:
    """All rows in the leaves of a tree; ``anchors`` and ``blocks`` are tables in the shared folder."""

    def __init__(self, rows: DataFrame):
        """``rows``: id long, label string, vector array<long>, anchor boolean, all without nulls."""
        spark = rows.sparkSession
        square = F.aggregate("vector", F.lit(0).cast("long"), lambda a, x: a + x * x)
        largest = F.array_max(F.transform("vector", lambda x: F.abs(x)))
        n, dims, longest, most = rows.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.max(square), F.max(largest)).first()
        self.rows, self.dims, longest, most = n, dims or 0, longest or 0, most or 0
        self.kind = "<i2" if most < 1 << 15 else "<i8"
        #: Are all products sums of whole numbers that doubles hold exactly?
        self.exact = most * most * max(self.dims, 1) < 1 << 53
        wanted = max(NODE_SAMPLE, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(self.dims, 1))))
        sample = np.zeros((0, self.dims))
        if n > LEAF_ROWS:
            picked = rows.select("id", "vector").orderBy(F.xxhash64("id", "vector"), "id").limit(wanted).collect()
            sample = np.array([list(r["vector"]) + [0] * (self.dims - len(r["vector"])) for r in picked], float)
        self.tree = tree = Tree(sample, n, float(longest))
        placed = checkpointed(_placed(rows, tree, self.kind, self.dims))
        if tree.points:
            ranges, shape = placed.filter("leaf is null"), (len(tree.points), tree.width, tree.width)
            tree.low, tree.high = _extremes(ranges, "low", F.min, shape, np.inf), _extremes(ranges, "high", F.max, shape, -np.inf)
        held = placed.filter("leaf is not null").select("leaf", "id", "label", "anchor", "vector")
        sizes = held.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
        dealt = held.join(F.broadcast(sizes), "leaf").withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.col("blocks")).cast("int"))
        self.blocks = checkpointed(dealt.groupBy("leaf", "block").agg(F.collect_list(F.struct("id", "label", "vector")).alias("rows")))
        self.places = checkpointed(self.blocks.select("leaf", "block"))
        self.anchors = checkpointed(held.filter("anchor").select(F.col("id").alias("anchor_id"), F.xxhash64("id", "label", "vector").alias("anchor_hash"), "label", "vector", "leaf")
                                    .dropDuplicates(KEY))
        self.chunks = max(1, -(-self.anchors.count() // CHUNK_ROWS))

    def _visits(self, asked: DataFrame, own: bool) -> DataFrame:
        """``asked`` (anchors with ``targets``) once per leaf to look into: their own one, or the others that their targets' annuli meet."""
        tree, kind, dims = self.tree, self.kind, self.dims
        if own:
            return asked.withColumn("at", F.col("leaf"))
        if not tree.points:
            return asked.limit(0).withColumn("at", F.col("leaf"))

        def work(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                vectors = _matrix(batch.column(3), kind, dims).astype(float)
                square = (vectors**2).sum(axis=1)
                targets = batch.column(5).to_pylist()
                width = max([len(t) for t in targets], default=0)
                inner, outer = np.ones((len(targets), max(width, 1))), np.zeros((len(targets), max(width, 1)))
                for i, ts in enumerate(targets):
                    for j, t in enumerate(ts):
                        if t["least"] <= t["most"]:
                            inner[i, j] = max(square[i] + tree.longest - 2.0 * t["most"], 0.0) ** 0.5
                            outer[i, j] = max(square[i] + tree.longest - 2.0 * t["least"], 0.0) ** 0.5
                leaf = batch.column(4).to_numpy()
                query = np.hstack([vectors, np.zeros((len(vectors), 1))])
                for at, rows in tree.visits(query, inner, outer):
                    rows = rows[leaf[rows] != at]
                    if len(rows):
                        yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, pa.array(np.full(len(rows), at, np.int32))], names=[*batch.schema.names, "at"])

        return asked.mapInArrow(work, f"anchor_id long, anchor_hash long, label string, vector binary, leaf int, targets {TARGETS}, at int")

    def _look(self, asked: DataFrame, own: bool, same: bool, k: int) -> DataFrame:
        """(anchor_id, anchor_hash, slot, id, score): of each visited block up to k rows per target, by score and id."""
        kind, dims, exact = self.kind, self.dims, self.exact
        visits = self._visits(asked, own).withColumn("chunk", F.pmod(F.col("anchor_hash"), F.lit(self.chunks)))
        packed = visits.groupBy("at", "chunk").agg(F.collect_list(F.struct("anchor_id", "anchor_hash", "label", "vector", "targets")).alias("asked"))
        met = packed.join(self.places, packed["at"] == self.places["leaf"]).select("leaf", "block", "asked").join(self.blocks, ["leaf", "block"]).select("asked", "rows")

        def work(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                for row in range(batch.num_rows):
                    asked, rows = batch.column(0)[row].values, batch.column(1)[row].values
                    a, x = _matrix(asked.field("vector"), kind, dims), _matrix(rows.field("vector"), kind, dims)
                    if exact:
                        scores = (a.astype(float) @ x.astype(float).T).astype(np.int64)
                    else:
                        scores = np.stack([(x * v).sum(axis=1) for v in a])
                    ids, anchor = rows.field("id").to_numpy(), asked.field("anchor_id").to_numpy()
                    coded = rows.field("label").dictionary_encode()
                    code, names = coded.indices.to_numpy(), {v: i for i, v in enumerate(coded.dictionary.to_pylist())}
                    out: tuple[list, ...] = ([], [], [], [], [])
                    for i, (label, key, targets) in enumerate(zip(asked.field("label").to_pylist(), asked.field("anchor_hash").to_pylist(), asked.field("targets").to_pylist())):
                        alike = code == names.get(label, -1)
                        open_to = np.flatnonzero(alike & (ids != anchor[i]) if same else ~alike)
                        score = scores[i, open_to]
                        for t in targets:
                            hit = np.flatnonzero((score >= t["least"]) & (score <= t["most"]))
                            if len(hit):
                                if len(hit) > k:
                                    hit = hit[score[hit] >= -np.partition(-score[hit], k - 1)[k - 1]]
                                best = hit[np.lexsort((ids[open_to[hit]], -score[hit]))[:k]]
                                for column, values in zip(out, ([int(anchor[i])] * len(best), [key] * len(best), [t["slot"]] * len(best), ids[open_to[best]].tolist(), score[best].tolist())):
                                    column.extend(values)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                                                     names=["anchor_id", "anchor_hash", "slot", "id", "score"])

        return met.mapInArrow(work, "anchor_id long, anchor_hash long, slot int, id long, score long")

    def first(self, targets: DataFrame, same: bool, k: int) -> DataFrame:
        """The first k rows per target: (anchor_id, anchor_hash, slot, rank, id, score).

        ``targets``: anchors with an array of (slot, least, most), the scores that a target admits.
        """
        asked = targets.select(*KEY, "label", "vector", "leaf", "targets")
        near = checkpointed(ranked(self._look(asked, True, same, k), k))
        reached = near.filter(F.col("rank") == k).groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("reached"))
        raised = asked.join(reached, KEY, "left").withColumn("targets", F.transform("targets", lambda t: F.struct(
            t["slot"].alias("slot"), F.greatest(t["least"], F.coalesce(F.element_at("reached", t["slot"]), t["least"])).alias("least"), t["most"].alias("most")))).drop("reached")
        far = self._look(raised.select(*KEY, "label", "vector", "leaf", "targets"), False, same, k)
        return ranked(near.drop("rank").unionByName(far), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy(*KEY, "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def usable(vector: Column) -> Column:
    """Is there a vector, without a null or non-finite component?"""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & whole, F.lit(False))


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows where ``anchor`` holds.

    An anchor's positives are its first rows of the same label by score, then smaller id; for each, the negatives are the first rows of another
    label with low * positive_score <= 100 * score <= high * positive_score.  Vectors hold whole numbers (fractions are cut off); a vector's squared length
    must fit in 64 bits, else the job fails with an overflow.  A shorter
    vector counts as filled up with zeros.  Rows without an id, a label or a vector, or with a null or non-finite component, take no part.
    Rows that repeat an id are rows of their own, but no positives of an anchor with this id; equal anchor rows are answered once.  A positive of negative score
    has no negatives.  No rows give no rows; other columns are not looked at.
    """
    ship(vectors.sparkSession)
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
        F.transform(vector_col, lambda x: x.cast("long")).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    index = Index(rows)
    target = lambda slot, least, most: F.struct(slot.cast("int").alias("slot"), least.cast("long").alias("least"), most.cast("long").alias("most"))
    whole = index.anchors.withColumn("targets", F.array(target(F.lit(0), F.lit(-FAR), F.lit(FAR))))
    chosen = checkpointed(index.first(whole, True, positives).select(*KEY, F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    p = F.col("positive_score").cast("decimal(20,0)")
    least, most = F.ceil(p * low / 100), F.floor(p * high / 100)
    windows = chosen.filter(least <= most).groupBy(*KEY).agg(F.collect_list(target(F.col("slot"), least, most)).alias("targets"))
    found = index.first(index.anchors.join(windows, KEY), False, negatives)
    return found.join(chosen, [*KEY, "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's relabelled rows, in 256ths."""
    rows = read(spark, sf_dir, "embeddings")
    rows = rows.filter(usable(F.col("embedding"))).select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("embedding"))
    return mine(rows, F.col("vec_id") % 50 == 0)


ORACLE = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id as id, list_dot_product(a.q, b.q)::bigint as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
), p as (
  select anchor_id, id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select p.anchor_id, positive_id, (row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.id))::int as rank,
  s.id as negative_id, positive_score, s.score as negative_score
from p join s on p.anchor_id = s.anchor_id and not s.same and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.id) <= 3
"""
