"""Ranked lexical search by MaxScore with pair bounds.

Documents are scored where they lie: an index row holds a document's occurrences of all terms that any item asks for, and a task reads its
index rows in blocks, term by term.  Three passes over the index (the texts are read once):

1. ``index``: rows (document, length, postings), and the counts N, L and df.
2. ``intersections``: the largest impact of each term, and for pairs of an item's terms, neighbours by weight, the size of the intersection of their lists and
   the largest joint impact of a document in it.  The lists of each item's heaviest pair also give documents that are scored in full; the
   k-th best of these is a score that the k-th best of all documents reaches.
3. ``search``: a set of terms gives no more than the sum of its maxima; where two of its terms were paired, no more than the larger of their
   joint maximum and each alone.  The longest run of an item's weakest terms whose combined bound stays under the item's threshold is left out
   at first: a document with these terms only cannot be among the best k.  Documents with any other term are candidates; they take the
   weak terms one by one, strongest first, and leave as soon as what is still to come cannot lift them to the threshold, which rises as a task finds documents.

Bounds decide which lists are read, never which documents count: scores are exact whole numbers.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from glyphmill.llm.base import UPPER, checkpointed, read, ship, text_slices

K = 20
#: UTF-8 bytes of item texts that are searched for in one go; more items are dealt into several goes over the documents.
ITEM_BYTES = 4 << 20
#: UTF-8 bytes of texts handled at a time in a worker (one text at least), and bytes of index rows in a block.
TEXT_BYTES, BLOCK_BYTES = 4 << 20, 6 << 20
#: Documents that a block scores in full, per item, for the threshold to start from.
SEEDS = 64
#: The terms of the contract.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans(UPPER, UPPER.lower())


def terms_of(text: str | None) -> list[str]:
    return [t.translate(_LOWER) for t in TERM.findall(text or "")]


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Each byte in lower case, and whether it belongs to a term."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    inside = np.ones(256, bool)
    for first, last in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
        inside[first:last + 1] = False
    return lower, inside


def _words(texts, lower: np.ndarray, inside: np.ndarray):
    """All terms of an Arrow array of texts, as one Arrow array, and the number of terms of each text."""
    import pyarrow as pa

    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = lower[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]]
    offsets -= offsets[0]
    if not len(raw):
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    there = inside[raw]
    begins = there.copy()
    begins[1:] &= ~there[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]  # a text's first byte begins a term of its own
    begins[heads] = there[heads]
    at = np.flatnonzero(begins)
    kept = np.cumsum(there)
    starts = kept[at] - 1
    bounds = np.concatenate([starts, kept[-1:]]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds.tobytes()), pa.py_buffer(raw[there].tobytes()))
    return words, np.diff(np.searchsorted(at, offsets))


def index(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """A row (doc_id, n, postings) per document that has a term of ``vocabulary``, and a row of counts per task.

    ``postings`` are pairs of unsigned 32-bit integers, a term's place in ``vocabulary`` and its occurrences; ``counts`` are documents with
    terms, their terms, and for each term of the vocabulary the documents that have it.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, postings binary, counts array<long>"
    size = len(vocabulary)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        asked, tables, kind = pa.array(vocabulary, pa.string()), _byte_tables(), None
        counts = np.zeros(size + 2, np.int64)
        for batch in batches:
            kind = batch.column(0).type
            for part in text_slices(batch, 1, TEXT_BYTES):
                words, n = _words(part.column(1), *tables)
                counts[0] += int((n > 0).sum())
                counts[1] += int(n.sum())
                term = pc.index_in(words, value_set=asked)
                hit = np.array(term.is_valid())
                doc = np.repeat(np.arange(len(n)), n)[hit]
                pair, tf = np.unique(doc * size + term.drop_null().to_numpy().astype(np.int64), return_counts=True)
                counts[2:] += np.bincount(pair % size, minlength=size) if size else 0
                rows, first = np.unique(pair // max(size, 1), return_index=True)
                raw = np.stack([(pair % max(size, 1)).astype("<u4"), tf.astype("<u4")], axis=1).tobytes()
                ends = 8 * np.append(first, len(pair))
                cells = [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)), pa.array(n[rows]), pa.array(cells, pa.binary()), pa.nulls(len(rows), pa.list_(pa.int64()))],
                    names=["doc_id", "n", "postings", "counts"])
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tolist()], pa.list_(pa.int64()))],
                                             names=["doc_id", "n", "postings", "counts"])

    return docs.mapInArrow(work, schema)


def _totals(rows: DataFrame, column: str, how, size: int) -> np.ndarray:
    """Element-wise total of an array column, added up in Spark; ``size`` numbers reach the driver."""
    out = np.zeros(size, np.int64)
    for place, value in rows.select(F.posexplode(column).alias("place", "v")).groupBy("place").agg(how("v")).collect():
        out[place] = value
    return out


class Block:
    """Impacts of a block of index rows, term by term; documents are numbered in the order of their ids, nulls first."""

    def __init__(self, part, weights: np.ndarray, documents: int, length: int):
        import pyarrow as pa
        import pyarrow.compute as pc

        order = pc.sort_indices(pa.table({"i": part.column(0)}), sort_keys=[("i", "ascending")], null_placement="at_start")
        self.ids, n, cells = (part.column(i).take(order) for i in range(3))
        self.n_docs = len(self.ids)
        count = pc.binary_length(cells).to_numpy(zero_copy_only=False).astype(np.int64) // 8
        flat = np.frombuffer(b"".join(c.as_buffer() for c in cells), "<u4").astype(np.int64)
        term, tf = flat[0::2], flat[1::2]
        m = 75 + 25 * n.to_numpy(zero_copy_only=False).astype(np.int64) * documents // max(length, 1)
        doc = np.repeat(np.arange(self.n_docs), count)
        impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
        by_term = np.argsort(term, kind="stable")
        self.doc, self.impact = doc[by_term], impact[by_term]
        self.at = np.searchsorted(term[by_term], np.arange(len(weights) + 1))
        self.most = np.zeros(len(weights), np.int64)
        some = np.flatnonzero(self.at[1:] > self.at[:-1])
        if len(some):
            self.most[some] = np.maximum.reduceat(self.impact, self.at[some])

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.at[term], self.at[term + 1])
        return self.doc[part], self.impact[part]

    def add(self, score: np.ndarray, docs: np.ndarray, term: int, times: int) -> None:
        """Add a term's impacts to the scores of ``docs`` (sorted)."""
        own, impact = self.of(term)
        if len(own):
            place = np.minimum(np.searchsorted(own, docs), len(own) - 1)
            score += np.where(own[place] == docs, impact[place], 0) * times


def neighbours(item: list[tuple[int, int]], weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of an item's terms that stand next to each other, or one apart, by weight: these can share a bound most tightly."""
    by_weight = sorted((t for t, _ in item), key=lambda t: (weights[t], t))
    return [tuple(sorted((by_weight[i], by_weight[j]))) for i in range(len(by_weight)) for j in (i + 1, i + 2) if j < len(by_weight)]


def intersections(rows: DataFrame, items: list, weights: np.ndarray, documents: int, length: int, pairs: list[tuple[int, int]], k: int) -> DataFrame:
    """Per task: the largest impact of each term, joint maximum and size of each pair's intersection, and (item, score) of up to k scored documents."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        most, joint, common = np.zeros(len(weights), np.int64), np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        by_first: dict[int, list[tuple[int, int]]] = {}
        for i, (a, b) in enumerate(pairs):
            by_first.setdefault(a, []).append((b, i))
        heavy = [sorted(neighbours(item, weights), key=lambda p: -int(weights[p[0]] + weights[p[1]])) for item in items]
        best = [np.zeros(0, np.int64) for _ in items]
        for batch in batches:
            for part in text_slices(batch, 2, BLOCK_BYTES):
                block = Block(part, weights, documents, length)
                most = np.maximum(most, block.most)
                met: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
                wanted = {p for ps in heavy for p in ps[:2]}
                dense = np.zeros(block.n_docs, np.int64)
                for a, others in by_first.items():
                    docs, impact = block.of(a)
                    if not len(docs):
                        continue
                    dense[docs] = impact
                    for b, i in others:
                        own, more = block.of(b)
                        there = dense[own]
                        hit = there > 0
                        both = there[hit] + more[hit]
                        if len(both):
                            joint[i] = max(joint[i], int(both.max()))
                            common[i] += len(both)
                            if (a, b) in wanted:
                                met[a, b] = own[hit], both
                    dense[docs] = 0
                for i, item in enumerate(items):
                    docs, impact = next((met[p] for p in heavy[i][:2] if p in met), None) or (block.of(max(item, key=lambda x: weights[x[0]])[0]) if item else (dense[:0], dense[:0]))
                    if len(docs):
                        docs = np.sort(docs[np.argsort(-impact, kind="stable")[:max(SEEDS, k)]])
                        score = np.zeros(len(docs), np.int64)
                        for term, times in item:
                            block.add(score, docs, term, times)
                        best[i] = -np.sort(-np.concatenate([best[i], score[score > 0]]))[:k]
        seeds = [(i, int(s)) for i, own in enumerate(best) for s in own]
        yield pa.RecordBatch.from_arrays([
            pa.array([most.tolist()], pa.list_(pa.int64())), pa.array([joint.tolist()], pa.list_(pa.int64())), pa.array([common.tolist()], pa.list_(pa.int64())),
            pa.array([[{"item": i, "score": s} for i, s in seeds]], pa.list_(pa.struct([("item", pa.int32()), ("score", pa.int64())])))],
            names=["most", "joint", "common", "seeds"])

    return rows.mapInArrow(work, "most array<long>, joint array<long>, common array<long>, seeds array<struct<item:int,score:long>>")


def prefix_bounds(item: list[tuple[int, int]], most: np.ndarray, joint: dict[tuple[int, int], int]) -> tuple[list[tuple[int, int]], list[int]]:
    """The item's terms, weakest first, and for each j a bound on what the first j of them can add up to in any document.

    Within the first j terms, disjoint pairs are taken greedily by what they save; a pair counts as its bound, a single term as its maximum.
    """
    order = sorted((x for x in item if most[x[0]] > 0), key=lambda x: (int(most[x[0]]) * x[1], x[0]))
    alone = [int(most[t]) * times for t, times in order]
    place = {t: i for i, (t, _) in enumerate(order)}
    savings = []
    for (a, b), both in joint.items():
        if a in place and b in place:
            i, j = place[a], place[b]
            times = min(order[i][1], order[j][1])
            bound = max(times * both + alone[i] - times * int(most[a]) + alone[j] - times * int(most[b]), alone[i], alone[j])
            if bound < alone[i] + alone[j]:
                savings.append((alone[i] + alone[j] - bound, max(i, j), min(i, j)))
    savings.sort(reverse=True)
    bounds, total = [0], 0
    for j in range(len(order)):
        total += alone[j]
        saved, used = 0, set()
        for saving, late, early in savings:
            if late <= j and late not in used and early not in used:
                used |= {late, early}
                saved += saving
        bounds.append(min(total - saved, bounds[-1] + alone[j]))
    return order, bounds


def best_of(block: Block, order: list[tuple[int, int]], bounds: list[int], threshold: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Up to k of the block's documents with the highest scores of at least ``threshold`` (and 1), best first; how many got a full score."""
    none = np.zeros(0, np.int64)
    if min(bounds[-1], sum(int(block.most[t]) * times for t, times in order)) < max(threshold, 1):
        return none, none, 0
    weak = max(j for j, bound in enumerate(bounds) if j == 0 or bound < threshold)
    lists = [(*block.of(t), times) for t, times in order[weak:]]
    met = np.concatenate([d for d, _, _ in lists]) if lists else none
    if not len(met):
        return none, none, 0
    score = np.bincount(met, np.concatenate([i * times for _, i, times in lists]), block.n_docs)  # exact: far below 2^53
    docs = np.flatnonzero(score)
    score = score[docs].astype(np.int64)
    for j in range(weak, 0, -1):
        stays = score + bounds[j] >= threshold
        docs, score = docs[stays], score[stays]
        if not len(docs):
            return none, none, 0
        block.add(score, docs, *order[j - 1])
    good = score >= max(threshold, 1)
    docs, score, full = docs[good], score[good], len(docs)
    if len(docs) > k:
        least = -np.partition(-score, k - 1)[k - 1]
        docs, score = docs[score >= least], score[score >= least]
    top = np.argsort(-score, kind="stable")[:k]
    return docs[top], score[top], full


def _search_tasks(rows: DataFrame, plans: list, thresholds: list[int], weights: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found: list[list] = [[] for _ in plans]
        least, kind = list(thresholds), None
        for batch in batches:
            kind = batch.column(0).type
            for part in text_slices(batch, 2, BLOCK_BYTES):
                block = Block(part, weights, documents, length)
                for i, (order, bounds) in enumerate(plans):
                    docs, score, _ = best_of(block, order, bounds, least[i], k)
                    if len(docs):
                        ids = block.ids.take(pa.array(docs)).to_pylist()
                        own = sorted([*found[i], *zip((-score).tolist(), [(x is not None, x) for x in ids])])[:k]
                        found[i] = own
                        if len(own) == k:
                            least[i] = max(least[i], -own[-1][0])
        if kind is not None:
            flat = [(i, x[1], -s) for i, own in enumerate(found) for s, x in own]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in flat], pa.int32()), pa.array([x for _, x, _ in flat], kind), pa.array([s for _, _, s in flat], pa.int64())],
                                             names=["item", "doc_id", "score"])

    return rows.mapInArrow(work, f"item int, doc_id {rows.schema['doc_id'].dataType.simpleString()}, score long")


def _search(texts: DataFrame, item_rows: list, id_type, k: int) -> DataFrame:
    """``search`` for items that the driver holds."""
    spark = texts.sparkSession
    spoken = [Counter(terms_of(text)) for _, text in item_rows]
    vocabulary = sorted({t for c in spoken for t in c})
    place = {t: i for i, t in enumerate(vocabulary)}
    items = [sorted((place[t], n) for t, n in c.items()) for c in spoken]
    indexed = checkpointed(index(texts, vocabulary))
    documents, length, *df = _totals(indexed.filter("counts is not null"), "counts", F.sum, len(vocabulary) + 2).tolist()
    rows = indexed.filter("counts is null").select("doc_id", "n", "postings")
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df], np.int64)
    pairs = sorted({p for item in items for p in neighbours(item, weights)})
    met = checkpointed(intersections(rows, items, weights, documents, length, pairs, k))
    most = _totals(met, "most", F.max, len(vocabulary))
    joint = dict(zip(pairs, _totals(met, "joint", F.max, len(pairs)).tolist()))
    by_score = Window.partitionBy("item").orderBy(F.desc("score"))
    kth = met.select(F.explode("seeds").alias("s")).select("s.item", "s.score").withColumn("r", F.row_number().over(by_score)).filter(F.col("r") <= k)
    thresholds = [0] * len(items)
    for item, score in kth.filter(F.col("r") == k).select("item", "score").collect():
        thresholds[item] = score
    plans = [prefix_bounds(item, most, {p: joint[p] for p in neighbours(item, weights)}) for item in items]
    found = _search_tasks(rows, plans, thresholds, weights, documents, length, k)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(item_rows)], f"item int, item_id {id_type}")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: for each row of ``items`` its k best documents with a score above 0 (all, if fewer).

    Equal scores go by ascending doc_id, nulls first.  Null or empty texts, and texts without a term, have no terms: such documents are not counted,
    such items get no rows.  Repeated documents and documents without an id are documents of their own, and repeated items are items of
    their own.  No documents or no items give no rows; other columns are not looked at.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    id_type = items.schema[item_col].dataType.simpleString()
    goes = max(1, -(-int(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES))
    out = None
    for go in range(goes):
        own = asked if goes == 1 else asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(goes)) == go)
        part = _search(texts, [tuple(r) for r in own.collect()], id_type, k)
        out = part if out is None else out.unionByName(part)
    return out


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLE = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t
  from documents where text is not null
), q as (
  select item_id, term, count(*) as times from (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from benchmark) group by all
), total as (
  select count(*)::bigint as big_n, sum(len(t))::bigint as big_l from d where len(t) > 0
), tf as (
  select r, doc_id, n, term, count(*)::bigint as tf
  from (select r, doc_id, len(t)::bigint as n, unnest(t) as term from d) where term in (select term from q) group by all
), w as (
  select term, floor(1000 * ln((2 * big_n + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, total group by term, big_n
), impact as (
  select r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))) as impact
  from tf join w using (term), total
), scored as (
  select item_id, r, doc_id, sum(times * impact)::bigint as score from q join impact using (term) group by all having sum(times * impact) > 0
)
select item_id, rank, doc_id, score from (
  select *, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank from scored) where rank <= 20
"""
