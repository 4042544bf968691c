"""Best-fit packing of tokenised documents into sequences of bounded length.

Lengths are whole numbers up to the capacity, so the histogram of piece lengths has at most ``capacity`` rows,
however many pieces there are.  Best-fit decreasing runs on the histogram: all open bins of one remaining capacity
and all pieces of one length are handled together, and a segment tree over remaining capacities finds the tightest open
bin in logarithmic time.  The outcome is the same packing that best fit gives piece by piece, written as moves: the pieces of
a length with ranks from..from+items go to bins seq_from, seq_from+1, ..., ``per_bin`` to each, from ``offset`` on.
A length opens or splits at most four runs of bins, and a run at least halves its room with every move, so there are at
most 44 * capacity moves.  They are broadcast; the pieces' ranks are numbered in parallel.
"""
from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType, LongType, IntegerType, ArrayType

from glyphmill.llm.base import WordMemory, checkpointed, numbered, read, release_arrow, ship, text_slices

CAPACITY = 2048
END = 0
#: Bytes of words and ids that a Python worker remembers, about.
REMEMBERED = 32 << 20
#: UTF-8 bytes of texts handled at a time in a worker (one text at least).
AT_A_TIME = 2 << 20

_workers: dict[str, tuple] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class RoomTree:
    """Segment tree over remaining capacities 0..capacity: which of them have an open bin."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, room: int, there: bool) -> None:
        node = room + self.leaves
        self.any[node] = there
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least ``length`` that has an open bin."""
        node = length + self.leaves
        if self.any[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                break
            node //= 2
        else:
            return None
        while node < self.leaves:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit_moves(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Moves (length, rank_from, items, per_bin, seq_from, offset) of best-fit decreasing."""
    tree, runs, moves, bins = RoomTree(capacity), {}, [], 0

    def opened(room: int, first: int, count: int) -> None:
        if room > 0 and count > 0:
            runs.setdefault(room, []).append((first, count))
            tree.set(room, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                first, count = bins, -(-left // (capacity // length))
                bins += count
            else:
                first, count = runs[room].pop()
                if not runs[room]:
                    tree.set(room, False)
            each = room // length
            full = min(count, left // each)
            for start, n, k in ((first, full, each), (first + full, min(1, count - full), left - full * each)):
                if n and 0 < k <= each:
                    moves.append((length, rank, n * k, k, start, capacity - room))
                    opened(room - k * length, start, n)
                    rank, left, first, count = rank + n * k, left - n * k, start + n, count - n
            opened(room, first, count)
    return moves


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: visible ones for themselves, others from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(other)}


#: One word of Latin letters: lower-cased and split into no more than itself by the tokenizer.
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Between a Latin letter or digit and a sign the tokenizer always splits, unless that is an apostrophe, or a bar inside a special token.
_SPLIT = r"([0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])([!-&(-/:-@\[-`{}~])"


class WordTokenizer:
    """Ids of whole texts, tokenising each distinct run of non-space characters once.

    The vocabulary drops white space and never merges across it, so a text's ids are the ids of its runs in order.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.known = WordMemory(REMEMBERED)

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that are not remembered."""
        model, letters, rest, out = self.tokenizer.model, self.letters, [], {}
        for w in words:
            if _LATIN.fullmatch(w):
                mapped = w.lower() if w.isascii() else "".join([letters[b] for b in w.lower().encode()])
                out[w] = np.array([t.id for t in model.tokenize(mapped)], "<u4").tobytes()
            else:
                rest.append(w)
        if rest:
            found = self.tokenizer.encode(rest, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            ends = np.cumsum(np.bincount(np.array(found.word_ids, dtype=np.int64), minlength=len(rest))) if len(ids) else np.zeros(len(rest), int)
            out.update((w, ids[(ends[i - 1] if i else 0):ends[i]].tobytes()) for i, w in enumerate(rest))
        for w, own in out.items():
            self.known.put(w, own)
        return out

    def texts(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, little-endian, and the number of ids of each text of an Arrow array without nulls."""
        import pyarrow.compute as pc

        runs = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, _SPLIT, r"\1 \2"))
        bounds = runs.offsets.to_numpy().astype(np.int64)
        coded = runs.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        parts = [self.known.get(w) for w in words]
        new = self._learn([w for w, ids in zip(words, parts) if ids is None])
        parts = [new[w] if ids is None else ids for w, ids in zip(words, parts)]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        pool = np.frombuffer(b"".join(parts), "<u4")
        starts = np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy()
        each = sizes[at] if len(at) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(each)])
        gather = np.repeat((starts[at] if len(at) else each) - ends[:-1], each) + np.arange(ends[-1])
        return pool[gather], ends[bounds[1:]] - ends[bounds[:-1]]


def _worker(path: str) -> WordTokenizer:
    if path not in _workers:
        _workers[path] = WordTokenizer(path)
    return _workers[path]


def tokenised_pieces(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
                     vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids).

    A text's ids are followed by the end id 0; a null or empty text has that one id.  Only longer ones than ``capacity`` are
    cut.  Null ids and repeated rows are documents of their own; other columns are not looked at.
    """
    ship(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    fields = [StructField("doc_id", docs.schema[id_col].dataType), StructField("piece", IntegerType()), StructField("start", LongType()),
              StructField("length", LongType()), StructField("ids_crc32", LongType())]
    fields += [StructField("ids", ArrayType(LongType()))] if with_ids else []

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tokenizer = _worker(path)
        tokenizer.known.open()
        for batch in batches:
            for part in text_slices(batch, 1, AT_A_TIME):
                ids, counts = tokenizer.texts(part.column(1))
                rows, piece, start, length, crc, all_ids, at = [], [], [], [], [], [], 0
                for row, count in enumerate(counts.tolist()):
                    own = np.append(ids[at:at + count], np.uint32(END)).astype("<u4")
                    at += count
                    for k, lo in enumerate(range(0, count + 1, capacity)):
                        cut_ids = own[lo:lo + capacity]
                        rows.append(row), piece.append(k), start.append(lo), length.append(len(cut_ids))
                        crc.append(zlib.crc32(cut_ids.tobytes()))
                        if with_ids:
                            all_ids.append(cut_ids.astype(np.int64))
                columns = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                           pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                columns += [pa.array(all_ids, pa.list_(pa.int64()))] if with_ids else []
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])
        release_arrow()

    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(cut, StructType(fields))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with doc_id, piece, length of 1..capacity) plus sequence_id and offset; no rows give no rows."""
    pieces = checkpointed(pieces)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    moves = best_fit_moves(histogram, capacity)
    table = pieces.sparkSession.createDataFrame(
        moves, "length long, _from long, _items long, _each long, _seq long, _off long")
    ranked = numbered(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], max(histogram.values(), default=0), "_rank")
    met = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (F.col("_rank") >= F.col("_from"))
                      & (F.col("_rank") < F.col("_from") + F.col("_items"))).drop(table["length"])
    inside = F.col("_rank") - F.col("_from")
    return met.withColumns({
        "sequence_id": F.col("_seq") + F.floor(inside / F.col("_each")),
        "offset": F.col("_off") + inside % F.col("_each") * F.col("length"),
    }).drop("_rank", "_from", "_items", "_each", "_seq", "_off")


def sequences(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """sequence_id, ids, documents (doc_id, piece and offset of each part): the packed sequences themselves.

    Texts are tokenised twice so that ids take part in one shuffle only, the one that gathers a sequence.
    """
    placed = pack(tokenised_pieces(docs, capacity, id_col, text_col, vocabulary), capacity)
    ids = tokenised_pieces(docs, capacity, id_col, text_col, vocabulary, with_ids=True).dropDuplicates(
        ["doc_id", "piece", "length", "ids_crc32"]).select(
        F.col("doc_id").alias("_d"), F.col("piece").alias("_p"), F.col("length").alias("_l"), F.col("ids_crc32").alias("_x"), "ids")
    both = placed.join(ids, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("piece") == F.col("_p")) & (F.col("length") == F.col("_l"))
                       & (F.col("ids_crc32") == F.col("_x")))
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return both.groupBy("sequence_id").agg(parts.alias("_parts")).select(
        "sequence_id", F.flatten(F.col("_parts.ids")).alias("ids"),
        F.transform("_parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"))).alias("documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(tokenised_pieces(read(spark, sf_dir, "documents"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
