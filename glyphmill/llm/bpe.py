"""Byte-pair encoding by a tokenization automaton, and decoding by its arc labels.

The merges are compiled in their order, each by one gadget, into a deterministic automaton over tokens that accepts exactly the token
sequences which the merges can leave.  It starts as one state with a loop for every basic symbol.  The gadget of a merge u v -> w
splits the state behind u: its new version has no arc for v any more, and wherever u and then v could be read before, an arc for w leads to
the state behind v.  A state's versions share their arcs, so a gadget costs one entry (``cut``: the moment from which an arc is gone)
and one link (``born``: the moment at which the state behind w left the versions of the state behind v).

Words are then read symbol by symbol.  What has been read is described by the set of live paths: (place in the trie of tokens, state before
that token).  Since every string has one token sequence, one path of each set stands at the trie's root; its token is the last one
of the sequence for what has been read.  These sets are the states of a second deterministic automaton, whose transition table is filled as
words need it; a word costs one table look-up per symbol, and walking back over the last tokens gives its ids.
"""
from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from glyphmill.llm.base import WordMemory, read, release_arrow, ship, text_slices

#: Bytes of words and ids that a Python worker remembers, about.
REMEMBERED = 32 << 20
#: States of the table of transitions (about 500 bytes each, with the arcs asked for); it is emptied when it is full.
STATES = 120_000
#: UTF-8 bytes of texts, or of ids, handled at a time in a worker (one text at least).
AT_A_TIME = 2 << 20
#: Basic symbols have ids below this.
SYMBOLS = 512
START = -1

_workers: dict[str, "BpeAutomaton"] = {}
_labels: dict[str, list] = {}

#: A letter of Latin words or a digit, and a sign that no piece shares with it: not an apostrophe, nor a bar, which special tokens have.
_SPLIT = r"([0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])([!-&(-/:-@\[-`{}~])"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _letter_of_byte() -> list[str]:
    """The letter that stands for each byte: visible Latin-1 ones for themselves, the others in order from 256 on."""
    out, extra = [], 256
    for byte in range(256):
        if byte in range(33, 127) or byte in range(161, 173) or byte in range(174, 256):
            out.append(chr(byte))
        else:
            out.append(chr(extra))
            extra += 1
    return out


def labels_of(vocabulary: dict[str, int]) -> list[str | None]:
    """The label of each id; None where no arc has it."""
    labels: list[str | None] = [None] * (1 + max(vocabulary.values(), default=-1))
    for token, i in vocabulary.items():
        labels[i] = token
    return labels


class BpeAutomaton:
    """The automaton of a vocabulary file with byte-level symbols, word ends, and no merges across white space.

    ``merges`` and ``vocabulary`` may be given in place of a file, for small vocabularies in tests.
    """

    def __init__(self, path: str | None = None, merges: list | None = None, vocabulary: dict[str, int] | None = None, word_end: str = "</w>"):
        self.splitter = None
        if path is not None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            import json

            from tokenizers import Tokenizer

            with open(path, encoding="utf-8") as file:
                whole = json.load(file)
            model = whole["model"]
            if model["type"] != "BPE" or model.get("dropout") or model.get("unk_token") or model.get("byte_fallback") or model.get("ignore_merges") \
                    or model.get("continuing_subword_prefix") or whole["decoder"] is not None or whole["post_processor"] is not None:
                raise ValueError("this vocabulary's model is not plain byte-level BPE")
            merges, vocabulary, word_end = model["merges"], model["vocab"], model["end_of_word_suffix"] or ""
            self.added = {t["content"]: t["id"] for t in whole["added_tokens"]}
            if any(not re.fullmatch(r"<\|[a-z]+\|>", t) for t in self.added):
                raise ValueError("added tokens must look like <|name|>")
            if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in whole["added_tokens"]):
                raise ValueError("added tokens must be plain strings without white space")
            self.splitter = Tokenizer.from_file(path)
        else:
            self.added = {}
        self.word_end, self.vocabulary = word_end, vocabulary
        self.between = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self.labels = labels_of({**vocabulary, **self.added})
        self._compile([tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges])
        self._forget_states()
        self.known = WordMemory(REMEMBERED)
        self.letters = _letter_of_byte()
        if self.splitter is not None:
            self._probe()

    # ------------------------------------------------------------------ compilation

    def _compile(self, merges: list[tuple[str, str]]) -> None:
        ids, made = self.vocabulary, {a + b for a, b in merges}
        self.symbol = {t: i for t, i in ids.items() if t not in made}
        #: The state behind a token has the token's id.  cut[state, token]: when the arc was taken away.
        self.cut: dict[tuple[int, int], int] = {}
        #: When a token's arcs came into being, the token whose versions its state left then, and its first part.
        self.born: dict[int, int] = {}
        self.behind: dict[int, int] = {}
        self.first: dict[int, int] = {}
        self.length = {i: 1 for i in self.symbol.values()}
        read = set(self.length)  # tokens that some sequence has
        for when, (left, right) in enumerate(merges):
            u, v, w = ids[left], ids[right], ids[left + right]
            if u not in self.length or v not in self.length or w in self.length:
                raise ValueError("each token must come from one merge of tokens that are there before it")
            if u in read and v in read and self.arc(u, v):  # else no sequence has this pair any more, and the gadget changes nothing
                self.born[w], self.behind[w], self.first[w] = when, v, u
                self.cut[u, v] = when
                read.add(w)
            self.length[w] = self.length[u] + self.length[v]
        # the trie of tokens, by symbols
        self.child: dict[int, int] = {}
        self.token_at: list[int] = [START]
        spelt: dict[int, tuple[int, ...]] = {}
        number = {i: k for k, i in enumerate(self.symbol.values())}
        self.number = {t: number[i] for t, i in self.symbol.items()}
        for i in [*self.symbol.values(), *self.born]:
            spelt[i] = spelt[self.first[i]] + spelt[self.behind[i]] if i in self.born else (number[i],)
            node = 0
            for s in spelt[i]:
                key = node * SYMBOLS + s
                if key not in self.child:
                    self.child[key] = len(self.token_at)
                    self.token_at.append(START)
                node = self.child[key]
            self.token_at[node] = i
        if len(self.symbol) > SYMBOLS:
            raise ValueError(f"more than {SYMBOLS} basic symbols")

    def arc(self, state: int, token: int) -> bool:
        """Has the state behind ``state`` (a token; START: nothing yet) an arc for ``token``?

        The arc for a token is there if the one for its first part was when the token came into being, and has not been cut since.
        Of two merges of one kind the left one comes first: an arc that is cut at the very moment a token is born gives it no arc either.
        """
        until = None
        while True:
            if state != START:
                owner, left_at = state, None
                while True:
                    cut = self.cut.get((owner, token))
                    if cut is not None and (left_at is None or cut < left_at) and (until is None or cut <= until):
                        return False
                    born = self.born.get(owner)
                    if born is None:
                        break
                    left_at = born if left_at is None else min(left_at, born)
                    owner = self.behind[owner]
            if token not in self.born:
                return True
            until = self.born[token] if until is None else min(until, self.born[token])
            token = self.first[token]

    # ------------------------------------------------------------------ reading words

    def _forget_states(self) -> None:
        self.table: dict[int, int] = {}
        self.last: list[int] = []
        self.paths: list[bytes] = []
        self.numbered: dict[bytes, int] = {}
        self.arcs: dict[int, bool] = {}
        self.begin = self._state([START])

    def _state(self, paths: list[int]) -> int:
        """Number of the state with these live paths: the last token of the path at the trie's root, then node << 32 | token + 1 of the others."""
        key = array("q", paths).tobytes()
        if key not in self.numbered:
            self.numbered[key] = len(self.paths)
            self.paths.append(key)
            self.last.append(paths[0])
        return self.numbered[key]

    def _step(self, state: int, symbol: int) -> int:
        """Fill one cell of the table."""
        whole, child = START, self.child
        first, *others = array("q", self.paths[state])
        live = [START]
        for node, before in [(0, first), *[(p >> 32, (p & 0xFFFFFFFF) - 1) for p in others]]:
            to = child.get(node * SYMBOLS + symbol)
            if to is not None:
                live.append(to << 32 | (before + 1))
                token = self.token_at[to]
                if token != START:
                    key = (before + 1) << 32 | token
                    there = self.arcs.get(key)
                    if there is None:
                        there = self.arcs[key] = self.arc(before, token)
                    if there:
                        whole = token
        live[0] = whole
        to = self._state(live)
        self.table[state * SYMBOLS + symbol] = to
        return to

    def word(self, piece: str) -> list[int]:
        """Ids of one pre-split word, written in byte letters."""
        state, table, last, lasts = self.begin, self.table, self.last, []
        number, end = self.number, len(piece) - 1
        symbols = [number[letter] for letter in piece[:end]]
        if piece:
            symbols.append(number[piece[end] + self.word_end])
        for symbol in symbols:
            to = table.get(state * SYMBOLS + symbol)
            if to is None:
                if len(self.paths) > STATES:  # start the table again from the paths that are live here
                    paths = self.paths[state]
                    self._forget_states()
                    state, table, last = self._state(list(array("q", paths))), self.table, self.last
                to = self._step(state, symbol)
            state = to
            lasts.append(last[state])
        out, at, length = [], end, self.length
        while at >= 0:
            token = lasts[at]
            out.append(token)
            at -= length[token]
        out.reverse()
        return out

    # ------------------------------------------------------------------ runs and texts

    #: What the vocabulary's own pattern gives for small ASCII letters, digits and signs; other runs are split by the vocabulary itself.
    _ASCII = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\\sa-z0-9]+")
    _PRINTED = re.compile("[!-~]+")
    #: One word of Latin letters is one piece; none of these letters changes by normalising but for its case.
    _LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")

    def _split(self, run: str) -> list[str]:
        if self._PRINTED.fullmatch(run):
            return self._ASCII.findall(run.lower())
        found = self.splitter.pre_tokenizer.pre_tokenize_str(self.splitter.normalizer.normalize_str(run))
        return [piece for piece, _ in found]

    def _run(self, run: str) -> bytes:
        if self._LATIN.fullmatch(run):
            letters, low = self.letters, run.lower()
            return array("I", self.word(low if low.isascii() else "".join([letters[b] for b in low.encode()]))).tobytes()
        out: list[int] = []
        at = 0
        for match in [*self.between.finditer(run), None]:
            for piece in self._split(run[at:match.start() if match else len(run)]):
                out.extend(self.word(piece))
            if match:
                out.append(self.added[match.group()])
                at = match.end()
        return array("I", out).tobytes()

    def texts(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the number of ids of each text of an Arrow array without nulls; each distinct run of non-space characters is read once."""
        import pyarrow.compute as pc

        runs = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, _SPLIT, r"\1 \2"))
        bounds = runs.offsets.to_numpy().astype(np.int64)
        coded = runs.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        known, parts = self.known, []
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = self._run(w)
                known.put(w, ids)
            parts.append(ids)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        pool = np.frombuffer(b"".join(parts), "<u4")
        starts = np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy()
        each = sizes[at] if len(at) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(each)]).astype(np.int64)
        gather = np.repeat((starts[at] if len(at) else each) - ends[:-1], each) + np.arange(ends[-1])
        return pool[gather], ends[bounds[1:]] - ends[bounds[:-1]]

    def _probe(self) -> None:
        """Raise where the file splits or normalises otherwise than ``texts`` relies on."""
        import pyarrow as pa

        probes = ["It's  don't I'LL\t12aé́ 你好 ~!x_y", "İstanbul ΣΑΣ a b ﬁ", "", " ", *self.added, "x".join(self.added)]
        ids, counts = self.texts(pa.array(probes))
        wanted = [self.splitter.encode(p, add_special_tokens=False).ids for p in probes]
        if counts.tolist() != [len(w) for w in wanted] or ids.tolist() != [i for w in wanted for i in w]:
            raise ValueError("this vocabulary splits or normalises texts in another way")
        self.known.clear()


def _worker(path: str) -> BpeAutomaton:
    if path not in _workers:
        _workers[path] = BpeAutomaton(path)
    return _workers[path]


def _worker_labels(path: str) -> list[str | None]:
    if path not in _labels:
        import json

        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        _labels[path] = labels_of(whole["model"]["vocab"] | {t["content"]: t["id"] for t in whole["added_tokens"]})
    return _labels[path]


def _encoded(batch, path: str) -> Iterator:
    """Documents, ids and their numbers, of parts of an Arrow batch (doc_id, text)."""
    automaton = _worker(path)
    automaton.known.open()
    for part in text_slices(batch, 1, AT_A_TIME):
        yield part.column(0), *automaton.texts(part.column(1))


def _cells(ids: np.ndarray, counts: np.ndarray):
    """The ids of each row as bytes, in an Arrow array."""
    import pyarrow as pa

    ends = np.concatenate([[0], 4 * np.cumsum(counts)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(ids.astype("<u4", copy=False).tobytes())])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (binary: little-endian unsigned 32-bit integers).

    A null or empty text, or one of white space only, has no ids.  Texts of any length are read whole.  Null ids and repeated rows are
    rows like others; no rows give no rows; other columns are not looked at.  Strings of added tokens in a text become these tokens.
    """
    ship(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType), StructField("ids", BinaryType())])

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for own_id, ids, counts in _encoded(batch, path):
                yield pa.RecordBatch.from_arrays([own_id, _cells(ids, counts)], names=["doc_id", "ids"])
        release_arrow()

    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(work, schema)


def _joined(ids: np.ndarray, counts: np.ndarray, labels, known: np.ndarray):
    """The text of each row: the labels of its ids, joined by spaces; ids without a label are passed over."""
    import pyarrow as pa
    import pyarrow.compute as pc

    there = np.zeros(len(ids), bool)
    there[ids < len(known)] = known[ids[ids < len(known)]]
    ends = np.concatenate([[0], np.cumsum(there)])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), labels.take(pa.array(ids[there]))), " ")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """One row per row: doc_id, text (the labels of the arcs that the ids stand for, special ones too, joined by spaces).

    Null or empty ids give an empty text; ids without a label are passed over.  Null doc_ids and repeated rows are rows like others.
    """
    ship(encoded.sparkSession)
    path = vocabulary or default_vocabulary()
    schema = StructType([StructField("doc_id", encoded.schema[id_col].dataType), StructField("text", StringType())])

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        labels = pa.array(_worker_labels(path), pa.string())
        known = ~np.array(labels.is_null())
        for batch in batches:
            for part in text_slices(batch, 1, AT_A_TIME):
                ids = np.frombuffer(b"".join(c.as_buffer() for c in part.column(1)), "<u4")
                counts = pc.binary_length(part.column(1)).to_numpy(zero_copy_only=False).astype(np.int64) // 4
                yield pa.RecordBatch.from_arrays([part.column(0), _joined(ids, counts, labels, known)], names=["doc_id", "text"])
        release_arrow()

    ids = encoded.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids"))
    return ids.mapInArrow(work, schema)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``encode`` and ``decode`` in one pass: doc_id, ids, text (decoded from these ids).  The same rows as from the two, one after the other."""
    ship(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType), StructField("ids", BinaryType()), StructField("text", StringType())])

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        labels = pa.array(_worker_labels(path), pa.string())
        known = ~np.array(labels.is_null())
        for batch in batches:
            for own_id, ids, counts in _encoded(batch, path):
                yield pa.RecordBatch.from_arrays([own_id, _cells(ids, counts), _joined(ids, counts, labels, known)], names=["doc_id", "ids", "text"])
        release_arrow()

    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(work, schema)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of each document, as digests."""
    return round_trip(read(spark, sf_dir, "documents")).select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
