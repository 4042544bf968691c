from __future__ import annotations

import hashlib
import random
import struct

import pytest
from tokenizers import Tokenizer

from glyphmill.llm import bpe

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def automaton():
    return bpe.BpeAutomaton(bpe.default_vocabulary())


def ids_of(automaton, texts):
    import pyarrow as pa

    ids, counts = automaton.texts(pa.array(texts, pa.string()))
    out, at = [], 0
    for n in counts.tolist():
        out.append(ids[at:at + n].tolist())
        at += n
    return out


def noisy(rng):
    bits = ["the", "The", "THE", "don't", "I'LL", "'s", "é", "é", "ñandú", "12", "3a", "…", "🙂", "你好", " ", " ", "\x00", "\x85", "ΣΑΣ", "İ", "ﬁ", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>",
            "</w>", "<|", "|>", "aaaa", "haha", "x_y", "-", "--", ".", "ß", "ǅ", " ", "\t", "\r\n", "zq", "ſ", "K"]
    return "".join(rng.choice(bits) + rng.choice(["", "", " ", "a"]) for _ in range(rng.randint(0, 25)))


def test_ids_equal_the_library(automaton, library):
    rng = random.Random(5)
    texts = [noisy(rng) for _ in range(5000)] + ["a" * n for n in range(120)] + ["ab" * n for n in range(60)] + ["".join(rng.choice("abcdehilnorst") for _ in range(n)) for n in range(400)]
    wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(automaton, texts) == wanted


def test_states_can_be_forgotten_inside_a_word(library, monkeypatch):
    monkeypatch.setattr(bpe, "STATES", 50)
    monkeypatch.setattr(bpe, "REMEMBERED", 2000)
    own, rng = bpe.BpeAutomaton(bpe.default_vocabulary()), random.Random(6)
    texts = [" ".join("".join(rng.choice("abcdehilnorst") for _ in range(rng.randint(1, 90))) for _ in range(4)) for _ in range(200)]
    assert ids_of(own, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert len(own.paths) <= 50 + 400


def by_hand(word, merges):
    """Apply the merges in their order, each from left to right."""
    parts = list(word)
    for left, right in merges:
        at = 0
        while at + 1 < len(parts):
            if (parts[at], parts[at + 1]) == (left, right):
                parts[at:at + 2] = [left + right]
            at += 1
    return parts


@pytest.mark.parametrize("seed", range(30))
def test_small_vocabularies_against_merging_by_hand(seed):
    rng = random.Random(seed)
    tokens, merges = list("abc"), []
    for _ in range(rng.randint(0, 25)):
        a, b = rng.choice(tokens), rng.choice(tokens)
        if a + b not in tokens:
            tokens.append(a + b)
            merges.append((a, b))
    own = bpe.BpeAutomaton(merges=merges, vocabulary={t: i for i, t in enumerate(tokens)}, word_end="")
    for _ in range(300):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
        assert [tokens[i] for i in own.word(word)] == by_hand(word, merges), (word, merges)
    # the arcs accept a pair of tokens exactly if merging leaves it
    for a in tokens:
        for b in tokens:
            left, right = by_hand(a, merges), by_hand(b, merges)
            if left == [a] and right == [b]:
                assert own.arc(own.vocabulary[a], own.vocabulary[b]) == (by_hand(a + b, merges) == [a, b])


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.BpeAutomaton(public_tokenizers.path("byte_bpe_50k.json"))
    with pytest.raises(ValueError):
        bpe.BpeAutomaton(merges=[("a", "b"), ("ab", "c"), ("b", "c"), ("a", "bc")], vocabulary={t: i for i, t in enumerate(["a", "b", "c", "ab", "abc", "bc"])})


def test_messy_rows_and_round_trip(spark, messy, empty, library):
    rows = [(r["doc_id"], r["text"] or "") for r in messy.collect()]
    encoded = bpe.encode(messy)
    assert encoded.columns == ["doc_id", "ids"]
    got = [(r["doc_id"], list(struct.unpack(f"<{len(r['ids']) // 4}I", r["ids"]))) for r in encoded.collect()]
    key = lambda x: (str(x[0]), x[1])
    assert sorted(got, key=key) == sorted([(i, library.encode(t, add_special_tokens=False).ids) for i, t in rows], key=key)
    back = [(r["doc_id"], r["text"]) for r in bpe.decode(encoded).collect()]
    assert sorted(back, key=key) == sorted([(i, library.decode(library.encode(t, add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in rows], key=key)
    both = [(r["doc_id"], bytes(r["ids"]), r["text"]) for r in bpe.round_trip(messy).collect()]
    assert sorted([(i, t) for i, _, t in both], key=key) == sorted(back, key=key)
    assert sorted([(i, list(struct.unpack(f"<{len(x) // 4}I", x))) for i, x, _ in both], key=key) == sorted(got, key=key)
    assert bpe.encode(empty).count() == 0 and bpe.round_trip(empty).count() == 0 and bpe.decode(bpe.encode(empty)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, bytearray(b"")), (3, bytearray(struct.pack("<3I", 320, 10**6, 49407)))], "doc_id long, ids binary")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(odd).collect()} == {1: "", 2: "", 3: "a</w> <|endoftext|>"}


def test_op13_equals_the_library_on_whole_documents(spark, texts, library):
    got = {r["doc_id"]: r for r in bpe.op13_bpe(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_batches_are_kept_small(spark):
    from glyphmill.llm import base

    before = spark.conf.get(base._BATCH_SETTING)
    spark.conf.set(base._BATCH_SETTING, "64m")
    base.small_batches(spark)
    assert int(spark.conf.get(base._BATCH_SETTING).rstrip("b")) == base.BATCH_BYTES
    spark.conf.set(base._BATCH_SETTING, "100000")
    base.small_batches(spark)
    assert int(spark.conf.get(base._BATCH_SETTING).rstrip("b")) == 100_000
    spark.conf.set(base._BATCH_SETTING, before)
