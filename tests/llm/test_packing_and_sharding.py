from __future__ import annotations

import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from glyphmill.llm import packing, sharding


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= length]
        if fitting:
            rooms[rooms.index(min(fitting))] -= length
        else:
            rooms.append(capacity - length)
    return sorted(rooms)


@settings(max_examples=150, deadline=None)
@given(st.integers(3, 70).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=150))))
def test_moves_are_best_fit_decreasing(case):
    capacity, lengths = case
    histogram = {n: lengths.count(n) for n in set(lengths)}
    moves = packing.best_fit_moves(histogram, capacity)
    bins, ranks = {}, {}
    for length, rank, items, each, seq, offset in moves:
        assert rank == ranks.get(length, 0)
        ranks[length] = rank + items
        for i in range(items):
            bins.setdefault(seq + i // each, []).append((offset + i % each * length, length))
    assert ranks == histogram
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in parts) for parts in bins.values()) == best_fit_decreasing(lengths, capacity)
    assert len(moves) <= 44 * capacity


def test_tightest_room():
    tree = packing.RoomTree(100)
    for room in (3, 17, 64, 100):
        tree.set(room, True)
    for length in range(1, 101):
        assert tree.tightest(length) == next((r for r in (3, 17, 64, 100) if r >= length), None)


TRICKY = ["", " ", "Hello, World!! it's 3.14 don't", "É è Ünï ßtraße ªº Ångström", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>", "éä É,x;y",
          "x y z\x1cq", "日本語のテキスト、です。", "don't'll 's 'RE can'T", "A_b-c/d.e@f #1 $$$ %%% w*** ###", "İstanbul ǅ", "🙂🙂 ok​z"]


def test_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_vocabulary())
    ids, counts = packing.WordTokenizer(packing.default_vocabulary()).texts(pa.array(TRICKY))
    at = 0
    for text, n in zip(TRICKY, counts):
        assert ids[at:at + n].tolist() == whole.encode(text, add_special_tokens=False).ids, text
        at += n


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return by


def test_pieces_and_places(messy, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_vocabulary())
    rows = packing.pack(packing.tokenised_pieces(messy)).collect()
    check_places(rows, 2048)
    want = []
    for r in messy.collect():
        ids = np.array(whole.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(r["doc_id"], k, lo, len(ids[lo:lo + 2048]), zlib.crc32(ids[lo:lo + 2048].tobytes())) for k, lo in enumerate(range(0, len(ids), 2048))]
    assert sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows], key=str) == sorted(want, key=str)
    assert packing.pack(packing.tokenised_pieces(empty)).count() == 0


def test_sequences_hold_the_ids(documents):
    got = packing.sequences(documents.limit(40), capacity=512).collect()
    assert all(len(r["ids"]) <= 512 for r in got)
    pieces = packing.tokenised_pieces(documents.limit(40), 512, with_ids=True).collect()
    own = {(p["doc_id"], p["piece"]): p["ids"] for p in pieces}
    assert sum(len(r["documents"]) for r in got) == len(pieces)
    for r in got:
        for d in r["documents"]:
            ids = own[(d["doc_id"], d["piece"])]
            assert r["ids"][d["offset"]:d["offset"] + len(ids)] == ids


def test_placement_balances_all_dimensions():
    rng = np.random.default_rng(2)
    sizes = np.stack([rng.lognormal(8, 1, 4000), rng.lognormal(5, 1, 4000), rng.integers(1, 20, 4000)], axis=1)
    where = sharding.place(sizes, 40)
    loads = np.stack([np.bincount(where, sizes[:, d], 40) for d in range(3)], axis=1)
    assert (loads.max(axis=0) / loads.mean(axis=0) < 1.03).all()


def test_shards(messy, empty, spark):
    rows = sharding.assign(messy, shards=5).collect()
    texts = [r["text"] or "" for r in messy.collect()]
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted((len(t.encode()) + 16, zlib.crc32(t.encode())) for t in texts)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(0 <= s < 5 and sorted(x) == list(range(len(x))) for s, x in slots.items())
    assert sharding.assign(empty).count() == 0


def test_a_hot_group_is_split_and_others_stay_together(spark):
    random.seed(4)
    rows = [(i, "the same text again and again") for i in range(2000)]
    rows += [(2000 + i, f"pair {i // 2} " + "y" * random.Random(i // 2).randint(1, 90)) for i in range(4000)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).collect()
    text = dict(rows)
    shards, size = {}, [0] * 8
    for r in got:
        shards.setdefault(text[r["doc_id"]], set()).add(r["shard"])
        size[r["shard"]] += r["size"]
    assert len(shards["the same text again and again"]) > 1
    assert all(len(s) == 1 for t, s in shards.items() if t.startswith("pair"))
    assert max(size) < 1.03 * min(size)


@pytest.mark.parametrize("shards", [1, 40])
def test_shard_counts_beyond_rows(documents, shards):
    rows = sharding.assign(documents, shards=shards).collect()
    assert len(rows) == documents.count() and max(r["shard"] for r in rows) < shards


def test_tokens_are_counted_without_spaces(spark, tmp_path):
    long = ["tab\tseparated\t" * 50, "line\nfeeds\n" * 50, "日本語のテキスト" * 50, "ข้อความ" * 50, "a,b;" * 50, "x" * 400]
    rows = [(i, t) for i, t in enumerate([*long, "two words", "", None])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["n_tokens"] for r in sharding.op10_sharding(spark, str(tmp_path)).collect()}
    assert all(got[i] >= 100 for i in range(len(long))), got
    assert (got[2], got[4], got[5], got[6], got[7], got[8]) == (400, 200, 100, 3, 0, 0)


@pytest.mark.parametrize("seed", range(12))
def test_placement_against_brute_force(seed):
    """Each unit, largest first, where a plain search over all shards puts it."""
    from glyphmill.llm import sharding

    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 50, (rng.integers(1, 25), 3)).astype(float)
    shards = int(rng.integers(1, 6))
    total = np.where(sizes.sum(axis=0) > 0, sizes.sum(axis=0), 1)
    unit = sizes / total * shards
    left, want = [[1.0] * 3 for _ in range(shards)], {}
    for i in sorted(range(len(unit)), key=lambda i: (-max(unit[i]), i)):
        room = [s for s in range(shards) if all(left[s][d] - unit[i][d] >= -1e-12 for d in range(3))]
        if room:
            s = max(room, key=lambda s: (sum(left[s][d] * unit[i][d] for d in range(3)), -s))
        else:
            s = max(range(shards), key=lambda s: (min(left[s][d] - unit[i][d] for d in range(3)), -s))
        want[i] = s
        left[s] = [left[s][d] - unit[i][d] for d in range(3)]
    assert sharding.place(sizes, shards).tolist() == [want[i] for i in range(len(unit))]


#: What a token was before plain letters and digits were looked at first.
_DEAR = rf"[{sharding._ALONE}]|[\p{{L}}\p{{M}}\p{{N}}&&[^{sharding._ALONE}]]{{1,4}}|[^\s\p{{L}}\p{{M}}\p{{N}}]"


def test_tokens_of_every_code_point(spark):
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    rows = [(i, "".join(f"a{c}{c}bcd{c}efghi {c}" for c in points[i:i + 500])) for i in range(0, len(points), 500)]
    got = spark.createDataFrame([*rows, (-1, ""), (-2, None)], "i int, t string").select(
        "i", sharding.tokens_in(F.col("t")).alias("n"), F.regexp_count("t", F.lit(_DEAR)).alias("wanted"))
    assert got.filter(~F.col("n").eqNullSafe(F.col("wanted"))).count() == 0


def test_tokens_of_plain_text_need_no_scripts(spark):
    docs = spark.range(0, 400, 1, 4).select(F.repeat(F.concat_ws(" ", F.lit("plain words, and more of them"), "id"), F.lit(400)).alias("t")).localCheckpoint()

    def seconds(count):
        begun = time.perf_counter()
        docs.agg(F.sum(count)).first()
        return time.perf_counter() - begun

    plain, dear = (min(seconds(x) for _ in range(3)) for x in (sharding.tokens_in(F.col("t")), F.regexp_count("t", F.lit(_DEAR))))
    assert plain < 0.7 * dear
