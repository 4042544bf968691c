"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly over the shards.

Equal texts form a group and go to one shard, as far as that allows near-equal shards.  What is placed is a unit:

* a heavy group (in bytes, tokens or rows above 1/FINE of a shard's share) is a unit of its own; there are at most
  3 * shards * FINE of them, whatever the data.  One above 1/WHOLE of a share is cut by a hash of the row into chunks
  of about that size;
* all other groups are gathered into shards * CELLS cells by a hash of the group.

So at most a few tens of thousands of unit sizes, independent of the number of rows, reach the driver.  Units are placed
largest first, each on the shard where the dot product of its size with the residual capacities is highest among those
that still have room for it; where none has, on the shard that is left with the least overload.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glyphmill.llm.base import checkpointed, numbered, read

FINE = 64
WHOLE = 4
CELLS = 256
ROW_OVERHEAD = 16
_ALONE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
#: Looking up a script is dear, so plain letters and digits come first; what starts no word and is no space is a token by itself.
TOKEN = rf"[A-Za-z0-9[\p{{L}}\p{{M}}\p{{N}}&&[^{_ALONE}]]]{{1,4}}|\S"


def place(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unit; ``sizes`` has a row per unit and a column per dimension."""
    total = sizes.sum(axis=0)
    share = sizes / np.where(total > 0, total, 1) * shards  # a shard holds 1 of each
    left = np.ones((shards, sizes.shape[1]))
    where = np.zeros(len(sizes), dtype=np.int64)
    for i in np.lexsort((np.arange(len(sizes)), -share.max(axis=1))):
        after = left - share[i]
        fits = (after >= -1e-12).all(axis=1)
        if fits.any():
            where[i] = np.argmax(np.where(fits, left @ share[i], -np.inf))
        else:
            where[i] = np.argmax(after.min(axis=1))
        left[where[i]] = after[where[i]]
    return where


def tokens_in(text: Column) -> Column:
    """Started fours of letters or digits in a word, single signs, and single letters of scripts without spaces: no space is needed between tokens."""
    return F.regexp_count(text.cast("string"), F.lit(TOKEN))


def assign(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, n_tokens, text_crc32, shard, slot (gapless from 0 in a shard).

    ``size`` is the UTF-8 length of the text (null: none) plus 16.  ``tokens`` is an expression on ``docs``; without it
    the number of spaces plus one stands for it.  Null ids, empty texts and repeated rows are rows like others; equal
    texts share a shard unless their group is heavy.  No rows give no rows; other columns are not looked at.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    count = tokens if tokens is not None else F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit(""))) + 1
    base = checkpointed(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.coalesce(count, F.lit(0)).cast("long").alias("n_tokens"), F.crc32(text).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("_g")))
    dims = [F.sum("size").alias("b"), F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("r")]
    total = base.agg(*dims).first()
    spark = docs.sparkSession
    if not total["r"]:
        return base.select("doc_id", "size", "n_tokens", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    over = F.greatest(*[F.col(c) * (shards * FINE) / max(1, total[c]) for c in "btr"])
    heavy = base.groupBy("_g").agg(*dims).filter(over > 1).select("_g", F.ceil(over * WHOLE / FINE).cast("int").alias("_chunks"))
    heavy = checkpointed(heavy)
    unit = base.join(F.broadcast(heavy), "_g", "left").withColumns({
        "_u": F.when(F.col("_chunks").isNotNull(), F.col("_g")).otherwise(F.pmod(F.xxhash64("_g", F.lit(1)), F.lit(shards * CELLS))),
        "_c": F.when(F.col("_chunks").isNotNull(), F.pmod(F.xxhash64("doc_id", "_g"), F.col("_chunks"))).otherwise(F.lit(-1)).cast("long")})
    units = sorted(unit.groupBy("_u", "_c").agg(*dims).collect())
    chosen = place(np.array([[u["b"], u["t"], u["r"]] for u in units], dtype=float), shards)
    table = spark.createDataFrame([(u["_u"], u["_c"], int(s)) for u, s in zip(units, chosen)], "_u long, _c long, shard int")
    placed = unit.join(F.broadcast(table), ["_u", "_c"]).drop("_u", "_c", "_chunks")
    return numbered(placed, ["shard"], ["doc_id", "_g"], total["r"] // shards, "slot").drop("_g")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances bytes, rows and ``tokens_in`` of the text."""
    return assign(read(spark, sf_dir, "documents"), tokens=tokens_in(F.col("text"))).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "n_tokens")
