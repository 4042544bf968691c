"""Exact dedup by progressive refinement: length, then a hash of the beginning, then a hash of the whole.

Texts are equal when they are the same without white space.  Each level only looks at rows that the level before
could not tell apart from every other row:

1. rows per stripped length (one narrow aggregate);
2. rows per slot of (length, hash of the first and last characters), among lengths that occur twice or more;
3. the hash of the whole text, only of rows whose slot occurs twice or more.  Only these rows are shuffled.

The levels hand over through bitmaps of fixed size (`base.slot_filter`), so texts never move and nothing that is
broadcast grows with the data.  A hot group (a third of all rows may be copies of one text) is one row after the
map-side half of the aggregate, and the join that hands its result back is a plain equi-join, which adaptive execution
splits.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glyphmill.llm.base import checkpointed, drop_rows, read, slot_filter, slot_of, stripped

#: Characters at either end that the second level hashes.
EDGE = 256
LENGTH_BITS = 20


def _whole(bare: Column) -> Column:
    return F.sha2(bare, 256)


def refine(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slot_bits: int = 24,
           whole_hash_of_all: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in the original text stays, then the smallest id (a null id
    counts as the largest).  A null text counts as empty; empty texts are equal to each other.  Rows that repeat both
    id and text are rows of the same group and are all marked kept where their id is the one that stays.  No rows
    give no rows; other columns are not looked at.  text_sha256 is null where the whole text never had to be read,
    unless ``whole_hash_of_all``.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t")).select(
        "doc_id", F.char_length("_t").cast("long").alias("_len"), stripped(F.col("_t")).alias("_bare")).withColumn(
        "_n", F.char_length("_bare"))

    lengths = base.groupBy("_n").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select(
        slot_of(F.col("_n"), LENGTH_BITS).alias("s"))
    same_length = slot_filter(base, lengths, slot_of(F.col("_n"), LENGTH_BITS), LENGTH_BITS, "_l")

    edges = slot_of(F.struct("_n", F.left("_bare", F.lit(EDGE)), F.right("_bare", F.lit(EDGE))), slot_bits)
    sized = same_length.withColumn("_e", F.when(F.col("_l"), edges))
    slots = sized.filter(F.col("_e").isNotNull()).groupBy("_e").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("_e")
    open_rows = slot_filter(sized, slots, F.coalesce("_e", F.lit(0)), slot_bits, "_p").select(
        "doc_id", "_len", "_bare", (F.col("_p") & F.col("_e").isNotNull()).alias("_p"))

    hashed = open_rows.select(
        "doc_id", "_len", F.when(F.col("_p") | F.lit(whole_hash_of_all), _whole(F.col("_bare"))).alias("_h"), "_p")
    hashed = checkpointed(hashed)  # narrow; read three times below instead of the texts
    # a null id is stored as the largest long, and so never wins against another
    best = F.max(F.struct(F.col("_len"), (-F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))).alias("_neg"), F.col("doc_id").alias("_id")))
    groups = hashed.filter("_p").groupBy("_h").agg(best.alias("_best"), F.count(F.lit(1)).alias("_size")).select(
        "_h", F.col("_best._id").alias("_keep"), "_size")
    groups = checkpointed(groups)  # one row per group; as a table of its own the join below deals out both sides and can split a hot key
    matched = hashed.filter("_p").join(groups, "_h").select("doc_id", F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
                                                          F.col("doc_id").eqNullSafe(F.col("_keep")).alias("kept"), F.col("_h").alias("text_sha256"))
    alone = hashed.filter(~F.col("_p")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                               F.lit(True).alias("kept"), F.col("_h").alias("text_sha256"))
    return matched.unionByName(alone)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slot_bits: int = 24) -> DataFrame:
    """``docs`` with one row of each group of equal texts (see `refine`), all columns as they are.

    Rows that repeat both id and text are reduced to one.
    """
    found = refine(docs, id_col, text_col, slot_bits).filter(F.col("group_size") > 1)
    key = {"doc_id": F.col(id_col), "text_sha256": _whole(stripped(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))}
    repeated = found.filter("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    return drop_rows(docs, key, found.filter("not kept"), slot_bits, once=repeated)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refine(read(spark, sf_dir, "documents"), whole_hash_of_all=True)


ORACLE = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as len,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as h
  from documents
), r as (
  select *, first_value(doc_id) over (partition by h order by len desc, doc_id) as keep_id,
         count(*) over (partition by h) as group_size
  from d
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, h as text_sha256 from r
"""
