"""Benchmark decontamination: a broadcast table of normalised test n-grams, verified hits, spans or documents removed.

A window is ``n`` consecutive words of a benchmark item (the whole item where it is shorter).  Looking up every
window of every document would make one row per word of the corpus.  A document is cut into blocks of g words
instead, and any run of 2g-1 words contains one whole block, so only one row per g words meets the benchmark table,
which holds the g-grams of the items at all positions together with the words on either side.  A block that meets an
item is extended word by word to the left and right; the hit counts when the common run is as long as the window.
The result is exact: it has every occurrence of every window and nothing else.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glyphmill.llm.base import ascii_lower, drop_rows, read

#: What separates words after lower-casing, and in the original text.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
SEPARATORS_RAW = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD_RAW = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WINDOW = 13


def normalised(text: Column) -> Column:
    """The words in lower case, each followed by one space."""
    words = F.trim(F.regexp_replace(ascii_lower(text), SEPARATORS + "+", " "))
    return F.when(words == "", F.lit("")).otherwise(F.concat(words, F.lit(" ")))


def _blocks(words: Column, size: int) -> Column:
    return F.regexp_extract_all(words, F.lit("(?:[^ ]+ ){1,%d}" % size), F.lit(0))


def ngram_table(bench: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """A row per position of an item at which a whole block of g words starts: g, block, item, need, before, after.

    ``before`` has the words in front of the block, nearest first, ``after`` those behind it, as far as a window reaches.
    """
    items = bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
                         F.split(F.rtrim(normalised(F.coalesce(F.col(text_col).cast("string"), F.lit("")))), " ").alias("w"))
    items = items.filter(F.col("w")[0] != "").distinct()
    need = F.least(F.size("w"), F.lit(n))
    sized = items.select("item", "w", need.alias("need"), F.floor((need + 1) / 2).cast("int").alias("g"))
    at = sized.withColumn("p", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("g"))))
    reach = F.col("need") - F.col("g")
    left = F.least(F.col("p"), reach)
    return at.select(
        "g", F.concat(F.array_join(F.slice("w", F.col("p") + 1, F.col("g")), " "), F.lit(" ")).alias("block"), "item", "need",
        F.reverse(F.slice("w", F.col("p") - left + 1, left)).alias("before"),
        F.slice("w", F.col("p") + F.col("g") + 1, reach).alias("after"))


def _common(a: Column, b: Column) -> Column:
    """How many first elements two arrays share."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))),
        F.struct(F.lit(0).alias("k"), F.lit(True).alias("go")),
        lambda s, same: F.struct((s["k"] + F.when(s["go"] & same, 1).otherwise(0)).alias("k"), (s["go"] & same).alias("go")),
        lambda s: s["k"])


def find_windows(docs: DataFrame, bench: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = 500_000) -> DataFrame:
    """One row per document: doc_id, _th, n_words, n_hit, n_items, items (sorted strings), spans (merged word ranges).

    A null or empty text has no words and no hits; an item without words has no windows.  Repeated rows (same id
    and text) give one row each time.  Documents that share an id but not a text are told apart by ``_th``, a hash of
    the text.  A null item id counts as an item named ''.  No documents give no rows, no items no hits.  Other columns
    are not looked at.  The n-gram table is broadcast up to ``broadcast_rows`` rows (a row has at most 3 * n words);
    a larger one is joined by a shuffle on the block.
    """
    grams = ngram_table(bench, n, item_id_col, item_text_col)
    known = grams.groupBy("g").agg(F.count(F.lit(1)).alias("rows")).collect()  # at most (n + 1) / 2 rows
    sizes = sorted(r["g"] for r in known)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("_th"), normalised(text).alias("_w"))
    counted = words.withColumn("n_words", (F.char_length("_w") - F.char_length(F.replace(F.col("_w"), F.lit(" "), F.lit("")))).cast("long"))
    cut = counted.withColumns({f"_b{g}": _blocks(F.col("_w"), g) for g in sizes})

    def around(g: int) -> Column:
        b = F.col(f"_b{g}")
        return F.transform(b, lambda x, i: F.struct(
            F.lit(g).alias("g"), i.alias("i"), F.coalesce(F.get(b, i - 1), F.lit("")).alias("prev"), x.alias("cur"),
            F.coalesce(F.get(b, i + 1), F.lit("")).alias("next")))

    own = F.array(F.struct(F.lit(0).alias("g"), F.lit(0).alias("i"), F.lit("").alias("prev"), F.lit("").alias("cur"), F.lit("").alias("next")))
    rows = cut.select("doc_id", "_th", "n_words", F.explode(F.concat(own, *[around(g) for g in sizes])).alias("x")).select(
        "doc_id", "_th", "n_words", "x.*")
    table = grams.select(F.col("g").alias("_g"), F.col("block").alias("_block"), "item", "need", "before", "after")
    if sum(r["rows"] for r in known) <= broadcast_rows:
        table = F.broadcast(table)
    met = rows.join(table, (F.col("g") == F.col("_g")) & (F.col("cur") == F.col("_block")), "left").filter(
        (F.col("g") == 0) | F.col("item").isNotNull())
    left = _common(F.col("before"), F.reverse(F.split(F.rtrim("prev"), " ")))
    right = _common(F.col("after"), F.split(F.rtrim("next"), " "))
    extended = met.withColumn("_l", F.when(F.col("g") > 0, left)).withColumn("_r", F.when(F.col("g") > 0, right)).filter(
        (F.col("g") == 0) | (F.col("_l") + F.col("g") + F.col("_r") >= F.col("need")))
    span = F.when(F.col("g") > 0, F.struct((F.col("i") * F.col("g") - F.col("_l")).alias("start"),
                                           ((F.col("i") + 1) * F.col("g") + F.col("_r")).alias("end")))
    found = extended.groupBy("doc_id", "_th").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.collect_set(span)).alias("_spans"),
        F.array_sort(F.collect_set(F.when(F.col("g") > 0, F.col("item")))).alias("items"),
        F.sum(F.when(F.col("g") == 0, 1).otherwise(0)).alias("_rows"))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    merged = F.aggregate("_spans", empty, lambda done, s: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"))))
    ).otherwise(F.concat(done, F.array(s))))
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + (s["end"] - s["start"]))
    return found.withColumn("spans", merged).select(
        "doc_id", "_th", "n_words", total.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans",
        F.explode(F.sequence(F.lit(1), F.col("_rows"))).alias("_again")).drop("_again")


def contaminated() -> Column:
    """A document is contaminated when hit words are a twentieth of its words or more."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated documents, all columns as they are; repeated rows go or stay together."""
    gone = find_windows(docs, bench, n, id_col, text_col).filter(contaminated()).select("doc_id", "_th")
    return drop_rows(docs, {"doc_id": F.col(id_col), "_th": F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))}, gone)


def cut_spans(docs: DataFrame, bench: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text without the hit words (each goes with what follows it up to the next word), n_hit; all documents."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hits = find_windows(docs, bench, n, id_col, text_col).filter("n_hit > 0").select(
        F.col("doc_id").alias("_id"), F.col("_th").alias("_h"), "spans", "n_hit").distinct()
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("_th"))
    joined = base.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_h")), "left")
    chunks = F.regexp_extract_all("text", F.lit(f"{WORD_RAW}+{SEPARATORS_RAW}*"), F.lit(0))
    left = F.filter(chunks, lambda c, i: ~F.exists("spans", lambda s: (i >= s["start"]) & (i < s["end"])))
    shorter = F.concat(F.regexp_extract("text", f"^{SEPARATORS_RAW}*", 0), F.array_join(left, ""))
    return joined.select("doc_id", F.when(F.col("spans").isNotNull(), shorter).otherwise(F.col("text")).alias("text"),
                         F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_windows(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        contaminated().alias("contaminated"))


ORACLE = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), bw as (
  select distinct item_id, n, array_to_string(w[p:p + n - 1], ' ') as win
  from (select item_id, w, least(len(w), 13) as n, unnest(range(1, len(w) - least(len(w), 13) + 2)) as p from b where len(w) > 0)
), lengths as (select distinct n from bw
), dw as (
  select doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d, lengths where len(w) >= n)
), h as (select dw.doc_id, dw.p, dw.n, bw.item_id from dw join bw using (n, win)
), hit as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from h) group by 1
), it as (
  select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as items
  from (select distinct doc_id, cast(item_id as varchar) as i from h) group by 1
)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (doc_id) left join it using (doc_id)
"""
