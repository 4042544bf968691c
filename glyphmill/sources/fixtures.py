"""Token tables derived from the star-schema tables.

customer = sample, market segment = label, part brand = gene, and a notation string built from the
customer's line items = event.  Everything is row-level arithmetic plus two key joins, so the derived
tables grow with their inputs.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glyphmill.functions import cells
from glyphmill.functions.hashing import md5_int
from glyphmill.operators import folds
from glyphmill.operators.ranks import by_rows
from glyphmill.session import cut_lineage
from glyphmill.sources.tables import dealt, dealt_over, spread, table

LETTERS = cells.AMINO

#: Line items behind the events of one task; queries make up to ten rows of each event.
EVENT_ROWS = 250_000

# Row-level text of the raw-cell fixture (plain SQL so that any engine can evaluate the same text).
NOTATION = """
case (l_orderkey + l_partkey * 3 + l_suppkey) % 32
 when 8 then concat(a, p, a) when 9 then concat(a, p, '*') when 10 then concat(a, p, 'FS')
 when 11 then concat(a, p, 'fs') when 12 then concat(a, p, 'X') when 13 then concat(p, 'DEL')
 when 14 then concat(p, 'del') when 15 then concat(a, p, '_', b, p, 'DELINS')
 when 16 then concat('IVS', p, '+2') when 17 then concat('SPLICE_', p) when 18 then concat('*', p, '*')
 when 19 then concat(p, '_', p, a, b, '>F*') when 20 then concat(a, '-', p, b)
 when 21 then concat(p, 'INS', a, b) when 22 then concat(p, 'DUP') when 23 then 'START_LOST'
 when 24 then concat('STOP_LOSS', p) when 25 then concat(a, p) when 26 then 'AX'
 when 27 then concat(a, p, 'FSDEL') when 28 then concat(a, p, 'TER') when 29 then concat('p.', a, p, b)
 when 30 then lower(concat(a, p, b)) when 31 then 'UNCLEAR' else concat(a, p, b) end
"""
CELL = """
case when l_linenumber = 7 and l_partkey % 3 = 0 then null
 when l_linenumber = 7 and l_partkey % 3 = 1 then 'WT'
 when l_linenumber = 7 then '  '
 when l_linenumber = 6 then concat(n, ';', a, p, b, ' ; ', n)
 when l_linenumber = 5 then concat(n, '|', b, p, a)
 when l_linenumber = 4 then concat(n, ', ', a, p, '*')
 when l_linenumber = 3 then concat(a, p, b, b, p, a)
 when l_linenumber = 2 then concat(n, '/', a, p, 'FS') else n end
"""


def letter(key: str) -> Column:
    return F.expr(f"substr('{LETTERS}', cast({key} % 20 as int) + 1, 1)")


class Fixtures:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @cached_property
    def samples(self) -> DataFrame:
        return self.t("customer").select(F.col("c_custkey").alias("sid"), F.col("c_mktsegment").alias("label"))

    @cached_property
    def classes(self) -> list[str]:
        """The label domain: checked to be small before it reaches the driver."""
        return classes_of(self.samples)

    @cached_property
    def line_items(self) -> DataFrame:
        return spread(self.t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))

    @cached_property
    def documents(self) -> DataFrame:
        return spread(self.t("documents"))

    @cached_property
    def events(self) -> DataFrame:
        """Distinct (sid, gene, event), dealt by sample.

        The number of tasks follows the line items, not the compressed bytes that were shuffled, so a task holds about ``EVENT_ROWS`` of them
        at any size, and what is grouped by sample afterwards needs no further shuffle.
        """
        position = F.expr("cast(l_partkey % 1500 + 1 as string)")
        tail = F.expr("case when l_linenumber = 7 then 'FS' when l_linenumber = 6 then '*' end")
        orders = self.t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        parts = self.t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
        rows = by_rows(by_rows(self.line_items, orders, ["l_orderkey"]), parts, ["l_partkey"])
        found = rows.select(
            F.col("o_custkey").alias("sid"),
            F.col("p_brand").alias("gene"),
            F.concat(letter("l_partkey"), position, F.coalesce(tail, letter("l_suppkey"))).alias("event"),
        )
        return dealt_over(found, "sid", -(-self.t("lineitem").count() // EVENT_ROWS)).distinct()

    @cached_property
    def typed(self) -> DataFrame:
        return typed_events(self.events)

    @cached_property
    def parsed(self) -> DataFrame:
        """``typed``, joined and parsed once: for queries that read it more than once."""
        return cut_lineage(self.typed)

    def tokens(self, level: str = "gene_type") -> DataFrame:
        """Distinct (sid, token)."""
        return token_table(self.typed, level)

    @cached_property
    def cells(self) -> DataFrame:
        """(sid, gene, cell): a sample's events of one gene joined by ';'.  A cell is one table cell by nature."""
        text = F.concat_ws(";", F.array_sort(F.collect_set("event")))
        decorated = (
            F.when(F.pmod(F.col("sid"), F.lit(7)) == 0, F.lower("cell"))
            .when(F.pmod(F.col("sid"), F.lit(7)) == 1, F.concat(F.lit("p."), F.col("cell")))
            .otherwise(F.col("cell"))
        )
        return self.events.groupBy("sid", "gene").agg(text.alias("cell")).withColumn("cell", decorated)

    @cached_property
    def wide(self) -> DataFrame:
        """One string column per gene, reference where a sample has no event.  The 25 brands are the schema."""
        brands = [f"Brand#{i}" for i in range(1, 26)]
        pivoted = self.cells.groupBy("sid").pivot("gene", brands).agg(F.first("cell"))
        filled = self.samples.join(pivoted, "sid", "left")
        return filled.select("sid", "label", *[F.coalesce(F.col(f"`{b}`"), F.lit("WT")).alias(b) for b in brands])

    @cached_property
    def raw_cells(self) -> DataFrame:
        """(sid, line, gene, cell, label): one messy cell per line item, no shuffle."""
        base = self.line_items.select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
            letter("l_partkey").alias("a"), letter("l_suppkey").alias("b"),
            F.expr("cast(l_partkey % 1500 + 1 as string)").alias("p"),
        ).withColumn("n", F.expr(NOTATION))
        return base.select(
            F.col("l_orderkey").alias("sid"),
            F.col("l_linenumber").alias("line"),
            F.expr("concat('G', cast(l_partkey % 40 as string))").alias("gene"),
            F.expr(CELL).alias("cell"),
            F.col("n").alias("notation"),
            F.expr("l_partkey % 5").alias("grp"),
        )

    def folds(self, k: int = 5, seed: int = 42) -> DataFrame:
        return folds.stratified_folds(self.samples, k, seed)

    def prob(self, variants: list[str], signal: int = 0) -> DataFrame:
        """(sid, label, variant, cls, p): md5-derived probabilities, normalised inside the row.

        ``signal`` is added to the weight of the true class, so that metrics are not all chance level.
        """
        classes = self.classes
        per_variant = F.explode(F.array(*[F.lit(v) for v in variants]))
        base = dealt(self.samples, "sid", len(variants) * len(classes)).withColumn("variant", per_variant)
        weights = [
            F.lit(1)
            + md5_int(F.concat_ws(":", F.col("variant"), F.col("sid").cast("string"), F.lit(c))) % 1000
            + F.when(F.col("label") == c, F.lit(signal)).otherwise(F.lit(0))
            for c in classes
        ]
        base = base.withColumn("w", F.array(*[w.cast("double") for w in weights]))
        base = base.withColumn("total", F.aggregate("w", F.lit(0.0), lambda acc, x: acc + x))
        pairs = F.array(*[
            F.struct(F.lit(c).alias("cls"), (F.col("w")[i] / F.col("total")).alias("p")) for i, c in enumerate(classes)
        ])
        return base.select("sid", "label", "variant", F.explode(pairs).alias("x")).select(
            "sid", "label", "variant", "x.cls", "x.p"
        )


def classes_of(samples: DataFrame, limit: int = 2_000) -> list[str]:
    found = [r[0] for r in samples.select("label").distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"more than {limit} labels; class-wide columns do not fit")
    return sorted(x for x in found if x is not None)


def typed_events(events: DataFrame, dialect: str = "standard7") -> DataFrame:
    e = F.col("event")
    return events.select(
        "*",
        cells.DIALECTS[dialect](e).alias("event_type"),
        cells.substitution_ref(e).alias("ref"),
        cells.substitution_position(e).alias("position"),
        cells.substitution_alt(e).alias("alt"),
    )


def token_table(typed: DataFrame, level: str) -> DataFrame:
    return typed.select("sid", cells.token(level).alias("token")).filter(F.col("token").isNotNull()).distinct()
