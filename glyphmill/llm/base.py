"""What the corpus operators share: text normal forms, fixed-size membership filters, distributed numbering."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from glyphmill.session import cut_lineage, ensure_checkpoint_dir

#: The white space of the contracts, `[\x20\x09-\x0D]`.
WHITE = (" ", "\n", "\t", "\r", "\x0b", "\x0c")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Bits per row of a membership filter, fixed by the function that builds bitmaps.
BITS_A_ROW = 32_768


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; later jobs read it instead of repeating the work."""
    return cut_lineage(df)


def release(spark: SparkSession) -> None:
    """Let Spark remove shuffle and checkpoint files of tables that nothing refers to any more.

    Its cleaner acts when the driver's JVM collects their handles, which a driver with little to do may not do for a long time.
    """
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def narrowed(df: DataFrame) -> DataFrame:
    """As many partitions as a shuffle would give, at most: tables that are added to again and again do not fall into ever more files."""
    return df.coalesce(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is (``lower`` is that, and faster, where all is ASCII)."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))


def stripped(text: Column) -> Column:
    """The text without any white space."""
    for char in WHITE:
        text = F.replace(text, F.lit(char), F.lit(""))
    return text


def slot_of(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << bits))


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column of ``df`` has, in whatever case."""
    tag = "_gm_"
    while any(c.lower().startswith(tag) for c in df.columns):
        tag += "_"
    return tag


def slot_filter(df: DataFrame, slots: DataFrame, slot: Column, bits: int, out: str) -> DataFrame:
    """Add boolean ``out``: is the row's slot among ``slots`` (one column, any repeats)?

    The filter is a bitmap of 2**bits bits in at most 2**bits / 32,768 rows of 4 KB, so what is broadcast has a
    size that does not depend on the data (2 MB for 24 bits).  It has no false negatives; where it fills up, more
    rows pass and the exact step behind it does more work.
    """
    name, tag = slots.columns[0], free_prefix(df)
    maps = (
        slots.select(F.col(name).cast("long").alias(f"{tag}s"))
        .groupBy(F.floor(F.col(f"{tag}s") / BITS_A_ROW).cast("int").alias(f"{tag}row"))
        .agg(F.bitmap_construct_agg(F.col(f"{tag}s") % BITS_A_ROW).alias(f"{tag}map"))
    )
    placed = df.withColumn(f"{tag}slot", slot.cast("long")).withColumn(
        f"{tag}row", F.floor(F.col(f"{tag}slot") / BITS_A_ROW).cast("int"))
    at = (F.col(f"{tag}slot") % BITS_A_ROW).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(f"{tag}map"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.shiftright(byte, 0).bitwiseAND(F.call_function("shiftleft", F.lit(1), at % 8)) != 0, F.lit(False))
    return placed.join(F.broadcast(maps), f"{tag}row", "left").withColumn(out, hit).drop(f"{tag}row", f"{tag}slot", f"{tag}map")


def drop_rows(docs: DataFrame, key: dict[str, Column], drop: DataFrame, bits: int = 24, once: DataFrame | None = None) -> DataFrame:
    """``docs`` without the rows whose key is in ``drop``; of rows whose key is in ``once`` one stays.

    ``key`` names expressions on ``docs``; ``drop`` and ``once`` have columns of these names.  Nulls are values.
    Only rows that a fixed-size filter cannot clear are shuffled; all others pass straight through the scan.
    """
    names, tag = list(key), free_prefix(docs)
    own = {n: f"{tag}k{i}" for i, n in enumerate(names)}
    rename = lambda d: d.select(*[F.col(n).alias(own[n] + "r") for n in names])
    packed = lambda cols: F.struct(*cols)
    drop = rename(drop).distinct()
    once = rename(once).distinct() if once is not None else None
    touched = drop if once is None else drop.unionByName(once)
    slots = touched.select(slot_of(packed([F.col(own[n] + "r") for n in names]), bits).alias("s"))
    keyed = docs.withColumns({own[n]: key[n] for n in names})
    flagged = slot_filter(keyed, slots, slot_of(packed([F.col(own[n]) for n in names]), bits), bits, f"{tag}in")
    clear = flagged.filter(~F.col(f"{tag}in")).select(*docs.columns)
    rest = flagged.filter(f"{tag}in")
    same = None
    for n in names:
        part = F.col(own[n]).eqNullSafe(F.col(own[n] + "r"))
        same = part if same is None else same & part
    rest = rest.join(drop, same, "left_anti")
    if once is None:
        return clear.unionByName(rest.select(*docs.columns))
    single = rest.join(once, same, "left_anti").select(*docs.columns)
    repeated = rest.join(once, same, "left_semi").dropDuplicates([own[n] for n in names]).select(*docs.columns)
    return clear.unionByName(single).unionByName(repeated)


def numbered(df: DataFrame, groups: list[str], order: list[str], rows: int, out: str, per_bucket: int = 20_000) -> DataFrame:
    """0-based gapless number of each row in its group, without gathering a group in one task.

    Rows fall into hash buckets of about ``per_bucket`` rows (their number follows ``rows``, the row count of
    ``df``); a window over the small table of bucket sizes gives each bucket its first number.
    """
    buckets = max(8, -(-rows // per_bucket))
    keyed = df.withColumn("_gm_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = keyed.groupBy(*groups, "_gm_b").agg(F.count(F.lit(1)).alias("_gm_n"))
    before = Window.partitionBy(*groups).orderBy("_gm_b").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(*groups, "_gm_b", F.coalesce(F.sum("_gm_n").over(before), F.lit(0)).alias("_gm_o"))
    inside = Window.partitionBy(*groups, "_gm_b").orderBy(*order)
    return (
        keyed.withColumn("_gm_r", F.row_number().over(inside) - 1)
        .join(first, [*groups, "_gm_b"])
        .withColumn(out, (F.col("_gm_r") + F.col("_gm_o")).cast("long"))
        .drop("_gm_b", "_gm_r", "_gm_o")
    )


def text_slices(batch, column: int, limit: int = 4 << 20):
    """An Arrow batch in parts of at most ``limit`` bytes of text (one row at least), so that what a worker makes of them is bounded."""
    import numpy as np
    import pyarrow.compute as pc

    size = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


class WordMemory:
    """What a Python worker has made of words, in at most ``limit`` bytes, about.

    Two generations of half that size: a word that is asked for again moves to the younger one, and the older one goes when the younger is
    full, so frequent words stay.  Words longer than ``longest`` are not kept at all.  A worker keeps the words of one operator: the memory
    that is opened for a partition empties the one that was open before.
    """

    #: Bytes of a word and of the places of it and its value in a table.
    ENTRY = 200
    _open: "WordMemory | None" = None

    def __init__(self, limit: int, longest: int = 64):
        self.half, self.longest = limit // 2, longest
        self.clear()

    def open(self) -> None:
        last, WordMemory._open = WordMemory._open, self
        if last is not None and last is not self:
            last.clear()

    def clear(self) -> None:
        self.young: dict = {}
        self.old: dict = {}
        self.held = 0

    def get(self, word: str):
        value = self.young.get(word)
        if value is None:
            value = self.old.get(word)
            if value is not None:
                self.put(word, value)
        return value

    def put(self, word: str, value) -> None:
        """``value``: bytes, or a tuple of numbers."""
        if len(word) > self.longest:
            return
        if self.held > self.half:
            self.old, self.young, self.held = self.young, {}, 0
        self.young[word] = value
        self.held += self.ENTRY + (len(value) if isinstance(value, bytes) else 40 * len(value))


def release_arrow() -> None:
    """Give memory that Arrow holds in reserve back to the system; called at the end of a partition."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()


_shipped: set[str] = set()
#: Bytes of rows that go to a Python worker at a time.  Buffers of the JVM and the worker grow by doubling, so each takes a few times as much.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bound on the bytes of an Arrow batch to ``BATCH_BYTES``; a lower one stays.

    Ten thousand long texts, the session's other bound, are more than an executor should hold several times over.
    """
    from pyspark.errors import PySparkException

    try:
        now = spark.conf.get(_BATCH_SETTING, "")
    except PySparkException:
        return  # a Spark version without this setting
    digits = "".join(c for c in str(now) if c.isdigit())
    if not digits or int(digits) > BATCH_BYTES or not str(now).rstrip("b").isdigit():
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so that they need no installation of it, and keep their batches small."""
    import tempfile
    import zipfile
    from pathlib import Path

    import glyphmill

    small_batches(spark)  # per session, so always
    context, root = spark.sparkContext, Path(glyphmill.__file__).parent
    if context.applicationId in _shipped or not root.is_dir():
        return
    _shipped.add(context.applicationId)
    archive = Path(tempfile.mkdtemp(prefix="glyphmill-")) / "glyphmill-package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, Path("glyphmill") / file.relative_to(root))
    context.addPyFile(str(archive))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir; a temporary one on a local master without it)."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that this package has written, on whatever file system it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
