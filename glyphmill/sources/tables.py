"""Scans and sinks."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input that arrives in fewer splits than there are cores.

    Large inputs already come in many splits and pass through untouched, so no shuffle is added to them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows that one task makes out of the rows it reads.
TASK_ROWS = 500_000


def dealt(df: DataFrame, key: str, times: int) -> DataFrame:
    """Rows dealt by ``key``, before each becomes ``times`` rows, over so many tasks that none makes many more than ``TASK_ROWS``.

    What is grouped by the key afterwards needs no further shuffle, so only the rows themselves move, not what they become.
    """
    return dealt_over(df, key, -(-df.count() * times // TASK_ROWS))


def dealt_over(df: DataFrame, key: str, tasks: int) -> DataFrame:
    """Rows dealt by ``key`` over ``tasks`` tasks, or as many as there are cores if that is more."""
    return df.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism), key)


def read_wide_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All-string wide table with a header; no type inference, so one pass over the file."""
    reader = spark.read.option("header", True)
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path)


def feature_columns(df: DataFrame, *reserved: str) -> list[str]:
    """All columns that are neither id nor label, in table order."""
    return [c for c in df.columns if c not in reserved]


def unpivot_cells(df: DataFrame, ids: list[str], features: list[str], reference: str | None = "WT") -> DataFrame:
    """Wide -> long (ids, gene, cell).  With a reference value, reference and null cells are dropped at once."""
    long = df.unpivot(ids, features, "gene", "cell")
    return long if reference is None else long.filter(F.col("cell") != reference)


def head_per_group(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first n rows of every group; Spark keeps n rows per task and group before the shuffle."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def write_csv_ordered(df: DataFrame, path: str, order: list[str]) -> None:
    """Header CSV in a fixed column and row order: range partitions keep the order across part files."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def roundtrip_difference(spark: SparkSession, written: DataFrame, path: str) -> int:
    """Rows that differ between a frame and what was written, both ways (0 = equal)."""
    back = read_wide_csv(spark, path, written.columns)
    expected = written.select([F.col(c).cast("string").alias(c) for c in written.columns])
    return expected.exceptAll(back).count() + back.exceptAll(expected).count()


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def as_json_rows(df: DataFrame, name: str = "record") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def export_probabilities(prob: DataFrame, keys: list[str], classes: list[str], prefix: str = "prob_") -> DataFrame:
    """Long -> one column per class."""
    wide = prob.groupBy(*keys).pivot("cls", classes).agg(F.first("p"))
    return wide.select(*keys, *[F.col(f"`{c}`").alias(prefix + c) for c in classes])


def import_probabilities(wide: DataFrame, keys: list[str], classes: list[str], prefix: str = "prob_") -> DataFrame:
    """One column per class -> long, rows renormalised to sum to one (in the row, before exploding)."""
    total = sum((F.col(f"`{prefix}{c}`") for c in classes), F.lit(0.0))
    pairs = F.array(*[
        F.struct(F.lit(c).alias("cls"), (F.col(f"`{prefix}{c}`") / F.nullif(total, F.lit(0.0))).alias("p"))
        for c in classes
    ])
    return wide.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.cls", "x.p")


def probability_families(columns: list[str], classes: list[str], separator: str = "__") -> list[str]:
    """Prefixes for which every class has a column."""
    seen: dict[str, set[str]] = {}
    for column in columns:
        prefix, _, suffix = column.rpartition(separator)
        if prefix:
            seen.setdefault(prefix, set()).add(suffix)
    return sorted(p for p, found in seen.items() if set(classes) <= found)


def labelled_template(template: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Rows of the template in its own order, each with its predicted label (null if none)."""
    return template.join(predictions, key, "left")


def read_placed(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """A header CSV or Parquet table with ``place``, the 0-based number of each row in file order.

    Files count in the order of their names.  Parquet files know a row's index.  A text file is read in blocks, each by one task from its start to
    its end, so the block's offset and a number that grows inside the task give the order; rows are numbered inside a block, and only the table of
    block sizes is summed up.  A file that cannot be split (gzip) is one block.
    """
    if kind == "parquet":
        rows = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_file"), F.lit(0).alias("_block"), F.col("_metadata.row_index").alias("_row"))
    elif kind == "csv":
        rows = read_wide_csv(spark, path).select(
            "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
        inside = Window.partitionBy("_file", "_block").orderBy("_row")  # at most spark.sql.files.maxPartitionBytes of text
        rows = rows.withColumn("_row", F.row_number().over(inside) - 1)
    else:
        raise ValueError(f"no order is known for files of kind {kind!r}")
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    sizes = rows.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_file", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return rows.join(offsets, ["_file", "_block"]).withColumn("place", F.col("_row") + F.col("_o")).drop("_file", "_block", "_row", "_o")


def checked_template(template: DataFrame, predictions: DataFrame, key: str, label: str = "label") -> DataFrame:
    """``labelled_template`` of a template with places, or ValueError: every key must occur once in the template and once among the predictions,
    with a label, and no prediction may lack a row of the template.  One aggregate by key finds all four faults.
    """
    here = template.select(key, F.lit(1).alias("_t"), F.lit(0).alias("_p"), F.lit(0).alias("_l"))
    there = predictions.select(key, F.lit(0).alias("_t"), F.lit(1).alias("_p"), F.col(label).isNotNull().cast("int").alias("_l"))
    per = here.unionByName(there).groupBy(key).agg(*[F.sum(c).alias(c) for c in ("_t", "_p", "_l")])
    faults = per.agg(
        F.count_if((F.col("_t") > 1) | ((F.col("_t") > 0) & F.col(key).isNull())).alias("repeated or null in the template"),
        F.count_if(F.col("_p") > 1).alias("predicted more than once"),
        F.count_if((F.col("_t") > 0) & (F.col("_l") == 0)).alias("without a predicted label"),
        F.count_if(F.col("_t") == 0).alias("not in the template")).first().asDict()
    if any(faults.values()):
        raise ValueError("template and predictions do not agree: " + ", ".join(f"{n} keys {what}" for what, n in faults.items() if n))
    return labelled_template(template, predictions.select(key, label), key)


def write_template(labelled: DataFrame, path: str, key: str, label: str = "label") -> DataFrame:
    """Write (key, label) as header CSV in the template's order; what was written is read back and compared place by place.

    Range partitions keep the order across the part files.  Returns the rows read back, all strings, with their places.
    """
    labelled.repartitionByRange("place").sortWithinPartitions("place").select(key, label).write.mode("overwrite").option("header", True).csv(path)
    back = read_placed(labelled.sparkSession, path)
    wanted = labelled.select("place", F.col(key).cast("string").alias("_k"), F.col(label).cast("string").alias("_l"))
    wrong = wanted.join(back, "place", "full").filter(~(F.col(key).eqNullSafe(F.col("_k")) & F.col(label).eqNullSafe(F.col("_l")))).count()
    if wrong:
        raise ValueError(f"{wrong} rows of {path} differ from what was to be written at their place")
    return back


def upsert(board: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Replace rows with the same key, keep the others."""
    return board.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder (a local one only where none is configured)."""
    import uuid

    from glyphmill.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
