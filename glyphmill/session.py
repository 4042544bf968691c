"""Session helper.  Nothing here is needed on a cluster that already hands out a session."""
from __future__ import annotations

import tempfile
from threading import Lock

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8, app: str = "glyphmill") -> SparkSession:
    """A local session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's shared checkpoint folder; make a temporary one only for a local master without any."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not context.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="glyphmill-ckpt-"))


def in_parallel(calls: list, at_once: int = 5) -> list:
    """Results of functions that start Spark jobs of their own, run from as many threads; their jobs share the executors."""
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target

    if not calls:
        return []
    spark = SparkSession.active()
    with ThreadPool(min(at_once, len(calls))) as pool:
        return [x.get() for x in [pool.apply_async(inheritable_thread_target(spark)(call)) for call in calls]]


#: Drops the shuffle files of a query when it ends (Spark 4); read when a query is made, so it is on only while one is copied.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_conf_lock = Lock()


def _dropping_shuffles(df: DataFrame) -> DataFrame:
    """The same table as a query that drops its shuffle files when it ends, on all executors."""
    conf = df.sparkSession.conf
    with _conf_lock:
        before = conf.get(_DROP_SHUFFLES, None)
        conf.set(_DROP_SHUFFLES, "true")
        try:
            return df.select("*")
        finally:
            conf.unset(_DROP_SHUFFLES) if before is None else conf.set(_DROP_SHUFFLES, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors.

    Once it is written nothing reads the shuffles behind it, so they go at once; otherwise they would lie on the executors until the driver
    collects its garbage, and the steps of a query would add up.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return _dropping_shuffles(df).checkpoint(eager=True)


def drop_table(*tables: DataFrame) -> None:
    """Delete the files of the checkpoints (results of ``cut_lineage``) that these tables read, when no later step reads them."""
    for df in tables:
        spark, leaves = df.sparkSession, df._jdf.queryExecution().analyzed().collectLeaves()
        for i in range(leaves.size()):
            if leaves.apply(i).getClass().getSimpleName() == "LogicalRDD" and (found := leaves.apply(i).rdd().getCheckpointFile()).isDefined():
                path = spark._jvm.org.apache.hadoop.fs.Path(found.get())
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
