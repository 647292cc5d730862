"""Session helpers: a tuned local session and reliable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# So many tables are worked on side by side: small jobs wait for the driver more than for the cores.
TABLES_AT_ONCE = 8


def local_session(cpus: int | str = "*", name: str = "rowloom") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    parallel = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(parallel))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # Recording the Python call site of every Column costs more than planning it.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    return tune(spark)


def tune(spark: SparkSession) -> SparkSession:
    """Session settings the wide generating projections need.

    A projection whose generated method passes 8000 bytecodes is never compiled by the JVM.
    With this limit Spark splits it into compiled pieces instead; measured about 3 times
    faster on 14 generated columns.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for cut lineage: the one the cluster names, or our own on a local master."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="rowloom-checkpoint-"))
        known = sc.getCheckpointDir()
    return known


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a table written to the shared folder; it survives the loss of executors.

    Read back, the table has true sizes, so later joins are planned on facts. Loops need that:
    a checkpoint keeps the estimates and constraints of its plan, which grow every round.
    """
    return materialize_counted(df)[0]


def materialize_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``materialize`` and the number of rows, counted while they are written."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/rowloom-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"]


def forget(table: DataFrame) -> None:
    """Give back the space of a table that ``materialize`` wrote and nothing will read again.

    The folder is overwritten by an empty table, so only Spark's own writer touches the shared folder.
    """
    files = table.inputFiles()
    if files:
        folder = files[0].rsplit("/", 1)[0]
        table.sparkSession.createDataFrame([], table.schema).coalesce(1).write.mode("overwrite").parquet(folder)


def spread(df: DataFrame) -> DataFrame:
    """The rows over as many partitions as there are cores, for rows that are small beside the work they make.

    The number is given, so adaptive execution does not merge the partitions for their size.
    """
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for when partitions must stay as they are on every reading."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def side_by_side(spark: SparkSession, work: Callable, items: Iterable) -> list:
    """``work`` on every item, the jobs of several items at a time; results in the order of the items."""
    with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), items))
