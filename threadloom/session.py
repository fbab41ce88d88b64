"""Session settings that the library reads or needs; nothing here is forced on a caller."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED = "spark.checkpoint.dir"
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int | str = "*", name: str = "threadloom", memory: str = "8g") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    parts = 8 if cpus == "*" else max(int(cpus), 1)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "true")
        .config(SHARED, tempfile.mkdtemp(prefix="threadloom-"))
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables that the driver and all executors share.

    It is the one named in ``spark.checkpoint.dir`` or set as checkpoint folder; without either it lies in the
    warehouse, which is shared as well. The kind of master plays no part.
    """
    named = spark.conf.get(SHARED, None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_threadloom"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write the table to the shared folder and read it back.

    Later steps neither recompute nor replan what came before, survive lost executors, read only the
    columns they need, and know the size, by which Spark picks broadcast joins. The shuffle files of the
    write are dropped when it ends. ``release`` deletes the table; what is left goes when the session ends.
    Large tables that stay long take less disk with a ``compression`` of their own, such as ``zstd``.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/threadloom-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(CLEAN_UP, before)
    where, fs = _files(spark, path)
    fs.deleteOnExit(where)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def release(*tables: DataFrame) -> None:
    """Delete tables that ``cut_lineage`` returned; nothing may read them later."""
    for table in tables:
        where, fs = _files(table.sparkSession, table._written_to)
        fs.delete(where, True)


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
