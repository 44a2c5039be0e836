"""Cutting lineage through the folder that driver and executors share, and joins that hot keys don't hold up."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, one is made on a single machine, and a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            base = tempfile.mkdtemp(prefix="strandloom-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` and read it back, so that later steps start from files and survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/strandloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def short_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it tables are read and written with batches of so many rows, for rows that hold long arrays: a task has a batch several times over."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {name: spark.conf.get(name) for name in names}
    for name, n in before.items():
        spark.conf.set(name, str(min(rows, int(n)) if int(n) > 0 else rows))
    try:
        yield
    finally:
        for name, n in before.items():
            spark.conf.set(name, n)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by ``stored`` once nothing reads it any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for f in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if "/strandloom/" in f:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(conf).delete(path, True)


def forget(spark: SparkSession, hours: float = 24.0) -> int:
    """Delete tables, files and archives in the shared folder that are older than so many hours; returns how many.

    Lazy results read what has been stored, so only what no running query can still need is to go.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/strandloom")
    files = top.getFileSystem(conf)
    if not files.exists(top):
        return 0
    old = [x.getPath() for x in files.listStatus(top) if x.getModificationTime() < (time.time() - hours * 3600) * 1000]
    for path in old:
        files.delete(path, True)
    return len(old)


def looked_up(left: DataFrame, right: DataFrame, key: str, count: str, total: int, keep: bool = False) -> DataFrame:
    """``left`` left-joined with ``right``, whose ``key`` is unique and whose ``count`` says how many rows of ``left`` have it.

    Keys of over a thousandth of ``total`` rows, a thousand of them at most, are broadcast, so
    that no task gets all rows of a hot key; the rest are joined as Spark sees fit. ``keep``: the
    counts are wanted too.
    """
    more = [c for c in right.columns if c != key and (keep or c != count)]
    hot = right.filter(F.col(count) > total / 1000).select(key, F.struct(*more).alias("_hot"))
    told = left.join(F.broadcast(hot), key, "left")
    cold = told.filter("_hot is null").drop("_hot").join(right.filter(F.col(count) <= total / 1000).select(key, *more), key, "left")
    return told.filter("_hot is not null").select(*left.columns, "_hot.*").unionByName(cold.select(*left.columns, *more))


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` with a number from 0 in the order of some columns.

    Rows are counted within ranges of the order and set off by the ranges before, so that no
    single task sorts them all; only the counts of the ranges meet in one.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    before = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before", "_part")
