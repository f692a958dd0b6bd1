"""What the operators of this folder share: tables, checkpoints, distributed row numbers."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``. Only a local master, as in tests, may go without: its one machine gets a folder of its own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Holds for the plans that are made inside."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Plans give up their shuffle files when an action on them ends, instead of when the driver collects its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows in a batch that goes to a Python worker; rows that hold lists need fewer.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Scratch:
    """Tables in a folder of their own below the shared checkpoint folder, each dropped once it is no longer read."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, files: float | None = None) -> DataFrame:
        """``df`` as a table, of so many files at most (few rows in many files cost more than they hold); lineage and shuffle files end here."""
        with setting(self.spark, FREED, "true"):
            df = df.select("*") if files is None else df.coalesce(math.ceil(files) or 1)
            df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes these tables; without names the whole folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for name in names or ("",):
            gone = path(f"{self.folder}/{name}".rstrip("/"))
            gone.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(gone, True)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_row_numbers(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``name``: the 1-based place of each row among those with equal ``keys``, by ``order``.

    A key may hold any share of the rows: rows are dealt out by range over (keys, order), so that a hot
    key spreads over many tasks, and each task adds what earlier tasks hold of its key. Only one count for
    each key and task is gathered. The dealt rows are checkpointed, since ranges are sampled and must not
    be drawn twice.
    """
    part, before = f"{name}_part", f"{name}_before"
    dealt = df.repartitionByRange(partitions(df), *keys, *order).withColumn(part, F.spark_partition_id())
    dealt = checkpointed(dealt)
    counts = dealt.groupBy(*keys, part).agg(F.count(F.lit(1)).alias(f"{name}_n"))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1) if keys else Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"{name}_{k}") for k in keys], F.col(part).alias(f"{name}_p"), F.coalesce(F.sum(f"{name}_n").over(earlier), F.lit(0)).alias(before))
    match = F.col(part) == F.col(f"{name}_p")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"{name}_{k}"))
    inside = Window.partitionBy(part, *keys).orderBy(*order)
    numbered = dealt.withColumn(name, F.row_number().over(inside))
    return numbered.join(offsets, match).withColumn(name, F.col(name) + F.col(before)).drop(part, before, f"{name}_p", *[f"{name}_{k}" for k in keys])
