"""The queries over a growing folder of reads, with Structured Streaming.

``freq`` only sums, so nothing expires and no watermark is needed: it runs in update or complete mode. ``summary``
is a projection and runs in append mode, and so does ``view``, which needs no other reads to tell a read's first calls.
Counts go to a table that is summed from those of each batch (``start_counts``), rows to files (``start_files``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandframe.functions.scalars import ratio
from strandframe.options import QueryOptions
from strandframe.plans.queries import freq
from strandframe.sources.alignments import SCHEMA


def read_stream(spark: SparkSession, path: str, schema: str = SCHEMA, files_per_trigger: int = 64) -> DataFrame:
    """Reads that are added as Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def start(rows: DataFrame, name: str, checkpoint: str, mode: str) -> StreamingQuery:
    """To a table in the driver's memory, over all that is there now: for small results and tests."""
    return rows.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def start_files(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Rows of ``view`` or ``summary`` to Parquet files, each read once whatever is run again."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def start_counts(reads: DataFrame, reference: DataFrame, options: QueryOptions, path: str, checkpoint: str) -> StreamingQuery:
    """Counts of ``freq`` of each batch of reads as a folder of their own below ``path``; ``total_counts`` sums them. A batch that is run again replaces its folder."""

    def write(batch: DataFrame, number: int) -> None:
        freq(batch, reference, options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return reads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def total_counts(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``freq`` has over all batches so far."""
    rows = spark.read.parquet(path)
    keys = [c for c in rows.columns if c not in ("n_called", "n_mod", "freq", "batch")]
    summed = rows.groupBy(*keys).agg(F.sum("n_called").alias("n_called"), F.sum("n_mod").alias("n_mod"))
    return summed.withColumn("freq", ratio(F.col("n_mod"), F.col("n_called"))).select(*[c for c in rows.columns if c != "batch"])
