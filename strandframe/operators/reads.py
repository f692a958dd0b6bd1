"""Record filters and counters."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

log = logging.getLogger("strandframe")


def kept(allow_secondary: bool = False, skip_supplementary: bool = False) -> Column:
    """Which records take part. All tests are on columns of the scan, so they are pushed down to Parquet."""
    flag = F.col("flag")
    out = (flag.bitwiseAND(4) == 0) & (F.col("seq") != "") & (F.col("seq") != "*") & F.col("mm").isNotNull()
    if not allow_secondary:
        out = out & (flag.bitwiseAND(0x100) == 0)
    if skip_supplementary:
        out = out & (flag.bitwiseAND(0x800) == 0)
    return out


def filter_reads(reads: DataFrame, allow_secondary: bool = False, skip_supplementary: bool = False) -> DataFrame:
    return reads.filter(kept(allow_secondary, skip_supplementary))


def skip_reason(allow_secondary: bool = False, skip_supplementary: bool = False) -> Column:
    """The first test that a record fails, else null."""
    flag = F.col("flag")
    out = F.when(flag.bitwiseAND(4) != 0, "unmapped")
    if not allow_secondary:
        out = out.when(flag.bitwiseAND(0x100) != 0, "secondary")
    if skip_supplementary:
        out = out.when(flag.bitwiseAND(0x800) != 0, "supplementary")
    return out.when((F.col("seq") == "") | (F.col("seq") == "*"), "empty").when(F.col("mm").isNull(), "no tag")


def counters(reads: DataFrame, allow_secondary: bool = False, skip_supplementary: bool = False) -> DataFrame:
    """One row: records and bytes in all, skipped and processed."""
    ok = F.coalesce(kept(allow_secondary, skip_supplementary), F.lit(False)).cast("long")
    size = F.col("data_len") if "data_len" in reads.columns else F.length("seq").cast("long")
    total, done = F.count(F.lit(1)), F.coalesce(F.sum(ok), F.lit(0))
    return reads.agg(total.alias("total_reads"), (total - done).alias("skipped_reads"), done.alias("processed_reads"), F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"), F.coalesce(F.sum(size * ok), F.lit(0)).alias("processed_bytes"))


def observed(reads: DataFrame, name: str = "reads", **flags: bool) -> tuple[DataFrame, Observation]:
    """The reads, and an observation of the same counters that costs no pass of its own."""
    seen = Observation(name)
    ok = F.coalesce(kept(**flags), F.lit(False)).cast("long")
    size = F.col("data_len") if "data_len" in reads.columns else F.length("seq").cast("long")
    sums = {"processed_reads": ok, "total_bytes": size, "processed_bytes": size * ok}
    return reads.observe(seen, F.count(F.lit(1)).alias("total_reads"), *[F.coalesce(F.sum(x), F.lit(0)).alias(k) for k, x in sums.items()]), seen


def check_skipped(total: int, processed: int, strict: bool = False) -> str | None:
    """A warning if over 90 % of the records were skipped; with ``strict`` an error if all were."""
    if total and not processed and strict:
        raise ValueError("all records were skipped")
    if total and total - processed > 0.9 * total:
        log.warning("%d of %d records were skipped", total - processed, total)
        return f"{total - processed} of {total} records were skipped"
    return None
