"""The text formats of the results, as one string column, and their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions.scalars import fixed6

VIEW = ["ref_contig", "ref_pos", "strand", "read_id", "read_pos", "mod_code", "mod_prob", "ins_offset", "haplotype"]
FREQ = ["contig", "start", "end", "strand", "n_called", "n_mod", "freq", "mod_code", "ins_offset", "haplotype"]
BED = ["contig", "start", "end", "name", "score", "strand", "thick_start", "thick_end", "color", "coverage", "percent"]
SUMMARY_HEADER = "read_id\t modifications"


def _lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    cell = lambda c: fixed6(F.col(c)) if c in ("mod_prob", "freq", "percent") else F.col(c).cast("string")
    return rows.select(F.concat_ws("\t", *[cell(c) for c in columns if c in rows.columns]).alias("value"))


def view_lines(rows: DataFrame) -> tuple[str, DataFrame]:
    """Header and lines."""
    return "\t".join(c for c in VIEW if c in rows.columns), _lines(rows, VIEW)


def freq_lines(rows: DataFrame) -> tuple[str, DataFrame]:
    return "\t".join(c for c in FREQ if c in rows.columns), _lines(rows, FREQ)


def bedmethyl_lines(rows: DataFrame) -> tuple[None, DataFrame]:
    return None, _lines(rows, BED)


def summary_lines(rows: DataFrame) -> tuple[str, DataFrame]:
    """Each entry is followed by a blank; reads without entries have a line, too."""
    entries: Column = F.concat_ws("", F.transform("modifications", lambda x: F.concat(x, F.lit(" "))))
    return SUMMARY_HEADER, rows.select(F.concat(F.col("read_id"), F.lit("\t"), entries).alias("value"))


def write_lines(header: str | None, lines: DataFrame, path: str, one_file: bool = False) -> None:
    """Text part files, each with the header, so that each is a table; or one ordered file, which costs one task for the output."""
    rows = lines.coalesce(1) if one_file else lines
    writer = rows.write.mode("overwrite")
    if header is None:
        writer.text(path)
    else:  # CSV writers know headers; nothing is quoted
        rows.withColumnRenamed("value", header).write.mode("overwrite").option("header", True).option("sep", "\x01").option("quote", "").option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(path)
