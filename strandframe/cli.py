"""``python -m strandframe.cli view|freq|mod-freq|summary``: the queries from the command line."""

from __future__ import annotations

import argparse
import logging
import resource
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe import scratch
from strandframe.operators.reads import check_skipped, observed
from strandframe.options import QueryOptions, parse_codes, parse_size, warn_untried, with_thresholds
from strandframe.plans import queries as plans
from strandframe.sinks import text as sinks
from strandframe.sources.alignments import read_alignments
from strandframe.sources.references import read_reference_chunks

log = logging.getLogger("strandframe")
LEVELS = [logging.CRITICAL + 10, logging.CRITICAL, logging.ERROR, logging.WARNING, logging.INFO, logging.DEBUG, logging.NOTSET + 1]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandframe", description=__doc__)
    top.add_argument("-V", "--version", action="version", version="strandframe 0.1.0")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("view", "freq", "mod-freq", "summary"):
        p = commands.add_parser(name)
        if name != "summary":
            p.add_argument("reference", help="FASTA or FASTQ, plain or gzip")
            p.add_argument("-c", "--mod-codes", default="m")
            p.add_argument("--insertions", action="store_true")
            p.add_argument("--haplotypes", action="store_true")
            p.add_argument("--include-non-ref", action="store_true", help="accepted; has no effect")
        else:
            p.add_argument("-c", "--mod-codes", default=None, help="accepted; has no effect")
        if name in ("freq", "mod-freq"):
            p.add_argument("-b", "--bedmethyl", action="store_true")
            p.add_argument("-m", "--mod-thresh", default=None)
        p.add_argument("alignments", help="BAM or SAM file, folder or pattern")
        p.add_argument("-t", "--threads", type=int, default=8)
        p.add_argument("-K", "--batchsize", type=int, default=512)
        p.add_argument("-B", "--max-bytes", default="20M")
        p.add_argument("-p", "--progress", type=int, default=0)
        p.add_argument("-o", "--output", default=None)
        p.add_argument("-v", "--verbose", type=int, default=4)
        p.add_argument("--debug-break", type=int, default=-1)
        p.add_argument("--allow-secondary", action="store_true")
        p.add_argument("--skip-supplementary", action="store_true")
        p.add_argument("--strict", action="store_true", help="fail if all records are skipped")
    return top


def query_options(a: argparse.Namespace) -> QueryOptions:
    codes = with_thresholds(parse_codes(getattr(a, "mod_codes", None) or "m"), getattr(a, "mod_thresh", None))
    if a.command != "summary":
        warn_untried(codes)
    return QueryOptions(tuple(codes), getattr(a, "insertions", False), getattr(a, "haplotypes", False), a.allow_secondary, a.skip_supplementary, batch_reads=a.batchsize, batch_bytes=parse_size(a.max_bytes), threads=a.threads)


def lines(spark: SparkSession, a: argparse.Namespace, path: str) -> tuple[str | None, DataFrame]:
    """Header and lines. The alignments are decoded once: results go to a table at ``path``, with counters seen on the way, and only that is sorted."""
    options = query_options(a)
    for c in options.codes if a.command != "summary" else ():
        log.info("code %s in context %s, threshold %s", c.code, c.context, c.threshold)
    reads = read_alignments(spark, a.alignments)
    if a.debug_break >= 0:
        reads = reads.limit((a.debug_break + 1) * options.batch_reads)
    reads, seen = observed(reads, allow_secondary=a.allow_secondary, skip_supplementary=a.skip_supplementary)
    if a.command == "summary":
        rows = plans.summary(reads, a.allow_secondary, a.skip_supplementary)
    else:
        reference = read_reference_chunks(spark, a.reference, pad=max(len(c.context) for c in options.sought().values()))
        rows = (plans.view if a.command == "view" else plans.freq)(reads, reference, options)
    rows.write.parquet(path)
    n = seen.get
    log.info("records: %d, skipped %d, processed %d; bytes: %d, processed %d", n["total_reads"], n["total_reads"] - n["processed_reads"], n["processed_reads"], n["total_bytes"], n["processed_bytes"])
    check_skipped(n["total_reads"], n["processed_reads"], a.strict)
    rows = spark.read.schema(rows.schema).parquet(path)
    if a.command == "summary":
        return sinks.summary_lines(rows.orderBy("record_idx"))
    if a.command == "view":
        return sinks.view_lines(plans.in_view_order(rows))
    rows = plans.in_freq_order(rows)
    return sinks.bedmethyl_lines(plans.bedmethyl(rows)) if a.bedmethyl else sinks.freq_lines(rows)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=LEVELS[max(0, min(6, a.verbose))], stream=sys.stderr)
    began = time.time()
    builder = SparkSession.builder.appName("strandframe").config("spark.sql.execution.arrow.maxRecordsPerBatch", a.batchsize)
    spark = builder.config("spark.sql.execution.arrow.maxBytesPerBatch", parse_size(a.max_bytes)).getOrCreate()
    path = scratch.folder(spark)
    header, rows = lines(spark, a, path)
    if a.output:
        sinks.write_lines(header, rows, a.output, one_file=True)
    else:
        if header:
            print(header)
        for row in rows.select(F.col("value")).toLocalIterator():  # part by part
            print(row.value)
    scratch.delete(spark, path)
    used = resource.getrusage(resource.RUSAGE_SELF)
    log.info("%s took %.1f s; this process: %.1f s of CPU, %.0f MB at most", " ".join(argv or sys.argv[1:]), time.time() - began, used.ru_utime + used.ru_stime, used.ru_maxrss / 1024)
    return 0


if __name__ == "__main__":
    sys.exit(main())
