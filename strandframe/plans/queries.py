"""The three queries as plans over reads and a reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions.scalars import probability, summary_entry
from strandframe.operators.calls import decode_calls
from strandframe.operators.context import at_reference, contig_lengths, with_lengths
from strandframe.operators.reads import filter_reads
from strandframe.operators.sites import site_counts
from strandframe.options import QueryOptions


def calls(reads: DataFrame, reference: DataFrame, options: QueryOptions, first: bool = False) -> DataFrame:
    """Scan, filter, decode, join with the reference: narrow up to here if the reference is small. With ``first`` of each read's calls of a code at a place only the first."""
    contigs, bases = contig_lengths(reference).agg(F.count(F.lit(1)), F.coalesce(F.sum("ref_len"), F.lit(0))).first()
    kept = with_lengths(filter_reads(reads, options.allow_secondary, options.skip_supplementary), reference, contigs)
    return at_reference(decode_calls(kept, options, first), reference, options, bases)


def view(reads: DataFrame, reference: DataFrame, options: QueryOptions | None = None) -> DataFrame:
    """One row for each modification call on each placed base of each read. No shuffle: a read's first calls are told while it is decoded."""
    options = options or QueryOptions()
    rows = calls(reads, reference, options, first=True)
    more = [*(["ins_offset"] if options.insertions else []), *(["haplotype"] if options.haplotypes else [])]
    return rows.select("record_idx", F.col("contig").alias("ref_contig"), "ref_pos", "strand", F.col("qname").alias("read_id"), "read_pos", "mod_code", probability(F.col("ml")).alias("mod_prob"), *more)


def in_view_order(rows: DataFrame) -> DataFrame:
    """Records in input order, sorted inside; a global sort, for output that needs it."""
    more = [c for c in ("ins_offset", "haplotype") if c in rows.columns]
    return rows.orderBy("record_idx", "ref_contig", "ref_pos", "strand", "mod_code", *more)


def freq(reads: DataFrame, reference: DataFrame, options: QueryOptions | None = None) -> DataFrame:
    """One row for each site and code with counts over all reads."""
    options = options or QueryOptions()
    return site_counts(calls(reads, reference, options), options)


def in_freq_order(rows: DataFrame) -> DataFrame:
    more = [c for c in ("ins_offset", "haplotype") if c in rows.columns]
    return rows.orderBy("contig", "start", "strand", "mod_code", *more)


def bedmethyl(rows: DataFrame) -> DataFrame:
    """Rows of ``freq`` in the 11 columns of bedMethyl; with haplotypes only the totals."""
    rows = rows.filter("haplotype = '*'") if "haplotype" in rows.columns else rows
    end = F.col("start") + 1
    return rows.select("contig", "start", end.alias("end"), F.col("mod_code").alias("name"), F.col("n_called").alias("score"), "strand", F.col("start").alias("thick_start"), end.alias("thick_end"), F.lit("255,0,0").alias("color"), F.col("n_called").alias("coverage"), (F.col("n_mod") * F.lit(100.0) / F.col("n_called")).alias("percent"))


def summary(reads: DataFrame, allow_secondary: bool = False, skip_supplementary: bool = False) -> DataFrame:
    """Per read the distinct ``base|codes|flag`` of groups that name a base, by first appearance. One projection, no shuffle."""
    head = r"^([ACGTUNacgtun])[+-]([A-Za-z]+|[0-9]+)([.?]?)(,.*)?$"
    text = F.filter(F.split("mm", ";"), lambda g: g.contains(","))
    entry = lambda g: summary_entry(F.translate(F.upper(F.regexp_extract(g, head, 1)), "U", "T"), F.regexp_extract(g, head, 2), F.when(F.regexp_extract(g, head, 3) == "?", "?").otherwise("."))
    kept = filter_reads(reads, allow_secondary, skip_supplementary)
    return kept.select("record_idx", F.col("qname").alias("read_id"), F.array_distinct(F.transform(text, entry)).alias("modifications"))
