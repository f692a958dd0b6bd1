"""Queries whose data go through files: written, read back, and held against SQL twins on the tables they were made from.

The files lie in folders of their own (``scratch.py``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.operators import compare
from strandframe.operators.calls import decode_calls
from strandframe.operators.context import at_reference, contig_lengths, with_lengths
from strandframe.operators.reads import filter_reads, observed
from strandframe.operators.sites import site_counts
from strandframe.options import QueryOptions, parse_codes, with_thresholds
from strandframe.plans import queries as plans
from strandframe.scratch import folder
from strandframe.sinks import text as sinks
from strandframe.sources import alignments, bam, references, tables
from strandframe.synth import reads_and_reference

FIELDS = ["qname", "flag", "contig", "pos", "cigar", "seq", "mm", "ml", "hp"]
PLAIN = QueryOptions(tuple(with_thresholds(parse_codes("m"), None)))
ALL = QueryOptions(tuple(with_thresholds(parse_codes("m[*],h"), None)), insertions=True, haplotypes=True)
CHUNK, PAD = 64, 9


def write_bam(reads: DataFrame, contigs: dict[str, int], path: str) -> None:
    """One BAM file for each partition of ``reads``."""
    store, inner = bam._filesystem(path)
    store.create_dir(inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = [row for batch in batches for row in batch.to_pylist()]
        name = f"{path}/part-{TaskContext.get().partitionId():05d}.bam"
        store, inner = bam._filesystem(name)
        with store.open_output_stream(inner) as out:
            out.write(alignments.to_bam(records, contigs))
        yield pa.RecordBatch.from_pydict({"path": [name]})

    reads.select(FIELDS).mapInArrow(run, "path string").collect()


def sam_lines(reads: DataFrame) -> DataFrame:
    none = F.lit("*")
    tag = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(name), value))
    ml = F.array_join(F.col("ml").cast("array<string>"), ",")
    return reads.select(F.concat_ws("\t", "qname", F.col("flag").cast("string"), F.coalesce("contig", none), (F.col("pos") + 1).cast("string"), F.lit("60"), "cigar", none, F.lit("0"), F.lit("0"), "seq", none, tag("MM:Z:", F.col("mm")), tag("ML:B:C,", ml), tag("HP:i:", F.col("hp").cast("string"))).alias("value"))


def fasta_lines(contigs: DataFrame) -> DataFrame:
    return contigs.select(F.concat(F.lit(">"), F.col("contig"), F.lit(" made\n"), F.array_join(F.regexp_extract_all("seq", F.lit("(.{1,60})"), F.lit(1)), "\n")).alias("value"))


def _file_sam(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{folder(spark)}/x.sam"
    sam_lines(reads_and_reference(spark, sf_dir)[0]).write.text(path)
    return alignments.read_alignments(spark, path).select(FIELDS)


def _file_bam(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    rows, reference = reads_and_reference(spark, sf_dir)
    write_bam(rows, dict(reference.select("contig", F.length("seq")).collect()), path)
    return alignments.read_bam(spark, path, 100_000).select(*FIELDS, "contig_len")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    fasta_lines(reads_and_reference(spark, sf_dir)[1]).write.option("compression", "none").text(path)
    return references.read_reference_chunks(spark, f"{path}/*.txt", PAD, CHUNK, 1000)


def _file_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from BAM and FASTA files, with the reference joined by chunk as one that is too large to be sent."""
    kept, pieces = filter_reads(_file_bam(spark, sf_dir).withColumn("record_idx", F.lit(0))), _file_pieces(spark, sf_dir)
    found = decode_calls(with_lengths(kept, pieces, contig_lengths(pieces).count()), PLAIN)
    return site_counts(at_reference(found, pieces, PLAIN, bases=1 << 40), PLAIN)


def _file_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    fasta_lines(reads_and_reference(spark, sf_dir)[1]).write.option("compression", "gzip").text(path)
    return references.read_reference_chunks(spark, f"{path}/*.gz", PAD)


def _written(spark: SparkSession, lines: tuple[str | None, DataFrame], name: str = "") -> str:
    path = folder(spark) + name
    sinks.write_lines(*lines, path)
    return path


def _file_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_view_tsv(spark, _written(spark, sinks.view_lines(plans.view(*reads_and_reference(spark, sf_dir), PLAIN))))


def _file_freq_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.read_sites(spark, _written(spark, sinks.freq_lines(plans.freq(*reads_and_reference(spark, sf_dir), ALL)), ".mm.tsv"))
    return rows.withColumn("ins_offset", F.col("ins_offset").cast("int"))


def _file_bedmethyl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plans.bedmethyl(plans.freq(*reads_and_reference(spark, sf_dir), PLAIN))
    return tables.read_sites(spark, _written(spark, sinks.bedmethyl_lines(rows), ".bedmethyl"))


def _file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, sinks.summary_lines(plans.summary(reads_and_reference(spark, sf_dir)[0])))
    return spark.read.text(path).filter(F.col("value") != sinks.SUMMARY_HEADER)


def _file_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    rows, reference = reads_and_reference(spark, sf_dir)
    size = F.length("contig")
    reference.select(F.concat_ws("\t", "contig", (size * 3).cast("string"), (size * 20).cast("string")).alias("value")).write.text(path)
    return _regions(plans.freq(rows, reference, PLAIN), tables.read_regions(spark, path))


def _regions(sites: DataFrame, regions: DataFrame) -> DataFrame:
    return tables.in_regions(sites.withColumnRenamed("start", "at"), regions, "at").select("contig", F.col("at").alias("start"), "strand", "n_called", "mod_code")


def _file_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites as a truth set, those of odd positions in groups of two motifs, which aren't read."""
    rows = plans.freq(*reads_and_reference(spark, sf_dir), PLAIN).filter("strand = '+'")
    header = ["chromosome", "start", "end", "num_motifs_in_group", "called_sites", "called_sites_methylated"]
    cells: list[Column] = [F.col("contig"), F.col("start"), F.col("end"), F.col("start") % 2 + 1, F.col("n_called"), F.col("n_mod")]
    lines = rows.select(F.concat_ws("\t", *[c.cast("string") for c in cells]).alias("value"))
    return tables.read_sites(spark, _written(spark, ("\t".join(header), lines), ".tsv"))


def _compare_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extracted BED against rows of view: calls of all reads, and of a pass that skips supplementary ones."""
    rows, reference = reads_and_reference(spark, sf_dir)
    header = "read_id forward_read_position ref_position chrom mod_strand ref_strand ref_mod_strand mod_qual mod_code".split()
    cells = ["read_id", "read_pos", "ref_pos", "ref_contig", "strand", "strand", "strand", "mod_prob", "mod_code"]
    lines = plans.view(rows, reference, PLAIN).select(F.concat_ws("\t", *[F.col(c).cast("string") for c in cells]).alias("value"))
    left = tables.read_extract_bed(spark, _written(spark, ("\t".join(header), lines)))
    right = plans.view(rows, reference, QueryOptions(PLAIN.codes, skip_supplementary=True))
    return compare.compare(left, right, ["ref_contig", "ref_pos", "strand", "read_id", "read_pos", "mod_code"], "mod_prob", compare.VIEW_TOLERANCE)


def _compare_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of freq against a script's table of two decimals, of which one site in seven is set off."""
    rows = plans.freq(*reads_and_reference(spark, sf_dir), PLAIN)
    off = F.col("freq") + F.when(F.col("start") % 7 == 0, 0.25).otherwise(0.0)
    cells = [F.col("contig"), F.col("start").cast("string"), F.col("strand"), F.col("mod_code"), F.format_string("%.2f", off)]
    path = _written(spark, ("\t".join(["contig", "ref_pos", "strand", "mod_code", "frequency"]), rows.select(F.concat_ws("\t", *cells).alias("value"))))
    right = tables.read_script_tsv(spark, path).select("contig", F.col("ref_pos").alias("start"), "strand", "mod_code", F.col("frequency").alias("freq"))
    return compare.compare(rows, right, ["contig", "start", "strand", "mod_code"], "freq", compare.RATIO_TOLERANCE)


def _numbered(rows: DataFrame) -> DataFrame:
    """The place of each row in the order in which it comes; in one partition, so numbers have no gaps."""
    return rows.coalesce(1).withColumn("place", F.monotonically_increasing_id())


def _order_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(plans.in_freq_order(plans.freq(*reads_and_reference(spark, sf_dir), ALL))).select("contig", "start", "strand", "mod_code", "ins_offset", "haplotype", "place")


def _order_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(plans.in_view_order(plans.view(*reads_and_reference(spark, sf_dir), PLAIN))).select("record_idx", "ref_pos", "strand", "mod_code", "place")


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a run, seen while it ran."""
    rows, seen = observed(reads_and_reference(spark, sf_dir)[0])
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["total_reads"], seen.get["processed_reads"])], "total_reads long, processed_reads long")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"file_sam": _file_sam, "file_bam": _file_bam, "file_fasta_chunks": _chunks, "file_freq_by_chunk": _file_freq, "file_view_tsv": _file_view, "file_freq_tsv": _file_freq_tsv, "file_bedmethyl": _file_bedmethyl, "file_summary": _file_summary, "file_regions": _file_regions, "file_truth_tsv": _file_truth, "compare_view_extract": _compare_extract, "compare_freq_script": _compare_script, "order_freq": _order_freq, "order_view": _order_view, "observed_counters": _observed}
