"""Text tables that results are compared with: bedMethyl, TSV of freq, of view and of truth sets, extracted BEDs, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_bedmethyl(spark: SparkSession, path: str) -> DataFrame:
    """contig, start, strand, mod_code, n_called, n_mod, percent; fields parted by any white space, so also wider variants."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.trim("value") != "")
    rows = rows.select(f[0].alias("contig"), f[1].cast("int").alias("start"), f[2].cast("int").alias("end"), f[3].alias("mod_code"), f[5].alias("strand"), f[9].cast("long").alias("n_called"), f[10].cast("double").alias("percent"))
    return rows.withColumn("n_mod", (F.col("percent") / 100 * F.col("n_called")).cast("long"))


def _with_header(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def read_freq_tsv(spark: SparkSession, path: str) -> DataFrame:
    rows = _with_header(spark, path)
    return rows.withColumns({c: F.col(c).cast(t) for c, t in (("start", "int"), ("end", "int"), ("n_called", "long"), ("n_mod", "long"), ("freq", "double")) if c in rows.columns})


def read_view_tsv(spark: SparkSession, path: str) -> DataFrame:
    return _with_header(spark, path).withColumns({"ref_pos": F.col("ref_pos").cast("int"), "read_pos": F.col("read_pos").cast("int"), "mod_prob": F.col("mod_prob").cast("double")})


def read_extract_bed(spark: SparkSession, path: str) -> DataFrame:
    """The calls of an extracted BED in the columns of view."""
    return _with_header(spark, path).select(F.col("chrom").alias("ref_contig"), F.col("ref_position").cast("int").alias("ref_pos"), F.col("ref_strand").alias("strand"), "read_id", F.col("forward_read_position").cast("int").alias("read_pos"), "mod_code", F.col("mod_qual").cast("double").alias("mod_prob"))


def read_truth_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Sites of groups with one motif; positions as contig, start and strand +."""
    rows = _with_header(spark, path).filter(F.col("num_motifs_in_group").cast("int") <= 1)
    return rows.select(F.col("chromosome").alias("contig"), F.col("start").cast("int").alias("start"), F.lit("+").alias("strand"), F.col("called_sites").cast("long").alias("n_called"), F.col("called_sites_methylated").cast("long").alias("n_mod"))


def read_script_tsv(spark: SparkSession, path: str) -> DataFrame:
    return _with_header(spark, path).withColumns({"ref_pos": F.col("ref_pos").cast("int"), "frequency": F.col("frequency").cast("double")})


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """By the file's name: bedMethyl, TSV of freq, or truth set."""
    name = path.rsplit("/", 1)[-1]
    if "bedmethyl" in name or name.endswith(".bed"):
        return read_bedmethyl(spark, path)
    return read_freq_tsv(spark, path) if name.endswith(".mm.tsv") else read_truth_tsv(spark, path)


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """(contig, start, end) of a BED file; malformed lines are an error."""
    f = F.split("value", "\t")
    begin, end = f[1].try_cast("int"), F.get(f, F.lit(2)).try_cast("int")
    bad = F.raise_error(F.concat(F.lit("malformed region: "), F.col("value")))
    ok = F.coalesce((F.size(f) >= 3) & (end >= begin), F.lit(False))
    return spark.read.text(path).filter("value <> ''").select(F.when(ok, f[0]).otherwise(bad).alias("contig"), begin.alias("start"), end.alias("end"))


def in_regions(calls: DataFrame, regions: DataFrame, position: str = "ref_pos") -> DataFrame:
    """Rows inside some region: regions are cut at bins of 2^14 bases, so that the join is an equi-join."""
    bins = regions.select("contig", "start", "end", F.explode(F.sequence(F.shiftright("start", 14), F.shiftright(F.col("end"), 14))).alias("bin"))
    met = (calls["contig"] == bins["contig"]) & (F.shiftright(calls[position], 14) == bins["bin"]) & (calls[position] >= bins["start"]) & (calls[position] < bins["end"])
    return calls.join(bins, met, "left_semi")
