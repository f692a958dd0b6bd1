"""Comparing results: full outer joins with tolerances, strand folding and correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions.scalars import called_state, folded_start

#: Tolerances of each pair of formats.
VIEW_TOLERANCE, PERCENT_TOLERANCE, RATIO_TOLERANCE = 0.002, 5.0, 0.005


def compare(left: DataFrame, right: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Keys, value_1, value_2, diff and outcome: ``in_both``, ``large_diff``, ``missing_in_file1`` or ``missing_in_file2``.

    Each side has one row for each key: of several, the one with the highest value stays.
    """
    one = lambda df, name: df.groupBy(*keys).agg(F.max(value).alias(name), F.lit(True).alias(f"has_{name}"))
    both = one(left, "value_1").join(one(right, "value_2"), keys, "full_outer")
    diff = F.abs(F.col("value_1") - F.col("value_2"))
    outcome = F.when(F.col("has_value_1").isNull(), "missing_in_file1").when(F.col("has_value_2").isNull(), "missing_in_file2").when(diff > tolerance, "large_diff").otherwise("in_both")
    return both.select(*keys, "value_1", "value_2", diff.alias("diff"), outcome.alias("outcome"))


def folded(sites: DataFrame, start: str = "start", n_called: str = "n_called", n_mod: str = "n_mod") -> DataFrame:
    """(contig, start, n_called, n_mod): both strands of a CG pair as one site."""
    return sites.groupBy("contig", folded_start(F.col(start), F.col("strand")).alias("start")).agg(F.sum(n_called).alias("n_called"), F.sum(n_mod).alias("n_mod"))


def pearson(x: str, y: str) -> Column:
    """0 for no rows or no variance."""
    r = F.corr(x, y)
    return F.when(r.isNull() | F.isnan(r), 0.0).otherwise(r)


def frequency_correlation(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: n_sites in both and the Pearson correlation of their frequencies, strands folded."""
    f = lambda df, name: folded(df).filter("n_called > 0").select("contig", "start", (F.col("n_mod") / F.col("n_called")).alias(name))
    return f(left, "x").join(f(right, "y"), ["contig", "start"]).agg(F.count(F.lit(1)).alias("n_sites"), pearson("x", "y").alias("r"))


def freq_from_view(view: DataFrame, code: str, threshold: float = 0.8) -> DataFrame:
    """(contig, ref_pos, strand, mod_code, frequency) of one code, from rows of ``view``."""
    state = called_state(F.col("mod_prob"), F.lit(threshold))
    rows = view.filter(F.col("mod_code") == code).withColumn("state", state).filter("state is not null")
    return rows.groupBy(F.col("ref_contig").alias("contig"), "ref_pos", "strand", "mod_code").agg((F.sum("state") / F.count(F.lit(1))).alias("frequency"))
