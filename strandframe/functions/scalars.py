"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def probability(ml: Column) -> Column:
    """The middle of the interval that an 8-bit value stands for."""
    return (ml + F.lit(0.5)) / F.lit(256.0)


def called_state(p: Column, threshold: Column) -> Column:
    """1 modified, 0 not modified, null ambiguous."""
    return F.when(p >= threshold, 1).when(p <= F.lit(1.0) - threshold, 0)


def complement(bases: Column) -> Column:
    return F.translate(bases, "ACGTUN", "TGCAAN")


def reverse_complement(bases: Column) -> Column:
    return F.reverse(complement(bases))


def strand_of(flag: Column) -> Column:
    return F.when(flag.bitwiseAND(16) != 0, "-").otherwise("+")


def haplotype_of(hp: Column) -> Column:
    """As an unsigned byte; 0 if missing."""
    return F.coalesce(hp, F.lit(0)).bitwiseAND(255)


def ratio(n_mod: Column, n_called: Column) -> Column:
    return n_mod / n_called


def percent(n_mod: Column, n_called: Column) -> Column:
    return n_mod * F.lit(100.0) / n_called


def fixed6(x: Column) -> Column:
    """As text with six decimals, ties to even, as C's ``%f`` prints such ratios."""
    return F.bround(x.cast("decimal(20,12)"), 6).cast("decimal(20,6)").cast("string")


def in_context(window: Column, pattern: Column) -> Column:
    """Whether the window of 2m - 1 bases around a base holds the pattern of m bases: any match in it covers the base."""
    return F.contains(window, pattern)


def folded_start(start: Column, strand: Column) -> Column:
    """The position of the forward base of a CG pair."""
    return F.when(strand == "-", start - 1).otherwise(start)


def summary_entry(base: Column, codes: Column, flag: Column) -> Column:
    return F.concat_ws("|", base, codes, flag)
