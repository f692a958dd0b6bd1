"""Joining calls with the reference: context windows and matching bases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions.scalars import in_context
from strandframe.options import ModCode, QueryOptions

CHUNK = 1 << 16
#: A reference of at most this many bases is sent to all executors; a larger one is joined by chunk.
BROADCAST_MOST = 32 << 20
#: Contigs whose lengths are sent to all executors, at most.
CONTIGS_MOST = 500_000


def chunked(reference: DataFrame) -> bool:
    return "ref_offset" in reference.columns


def contig_lengths(reference: DataFrame) -> DataFrame:
    """(ref_contig, ref_len)."""
    if chunked(reference):
        return reference.filter("ref_chunk = 0").select(F.col("contig").alias("ref_contig"), "ref_len")
    return reference.select(F.col("contig").alias("ref_contig"), F.length("seq").alias("ref_len"))


def chunks(reference: DataFrame, pad: int, size: int = CHUNK) -> DataFrame:
    """(contig, chunk, offset, seq): pieces of each contig with ``pad`` bases of their neighbours; offset is the position of the first base. A reference that comes in chunks, as of ``read_reference_chunks``, stays as it is."""
    if chunked(reference):
        return reference.select(F.col("contig").alias("ref_contig"), "ref_chunk", "ref_offset", F.col("seq").alias("ref_seq"))
    count = F.greatest(F.ceil(F.length("seq") / size), F.lit(1)).cast("int")
    rows = reference.select("contig", F.col("seq").alias("whole"), F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk"))
    offset = F.greatest(F.col("chunk") * size - pad, F.lit(0))
    return rows.select(F.col("contig").alias("ref_contig"), F.col("chunk").alias("ref_chunk"), offset.alias("ref_offset"), F.substring("whole", offset + 1, (F.col("chunk") + 1) * size + pad - offset).alias("ref_seq"))


def _by_code(codes: tuple[ModCode, ...], value) -> Column:  # noqa: ANN001
    """A value of the requested code that a call was sought by."""
    out = F.lit(None)
    for c in codes:
        out = F.when(F.col("sought") == c.code, F.lit(value(c))).otherwise(out)
    return out


def thresholds(codes: tuple[ModCode, ...]) -> Column:
    return _by_code(codes, lambda c: float(c.threshold)).cast("double")


def context_sites(reference: DataFrame, code: ModCode, reverse: bool = False) -> DataFrame:
    """(contig, ref_pos): all positions that the context of a code marks, on a strand."""
    pattern = code.reverse_context if reverse else code.context
    positions = reference.select("contig", "seq", F.posexplode(F.split("seq", "")).alias("ref_pos", "base")).filter("base <> ''")
    if pattern == "*":
        return positions.select("contig", "ref_pos")
    begin = F.greatest(F.col("ref_pos") - len(pattern) + 1, F.lit(0))
    window = F.substring("seq", begin + 1, F.col("ref_pos") + len(pattern) - begin)
    return positions.filter(in_context(window, F.lit(pattern))).select("contig", "ref_pos")


def on_contigs(reads: DataFrame, reference: DataFrame) -> DataFrame:
    """The reads whose contig the reference has."""
    return reads.join(contig_lengths(reference), F.col("contig") == F.col("ref_contig"), "left_semi")


def with_lengths(reads: DataFrame, reference: DataFrame, contigs: int) -> DataFrame:
    """Adds ref_len, the length of the read's contig by the reference: null if it lacks that. The kernel makes an error of it, whatever is asked for."""
    lengths = contig_lengths(reference)
    if contigs <= CONTIGS_MOST:
        lengths = F.broadcast(lengths)
    return reads.join(lengths, F.col("contig") == F.col("ref_contig"), "left").drop("ref_contig")


def at_reference(calls: DataFrame, reference: DataFrame, options: QueryOptions, bases: int | None = None) -> DataFrame:
    """Calls that are in the context of their code and whose base is that of the reference.

    With insertions, no call is tested. ``bases``: how many the reference has, if known; else they are counted, to
    choose between sending it and joining by chunk.
    """
    if options.insertions:
        return calls
    codes = tuple(options.sought().values())
    if all(c.context == "*" for c in codes):
        return calls
    pad = max(len(c.context) for c in codes)
    pieces = chunks(reference, pad, CHUNK)
    if bases is None:
        bases = contig_lengths(reference).agg(F.sum("ref_len")).first()[0] or 0
    if bases <= BROADCAST_MOST:
        pieces = F.broadcast(pieces)
    met = calls.withColumn("chunk", F.floor(F.col("ref_pos") / CHUNK).cast("int")).join(pieces, (F.col("contig") == F.col("ref_contig")) & (F.col("chunk") == F.col("ref_chunk")), "left")
    seq = F.coalesce("ref_seq", F.raise_error(F.concat(F.lit("the reference lacks position "), F.col("ref_pos"), F.lit(" of "), F.coalesce("contig", F.lit("*")))))
    place = F.col("ref_pos") - F.col("ref_offset")
    ok = F.lit(False)
    for c in codes:
        m = len(c.context)
        begin = F.greatest(place - m + 1, F.lit(0))
        window = F.substring(seq, begin + 1, place + m - begin)
        pattern = F.when(F.col("strand") == "-", c.reverse_context).otherwise(c.context)
        same = F.substring(seq, place + 1, F.lit(1)) == F.col("read_base")
        inside = F.lit(True) if c.context == "*" else in_context(window, pattern) & F.when(F.col("unless_base"), ~same).otherwise(F.col("any_base") | same)
        ok = F.when(F.col("sought") == c.code, inside).otherwise(ok)
    return met.filter(ok).select(*calls.columns)
