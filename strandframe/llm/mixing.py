"""Mixing sources to target weights by systematic sampling. DataFrame operations only.

Each document of a source is expected ``target / source size`` times. Within a source, documents are ordered by
size and id; with one random offset for the source, a document is taken once for each whole number that the
running sum of expected copies crosses at it. As neighbours have nearly the same size, what is taken of a
source differs from its target by a few documents' words at most.

Targets: sources in the order of their code points, null last, weigh 5, 2, 1, repeating, and share a multiple of
all sizes; a target stops at ``most`` times its source's size, and the excess is shared again by weight among
the others until none is above.

Defined results: a null text has size 0; a null source is one source; documents without words are expected like
others and take 0 words; rows that repeat are rows of their own; ties of size and id are broken arbitrarily
among rows with equal results; an empty table gives an empty one; other columns are passed on, and an
input column with the name of an output column is replaced. The offset depends on the source and the seed only,
so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import checkpointed, partitions, with_row_numbers

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
MADE = ["size", "source_size", "target", "copies", "taken"]


def words(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, n and target of the sources (source, source_size, n)."""
    ranked = with_row_numbers(sizes.withColumn("unknown", F.col("source").isNull().cast("int")), [], ["unknown", "source"], "rank").drop("unknown")
    ranked = checkpointed(ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))))
    cap = most * F.col("source_size")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = None, -1
    while True:  # each round stops at least one more source at its cap
        below = F.lit(True) if level is None else F.col("weight") * F.lit(level) <= cap
        full, weight, n = ranked.agg(F.sum(F.when(~below, cap).otherwise(0)), F.sum(F.when(below, F.col("weight")).otherwise(0)), F.sum((~below).cast("int"))).first()
        if not weight or n == stopped:
            break
        level, stopped = (share * total - full) / weight, n
    return ranked.select("source", "source_size", "n", F.least(F.col("weight") * F.lit(level or 0.0), cap.cast("double")).alias("target"))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: str = "", keep: list[str] | None = None, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds size, source_size, target, copies and taken (words) to each row. ``keep``: the columns to pass on, all if None."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in MADE]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{doc_id}`").alias("\x00id"), F.col(f"`{source}`").alias("\x00source"), words(text).alias("size"))
    rows = with_row_numbers(checkpointed(rows), ["\x00source"], ["size", "\x00id"], "\x00place")
    goals = targets(rows.groupBy(F.col("\x00source").alias("source")).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), share, most)
    goals = checkpointed(goals.withColumnRenamed("source", "\x00goal").withColumnRenamed("n", "\x00n"))
    # Sources with many rows are few, so that they can be sent to the rows, however many these are.
    same, n = F.col("\x00source").eqNullSafe(F.col("\x00goal")), goals.agg(F.sum("\x00n")).first()[0] or 0
    large = F.col("\x00n") * 2 * partitions(docs) > n
    hot = F.broadcast(goals.filter(large))
    met = rows.join(hot, same).unionByName(rows.join(hot.select("\x00goal"), same, "left_anti").join(goals.filter(~large), same))
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.concat(F.lit("s"), F.col("\x00source").cast("string")), F.lit("n")))), 1, 8), 16, 10).cast("double") / 4294967296
    copies = F.floor(F.col("\x00place") * rate + offset) - F.floor((F.col("\x00place") - 1) * rate + offset)
    return met.select(*[F.col(f"`{c}`") for c in kept], "size", "source_size", "target", copies.cast("long").alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
     p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS place FROM d),
     s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
     w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1] AS weight FROM s),
     c AS (SELECT *, row_number() OVER (ORDER BY 2 * source_size / weight, source) AS i, 2 * source_size AS cap, coalesce(sum(2 * source_size) OVER before, 0) AS full_before, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left, sum(source_size) OVER () AS total
           FROM w WINDOW before AS (ORDER BY 2 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     l AS (SELECT arg_min((1.5::DOUBLE * total - full_before)::DOUBLE / weight_left, i) FILTER (weight * ((1.5::DOUBLE * total - full_before)::DOUBLE / weight_left) <= cap) AS level FROM c),
     t AS (SELECT source, source_size, least(weight * level, cap::DOUBLE) AS target FROM c, l),
     r AS (SELECT p.*, t.source_size, t.target, CASE WHEN t.source_size = 0 THEN 0.0 ELSE t.target / t.source_size END AS rate,
                  ('0x' || substr(md5(coalesce('s' || p.source, 'n')), 1, 8))::BIGINT::DOUBLE / 4294967296::DOUBLE AS u
           FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(place * rate + u) - floor((place - 1) * rate + u))::BIGINT * size)::BIGINT AS taken FROM r
"""
