"""Reads and contigs made from the driver's tables, in Spark and, by the same rules, in SQL for DuckDB.

Contigs: one for each nation, 512 bases rich in CG. Reads: one for each order, whose CIGAR, flags, tags and values
follow from its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: CIGAR and pieces of SEQ, as (offset from the read's position, length) in the reference or literal bases.
SHAPES = [
    ("40M", [(0, 40)]),
    ("5S35M", ["ACGTC", (0, 35)]),
    ("10M2I20M", [(0, 10), "CG", (10, 20)]),
    ("12M3D18M", [(0, 12), (15, 18)]),
    ("8M60N24M", [(0, 8), (68, 24)]),
    ("3S20M1I10M2S", ["CGA", (0, 20), "C", (20, 10), "GT"]),
    ("15=1X14=", [(0, 15), "T", (16, 14)]),
]
#: Tags; null is a read without one. They name at most four bases of a kind.
TAGS = ["C+m?,0,1;", "C+m.,1,0;", "C+h?,0,1;C+m?,0,1;", "C+mh?,0,2;", "A+a.,0;C+m?,2;", "N+n?,3,2;", "T+17802,1;C+m,0;", None, "C+m?,1;C+h.,0;", "C-m?,0,1;", "C+m?,0;C+m?,0;", "G+19229.,1;C+m?,1;", "C+21839.,0,0;", "A+a?,1;A+17596.,0;", "C+m.;", "C+m?,2;T+g?,0;"]
#: Instead, if a read has too few bases of some kind.
SPARE = "C+m?;"
HEX, BASES = "0123456789abcdef", "ACGTCGACGTCGATCG"


def _case(number: str, values: list[str]) -> str:
    return f"CASE {number} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _text(x: str | None) -> str:
    return "NULL" if x is None else f"'{x}'"


def ctes(duckdb: bool = False) -> str:
    """``contigs(contig, seq)`` and ``reads`` as common table expressions."""
    block = f"translate(md5(concat(CAST(n_nationkey AS VARCHAR(20)), '_', CAST({{i}} AS VARCHAR(20)))), '{HEX}', '{BASES}')"
    seq = "concat(" + ", ".join(block.format(i=i) for i in range(16)) + ")"
    piece = lambda p: f"'{p}'" if isinstance(p, str) else f"substr(c.seq, pos + {p[0] + 1}, {p[1]})"
    shape = _case("k % 7", [f"'{cigar}'" for cigar, _ in SHAPES])
    bases = _case("k % 7", [f"concat({', '.join(map(piece, parts))})" for _, parts in SHAPES])
    enough = " AND ".join(f"length(seq) - length(replace(seq, '{b}', '')) >= 4" for b in "ACGT")
    tag = _case("k % 16", [_text(t) for t in TAGS])
    pair = "substr(md5(concat(CAST(k AS VARCHAR(20)), 'ml')), {at}, 2)"
    value = (lambda at: f"CAST(('0x' || {pair.format(at=at)}) AS INT)") if duckdb else (lambda at: f"CAST(conv({pair.format(at=at)}, 16, 10) AS INT)")
    values = ", ".join(value(2 * i + 1) for i in range(4))
    array = f"[{values}]" if duckdb else f"array({values})"
    return f"""contigs AS (SELECT n_nationkey, n_name AS contig, {seq} AS seq FROM nation),
     drawn AS (SELECT o_orderkey AS k, o_custkey % 25 AS nation, CAST(o_orderkey % 400 AS INT) AS pos FROM orders),
     placed AS (SELECT k, contig, pos, {shape} AS cigar, {bases} AS seq FROM drawn JOIN contigs c ON c.n_nationkey = nation),
     reads AS (SELECT k AS record_idx, concat('r', CAST(k AS VARCHAR(20))) AS qname,
            CAST(CASE WHEN k % 17 = 0 THEN 4 ELSE 0 END + CASE WHEN k % 2 = 1 THEN 16 ELSE 0 END + CASE WHEN k % 11 = 0 THEN 256 ELSE 0 END + CASE WHEN k % 13 = 0 THEN 2048 ELSE 0 END AS INT) AS flag,
            contig, pos, cigar, seq, CASE WHEN {enough} OR k % 16 = 7 THEN {tag} ELSE '{SPARE}' END AS mm, {array} AS ml,
            CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(k % 3 AS INT) END AS hp
            FROM placed)"""


def reads_and_reference(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "orders")}
    # The keys are few bytes in few files; dealt out first, they let all cores make and decode reads.
    tables["orders"] = tables["orders"].select("o_orderkey", "o_custkey").repartition(spark.sparkContext.defaultParallelism)
    reads = spark.sql(f"WITH {ctes().replace('FROM nation', 'FROM {nation}').replace('FROM orders', 'FROM {orders}')} SELECT * FROM reads", **tables)
    contigs = spark.sql(f"WITH {ctes().replace('FROM nation', 'FROM {nation}').replace('FROM orders', 'FROM {orders}')} SELECT contig, seq FROM contigs", **tables)
    return reads, contigs
