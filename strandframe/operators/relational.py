"""Decoding step by step as relations: one row for each segment, base, group and call of a read.

These are the declarative forms of what ``operators.calls`` does in one pass over each read. They shuffle by
record, so they serve inspection and tests; whole queries run on the one-pass kernel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

READ, REFERENCE = ["M", "I", "S", "=", "X"], ["M", "D", "N", "=", "X"]


def cigar_segments(reads: DataFrame) -> DataFrame:
    """(record_idx, seg_no, op, len, read_start, ref_start) of each operation; hard clips, padding and unknown ones are errors."""
    ops = F.regexp_extract_all("cigar", F.lit(r"(\d+)([A-Za-z=])"), F.lit(2))
    lens = F.regexp_extract_all("cigar", F.lit(r"(\d+)([A-Za-z=])"), F.lit(1))
    rows = reads.select("record_idx", "pos", F.posexplode(F.arrays_zip(ops.alias("op"), lens.alias("len"))).alias("seg_no", "s"))
    rows = rows.select("record_idx", "pos", "seg_no", F.col("s.op").alias("op"), F.col("s.len").cast("int").alias("len"))
    before = Window.partitionBy("record_idx").orderBy("seg_no").rowsBetween(Window.unboundedPreceding, -1)
    along = lambda kinds: F.coalesce(F.sum(F.when(F.col("op").isin(kinds), F.col("len")).otherwise(0)).over(before), F.lit(0)).cast("int")
    checked = F.when(F.col("op").isin(*READ, "D", "N"), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("CIGAR operation cannot be handled: "), F.col("op"))))
    return rows.select("record_idx", "seg_no", checked.alias("op"), "len", along(READ).alias("read_start"), (F.col("pos") + along(REFERENCE)).cast("int").alias("ref_start"))


def aligned_pairs(reads: DataFrame, insertions: bool = False) -> DataFrame:
    """(record_idx, rp, ref_pos, ins_offset): aligned bases of a read; inserted ones too, at the base to their left, if asked for."""
    seg = cigar_segments(reads).filter(F.col("op").isin("M", "=", "X", *(["I"] if insertions else [])))
    rows = seg.select("record_idx", "op", "ref_start", "read_start", F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("k"))
    inserted = F.col("op") == "I"
    rows = rows.select("record_idx", (F.col("read_start") + F.col("k")).alias("rp"), F.when(inserted, F.col("ref_start") - 1).otherwise(F.col("ref_start") + F.col("k")).alias("ref_pos"), F.when(inserted, F.col("k") + 1).otherwise(0).alias("ins_offset"))
    return rows.filter("ref_pos >= 0")


def base_ranks(reads: DataFrame) -> DataFrame:
    """(record_idx, rp, base, rank, rank_any): the place of each base among equal ones, and among all, in the direction of the original read."""
    rows = reads.select("record_idx", F.col("flag").bitwiseAND(16).alias("rev"), F.posexplode(F.split("seq", "")).alias("rp", "base")).filter("base <> ''")
    order = F.when(F.col("rev") != 0, -F.col("rp")).otherwise(F.col("rp"))
    rank = lambda *keys: (F.row_number().over(Window.partitionBy("record_idx", *keys).orderBy(order)) - 1)
    return rows.select("record_idx", "rp", "base", rank("base").alias("rank"), rank().alias("rank_any"))


def mm_groups(reads: DataFrame) -> DataFrame:
    """(record_idx, grp, base, codes, flag, skips, lookup): the groups of the tag; ``lookup`` has the string that each code is looked up by."""
    rows = reads.select("record_idx", F.posexplode(F.split("mm", ";")).alias("grp", "g")).filter("g <> ''")
    head = r"^([ACGTUNacgtun])([+-])([A-Za-z]+|[0-9]+)([.?]?)((?:,[0-9]{1,9})*)$"
    part = lambda k: F.regexp_extract("g", head, k)
    rows = rows.withColumn("g", F.when(F.col("g").rlike(head) | (F.col("g") == ""), F.col("g")).otherwise(F.raise_error(F.concat(F.lit("malformed MM group: "), F.col("g")))))
    codes = part(3)
    letters = F.transform(F.sequence(F.lit(1), F.length(codes)), lambda i: F.substring(codes, i, F.length(codes)))
    return rows.select("record_idx", "grp", F.translate(F.upper(part(1)), "U", "T").alias("base"), codes.alias("codes"), F.when(part(4) == "?", "?").otherwise(".").alias("flag"), F.filter(F.transform(F.split(part(5), ","), lambda x: F.nullif(x, F.lit("")).cast("int")), lambda x: x.isNotNull()).alias("skips"), F.when(codes.rlike("^[0-9]"), F.array(codes)).otherwise(letters).alias("lookup"))


def mm_calls(reads: DataFrame) -> DataFrame:
    """(record_idx, grp, base, call, rank, ml_start): each stated base by its rank, and where its values begin in ML."""
    groups = mm_groups(reads)
    earlier = Window.partitionBy("record_idx").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("first_ml", F.coalesce(F.sum(F.size("skips") * F.size("lookup")).over(earlier), F.lit(0)))
    rows = groups.select("record_idx", "grp", "base", F.size("lookup").alias("n_codes"), "first_ml", F.posexplode("skips").alias("call", "skip"))
    along = Window.partitionBy("record_idx", "grp").orderBy("call")
    return rows.select("record_idx", "grp", "base", "call", (F.sum(F.col("skip") + 1).over(along) - 1).alias("rank"), (F.col("first_ml") + F.col("call") * F.col("n_codes")).alias("ml_start"))


def ml_values(reads: DataFrame) -> DataFrame:
    """(record_idx, grp, call, code, ml): the value of each stated code."""
    calls = mm_calls(reads).join(mm_groups(reads).select("record_idx", "grp", F.posexplode("lookup").alias("m", "code")), ["record_idx", "grp"])
    return calls.join(reads.select("record_idx", "ml"), "record_idx").select("record_idx", "grp", "call", "code", F.get("ml", (F.col("ml_start") + F.col("m")).cast("int")).cast("int").alias("ml"))


def _wanted(reads: DataFrame) -> DataFrame:
    """Groups with the base that stands in SEQ."""
    turned = reads.select("record_idx", F.col("flag").bitwiseAND(16).alias("rev"))
    return mm_groups(reads).join(turned, "record_idx").withColumn("target", F.when(F.col("rev") != 0, F.translate("base", "ACGTN", "TGCAN")).otherwise(F.col("base")))


def _group_bases(reads: DataFrame) -> DataFrame:
    """(record_idx, grp, rp, rank): the bases that each group ranks."""
    ranks, groups = base_ranks(reads), _wanted(reads).select("record_idx", "grp", "target")
    some = groups.filter("target <> 'N'").join(ranks, (groups.record_idx == ranks.record_idx) & (groups.target == ranks.base)).select(groups.record_idx, "grp", "rp", "rank")
    return some.unionByName(groups.filter("target = 'N'").join(ranks.drop("rank"), "record_idx").select("record_idx", "grp", "rp", F.col("rank_any").alias("rank")))


def called_bases(reads: DataFrame) -> DataFrame:
    """(record_idx, grp, call, rank, rp): the stated bases in SEQ."""
    return mm_calls(reads).select("record_idx", "grp", "call", "rank").join(_group_bases(reads), ["record_idx", "grp", "rank"]).select("record_idx", "grp", "call", "rank", "rp")


def skipped_bases(reads: DataFrame) -> DataFrame:
    """(record_idx, grp, rank, rp): of groups that state all their bases (flag ``.``), those not listed: unmodified."""
    implicit = mm_groups(reads).filter("flag = '.'").select("record_idx", "grp")
    bases = _group_bases(reads).join(implicit, ["record_idx", "grp"], "left_semi")
    return bases.join(mm_calls(reads).select("record_idx", "grp", "rank"), ["record_idx", "grp", "rank"], "left_anti").select("record_idx", "grp", "rank", "rp")
