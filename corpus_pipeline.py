"""The corpus pipeline: from documents to token ids, each stage on all that its predecessor kept.

toxicity drops documents that the model scores as toxic; quality drops those that the quality rules reject; near
duplicates keeps of each group of linked documents the one with the smallest id; mixing repeats or drops
documents to meet the sources' target weights; encoding gives each remaining row its token ids.

Rows that repeat an id are rows of their own; all stages but near duplicates judge each row by itself, and that
one keeps one row of a group. Rows without an id aren't linked, and stay. An empty table gives an empty one;
without labels nothing is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm import bpe, jaccard, mixing, quality, toxicity
from strandframe.llm.common import Scratch, checkpointed, table
from strandframe.llm.queries import TOXIC, tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Ids that are broadcast, at most (8 MB of numbers).
IDS_SENT = 1_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model, keep=[*COLUMNS]).filter(F.col("score") < TOXIC).select(*COLUMNS)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_rules(docs, keep=COLUMNS).filter("kept").select(*COLUMNS)


def _sent(ids: DataFrame) -> DataFrame:
    """The ids, sent to all executors if they are few; else the join is left to shuffle."""
    ids = checkpointed(ids)
    return F.broadcast(ids) if ids.count() <= IDS_SENT else ids


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    groups = jaccard.near_duplicate_groups(docs.select("doc_id", "text"))
    again = _sent(docs.groupBy("doc_id").count().filter("doc_id is not null and count > 1").select("doc_id"))
    dropped = _sent(groups.filter("component_id <> doc_id").select("doc_id").join(again, "doc_id", "left_anti"))
    kept = docs.join(dropped, "doc_id", "left_anti")
    if again.isEmpty():
        return kept
    # Rows that repeat an id: each is judged by its own set, and of a group that begins with the id one row stays.
    rows = docs.join(again, "doc_id", "left_semi").select(F.struct(*COLUMNS).alias("row"), "text")
    rows = jaccard.profiles(rows, "row", "text").select(F.col("doc_id").alias("row"), "fp", "n")
    first = groups.filter("component_id = doc_id").join(again, "doc_id", "left_semi").select("doc_id", F.col("fp").alias("of"), "group").distinct()
    linked = rows.filter("n > 0").join(first, F.expr("row.doc_id = doc_id and fp = of")).groupBy("group").agg(F.min("row").alias("row"))
    several = rows.filter("n = 0").select("row.*").unionByName(linked.select("row.*"))
    return kept.join(again, "doc_id", "left_anti").unionByName(several)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Only places of rows in their files and sizes go through the sampling; texts meet their copies once.
    place = F.struct("_metadata.file_name", "_metadata.row_index").alias("row")
    rows = docs.select(*COLUMNS, place)
    mixed = mixing.mix_sources(rows, keep=["row"]).filter("copies > 0").select("row", F.col("copies").cast("int").alias("copies"))
    return rows.join(mixed, "row").select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.bpe_encode(docs, *tokenizer(), keep=["doc_id", "source"])
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", drop_toxic), ("quality rules", drop_poor), ("n-gram Jaccard join", drop_near_copies), ("mixing to target weights", mix), ("byte-level BPE", encode)]
#: Learned scores, suffix arrays and BPE are beyond SQL; a test holds the rows of run() against those of a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; between stages the rows are written to the shared checkpoint folder, and what a stage has read is deleted."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.write(docs, str(i))
            if i:
                scratch.drop(str(i - 1))
    return docs
