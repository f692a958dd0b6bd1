"""Exact top-k search by inner product over quantised vectors.

Method: exhaustive term-at-a-time accumulation. A term is a component; candidates are dealt into blocks, and in
each block the postings of a term (candidates with a non-zero weight, and the weights) are scattered, times
the weight of each query row that has the term, into dense score arrays. Selection by partition keeps the best
k of a block for each query, with ties to the smaller id; the blocks' lists are then merged.

Queries are dealt into blocks as well, and each pair of a query block and a candidate block is one bounded task.

Defined results: vectors that are null or hold null or non-finite components take no part; vectors of unequal
length count as filled up with zeros; a query is not its own candidate, nor are other rows with its id, and each
row of a repeated id answers as a candidate and asks as a query; fewer than k candidates give fewer results; an
empty table gives an empty one. Scores beyond 64 bits, if any, are cut to their range. Other columns are not
passed on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
CANDIDATES, QUERIES, ROWS = 8192, 1024, 64
LEAST_BLOCKS = 16


def quantised(df: DataFrame, vec_id: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): whole numbers, as doubles."""
    v = F.col(f"`{vector}`")
    sound = v.isNotNull() & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    scaled = F.transform(v, lambda x: _floor(x.cast("double") * scale))
    return df.filter(sound & F.col(f"`{vec_id}`").isNotNull()).select(F.col(f"`{vec_id}`").alias("vec_id"), scaled.alias("v"))


def _floor(x: F.Column) -> F.Column:
    """Floor as a double, also beyond 64 bits, where doubles are whole."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = pa.concat_arrays(column.chunks)
    lengths, values = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def accumulate(asked: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Scores of query rows against candidates, term by term."""
    most = np.abs(asked).max(axis=0, initial=0) @ np.abs(held).max(axis=0, initial=0)
    kind = np.int64 if most < 2.0**62 else object
    whole = (lambda x: x.astype(np.int64)) if kind is np.int64 else (lambda x: np.frompyfunc(int, 1, 1)(x))
    asked, held = whole(asked), whole(held)
    scores = np.zeros((len(asked), len(held)), kind)
    for term in range(held.shape[1]):
        rows, docs = np.flatnonzero(asked[:, term]), np.flatnonzero(held[:, term])
        if len(rows) and len(docs):
            update = np.multiply.outer(asked[rows, term], held[docs, term])
            if len(rows) == len(asked) and len(docs) == len(held):
                scores += update
            else:
                scores[np.ix_(rows, docs)] += update
    return scores


def best(scores: np.ndarray, ids: np.ndarray, own: object, k: int) -> np.ndarray:
    """The places of the k highest scores among those with another id, ties to the smaller id."""
    places = np.flatnonzero(ids != own)
    if len(places) > k:
        if scores.dtype != object:
            bound = np.partition(scores[places], len(places) - k)[len(places) - k]
        else:
            bound = sorted(scores[places])[-k]
        places = places[scores[places] >= bound]
    return places[np.lexsort((ids[places], -scores[places]))][:k] if scores.dtype != object else np.array(sorted(places, key=lambda i: (-scores[i], ids[i]))[:k], int)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries and candidates (vec_id, v) as ``quantised`` gives them."""
    n, m = candidates.count(), queries.count()
    blocks, lots = max(LEAST_BLOCKS, -(-n // CANDIDATES)), max(1, -(-m // QUERIES))
    dealt = lambda into: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(into)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    held = candidates.withColumn("block", dealt(blocks)).withColumn("lot", every(lots))
    asked = queries.withColumn("number", F.monotonically_increasing_id()).withColumn("lot", dealt(lots)).withColumn("block", every(blocks))
    limit = 2**63

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if len(q) and len(c):
            width = max(int(pc.max(pc.list_value_length(x)).as_py() or 0) for x in (q["asked"], c["v"]))
            held, ids, asking = _matrix(c["v"], width), c["vec_id"].to_numpy(), q["query"].to_numpy()
            numbers = q["number"].to_numpy()
            wanted = _matrix(q["asked"], width)
            for at in range(0, len(asking), ROWS):
                scores = accumulate(wanted[at : at + ROWS], held)
                for i, row in enumerate(scores):
                    top = best(row, ids, asking[at + i], k)
                    found.append((np.full(len(top), asking[at + i]), ids[top], np.array([max(-limit, min(limit - 1, int(x))) for x in row[top]], np.int64), np.full(len(top), numbers[at + i])))
        columns = [np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else [()] * 4)]
        return pa.table({"query_id": columns[0].astype(np.int64), "vec_id": columns[1].astype(np.int64), "score": columns[2], "row": columns[3].astype(np.int64)})

    asked = asked.select(F.col("block").alias("b"), F.col("lot").alias("l"), F.col("vec_id").alias("query"), F.col("v").alias("asked"), "number")
    lists = asked.groupBy("b", "l").cogroup(held.select("block", "lot", "vec_id", "v").groupBy("block", "lot")).applyInArrow(meet, "query_id long, vec_id long, score long, row long")
    place = F.row_number().over(Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")).cast("int")
    return lists.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
           FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
     r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
