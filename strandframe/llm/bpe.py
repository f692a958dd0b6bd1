"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before a white-space character that follows a character of another kind. Each match of
the pattern that holds white space either begins with it or holds nothing else, so such a place is always
between two matches, and encoding the parts gives the ids of the whole. A run of white space that is too
long for the library's regular expressions is handed over as the one piece that the pattern makes of it.
Ids are decoded by joining the raw bytes of the tokens; the result need not be valid UTF-8 for id lists that
were cut elsewhere.

Defined results: null and empty texts have no ids and decode to no bytes; repeated rows give repeated rows;
an empty table gives an empty one; columns are passed on, and an input column with the name of an output
column is replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandframe.llm.textvec import release

#: White_Space of Unicode, as the library's expressions understand \s.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A text longer than this many characters is cut at safe places about so far apart.
PIECE = 1 << 16
#: White space longer than this isn't given to the regular expression.
LONG_RUN = 1 << 12
_BOUNDARY = re.compile(rf"(?<=[^{WHITE}])[{WHITE}]")
_RUN = re.compile(rf"[{WHITE}]{{{LONG_RUN},}}")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Parts of the text between which no match of the pattern lies."""
    at = 0
    while len(text) - at > size:
        cut = _BOUNDARY.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(enc: tiktoken.Encoding, text: str) -> list[int]:
    if len(text) < LONG_RUN:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in pieces(text):
        at = 0
        for run in _RUN.finditer(piece):
            # The pattern takes a run of white space but for its last character, if another character follows.
            stop = run.end() if run.end() == len(piece) else run.end() - 1
            ids += enc.encode_ordinary(piece[at : run.start()])
            ids += enc._core_bpe.encode_single_piece(piece[run.start() : stop].encode())
            at = stop
        ids += enc.encode_ordinary(piece[at:]) if at < len(piece) else []
    return ids


def bpe_encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds ``ids`` (array of int) for the whole ``text``, and in ``decoded``, if named, the bytes decoded from the ids. ``keep``: the other columns to pass on, all if None."""
    made = [x for x in (ids, decoded) if x]
    kept = [c for c in (df.columns if keep is None else keep) if c not in made]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("\x00text"))
    fields = [source.schema[c] for c in kept] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False))] + ([T.StructField(decoded, T.BinaryType())] if decoded else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            texts, at = batch.column(batch.num_columns - 1), 0
            while at < len(texts):  # some 2 MB of text at a time
                to, size = at, 0
                found: list[list[int]] = []
                while to < len(texts) and size < 1 << 21:
                    x = texts[to].as_py() or ""
                    size += len(x)
                    found.append(encode(enc, x))
                    to += 1
                out = [batch.column(i).slice(at, to - at) for i in range(batch.num_columns - 1)]
                out.append(pa.array(found, pa.list_(pa.int32())))
                if decoded:
                    out.append(pa.array([enc.decode_bytes(x) for x in found], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])
                at = to
            release()

    return source.mapInArrow(run, T.StructType(fields))


def bpe_decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``decoded``: the raw bytes of the tokens, joined. Null ids count as none."""

    @F.pandas_udf(T.BinaryType())
    def run(column):  # noqa: ANN001, ANN202
        enc = encoding(path, pattern)
        return column.map(lambda x: enc.decode_bytes([] if x is None else [int(i) for i in x]))

    return df.withColumn(decoded, run(F.col(ids)))


def digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> list:
    """The contract's digest columns, from the operator's columns."""
    return [F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col(ids).cast("array<string>")), 256).alias("ids_sha256"), F.sha2(F.col(decoded), 256).alias("decoded_sha256")]
