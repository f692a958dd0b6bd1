"""Decoding in one pass over each read: an Arrow-batched kernel from records to calls.

It emits only calls at aligned bases (inserted ones too, if asked for) of requested codes, so that no shuffle is
needed before the reference is joined. The work inside a read is done on arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.options import QueryOptions

SCHEMA = "record_idx long, qname string, contig string, ref_pos int, strand string, read_pos int, mod_code string, ml int, ins_offset int, haplotype int, is_skipped boolean, read_base string, any_base boolean, sought string, grp int, place int, unless_base boolean"
ARROW = pa.schema([("record_idx", pa.int64()), ("qname", pa.string()), ("contig", pa.string()), ("ref_pos", pa.int32()), ("strand", pa.string()), ("read_pos", pa.int32()), ("mod_code", pa.string()), ("ml", pa.int32()), ("ins_offset", pa.int32()), ("haplotype", pa.int32()), ("is_skipped", pa.bool_()), ("read_base", pa.string()), ("any_base", pa.bool_()), ("sought", pa.string()), ("grp", pa.int32()), ("place", pa.int32()), ("unless_base", pa.bool_())])
COLUMNS = ["record_idx", "qname", "flag", "contig", "pos", "cigar", "seq", "mm", "ml", "hp"]
#: Columns that are checked if they are there: lengths of the contig by the reference and by the header of the alignments.
CHECKED = ["ref_len", "contig_len"]
_OP = re.compile(r"(\d+)([A-Za-z=])")
_GROUP = re.compile(r"([ACGTUNacgtun])([+-])([A-Za-z]+|[0-9]+)([.?]?)((?:,[0-9]{1,9})*)")
_COMPLEMENT = str.maketrans("ACGTN", "TGCAN")


def reference_positions(cigar: str, pos: int, length: int, insertions: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each base of SEQ its reference position (-1: none) and its offset inside an insertion."""
    places, offsets = np.full(length, -1, np.int64), np.zeros(length, np.int64)
    read, ref = 0, pos
    for size, op in _OP.findall(cigar):
        n = int(size)
        if op in "M=X":
            places[read : read + n] = np.arange(ref, ref + n)
            read, ref = read + n, ref + n
        elif op in "DN":
            ref += n
        elif op == "I":
            if insertions and ref > 0:
                places[read : read + n] = ref - 1
                offsets[read : read + n] = np.arange(1, n + 1)
            read += n
        elif op == "S":
            read += n
        else:
            raise ValueError(f"CIGAR operation cannot be handled: {op}")
    if read != length and cigar not in ("", "*"):
        raise ValueError(f"CIGAR covers {read} of {length} bases")
    return places, offsets


def groups(mm: str) -> list[tuple[str, str, str, list[int]]]:
    """(base, codes, flag, skips) of each group of an MM tag."""
    out = []
    for text in mm.split(";"):
        if text:
            found = _GROUP.fullmatch(text)
            if not found:
                raise ValueError(f"malformed MM group: {text!r}")
            base = found[1].upper().replace("U", "T")
            out.append((base, found[3], found[4] or ".", [int(x) for x in found[5].split(",")[1:]]))
    return out


def lookups(codes: str, split: bool = False) -> list[str]:
    """What each code of a group is looked up by: a number as a whole, a letter with what follows it."""
    return [codes] if codes.isdigit() else list(codes) if split else [codes[m:] for m in range(len(codes))]


def ranked_bases(seq: str, letters: np.ndarray, base: str, reverse: bool) -> np.ndarray:
    """The bases of SEQ that a group counts, in the order in which it counts them."""
    target = base.translate(_COMPLEMENT) if reverse else base
    ranked = np.arange(len(seq)) if base == "N" else np.flatnonzero(letters == ord(target))
    return ranked[::-1] if reverse else ranked


def stated_ranks(skips: list[int], ranked: np.ndarray, base: str, qname: str) -> np.ndarray:
    ranks = np.cumsum(np.array(skips, np.int64) + 1) - 1
    if len(ranks) and ranks[-1] >= len(ranked):
        raise ValueError(f"read {qname}: MM names base {ranks[-1] + 1} of {len(ranked)} of {base}")
    return ranks


class _Seen:
    """Which bases of a read a code has been given for: so that each gets the first of its calls.

    A group of base N calls a base whatever the reference has, others only if it has the same. So a call of N that comes second
    counts where the base is not that of the reference, and only there, unless no call is held against it.
    """

    def __init__(self, length: int) -> None:
        self.length = length
        self.of: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def first(self, key: str, at: np.ndarray, any_base: bool, tested: bool) -> tuple[np.ndarray, np.ndarray]:
        """Which of these calls are first, and which of those are so unless the base is that of the reference."""
        if key not in self.of:
            self.of[key] = np.zeros(self.length, bool), np.zeros(self.length, bool)
        by_base, by_any = self.of[key]
        second = by_base[at]
        new = ~by_any[at] & (~second if not (any_base and tested) else True)
        (by_any if any_base else by_base)[at] = True
        return new, second


def check_contig(record: dict, end: int) -> None:
    """The contig of a record is in the reference, as long as the header says, and not shorter than the alignment."""
    if "ref_len" in record:
        size, named = record["ref_len"], record.get("contig_len")
        if size is None:
            raise ValueError(f"read {record['qname']}: the reference lacks contig {record['contig'] or '*'}")
        if named is not None and named != size:
            raise ValueError(f"contig {record['contig']} has {size} bases, by the header of the alignments {named}")
        if end >= size:
            raise ValueError(f"read {record['qname']}: the reference lacks position {end} of {record['contig']}")


def decode(record: dict, options: QueryOptions, first: bool = False) -> list[tuple]:
    """(ref_pos, read_pos, code, ml, ins_offset, skipped, base, any_base, sought, grp, place, unless_base) arrays for each group and code of one record. With ``first`` only the first call of a code at a place: by group, stated before skipped."""
    seq, reverse = record["seq"], bool(record["flag"] & 16)
    places, offsets = reference_positions(record["cigar"] or "", record["pos"], len(seq), options.insertions)
    check_contig(record, int(places.max(initial=-1)))
    letters, ml = np.frombuffer(seq.encode(), np.uint8), record["ml"]
    sought, seen = options.sought(), _Seen(len(seq))
    out, start = [], 0
    for g, (base, codes, flag, skips) in enumerate(groups(record["mm"])):
        keys = lookups(codes, options.split_codes)
        ranked = ranked_bases(seq, letters, base, reverse)
        ranks = stated_ranks(skips, ranked, base, record["qname"])
        stated = [(ranked[ranks], np.arange(len(ranks)), False)]
        if flag == ".":
            rest = np.ones(len(ranked), bool)
            rest[ranks] = False
            stated.append((ranked[rest], np.zeros(int(rest.sum()), np.int64), True))
        for at, call, skipped in stated:
            aligned = places[at] >= 0
            at, call = at[aligned], call[aligned]
            for m, key in enumerate(keys):
                wanted = "*" if "*" in sought else key if key in sought else None
                if wanted is None or not len(at):
                    continue
                if skipped:
                    values = np.zeros(len(at), np.int64)
                else:
                    index = start + call * len(keys) + m
                    if ml is None or index[-1] >= len(ml):
                        raise ValueError(f"read {record['qname']}: ML has no value {index[-1]}")
                    values = np.asarray(ml)[index]
                mine, unless = at, np.zeros(len(at), bool)
                number = np.arange(len(at)) * len(keys) + m
                if first:
                    new, second = seen.first(key, at, base == "N", not options.insertions and sought[wanted].context != "*")
                    mine, values, number, unless = mine[new], values[new], number[new], second[new]
                read_pos = len(seq) - 1 - mine if reverse else mine
                out.append((places[mine], read_pos, key, values, offsets[mine], skipped, letters[mine], base == "N", wanted, g, number, unless))
        start += len(skips) * len(keys)
    return out


def _records(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch; the values of ML, which may be many, stay in arrays."""
    plain = [name for name in batch.schema.names if name != "ml"]
    ml = batch.column("ml")
    values, ends = ml.values.to_numpy(zero_copy_only=False), ml.offsets.to_numpy()
    known = ml.is_valid().to_numpy(zero_copy_only=False)
    for i, row in enumerate(zip(*(batch.column(name).to_pylist() for name in plain), strict=True)):
        yield dict(zip(plain, row, strict=True)) | {"ml": values[ends[i] : ends[i + 1]] if known[i] else None}


def skipped_bases(reads: DataFrame) -> DataFrame:
    """(record_idx, grp, rank, rp): of groups that state all their bases (flag ``.``), those not listed: unmodified. One pass over each read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple[int, int, np.ndarray, np.ndarray]] = []
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            for record, qname, flag, seq, mm in rows:
                letters = np.frombuffer(seq.encode(), np.uint8)
                for g, (base, _, kind, skips) in enumerate(groups(mm)):
                    if kind == ".":
                        ranked = ranked_bases(seq, letters, base, bool(flag & 16))
                        rest = np.ones(len(ranked), bool)
                        rest[stated_ranks(skips, ranked, base, qname)] = False
                        parts.append((record, g, np.flatnonzero(rest), ranked[rest]))
            if parts:
                sizes = [len(p[2]) for p in parts]
                each = [np.repeat([p[0] for p in parts], sizes), np.repeat([p[1] for p in parts], sizes).astype(np.int32), *(np.concatenate([p[k] for p in parts]).astype(np.int32) for k in (2, 3))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in each], names=["record_idx", "grp", "rank", "rp"])

    return reads.select("record_idx", "qname", "flag", "seq", "mm").mapInArrow(run, "record_idx long, grp int, rank int, rp int")


def decode_calls(reads: DataFrame, options: QueryOptions, first: bool = False) -> DataFrame:
    """All calls of requested codes at placed bases (or of each code at each place the first), not yet held against the reference. Columns as in SCHEMA."""
    letters = pa.array([chr(i) for i in range(128)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(batch: pa.RecordBatch, parts: list[tuple], rows: list[int], haplotypes: list[int], strands: list[str]) -> pa.RecordBatch:
            """What is the same for a part of calls is repeated once, at the end."""
            sizes = [len(p[0]) for p in parts]
            row = np.repeat(rows, sizes)
            same = lambda k, kind=None: pa.array([p[k] for p in parts], kind).take(pa.array(np.repeat(np.arange(len(parts)), sizes)))
            each = lambda k, kind=np.int32: pa.array(np.concatenate([p[k] for p in parts]).astype(kind))
            of = lambda name: batch.column(name).take(pa.array(row))
            by_row = lambda values, kind: pa.array(values, kind).take(pa.array(row))
            columns = [of("record_idx"), of("qname"), of("contig"), each(0), by_row(strands, pa.string()), each(1), same(2, pa.string()), each(3), each(4), by_row(haplotypes, pa.int32()), same(5, pa.bool_()), letters.take(each(6)), same(7, pa.bool_()), same(8, pa.string()), same(9, pa.int32()), each(10), each(11, bool)]
            return pa.RecordBatch.from_arrays(columns, schema=ARROW)

        for batch in batches:
            parts, rows, haplotypes, strands, held = [], [], [], [], 0
            for i, record in enumerate(_records(batch)):
                strands.append("-" if record["flag"] & 16 else "+")
                haplotypes.append((record["hp"] or 0) & 255)
                found = decode(record, options, first)
                parts += found
                rows += [i] * len(found)
                held += sum(len(p[0]) for p in found)
                if held > 100_000:
                    yield made(batch, parts, rows, haplotypes, strands)
                    parts, rows, held = [], [], 0
            if parts:
                yield made(batch, parts, rows, haplotypes, strands)

    return reads.select(*COLUMNS, *[c for c in CHECKED if c in reads.columns]).mapInArrow(run, SCHEMA)
