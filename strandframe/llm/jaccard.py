"""Exact Jaccard self-join over word shingles, and the groups of linked documents.

Method: partition of the universe of shingles, and the pigeonhole principle. Two sets with a Jaccard
similarity of at least 3/4 differ in at most (|r| + |s|) / 7 shingles. Sets are taken in size bands; a band has
so many segments, and a hash of a shingle names its segment. A set is indexed by each of its non-empty segments
(one hash of what it holds), in its own band and, if it can be the smaller of a pair there, in the next; small
sets also by their one-deletion neighbourhoods (a segment less one shingle). For a set of n shingles that seeks
smaller ones, H = floor(2n / 7) differences may be spread over its segments. A segment matched exactly stands for
one unit, one matched with up to one deletion for two; with H + 1 units allocated, each partner shares
one of them. The allocation goes by cost: the units with the fewest other sets in their index lists, which
are counted over all documents. As a rule most units of a set that has no partner have empty lists, so that
it probes none, whatever passages it shares with others.

A set with fewer units than it needs, if there ever is one, is held against all sets that share one of its
first shingles instead (prefix filter), so that nothing rests on how shingles happen to fall.

Lists that are probed by many sets are not turned into all pairs: their probing sets are first linked to one
centre; then only pairs of sets that are still in different groups are held against each other, in blocks,
by sketches whose distance never exceeds that of the sets; what remains is verified exactly on the sets. The blocks of
a list hold either sets of its largest group or others, and two blocks of the largest group never meet. Near copies
meet in many lists; a pair is passed on by the first of them only, as far as a few random orders of each set's lists tell.

No list is gathered by one task. Tasks that index texts keep each set once, and pass entries of signatures that
they have met twice straight on, spread evenly; only the others, at most one for each signature and pass, are grouped
to find those that no other task has met.

Exact copies (equal sets) are one set throughout, told by a 64-bit fingerprint; shingles are 64-bit hashes.
Intermediate tables lie in the shared checkpoint folder and are deleted as soon as they have been read.

Defined results: null and empty texts, and those without words, have 0 shingles and are their own group;
ties go to the smallest id; rows that repeat an id share the group of their sets; rows without an id are not
linked and have no group; an empty table gives an empty one. No column of the input is passed on but the id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.llm.common import BATCH, Scratch, checkpointed, partitions, setting
from strandframe.llm.textvec import chunks, mix, shingle_sets

WORDS = 5
#: Standard deviations by which sets have more units than differences.
SPREAD = 8.0
#: Sets of up to so many shingles are also indexed by one-deletion neighbourhoods.
SMALL = 63
#: Index entries in one group of the join, about; entries that a task holds before it passes them on.
GROUP, FLUSH = 750_000, 1_000_000
#: Sets of one list in a block; pairs passed on for each set of two blocks before only nearest groups are joined; rounds of that.
BLOCK, PAIRS, ROUNDS = 1024, 8, 4
#: Orders of lists, by whose first common list a pair is passed on.
ORDERS = 6
#: Rows in a file: of numbers, with sketches, with hashes; shingles whose index entries make one. Each file costs the file
#: system calls, on a local one even processes, so that small tables get few.
THIN, WIDE, FAT, MANY = 500_000, 20_000, 5_000, 4_000_000
#: Ids that are broadcast, at most (16 MB of numbers); more go through a join that shuffles.
IDS_SENT = 1_000_000
#: Kinds of entries; what marks a signature that a task has passed on; entries of such in one piece.
EXACT, DELETED, MARK, EVEN = 0, 1, 4, 1 << 16
_U = np.uint64


@lru_cache(maxsize=64)
def segments(band: int, spread: float) -> int:
    """So many that a set of the band has more non-empty segments (or units, of small sets) than differences, at ``spread`` standard deviations."""
    low, high = 1 << band, (2 << band) - 1
    if high <= SMALL:
        return 2 * high
    m = 2
    while True:
        for size in (low, (low + high) // 2, high):
            load = size / m
            mean, deviation = m * (1 - math.exp(-load)), math.sqrt(max(0.0, m * (math.exp(-load) - (1 + load) * math.exp(-2 * load))))
            if mean - spread * deviation < 2 * size // 7 + 1:
                break
        else:
            return m
        m += max(1, m // 50)


def fingerprints(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, _U), np.cumsum(mix(hashes ^ _U(0x1234567)), dtype=_U)))
    return mix((total[at[1:]] - total[at[:-1]]) ^ mix(np.diff(at).astype(_U)))


def sketch(hashes: np.ndarray) -> bytes:
    """Parities of the numbers of shingles in 2^k places, of 2 to 4 places a shingle."""
    places = 1 << max(6, math.ceil(math.log2(2 * max(1, len(hashes)))))
    return np.packbits((np.bincount((hashes & _U(places - 1)).astype(np.int64), minlength=places) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes], size: int) -> np.ndarray:
    """The sketches in so many bytes, by adding halves; distances only become smaller."""
    out = np.empty((len(sketches), size), np.uint8)
    for i, s in enumerate(sketches):
        row = np.frombuffer(s, np.uint8)
        while len(row) > size:
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
        out[i] = row
    return out


def _banded(hashes: np.ndarray, at: np.ndarray, role: int, spread: float) -> tuple[np.ndarray, ...]:
    """Of the sets in their own band (role 0) or, those that can be the smaller of a pair there, in the next: the band of each set, whether it takes part, and hashes, owners and segments of those that do."""
    sizes = np.diff(at)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    bands = np.zeros(len(sizes), np.int64)
    bands[sizes > 0] = np.floor(np.log2(sizes[sizes > 0] + 0.5)).astype(np.int64)
    if role:
        chosen = (2 * sizes >= 3 << bands)[owner]
        hashes, owner, bands = hashes[chosen], owner[chosen], bands + 1
    count = np.array([segments(b, spread) for b in range(int(bands.max(initial=0)) + 1)], _U)[bands]
    return bands, hashes, owner, ((hashes >> _U(32)) * count[owner]) >> _U(32)


def unit_counts(hashes: np.ndarray, at: np.ndarray, spread: float) -> np.ndarray:
    """The units of each set: its segments with shingles, and once more those of small sets that hold two or more."""
    bands, _, owner, segment = _banded(hashes, at, 0, spread)
    first, after = _bounds((owner.astype(_U) << _U(32)) | segment)
    own = owner[first]
    deletable = ((2 << bands[own]) - 1 <= SMALL) & (after - first > 1)
    return np.bincount(own, minlength=len(bands)) + np.bincount(own[deletable], minlength=len(bands))


def index_entries(hashes: np.ndarray, at: np.ndarray, spread: float) -> Iterator[tuple[np.ndarray, ...]]:
    """The index of some sets: (signature, set, own band or the next, kind, segment if it has a second unit else -1)."""
    for role in (0, 1):
        band, h, own, segment = _banded(hashes, at, role, spread)
        if not len(h):
            continue
        new = np.ones(len(h), bool)
        new[1:] = (segment[1:] != segment[:-1]) | (own[1:] != own[:-1])  # hashes ascend, and so do segments
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(h)))
        scrambled = mix(h ^ _U(0x51ED27))
        total, place = np.add.reduceat(scrambled, first), mix((band[own[first]].astype(_U) << _U(40)) | segment[first])
        deletable = ((2 << band[own[first]]) - 1 <= SMALL) & (length > 1)
        yield mix(total ^ place), own[first], np.full(len(first), role == 0), np.full(len(first), EXACT), np.where(deletable, segment[first].astype(np.int64), -1)
        inside = np.repeat(deletable, length)
        of = np.repeat(np.arange(len(first)), length)[inside]
        if len(of):
            yield mix((total[of] - scrambled[inside]) ^ place[of]), own[first][of], np.full(len(of), role == 0), np.full(len(of), DELETED), segment[first][of].astype(np.int64)


def _bounds(ascending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal numbers begins and ends."""
    if not len(ascending):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = np.flatnonzero(ascending[1:] != ascending[:-1]) + 1
    return np.append(0, cuts), np.append(cuts, len(ascending))


def _planes(numbers: np.ndarray, width: int, skip: int = 0) -> bytes:
    """Byte by byte, the highest first, as that packs better; ``skip`` lowest bytes are left out."""
    return np.ascontiguousarray(numbers[:, None].view(np.uint8).reshape(len(numbers), -1)[:, skip:width][:, ::-1].T).tobytes()


def _from_planes(data: bytes, width: int, kind: type, skip: int = 0) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(width - skip, -1)
    out = np.zeros((raw.shape[1], np.dtype(kind).itemsize), np.uint8)
    out[:, skip:width] = raw[::-1].T
    return out.reshape(-1).view(kind)


def profiles(docs: DataFrame, doc_id: str, text: str, spread: float = SPREAD) -> DataFrame:
    """Of each document: id, and fp, n, units and sketch of its set."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, to, texts in chunks(batch.column(1), lower=True):
                hashes, at = shingle_sets(texts, WORDS)
                drawn = [sketch(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, to - row), pa.array(fingerprints(hashes, at).view(np.int64)), pa.array(np.diff(at)), pa.array(unit_counts(hashes, at, spread).astype(np.int64)), pa.array(drawn, pa.binary())], names=["doc_id", "fp", "n", "units", "sketch"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long, n long, units long, sketch binary")


def postings(docs: DataFrame, text: str, groups: int, spread: float) -> DataFrame:
    """The entries of the index lists with two sets or more: run, fp, kind, own, seg, n, units. Copies that are indexed by different tasks may repeat an entry."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        about: list[np.ndarray] = []
        n_sets = n_held = turn = 0

        def packed(numbers: np.ndarray, signature: np.ndarray, tag: np.ndarray, seg: np.ndarray, of: np.ndarray, sets: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Rows of entries by the ascending numbers of their groups."""
            for a, b in zip(*(x.tolist() for x in _bounds(numbers)), strict=True):
                inside, number = np.unique(of[a:b], return_inverse=True)
                tagged = (number.astype(np.uint32) << np.uint32(3)) | tag[a:b]
                yield pa.RecordBatch.from_arrays([pa.array([int(numbers[a])], pa.int32()), pa.array([_planes(signature[a:b], 8, 1)], pa.binary()), pa.array([_planes(tagged, 4)], pa.binary()), pa.array([_planes((seg[a:b] + 1).astype(np.uint16), 2)], pa.binary()), pa.array([sets[inside].tobytes()], pa.binary())], names=["grp", "signatures", "tags", "segs", "sets"])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal n_sets, n_held, turn
            signature, of, own, kind, seg = (np.concatenate(x) for x in zip(*held, strict=True))
            sets = np.concatenate(about)
            held.clear()
            about.clear()
            n_sets = n_held = 0
            once = np.zeros(len(sets), bool)  # each set, however many copies it has
            once[np.unique(sets[:, 0], return_index=True)[1]] = True
            mine = once[of]
            order = np.flatnonzero(mine)[np.argsort(signature[mine])]
            signature, of, seg, tag = signature[order], of[order], seg[order], (own[order].astype(np.uint32) << np.uint32(1)) | kind[order].astype(np.uint32)
            first, after = _bounds(signature)
            met = np.repeat(after - first > 1, after - first)
            # Of signatures that are met again here, only a mark goes to their group; the entries are dealt out evenly.
            lone = ~met
            lone[first] = True
            marked = (tag | np.where(met, np.uint32(MARK), np.uint32(0)))[lone]
            yield from packed(((signature[lone] >> _U(32)) * _U(groups)) >> _U(32), signature[lone], marked, seg[lone], of[lone], sets)
            piece = np.arange(int(met.sum())) // EVEN
            if len(piece):
                start = int(mix(signature[:1])[0] % _U(groups)) + turn
                numbers = (start + piece) % groups
                order = np.argsort(numbers, kind="stable")
                yield from packed((groups + numbers[order]).astype(_U), *(x[met][order] for x in (signature, tag, seg, of)), sets)
                turn += int(piece[-1]) + 1

        for batch in batches:
            for _, _, texts in chunks(batch.column(0), lower=True):
                hashes, at = shingle_sets(texts, WORDS)
                sets = np.stack((fingerprints(hashes, at), np.diff(at).astype(_U), unit_counts(hashes, at, spread).astype(_U)), axis=1)
                for signature, of, own, kind, seg in index_entries(hashes, at, spread):
                    held.append((signature, (of + n_sets).astype(np.int32), own, kind.astype(np.int8), seg.astype(np.int32)))
                    n_held += len(signature)
                about.append(sets)
                n_sets += len(sets)
                if n_held >= FLUSH:
                    yield from flush()
        if n_held:
            yield from flush()

    def join(table: pa.Table) -> pa.Table:
        signatures, tags, segs, sets, base = [], [], [], [], 0
        for row in table.select(["signatures", "tags", "segs", "sets"]).to_pylist():
            signatures.append(_from_planes(row["signatures"], 8, _U, 1))
            tags.append(_from_planes(row["tags"], 4, np.uint32).astype(np.int64) + (base << 3))
            segs.append(_from_planes(row["segs"], 2, np.uint16).astype(np.int64) - 1)
            sets.append(np.frombuffer(row["sets"], _U).reshape(-1, 3))
            base += len(sets[-1])
        signature, tag, seg, sets = np.concatenate(signatures), np.concatenate(tags), np.concatenate(segs), np.concatenate(sets)
        if table["grp"][0].as_py() < groups:
            order = np.argsort(signature, kind="stable")
            same = signature[order][1:] == signature[order][:-1]
            order = order[np.append(same, False) | np.append(False, same)]
            order = order[np.lexsort((sets[tag[order] >> 3, 0], signature[order]))]
            signature, tag, seg = signature[order], tag[order], seg[order]
            fp, mark = sets[tag >> 3, 0], (tag & MARK) > 0
            first, after = _bounds(signature)
            if len(first):
                again = np.append(False, (signature[1:] == signature[:-1]) & (fp[1:] == fp[:-1]) & ~mark[1:] & ~mark[:-1])
                shared = np.repeat((np.add.reduceat(~again, first) > 1) | np.logical_or.reduceat(mark, first), after - first)
                kept = shared & ~mark & ~again
                signature, tag, seg = signature[kept], tag[kept], seg[kept]
        fp, n, units = sets[tag >> 3].T
        return pa.table({"run": signature.view(np.int64), "fp": fp.view(np.int64), "kind": (tag & 1).astype(np.int32), "own": (tag & 2) > 0, "seg": seg.astype(np.int32), "n": n.astype(np.int64), "units": units.astype(np.int64)})

    rows = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(pack, "grp int, signatures binary, tags binary, segs binary, sets binary")
    return rows.groupBy("grp").applyInArrow(join, "run long, fp long, kind int, own boolean, seg int, n long, units long")


def counted(entries: DataFrame) -> DataFrame:
    """The entries with n_exact and n_deleted of their lists."""
    exact = F.sum(F.when(F.col("kind") == EXACT, 1).otherwise(0))
    lists = entries.groupBy("run").agg(exact.alias("n_exact"), (F.count(F.lit(1)) - exact).alias("n_deleted"))
    return entries.join(lists, "run")


def probes(lists: DataFrame) -> DataFrame:
    """(run, want, fp, n): the lists, and the kind of entry in them, that each set looks into, by the cheapest allocation."""
    own = lists.filter("own")
    exact = own.filter("kind = 0 and n_exact > 1").select("fp", "n", "units", (F.col("n_exact") - 1).alias("cost"), F.lit(0).alias("unit"), "run", F.lit(-1).alias("seg"))
    near = own.filter("seg >= 0").groupBy("fp", "seg").agg(F.first("n").alias("n"), F.first("units").alias("units"), F.sum(F.expr("if(kind = 0, n_exact - 1, 0)")).alias("c0"), F.sum(F.expr("if(kind = 0, n_deleted, n_exact)")).alias("c1"))
    near = near.withColumn("cost", F.greatest("c0", "c1")).filter("cost > 0").select("fp", "n", "units", "cost", F.lit(1).alias("unit"), F.lit(None).cast("long").alias("run"), "seg")
    by_set = Window.partitionBy("fp")
    chosen = exact.unionByName(near).withColumn("busy", F.count(F.lit(1)).over(by_set)).withColumn("place", F.row_number().over(by_set.orderBy("cost", "unit", "run", "seg")))
    chosen = chosen.filter("place <= floor(2 * n / 7) + 1 - (units - busy)")
    first = chosen.filter("unit = 0").select("run", F.lit(EXACT).alias("want"), "fp", "n")
    second = chosen.filter("unit = 1").select("fp", "seg").join(own.filter("seg >= 0").select("fp", "seg", "run", "kind", "n"), ["fp", "seg"]).select("run", (1 - F.col("kind")).alias("want"), "fp", "n")
    return first.unionByName(second).distinct()


def _sent(ids: DataFrame) -> DataFrame:
    """A written table of ids, sent to all executors if they are few; else the join is left to shuffle."""
    return F.broadcast(ids) if ids.count() <= IDS_SENT else ids


def _by_prefix(docs: DataFrame, text: str, bare: DataFrame) -> DataFrame:
    """(a, b, na, nb): each of the sets ``bare`` (fp, n, hashes) with the sets that hold one of its first quarter of shingles and one more; a similar set misses a quarter at most."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp, n, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = np.frombuffer(hashes, np.int64)[: n // 4 + 1]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([fp] * len(part), pa.int64()), pa.array([n] * len(part), pa.int64())], names=["h", "a", "na"])

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in chunks(batch.column(0), lower=True):
                hashes, at = shingle_sets(texts, WORDS)
                sizes = np.diff(at)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.repeat(fingerprints(hashes, at).view(np.int64), sizes)), pa.array(np.repeat(sizes, sizes))], names=["h", "b", "nb"])

    wanted = bare.select("fp", "n", "hashes").mapInArrow(first, "h long, a long, na long")
    shingles = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(every, "h long, b long, nb long")
    return wanted.join(shingles, "h").filter("a <> b").select("a", "b", "na", "nb").distinct()


def _distance_ok(a: bytes, b: bytes, n: int) -> bool:
    size = min(len(a), len(b))
    x, y = folded([a], size), folded([b], size)
    return int(np.bitwise_count(x ^ y).sum()) <= n // 7


def _sketched(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b, na, nb) that their sketches don't rule out."""
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("sketch").alias("sa")), "a").join(sets.select(F.col("fp").alias("b"), F.col("sketch").alias("sb")), "b").select("a", "b", "na", "nb", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n = batch.column(4).to_pylist(), batch.column(5).to_pylist(), (batch.column(2).to_numpy() + batch.column(3).to_numpy()).tolist()
            kept = pa.array([_distance_ok(*x) for x in zip(a, b, n, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(kept)

    return both.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar enough."""
    one = lambda side: sets.select(F.col("fp").alias(side), F.col("hashes").alias(f"h{side}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "ha", "hb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                common = int((p[np.minimum(np.searchsorted(p, q), len(p) - 1)] == q).sum())
                kept.append(100 * common >= 75 * (len(p) + len(q) - common))
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(v, component): the smallest vertex that each vertex of the written edges (a, b) can reach. Each round maps vertices to their smallest neighbour, and edges with them."""
    files = 2 * edges.count() / THIN
    edges = edges.filter("a <> b")
    steps = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
        steps.append(least := scratch.write(least, f"{name}_least{len(steps)}", files))
        edges = edges.join(least.toDF("a", "x"), "a").join(least.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        edges = scratch.write(edges.filter("a <> b").distinct(), f"{name}_edges{len(steps)}", files)
    if not steps:
        return edges.toDF("v", "component")
    # Few steps are needed, as they join whole neighbourhoods; the label of a vertex goes through all of them.
    labels = steps[0].withColumnRenamed("m", "component")
    for least in steps[1:]:
        labels = labels.join(least.toDF("component", "m"), "component", "left").select("v", F.coalesce("m", "component").alias("component"))
    return scratch.write(labels, f"{name}_labels", files)


def _merged(scratch: Scratch, groups: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """The groups (v, component) with further links between sets: only groups are joined, not all sets again."""
    label = lambda side, to: groups.select(F.col("v").alias(side), F.col("component").alias(to))
    between = links.join(label("a", "x"), "a", "left").join(label("b", "y"), "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    between = scratch.write(between.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), f"{name}_between", links.count() / THIN)
    joined = components(scratch, between, name).toDF("component", "joined")
    both = groups.union(joined.select(F.col("component").alias("v"), "component").join(groups.select("v"), "v", "left_anti"))
    return scratch.write(both.join(joined, "component", "left").select("v", F.coalesce("joined", "component").alias("component")), f"{name}_merged", groups.count() / THIN)


def _open_lists(both: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``both`` (run, want, asks, fp, n) in lists with sets of several groups, each content once: with their groups, and their block, which is from ``others`` on for sets outside the largest group of the list."""
    grouped = both.join(groups.withColumnRenamed("v", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    parts = grouped.groupBy("run", "want", "component").agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64("fp", "asks")).alias("x"), F.bit_xor(F.xxhash64("asks", "fp", F.lit(1))).alias("y"))
    runs = parts.groupBy("run", "want").agg(F.count(F.lit(1)).alias("groups"), F.sum("rows").alias("size"), F.max(F.struct("rows", "component")).alias("most"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).filter("groups > 1")
    runs = runs.groupBy("size", "x", "y").agg(F.min(F.struct("run", "want", "most")).alias("key"))
    blocks = lambda rows: F.ceil(rows / BLOCK).cast("int")
    runs = runs.select("key.run", "key.want", F.col("key.most.component").alias("largest"), blocks(F.col("key.most.rows")).alias("others"), blocks(F.col("size") - F.col("key.most.rows")).alias("rest"))
    inside = F.pmod(F.hash("fp"), F.col("others"))
    block = F.when(F.col("component") == F.col("largest"), inside).otherwise(F.col("others") + F.pmod(F.hash("fp"), F.col("rest")))
    return grouped.join(runs, ["run", "want"]).withColumn("block", block).drop("largest")


def _near(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Of two blocks (sizes, groups, sketches) the places of pairs of different groups that sizes and sketches don't rule out, and the distances of their sketches."""
    size = min(min(map(len, x[2])), min(map(len, y[2])))
    s, t = folded(x[2], size).view(_U), folded(y[2], size).view(_U)
    step, found = max(1, (1 << 20) // t.size), []
    for k in range(0, len(s), step):
        n, group = x[0][k : k + step, None], x[1][k : k + step, None]
        i, j = np.nonzero((group != y[1]) & (4 * y[0] >= 3 * n) & (4 * n >= 3 * y[0]))
        for c in range(0, len(i), 8 * step + 1024):
            p, q = i[c : c + 8 * step + 1024] + k, j[c : c + 8 * step + 1024]
            apart = np.bitwise_count(s[p] ^ t[q]).sum(axis=1, dtype=np.int64)
            ok = apart <= (x[0][p] + y[0][q]) // 7
            found.append((p[ok], q[ok], apart[ok]))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def _crossing(rows: DataFrame, sets: DataFrame, all_pairs: bool) -> DataFrame:
    """Of open lists the pairs (a, b, na, nb, run, want, more) of a set that asks with one that is listed, of different groups, that sizes and sketches don't rule out. Where two blocks have many, unless ``all_pairs``, for each group only the pair of the nearest sketches, and ``more`` is true."""
    ranks = [F.xxhash64("run", "want", F.lit(k)) for k in range(ORDERS)]
    # The first list of each set in each order, among those it looks into and among those it is listed in. If that of an asking and of a listed set are the same, it holds both.
    least = [F.array(*[F.coalesce(F.min(F.when(F.col("asks") == asks, r)), F.lit(0)) for r in ranks]).alias(name) for name, asks in (("in_asked", True), ("in_listed", False))]
    about = sets.select("fp", "sketch").join(rows.groupBy("fp").agg(*least), "fp")
    rows = rows.join(about, "fp").withColumn("first", F.when(F.col("asks"), F.col("in_asked")).otherwise(F.col("in_listed")))
    cell, key = F.struct("fp", "n", "component", "sketch", "first"), ["run", "want", "others", "rest", "block"]
    asks = rows.filter("asks").groupBy(*key).agg(F.collect_list(cell).alias("x"))
    asks = asks.select("run", "want", "x", F.explode(F.expr("sequence(if(block < others, others, 0), others + rest - 1)")).alias("block"))
    listed = rows.filter("not asks").groupBy(*key).agg(F.collect_list(cell).alias("y")).select("run", "want", "block", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def arrays(cells: pa.Array) -> tuple[np.ndarray, np.ndarray, tuple]:
            fp, n, group = (cells.field(k).to_numpy() for k in range(3))
            first = cells.field(4).flatten().to_numpy().reshape(-1, ORDERS)
            return fp, first, (n, group, cells.field(3).to_pylist())

        for batch in batches:
            for i in range(batch.num_rows):
                (a, first_a, x), (b, first_b, y) = arrays(batch.column(2)[i].values), arrays(batch.column(3)[i].values)
                p, q, apart = _near(x, y)
                common = first_a[p] == first_b[q]
                order = common.argmax(axis=1)
                here = first_a[p, order] == np.array(batch.column(4)[i].as_py())[order]
                p, q, apart = (v[here | ~common.any(axis=1)] for v in (p, q, apart))
                more = not all_pairs and len(p) > PAIRS * (len(a) + len(b))
                if more:
                    order = np.lexsort((b[q], a[p], apart))
                    p, q = p[order], q[order]
                    kept = np.union1d(np.unique(x[1][p], return_index=True)[1], np.unique(y[1][q], return_index=True)[1])
                    p, q = p[kept], q[kept]
                if len(p):
                    same = [pa.array([v.as_py()] * len(p), kind) for v, kind in ((batch.column(0)[i], pa.int64()), (batch.column(1)[i], pa.int32()), (pa.scalar(more), pa.bool_()))]
                    yield pa.RecordBatch.from_arrays([pa.array(a[p]), pa.array(b[q]), pa.array(x[0][p]), pa.array(y[0][q]), *same], names=["a", "b", "na", "nb", "run", "want", "more"])

    both = asks.join(listed, ["run", "want", "block"]).select("run", "want", "x", "y", F.array(*ranks).alias("ranks"))
    return both.mapInArrow(run, "a long, b long, na long, nb long, run long, want int, more boolean")


def _in_order(pairs: DataFrame) -> DataFrame:
    swapped = F.col("a") > F.col("b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swapped, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(swapped, F.col("na")).otherwise(F.col("nb")).alias("nb")).distinct()


def near_duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", spread: float = SPREAD) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest id that links reach), and fp and group, numbers of its set and of the group of sets that links reach."""
    spark = docs.sparkSession
    scratch, least_files = Scratch(spark), spark.sparkContext.defaultParallelism
    write = scratch.write
    all_docs = write(profiles(docs, doc_id, text, spread), "profiles")
    known = all_docs.filter("n > 0 and doc_id is not null")
    rows, total = all_docs.agg(F.count(F.lit(1)), F.sum("n")).first()
    sets = known.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("units").alias("units"), F.first("sketch").alias("sketch"))
    sets = write(sets, "sets", rows / WIDE)
    copies = postings(docs, text, max(2 * partitions(docs), math.ceil(0.7 * (total or 0) / GROUP)), spread).groupBy("run", "fp")
    entries = write(copies.agg(*[F.first(c).alias(c) for c in ("kind", "own", "seg", "n", "units")]), "entries", max(least_files, (total or 0) / MANY))
    files = max(least_files, entries.count() / THIN)
    lists = write(counted(entries), "lists", files)
    scratch.drop("entries")
    asked = write(probes(lists), "asked", files)
    crowd = asked.groupBy("run", "want").agg(F.count(F.lit(1)).alias("size"), F.min("fp").alias("centre"))
    listed = lists.select("run", F.col("kind").alias("want"), F.col("fp").alias("b"), F.col("n").alias("nb"))
    seen = asked.join(crowd, ["run", "want"]).filter("size <= 2 or fp = centre").select("run", "want", F.col("fp").alias("a"), F.col("n").alias("na")).join(listed, ["run", "want"]).filter("a <> b")
    seen = write(_in_order(seen), "seen", files)
    # Lists that more than two sets look into: pairs that the centre has not brought into one group.
    crowded = crowd.filter("size > 2").select("run", "want")
    both = listed.select("run", "want", F.col("b").alias("fp"), F.col("nb").alias("n")).join(crowded, ["run", "want"]).withColumn("asks", F.lit(False))
    both = write(both.unionByName(asked.join(crowded, ["run", "want"]).withColumn("asks", F.lit(True))), "crowded", files)
    scratch.drop("lists", "asked")
    # A set may look into a list that it is no entry of, so those of crowded lists are needed besides the pairs seen.
    bare = sets.filter("units <= floor(2 * n / 7)").select("fp", "n", "rep")
    needed = seen.select(F.col("a").alias("fp")).union(seen.select("b")).union(both.select("fp")).union(bare.select("fp")).distinct().join(sets.select("fp", "rep"), "fp")
    needed = write(needed, "needed", rows / THIN)
    hashed = write(_hashes(docs, doc_id, text, needed), "hashes", max(least_files, needed.count() / FAT))
    if not bare.isEmpty():
        more = write(_in_order(_by_prefix(docs, text, bare.join(hashed, "fp"))), "by_prefix")
        others = more.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(hashed.select("fp"), "fp", "left_anti").join(sets.select("fp", "rep"), "fp")
        hashed = hashed.union(write(_hashes(docs, doc_id, text, write(others, "others")), "hashes_of_others"))
        seen = seen.union(more).distinct()

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        files = max(least_files, pairs.count() / FAT)
        pairs = write(_sketched(pairs.filter("4 * na >= 3 * nb and 4 * nb >= 3 * na"), sets), f"{name}_pairs", files)
        lost = pairs.select(F.explode(F.array("a", "b")).alias("fp")).join(hashed.select("fp"), "fp", "left_anti")
        if not lost.isEmpty():
            raise RuntimeError(f"pairs of {name} are to be verified on sets without hashes")
        return write(_verified(pairs, hashed), name, files)

    groups = components(scratch, verified(seen, "links"), "groups")
    scratch.drop("seen")
    for turn in range(ROUNDS + 1):
        open_ = write(_open_lists(both, groups), f"open{turn}", max(least_files, files))
        scratch.drop(f"open{turn - 1}" if turn else "crowded")
        files = open_.count() / THIN
        with setting(spark, BATCH, str(max(1, BLOCK // 16))):  # rows hold blocks
            cross = write(_crossing(open_, sets, all_pairs=turn == ROUNDS), f"cross{turn}", max(least_files, 10 * files))
        further = verified(write(_in_order(cross), f"further{turn}", files), f"links{turn}")
        if not further.isEmpty():
            groups = _merged(scratch, groups, further, f"groups{turn}")
        # Lists of which pairs were left out are looked at again.
        again = cross.filter("more").select("run", "want").distinct()
        if again.isEmpty():
            break
        both = open_.select("run", "want", "asks", "fp", "n").join(again, ["run", "want"])
    found = sets.join(groups.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("group"))
    least = found.groupBy("group").agg(F.min("rep").alias("component_id"))
    found = write(found.select("fp", "group").join(least, "group"), "found", rows / THIN)
    linked = F.col("n").isNotNull() & (F.col("n") > 0) & F.col("doc_id").isNotNull()
    out = all_docs.select("doc_id", "n", "fp").join(found, "fp", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "fp", F.when(linked, F.col("group")).alias("group"))
    out = checkpointed(out.coalesce(math.ceil(rows / THIN) or 1))
    scratch.drop()
    return out


def _hashes(docs: DataFrame, doc_id: str, text: str, needed: DataFrame) -> DataFrame:
    """(fp, hashes) of the needed sets (fp, rep), made again from the texts of their smallest ids."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("rep"), F.col(f"`{text}`").alias("text")).join(_sent(needed), "rep").select("fp", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, to, texts in chunks(batch.column(1), lower=True):
                hashes, at = shingle_sets(texts, WORDS)
                part = batch.slice(row, to - row)
                mine = pa.array(fingerprints(hashes, at).view(np.int64) == part.column(0).to_numpy())  # rows may share an id
                made = pa.array([hashes[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), made], names=["fp", "hashes"]).filter(mine)

    return rows.mapInArrow(run, "fp long, hashes binary").dropDuplicates(["fp"])
