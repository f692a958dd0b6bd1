"""Quality rules: word, symbol, line and window counts, and a limit on repetition found by a suffix array.

Repetition: the suffixes of each text that begin with a repeated window of ``WINDOW`` words are sorted by
prefix doubling (the others have no repeat that long). The longest-common-prefix of neighbours in that order
gives, at each place, the longest substring (in words) that begins there and occurs elsewhere in the text:
the spans of all maximal repeated substrings. The verdict limits the covered fraction of the words, and the
longest repeat, of the union of these spans; and, as all repeats of ``WINDOW`` words or more cover just the words
that the window rule counts, the fraction covered by those of at least ``LONG`` words, which it doesn't see.

Defined results: null and empty texts have no words, all counts 0, and fail; ties and repeated rows are
judged row by row; an empty table gives an empty one. Whole texts are judged, whatever their length. The
columns asked for are passed on, and an input column with the name of an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandframe.llm.textvec import SCANNED, Texts, chunks, mix, segment_hashes, window_hashes

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: The method's limits: share of the words inside repeats, and words in the longest one.
MAX_COVERED = 0.30
MAX_LONGEST = 400
#: Words of a long repeat, and the share of the words that may lie inside such ones.
LONG, MAX_LONG_PERCENT = 10, 10
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat"]


def repeats(words: np.ndarray, first: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(places of words at which a repeated substring of at least ``window`` words begins, length of the longest such one there).

    ``words``: hashes of the words of some texts, end to end; ``first``: where each text begins. Repeats are
    sought within a text only.
    """
    none = np.zeros(0, np.int64)
    n = len(words)
    if n < window:
        return none, none
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    words = mix(words ^ mix(owner.astype(np.uint64) + np.uint64(1)))  # words of different texts differ
    keys = window_hashes(words, window)
    end = first[1:][owner]
    inside = np.arange(len(keys)) + window <= end[: len(keys)]
    at = np.flatnonzero(inside)
    at = at[np.argsort(keys[at], kind="stable")]
    again = np.zeros(len(at), bool)
    again[1:] = keys[at][1:] == keys[at][:-1]
    suffixes = at[again | np.append(again[1:], False)]
    if not len(suffixes):
        return none, none
    # Repeats lie within these windows, and end at the word after at the latest: only these places are ranked.
    near = _covered(n, suffixes, np.minimum(window + 1, end[suffixes] - suffixes))
    active = np.flatnonzero(near)
    levels: list[tuple[int, np.ndarray]] = []
    first_rank, second, step = np.zeros(len(active), np.int64), words[active], 0
    while len(active):
        order = np.lexsort((second, first_rank))
        active, second, first_rank = active[order], second[order], first_rank[order]
        group = np.ones(len(active), bool)
        group[1:] = first_rank[1:] != first_rank[:-1]
        split = group.copy()
        split[1:] |= second[1:] != second[:-1]
        places = np.arange(len(active))
        rank = levels[-1][1].copy() if levels else np.full(n + 1, -1, np.int64)
        rank[active] = first_rank + np.maximum.accumulate(np.where(split, places, 0)) - np.maximum.accumulate(np.where(group, places, 0))
        step = 2 * step or 1
        levels.append((step, rank))
        active = active[~(split & np.append(split[1:], True))]
        first_rank, second = rank[active], np.where(active + step < end[active], rank[np.minimum(active + step, n)], -1)
        second = np.where(second < 0, -1 - active, second)  # its text or the ranked places end: like no other suffix
    suffixes = suffixes[np.argsort(levels[-1][1][suffixes], kind="stable")]
    a, b = suffixes[:-1], suffixes[1:]
    common = np.zeros(len(a), np.int64)
    for length, ranks in reversed(levels):
        x, y = np.minimum(a + common, n), np.minimum(b + common, n)
        same = (ranks[x] == ranks[y]) & (ranks[x] >= 0) & (x + length <= end[a]) & (y + length <= end[b])
        common += np.where(same, length, 0)
    a, b, common = (z[common >= window] for z in (a, b, common))
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    found = np.flatnonzero(longest)
    return found, longest[found]


def _covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of n words lie in a span."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def _count(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]


def _duplicate_lines(texts: Texts) -> np.ndarray:
    data, offsets = texts.data, texts.offsets
    out = np.zeros(len(texts), np.int64)
    if not len(data):
        return out
    inner = offsets[1:-1]
    starts = np.unique(np.concatenate(([0], np.flatnonzero(data == 10) + 1, inner)))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    ends = ends - (data[ends - 1] == 10)
    worded = np.searchsorted(texts.starts, ends) > np.searchsorted(texts.starts, starts)
    starts, ends = starts[worded], ends[worded]
    if len(starts):
        owner = np.searchsorted(offsets, starts, "right") - 1
        hashes = segment_hashes(data, starts, ends)
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        again = owner[1:][(hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])]
        out += np.bincount(again, minlength=len(texts))
    return out


def measures(texts: Texts, window: int = WINDOW) -> list[np.ndarray]:
    """The figures of COLUMNS for each text."""
    return _measures(texts, window)[:-1]


def _measures(texts: Texts, window: int = WINDOW) -> list[np.ndarray]:
    """The figures of COLUMNS, and the words inside repeats of at least ``LONG`` words."""
    data, n = texts.data, len(texts.starts)
    letters = (data & 0xC0) != 0x80
    symbols = np.isin(data, np.frombuffer(SYMBOLS.encode(), np.uint8))
    solid = letters & (data != 32) & ~((data >= 9) & (data <= 13))
    words = segment_hashes(data, texts.starts, texts.ends)
    found, lengths = repeats(words, texts.first, window)
    in_windows = _covered(n, found, np.full(len(found), window))
    covered = _covered(n, found, lengths)
    in_long = _covered(n, found[lengths >= LONG], lengths[lengths >= LONG])
    longest = np.zeros(len(texts), np.int64)
    if len(found):
        np.maximum.at(longest, np.searchsorted(texts.first, found, "right") - 1, lengths)
    return [np.diff(texts.first), texts.per_text(solid), texts.per_text(symbols), _duplicate_lines(texts), _count(in_windows, texts.first), _count(covered, texts.first), longest, _count(in_long, texts.first)]


def quality_rules(df: DataFrame, text: str = "text", keep: list[str] | None = None, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """Adds the figures of COLUMNS (long), ``base_failed`` and ``kept`` (boolean) for each whole text. ``keep``: the columns to pass on, all if None."""
    made = [*COLUMNS, "base_failed", "kept"]
    kept = [c for c in (df.columns if keep is None else keep) if c not in made]
    # The text goes to the workers once, also if it is passed on.
    source = df.select(*[F.col(f"`{c}`") for c in kept if c != text], F.col(f"`{text}`").alias("\x00text"))
    n_kept = len(source.columns) - (text not in kept)
    schema = T.StructType(source.schema.fields[:n_kept] + [T.StructField(c, T.LongType()) for c in [*COLUMNS, "\x00long"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, to, texts in chunks(batch.column(batch.num_columns - 1), SCANNED):
                out = [batch.column(i).slice(row, to - row) for i in range(n_kept)]
                yield pa.RecordBatch.from_arrays(out + [pa.array(x.astype(np.int64)) for x in _measures(texts)], names=schema.names)

    n, again = F.col("n_words"), F.col("n_repeat_words")
    failed = (n < MIN_WORDS) | (100 * again > MAX_REPEAT_PERCENT * n)
    limited = (F.col("n_covered_words") <= F.lit(max_covered) * n) & (F.col("longest_repeat") <= max_longest) & (100 * F.col("\x00long") <= MAX_LONG_PERCENT * n)
    passed = [F.col("\x00text" if c == text else f"`{c}`").alias(c) for c in kept]
    return source.mapInArrow(run, schema).select(*passed, *COLUMNS, failed.alias("base_failed"), (~failed & limited).alias("kept"))
