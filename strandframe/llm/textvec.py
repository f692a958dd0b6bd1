"""Words, lines and shingles of whole Arrow batches as numpy arrays, without a Python loop over words."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are hashed at once. Each worker keeps tables of twice that many numbers, two of them.
_STEP = 1 << 18
#: Bytes of texts that an operator looks at at once, where it needs some 40 times as much for that.
SCANNED = 1 << 19
_P = 0x9E3779B97F4A7C15
_BYTES = np.random.RandomState(7).randint(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def release() -> None:
    """Gives unused memory back, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, 2 * _STEP)
        _powers[:] = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, p, np.uint64)))) for p in (np.uint64(_P), np.uint64(pow(_P, -1, 1 << 64)))]
    return _powers


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte segment; segments follow each other and don't overlap."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        a = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, a + _STEP, "right")))
        b = int(ends[to - 1])
        up, down = _power_tables(b - a)
        prefix = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTES[data[a:b]] * up[: b - a], out=prefix[1:])
        s, e = starts[at:to] - a, ends[at:to] - a
        out[at:to] = mix((prefix[e] - prefix[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return out


@dataclass
class Texts:
    """Some whole texts: their bytes end to end, ``offsets`` between them, and their words."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray  # of each word, in bytes
    ends: np.ndarray
    first: np.ndarray  # number of the first word of each text, and at the end the number of words

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self)), np.diff(self.first))

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def split_words(data: np.ndarray, offsets: np.ndarray) -> Texts:
    """Words are the runs of bytes other than space and 0x09-0x0D; a word ends with its text."""
    solid = ~_SPACE[data]
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    stops[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] = solid[inner]
    stops[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Texts(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def chunks(column: pa.Array | pa.ChunkedArray, most: int = 2 << 20, lower: bool = False) -> Iterator[tuple[int, int, Texts]]:
    """(first row, row after the last, texts) for runs of rows of about ``most`` bytes; one longer text is a run of its own. Null counts as empty."""
    column = pc.fill_null(column, "")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, offsets, data = column.cast(pa.large_string()).buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        part = data[offsets[row] : offsets[to]]
        yield row, to, split_words(_LOWER[part] if lower else part, offsets[row : to + 1] - offsets[row])
        row = to
    release()


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words; entry i is of words i to i + size - 1."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(_P) + words[k : k + n]
    return mix(out)


def shingle_sets(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted distinct shingles of each text; with fewer words the whole sequence is one; none without words."""
    words, counts = segment_hashes(texts.data, texts.starts, texts.ends), np.diff(texts.first)
    hashes = window_hashes(words, size)
    whole = np.ones(len(hashes), bool)  # not across two texts
    for k in range(1, size):
        cut = texts.first[1:-1] - k
        whole[cut[(cut >= 0) & (cut < len(hashes))]] = False
    owner = texts.owner()[: len(hashes)]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            extra[has] = extra[has] * np.uint64(_P) + words[texts.first[short[has]] + k]
        extra = mix(extra ^ mix(counts[short].astype(np.uint64)))
        hashes, owner = np.concatenate((hashes[whole], extra)), np.concatenate((owner[whole], short))
    else:
        hashes, owner = hashes[whole], owner[whole]
    order = np.lexsort((hashes, owner)) if len(short) else _sorted_within(hashes, owner, len(texts))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(texts) + 1))


def _sorted_within(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    by_hash = np.argsort(hashes)
    return by_hash[np.argsort(owner[by_hash].astype(np.uint16 if n < 1 << 16 else np.int64), kind="stable")]
