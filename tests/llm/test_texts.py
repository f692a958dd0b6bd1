"""Word vectors, repetition, shingles and BPE against brute force."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from strandframe.llm import bpe, quality, textvec

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_measures(t):
    w = WORD.findall(t)
    n = len(w)
    c = Counter(tuple(w[i : i + 5]) for i in range(n - 4))
    again = {k for i in range(n - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    covered, best = set(), 0
    for i in range(n):
        longest = 0
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and w[i + k] == w[j + k]:
                k += 1
            longest = max(longest, k)
        if longest >= 5:
            covered |= set(range(i, i + longest))
            best = max(best, longest)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return [n, sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(again), len(covered), best]


def random_texts(rng):
    out = []
    for _ in range(rng.randint(0, 12)):
        letters = "aébc#"[: rng.choice([1, 2, 3])] if rng.random() < 0.8 else "abcdefghÉZ"
        text = "".join(rng.choice(letters) + rng.choice([" ", "\n", "\t", "", " "]) for _ in range(rng.randint(0, 60)))
        out.append(rng.choice([None, "", "x"]) if rng.random() < 0.2 else text)
    return out


@pytest.mark.parametrize("seed", range(40))
def test_measures_and_shingles(seed):
    rng = random.Random(seed)
    texts = random_texts(rng)
    column, got = pa.array(texts, pa.string()), []
    for _, _, part in textvec.chunks(column, most=rng.choice([10, 1000])):
        got += map(list, zip(*[x.tolist() for x in quality.measures(part)], strict=True))
    assert got == [brute_measures(t or "") for t in texts]
    sizes, sets = [], []
    for _, _, part in textvec.chunks(column, lower=True):
        hashes, at = textvec.shingle_sets(part, 5)
        sets += [set(hashes[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
        sizes += np.diff(at).tolist()
    want = []
    for t in texts:
        w = WORD.findall("".join(x.lower() if x.isascii() else x for x in t or ""))
        want.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()})
    assert sizes == [len(x) for x in want]
    assert all(len(sets[i] & sets[j]) == len(want[i] & want[j]) for i in range(len(texts)) for j in range(len(texts)))


def test_bpe_cuts_change_nothing():
    enc = bpe.encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    rng = random.Random(3)
    mixed = "".join(rng.choice("ab é\n\t\x1c\x85　!1") for _ in range(200_000))
    for text in ["", "a b" * 50_000, " " * 9000 + "b", "x" + "\n" * 9000 + " b", "é" * 100_000 + " " * 5000, "a" + " " * 5000 + "'s b" + "\t" * 7000, mixed]:
        assert bpe.encode(enc, text) == enc.encode_ordinary(text)
    long = "a" + " " * 1_000_000 + "b c"  # too long a run for the library's own expressions
    assert enc.decode_bytes(bpe.encode(enc, long)) == long.encode()
