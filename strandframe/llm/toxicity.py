"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows around their hits.

Fitting. The lexicon is learned from labelled rows, of which at most ``LABELS_MOST`` take part (those with the
smallest hash of their id, so a fixed choice). Words and word beginnings that nearly only toxic rows hold
are found by one distributed count over all of these; only they, and the words of toxic rows that begin with them, reach the driver; of these a greedy cover of the toxic rows keeps the few that explain
them. A term whose words are nearly always the term itself is a word, else a stem, which fits all words
that begin with it. A logistic model over three sums of evidence is then fitted on the same rows.

Scoring. The trie of the terms and the automaton that allows some edits run as one product automaton, made
deterministic state by state as words need it. Each hit counts as its context says: less inside quotation
marks or beside a word of reporting, more beside an address in the second person. The sums of evidence (exact
words, stems, misspelled words) give the score.

Defined results: null and empty texts have no hits and the score of the intercept; without labels, or without
toxic ones, nothing is learned and all texts get that score; labels that repeat an id count once, as toxic if
one of them is; rows of the input that repeat are scored each; an empty table gives an empty one. An input
column with the name of an output column is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandframe.llm.common import checkpointed
from strandframe.llm.textvec import SCANNED, Texts, chunks, mix, shingle_sets

#: The one bound of the fit: labelled rows. Which words are looked at and kept is a matter of evidence alone.
LABELS_MOST = 20_000
#: Shortest beginning of a word, and its least evidence: toxic rows that hold it, times the logarithm of its lift.
SHORTEST, EVIDENCE = 3, 8
#: Smallest hashes of a text's shingles (of so many words), and how many two texts have in common at least that are copies.
HASHES, SHINGLE, ALIKE = 32, 5, 16
#: How many times as frequent in toxic rows a term is at least: one that explains further rows, and another one.
LIFT, LIFT_AGAIN = 4, 10
#: Hits in a word of a text that is wholly abusive, about.
DENSE = 0.02
#: Words on either side of a hit that make its context.
WINDOW = 6
QUOTED, REPORTED, ADDRESSED = 0.25, 0.6, 1.3
#: Intercept; presence of exact words, stems and misspelled words; density of the same.
PRIOR = np.array([-4.0, 5.0, 1.5, 3.0, 2.0, 4.0, 2.0])
KINDS = 3
#: Characters that stand for letters, words of reporting, words of address.
LEET = str.maketrans("013457@$!", "oieastasi")
REPORTING = set("said says say called wrote word words term terms quote quoted quotes phrase insult insults slur dit mot terme sagte sagt wort begriff dijo palabra término".split())
ADDRESS = set("you your you're u ur vous tu toi votre du dich dein sie ihr tú usted eres".split())
_OPEN, _CLOSE = "\"“«„‘'`(", "\"”»“’'`)"
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[^\w$@]+|_+")
_RUNS = re.compile(r"(\w)\1{2,}")
_PUNCTUATION = ".,;:!?\"'()[]{}<>|*#&%$_-+=/\\“”„«»‘’`…"
#: Words and states that a worker remembers.
_CACHE, STATES_MOST = 400_000, 20_000


def edits(term: str) -> int:
    """How many edits a word may be away from the term."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


@dataclass
class Lexicon:
    """The product automaton. A term maps to whether it is a stem."""

    terms: dict[str, bool]
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: list[tuple[str, bool] | None] = field(default_factory=lambda: [None])
    reach: list[int] = field(default_factory=lambda: [0])  # the most edits that a term below allows

    def __post_init__(self) -> None:
        for term, stem in sorted(self.terms.items()):
            node, allowed = 0, 0 if stem else edits(term)
            self.reach[0] = max(self.reach[0], allowed)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], allowed)
            self.ends[node] = (term, stem)
        self.letters = {c for x in self.children for c in x}
        self._reset()

    def _reset(self) -> None:
        """Number 0 is the dead state, 1 the start; ``moves`` of a state by letter, and what it says of a word that ends there."""
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.says: list[int] = []
        self._number(frozenset())
        self._number(self._closed({(0, 0)}))

    def _number(self, state: frozenset) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            ends = [(e, self.ends[node]) for node, e in state if self.ends[node]]
            words = [e for e, (term, stem) in ends if not stem and e <= edits(term)]
            self.says.append(2 if any(stem and e == 0 for e, (_, stem) in ends) else 1 if 0 in words else 3 if words else 0)
        return self.numbers[state]

    def _closed(self, states: set[tuple[int, int]]) -> frozenset:
        """With letters of the terms left out at the cost of an edit each."""
        todo, out = list(states), set(states)
        while todo:
            node, e = todo.pop()
            for child in self.children[node].values():
                if e < self.reach[child] and (child, e + 1) not in out:
                    out.add((child, e + 1))
                    todo.append((child, e + 1))
        return frozenset(out)

    def _step(self, state: frozenset, c: str) -> frozenset:
        out = set()
        for node, e in state:
            if c in self.children[node]:
                out.add((self.children[node][c], e))
            if e < self.reach[node]:
                out.add((node, e + 1))
            for child in self.children[node].values():
                if e < self.reach[child]:
                    out.add((child, e + 1))
        return self._closed(out)

    def find(self, word: str) -> int:
        """0 no hit, 1 a word of the lexicon, 2 a stem, 3 a misspelled word."""
        at, moves, says = 1, self.moves, self.says
        for c in word:
            after = moves[at].get(c)
            if after is None:
                after = moves[at][c] = self._number(self._step(self.states[at], c)) if c in self.letters else self._other(at)
            if not after:
                return 0
            at = after
            if says[at] == 2:
                return 2
        return says[at]

    def _other(self, at: int) -> int:
        """After a character that no term has."""
        if "" not in self.moves[at]:
            self.moves[at][""] = self._number(self._step(self.states[at], ""))
        return self.moves[at][""]

    def kind(self, raw: str) -> int:
        word = raw.lower().strip(_PUNCTUATION)
        if len(word) < SHORTEST:
            return 0
        found = self.find(word)
        if not found and (_RUNS.search(word) or not word.isalpha() and any(c.isalpha() for c in word)):
            found = 3 if self.find(_RUNS.sub(r"\1", _EDGE.sub("", word).translate(LEET))) else 0
        if not found and len(parts := _INNER.split(word)) > 1:  # words joined by a stroke, or with an ending after an apostrophe
            found = min((k for k in map(self.find, parts) if k), default=0)
        return found


@lru_cache(maxsize=2)
def scanner(terms: tuple[tuple[str, bool], ...]) -> Scanner:
    """One for each worker process, so that what it has learned of words serves all its tasks."""
    return Scanner(dict(terms))


def _context(words: list[str], at: int) -> float:
    """What the window around a hit makes of it."""
    weight = 1.0
    before, after = words[max(0, at - WINDOW) : at + 1], words[at : at + WINDOW + 1]
    opened = next((x[0] for x in reversed(before) if x[0] in _OPEN), None)
    closed = any(x.rstrip(".,;:!?")[-1:] in _CLOSE for x in after if x.rstrip(".,;:!?"))
    shut = any(x.rstrip(".,;:!?")[-1:] in _CLOSE for x in before[:-1] if len(x) > 1) and before[-1][0] not in _OPEN
    near = {_EDGE.sub("", x.lower()) for x in (*before[:-1], *after[1:])}
    if opened and closed and not shut:
        weight *= QUOTED
    elif near & REPORTING:
        weight *= REPORTED
    if near & ADDRESS and weight >= REPORTED:
        weight *= ADDRESSED
    return weight


class Scanner:
    """Finds the hits of a lexicon in texts: all words of some texts take their steps through the automaton at once, until most of them are in its dead state; the others are looked at one by one."""

    def __init__(self, terms: dict[str, bool]) -> None:
        self.lexicon, self.known = Lexicon(terms), {}
        letters = sorted(self.lexicon.letters)
        # Numbers of characters: 0 punctuation, 1 letters that no term has, 2 others that need a closer look, then the letters.
        self.symbols = np.full(0x250, 2, np.int16)
        for code in range(0x250):
            low = chr(code).lower()
            if low.isalpha() and len(low) == 1:
                self.symbols[code] = letters.index(low) + 3 if low in self.lexicon.letters else 1
            elif chr(code) in _PUNCTUATION and chr(code) not in "$@":
                self.symbols[code] = 0
        self.letters = letters
        self.table = np.zeros((0, 0), np.int32)

    def _table(self) -> np.ndarray:
        """The automaton's moves as far as they are known, else -1; number 0 is dead and stays so."""
        n = len(self.lexicon.states)
        if len(self.table) < n:
            table = np.full((2 * n + 64, len(self.letters) + 3), -1, np.int32)
            table[: len(self.table)] = self.table if self.table.size else -1
            table[0] = 0
            self.table = table
        return self.table

    def _suspects(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words that don't end in the dead state, or need a closer look; characters of the texts; where words begin among them."""
        codes = np.frombuffer(texts.data.tobytes().decode(errors="replace").encode("utf-32-le"), np.uint32)
        places = np.concatenate(([0], np.cumsum((texts.data & 0xC0) != 0x80)))
        starts, ends = places[texts.starts], places[texts.ends]
        symbols = np.where(codes < 0x250, self.symbols[np.minimum(codes, 0x24F)], np.int16(2))
        runs = np.flatnonzero((codes[2:] == codes[1:-1]) & (codes[1:-1] == codes[:-2]) & (symbols[2:] != 0) & (codes[2:] > 32)) if len(codes) > 2 else np.zeros(0, np.int64)
        closer = [np.searchsorted(starts, runs, "right") - 1]
        at, words = starts.copy(), np.arange(len(starts))
        state = np.ones(len(words), np.int32)
        while True:  # leading punctuation
            lead = (at < ends) & (state == 1)
            lead[lead] = symbols[at[lead]] == 0
            if not lead.any():
                break
            at[lead] += 1
        stops = ends.copy()
        while True:  # and that at the end
            tail = stops > at
            tail[tail] = symbols[stops[tail] - 1] == 0
            if not tail.any():
                break
            stops[tail] -= 1
        inner = np.concatenate(([0], np.cumsum(symbols == 0)))
        closer.append(words[inner[np.maximum(stops, at)] > inner[at]])  # punctuation inside
        says = np.array(self.lexicon.says)
        while len(words):
            live = at < stops[words]
            if len(says) < len(self.lexicon.says):
                says = np.array(self.lexicon.says)
            closer.append(words[~live][says[state[~live]] > 0])
            words, at, state = words[live], at[live], state[live]
            symbol = symbols[at]
            look = (symbol == 2) | (symbol == 0)
            closer.append(words[look])
            words, at, state, symbol = words[~look], at[~look], state[~look], symbol[~look]
            if not len(words):
                break
            after = self._table()[state, symbol]
            if (after < 0).any():
                for pair in np.unique(state[after < 0].astype(np.int64) * 4096 + symbol[after < 0]).tolist():
                    s, c = divmod(pair, 4096)
                    moved = self.lexicon._number(self.lexicon._step(self.lexicon.states[s], self.letters[c - 3] if c > 2 else ""))
                    self._table()[s, c] = moved
                after = self._table()[state, symbol]
            if len(says) < len(self.lexicon.says):
                says = np.array(self.lexicon.says)
            stem = says[after] == 2
            closer.append(words[stem])
            live = (after != 0) & ~stem
            words, at, state = words[live], at[live] + 1, after[live]
        return np.unique(np.concatenate(closer)), starts, ends

    def evidence(self, texts: Texts) -> np.ndarray:
        """For each text the sums of evidence: exact words, stems, misspelled words."""
        out = np.zeros((len(texts), KINDS))
        if not self.lexicon.terms or not len(texts.starts):
            return out
        if len(self.lexicon.states) > STATES_MOST:
            self.lexicon._reset()
            self.table = np.zeros((0, 0), np.int32)
        if len(self.known) > _CACHE:
            self.known.clear()
        word = lambda i: texts.data[texts.starts[i] : texts.ends[i]].tobytes().decode(errors="replace")
        suspects, _, _ = self._suspects(texts)
        owners = np.searchsorted(texts.first, suspects, "right") - 1
        for i, owner in zip(suspects.tolist(), owners.tolist(), strict=True):
            raw = word(i)
            kind = self.known.get(raw)
            if kind is None:
                kind = self.known[raw] = self.lexicon.kind(raw)
            if kind:
                low, high = max(texts.first[owner], i - WINDOW), min(texts.first[owner + 1], i + WINDOW + 1)
                out[owner, kind - 1] += _context([word(j) for j in range(low, high)], i - low)
        return out


@dataclass
class Model:
    terms: dict[str, bool]
    weights: np.ndarray


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are for tests only."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _drawn(rows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, hashes): of each text the smallest value of each of ``HASHES`` hashes over its shingles."""
    salts = mix(np.arange(1, HASHES + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, to, texts in chunks(batch.column(1), lower=True):
                hashes, at = shingle_sets(texts, SHINGLE)
                some = np.diff(at) > 0
                least = np.full((len(some), HASHES), np.iinfo(np.uint64).max, np.uint64)
                if some.any():
                    for k in range(HASHES):
                        least[some, k] = np.minimum.reduceat(mix(hashes ^ salts[k]), at[:-1][some])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, to - row), pa.array([x.tobytes() for x in least], pa.binary())], names=["id", "hashes"])

    return rows.select(doc_id, text).mapInArrow(run, f"id {rows.schema[doc_id].dataType.simpleString()}, hashes binary")


def _families(drawn: list[bytes]) -> list[int]:
    """The family of each row: rows are copies of one text if they have ``ALIKE`` of their hashes in common."""
    hashes = np.frombuffer(b"".join(drawn), np.uint64).reshape(-1, HASHES)
    family = list(range(len(hashes)))

    def find(i: int) -> int:
        while family[i] != i:
            family[i] = i = family[family[i]]
        return i

    for k in range(0, HASHES, 2):
        alike: dict[bytes, list[int]] = defaultdict(list)  # of rows that share two hashes, one for each family so far
        for i in range(len(hashes)):
            held = alike[hashes[i, k : k + 2].tobytes()]
            for j in held:
                if find(i) == find(j) or (hashes[i] == hashes[j]).sum() >= ALIKE:
                    family[find(i)] = find(j)
                    break
            else:
                held.append(i)
    return [find(i) for i in range(len(hashes))]


def _cover(beginnings: list[tuple[str, float, float]], rows: list[list[str]], family: list[int]) -> dict[str, bool]:
    """Of the beginnings (with their lifts) those that explain the toxic rows, given by their words and families."""
    lift = dict(beginnings)
    holds: dict[str, set[int]] = defaultdict(set)
    words: dict[str, Counter] = defaultdict(Counter)
    for i, row in enumerate(rows):
        for w in row:
            for n in range(SHORTEST, len(w) + 1):
                if w[:n] in lift:
                    holds[w[:n]].add(i)
                    words[w[:n]][w] += 1
    families = len(set(family))  # copies of one text share its rare words by chance: they count once
    terms: dict[str, bool] = {}
    left = set(range(len(rows)))
    for best in sorted(holds, key=lambda b: (len(holds[b]) * math.log(lift[b]), len(b), b), reverse=True):
        gained = holds[best]
        known = len({family[i] for i in gained})
        explains = 10 * len(gained & left) >= 3 * len(gained)
        if known < (max(3, families // 200) if explains else 8) or not explains and lift[best] < LIFT_AGAIN:
            continue
        terms[best] = words[best][best] < 0.9 * sum(words[best].values())
        left -= gained
        for n in range(SHORTEST, len(best)):  # what is left of its own beginnings is chance
            holds[best[:n]] = set()
        for b in holds:
            if b.startswith(best) and b != best:
                holds[b] = holds[b] - gained
    return terms


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = LABELS_MOST) -> Model:
    """Learns from the labels of rows that aren't held out. The joined side is at most ``most`` rows of (id, label)."""
    key = F.col(f"`{doc_id}`")
    chosen = labels.filter(key.isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(key.alias("\x00id")).agg(F.max((F.col(label) != 0).cast("int")).alias("\x00y")).orderBy(F.xxhash64("\x00id"), "\x00id").limit(most)
    rows = docs.select(key.alias("\x00id"), F.col(f"`{text}`").alias("\x00text")).join(F.broadcast(chosen), "\x00id")
    words = rows.select("\x00id", "\x00y", F.explode(F.array_distinct(F.split(F.lower("\x00text"), r"[^\p{L}\p{N}]+"))).alias("w")).filter(F.length("w").between(SHORTEST, 40))
    counts = words.groupBy("w").agg(F.sum("\x00y").alias("yes"), F.sum(1 - F.col("\x00y")).alias("no"))
    totals = chosen.agg(F.sum("\x00y"), F.count("\x00y")).first()
    yes, n = totals[0] or 0, totals[1]
    if not yes or yes == n:
        return Model({}, PRIOR.copy())
    beginnings = counts.select(F.explode(F.sequence(F.lit(SHORTEST), F.length("w"))).alias("l"), "w", "yes", "no").groupBy(F.substring("w", F.lit(1), F.col("l")).alias("b")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    lift = F.col("yes") / yes / ((F.col("no") + 0.5) / (n - yes))
    beginnings = beginnings.withColumn("lift", lift).filter((F.col("yes") * F.log("lift") >= EVIDENCE) & (F.col("lift") >= LIFT)).select("b", "lift")
    beginnings = checkpointed(beginnings)
    begin = words.filter("`\x00y` = 1").withColumn("b", F.explode(F.expr(f"transform(sequence({SHORTEST}, length(w)), l -> substring(w, 1, l))"))).join(beginnings, "b", "left_semi")
    suspects = begin.groupBy("\x00id").agg(F.collect_set("w").alias("ws")).select("\x00id", "ws").collect()
    beginnings = sorted(map(tuple, beginnings.collect()))
    if not beginnings:
        return Model({}, PRIOR.copy())
    drawn = dict(map(tuple, _drawn(rows.filter("`\x00y` = 1"), "\x00id", "\x00text").collect()))
    held = [(sorted(ws), drawn[i]) for i, ws in suspects]
    terms = _cover(beginnings, [ws for ws, _ in held], _families([x for _, x in held]))
    found = [f"\x00f{k}" for k in range(2 * KINDS)]
    seen = _features(rows.select("\x00y", "\x00text"), terms, "\x00text").groupBy("\x00y", *[F.round(F.col(f) * 16).alias(f) for f in found]).count().collect()
    x = np.array([[1.0, *(v / 16 for v in r[1:-1])] for r in seen])
    y, weight = np.array([r[0] for r in seen], float), np.array([r[-1] for r in seen], float)
    order = np.lexsort((*x.T, y))
    return Model(terms, _logistic(x[order], y[order], weight[order]))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton's method, drawn to the prior; few rows change little."""
    w = PRIOR.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (weight * (p - y)) + (w - PRIOR)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w = w - np.linalg.solve(curve, slope)
    return np.append(min(w[0], 0), np.maximum(w[1:], 0))


def _features(df: DataFrame, terms: dict[str, bool], text: str, passed: bool = False) -> DataFrame:
    """The other columns, and of ``text`` the features of the model, each from 0 to 1: presence and density of each kind of hit. ``passed``: with the text itself, which goes to the workers once."""
    kept = [c for c in df.columns if c != text]
    sent = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`"))
    n = len(kept) + passed
    schema = T.StructType(sent.schema.fields[:n] + [T.StructField(f"\x00f{k}", T.DoubleType()) for k in range(2 * KINDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(tuple(sorted(terms.items())))
        for batch in batches:
            for row, to, texts in chunks(batch.column(batch.num_columns - 1), SCANNED):
                found = scan.evidence(texts)
                dense = found / (DENSE * np.maximum(np.diff(texts.first), 50))[:, None]
                found = np.hstack((1 - np.exp(-found), np.minimum(1, dense)))
                out = [batch.column(i).slice(row, to - row) for i in range(n)]
                yield pa.RecordBatch.from_arrays(out + [pa.array(np.ascontiguousarray(found[:, k])) for k in range(2 * KINDS)], names=schema.names)

    return sent.mapInArrow(run, schema)


def score_toxicity(df: DataFrame, model: Model, text: str = "text", score: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Adds ``score`` (0 to 1, higher: toxic likelier) of each whole text. ``keep``: the columns to pass on, all if None."""
    kept = [c for c in (df.columns if keep is None else keep) if c != score]
    found = _features(df.select(*[F.col(f"`{c}`") for c in kept if c != text], F.col(f"`{text}`").alias("\x00text")), model.terms, "\x00text", text in kept)
    total = F.lit(float(model.weights[0]))
    for k in range(2 * KINDS):
        total = total + F.col(f"\x00f{k}") * float(model.weights[k + 1])
    return found.select(*[F.col("\x00text" if c == text else f"`{c}`").alias(c) for c in kept], (1 / (1 + F.exp(-total))).alias(score))
