"""The automaton against edit distance; learning on a small fixture; odd inputs."""

import random
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from strandframe.llm import quality, textvec
from strandframe.llm import toxicity as X


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, last = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(row[j] + 1, last[j + 1] + 1, last[j] + (x != y)))
    return row[-1]


def test_automaton_is_edit_distance():
    rng = random.Random(2)
    terms = {t: False for t in ("abcd", "abcab", "bbbbbb", "cabacbaac")}
    lexicon = X.Lexicon(terms)
    for _ in range(4000):
        word = list(rng.choice(list(terms)))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(word) + 1)
            word[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "b", "z"])
        word = "".join(word)
        near = [distance(word, t) for t in terms if distance(word, t) <= X.edits(t)]
        assert lexicon.find(word) == (0 if not near else 1 if min(near) == 0 else 3), word


def test_stems_and_disguise():
    lexicon = X.Lexicon({"clown": False, "vequ": True})
    assert [lexicon.kind(w) for w in ("Clown!", "cl0wn", "clwn", "clooown", "crowns", "vequoir", "bvequ", "", "--")] == [1, 3, 3, 3, 0, 2, 0, 0, 0]


def test_parts_of_joined_words():
    lexicon = X.Lexicon({"clown": False, "idiot": False})
    assert [lexicon.kind(w) for w in ("xyz/clown", "Idiot's", "clown-like", "not-here", "clwn/xyz", "a_clown")] == [1, 1, 1, 0, 3, 1]
    scan = X.Scanner({"clown": False, "idiot": False})
    for _, _, texts in X.chunks(pa.array(["zzz/clown and (idiot's) 'so' be-it", "nothing to-see here..."])):
        assert (scan.evidence(texts)[:, 0] > 0).tolist() == [True, False]


def test_quotation_counts_less():
    abuse, quoted = "you are a clown and nothing else".split(), 'she was called a "clown" by a man'.split()
    assert X._context(abuse, 3) > 1 > X._context(quoted, 4)


def test_learns_and_scores_odd_inputs(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        words = ["".join(rng.choice("etaoin") for _ in range(rng.randint(2, 7))) for _ in range(60)]
        if i % 5 == 0:
            words[7] = words[31] = "clown"
        rows.append((i, " ".join(words), "en", 1.0))
        labels.append((i, int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    marks = spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")
    model = X.fit(docs, marks)
    assert "clown" in model.terms
    odd = spark.createDataFrame([(1001, None, "x", 0.0), (1002, "", "x", 0.0), (None, "you clown, you absolute clown", "x", 0.0), (1003, "a" * 200_000, "x", 0.0), (1003, "a" * 200_000, "x", 0.0)], docs.schema)
    got = X.score_toxicity(docs.union(odd), model)
    assert got.columns == ["doc_id", "text", "lang", "score"] and got.count() == 605
    held = got.join(marks, "doc_id").filter(X.held_out(F.col("doc_id"))).select((F.col("score") >= 0.3).cast("int").alias("p"), "toxic").collect()
    assert len(held) > 50 and all(r.p == r.toxic for r in held if r.toxic is not None)
    scores = {(r.doc_id, r.lang): r.score for r in got.filter("lang = 'x'").collect()}
    assert all((v >= 0.3) == (k[0] is None) for k, v in scores.items())


def test_families_are_copies(spark):
    """Unlike texts that share a term are no copies; near copies count once."""
    rng = random.Random(8)
    common = [f"word{k}" for k in range(60)]  # all texts hold the same words, each in an order of its own
    make = lambda: rng.sample(common, 60)
    rows, labels = [], []
    for i in range(600):
        words = make()
        if i % 5 == 0:
            words += ["clown", "clown"]
        if i % 25 == 0:
            words.insert(20, "disgusting")
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = X.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {"clown", "disgusting"} <= set(model.terms)
    copies = spark.createDataFrame([(1000 + i, f"{rows[1][1]} q{i}") for i in range(9)] + [(2000, None), (2001, "x")], docs.schema)
    drawn = dict(map(tuple, X._drawn(docs.filter("doc_id < 20").union(copies), "doc_id", "text").collect()))
    family = dict(zip(drawn, X._families(list(drawn.values())), strict=True))
    assert len(set(family.values())) == 22 and len({family[i] for i in (1, *range(1000, 1009))}) == 1


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    model = X.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert model.terms == {} and X.score_toxicity(docs, model).collect() == []


def test_workers_get_each_text_once(spark, monkeypatch):
    """Executors hold a batch of texts in the JVM and in Python: one copy each, also if the text is passed on."""
    docs = spark.createDataFrame([(1, "you clown, you", "x"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, lang string")
    sent, mapped = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, *a, **b: sent.append(self.columns) or mapped(self, *a, **b))
    model = X.Model({"clown": False}, X.PRIOR)
    scored, ruled = X.score_toxicity(docs, model, keep=["text", "doc_id"]), quality.quality_rules(docs, keep=["text", "doc_id"])
    assert [len(x) for x in sent] == [2, 2]
    assert scored.columns == ["text", "doc_id", "score"] and ruled.columns == ["text", "doc_id", *quality.COLUMNS, "base_failed", "kept"]
    whole = {r.doc_id: r for r in docs.collect()}
    alone = {r.doc_id: r.score for r in X.score_toxicity(docs, model, keep=["doc_id"]).collect()}
    assert all(r.text == whole[r.doc_id].text and r.score == alone[r.doc_id] for r in scored.collect())
    assert {r.doc_id: (r.text, r.n_words) for r in ruled.collect()} == {1: ("you clown, you", 3), 2: (None, 0), 3: ("", 0)}
    assert X.score_toxicity(docs, model).columns == [*docs.columns, "score"] and len(sent[-1]) == 3


def test_scans_in_little_memory(spark, monkeypatch):
    """What a worker needs beside its batch of texts doesn't grow with the batch, and is small beside an executor's share."""
    rng = random.Random(3)
    texts = pa.array([" ".join("".join(rng.choice("etaoinclw") for _ in range(rng.randint(2, 8))) for _ in range(400)) for _ in range(2000)])
    df = spark.createDataFrame([], "text string")
    runs, mapped = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: runs.append(run) or mapped(self, run, schema))
    X._features(df, {"clown": False, "idiot": False}, "text")
    quality.quality_rules(df, keep=[])
    textvec._powers.clear()
    for run in runs:
        tracemalloc.start()
        try:
            assert sum(x.num_rows for x in run(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]))) == len(texts)
            assert tracemalloc.get_traced_memory()[1] < 45e6
        finally:
            tracemalloc.stop()
    assert 0 < sum(x.nbytes for x in textvec._powers) < 1 << 24
