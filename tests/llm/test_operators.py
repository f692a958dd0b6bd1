"""Each operator on small tables against brute force, and on odd inputs: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import tiktoken

from strandframe.llm import bpe, chat, html_extract, jaccard, license_scan, mixing, quality, topk, toxicity, url_filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, source string, size long, kept string, ids string"


def odd_docs(spark):
    rng = random.Random(6)
    long = " ".join(str(rng.randint(0, 10**6)) for _ in range(30_000))
    texts = [None, "", " \n\t ", "one", "Ein Satz, zwei Sätze. Ünder the MIT License", "released under the MIT license.", long, long, "a b c d e " * 20, "x" * 50_000]
    rows = [(i, t, [None, "s", ""][i % 3], 7, "k", "i") for i, t in enumerate(texts)] + [(3, "one", "s", 7, "k", "i"), (None, "null id", "s", 7, "k", "i")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return odd_docs(spark).cache()


def test_bpe(spark, docs):
    enc = bpe.encoding(RANKS, P.PATTERN)
    coded = bpe.bpe_encode(docs, RANKS, P.PATTERN, decoded="decoded")
    rows = coded.collect()
    assert len(rows) == 12 and coded.columns.count("ids") == 1
    for r in rows:
        assert list(r.ids) == enc.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    again = bpe.bpe_decode(coded.drop("decoded"), RANKS, P.PATTERN).select("text", "decoded").collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in again)
    assert bpe.bpe_encode(docs.limit(0), RANKS, P.PATTERN).count() == 0
    assert isinstance(enc, tiktoken.Encoding)


def test_quality(docs):
    rows = quality.quality_rules(docs).collect()
    assert len(rows) == 12
    by = {r.doc_id: r for r in rows}
    assert by[0].n_words == 0 and by[0].base_failed and not by[0].kept
    assert by[8].n_repeat_words == 100 and by[8].longest_repeat == 95 and by[8].base_failed
    assert by[6].kept is True and quality.quality_rules(docs.limit(0)).collect() == []


def test_quality_method_rejects_what_the_base_rule_keeps(spark):
    words = [f"w{i}" for i in range(200)]
    passage = words[:15]
    short = [w for k in range(3) for w in words[10 * k : 10 * k + 5] + [f"x{k}"]]
    texts = [" ".join(words), " ".join(words + passage), " ".join(words + short)]
    rows = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [rows[i].n_repeat_words for i in range(3)] == [0, 30, 30] and not any(r.base_failed for r in rows.values())
    assert [rows[i].kept for i in range(3)] == [True, False, True]


def test_licenses(docs):
    rows = {(r.doc_id, r.text): r for r in license_scan.scan_licenses(docs).collect()}
    hit = next(r for k, r in rows.items() if k[0] == 5)
    assert (hit.n_words, hit.n_base, hit.first_word, hit.last_word, hit.base_labels, hit.labels, hit.score) == (5, 1, 1, 1, "mit", "mit", 1.0)
    miss = next(r for k, r in rows.items() if k[0] == 4)  # Ü is another letter than U
    assert (miss.n_base, miss.base_labels, miss.labels, miss.score) == (0, "", "", 0.0)
    assert next(r for k, r in rows.items() if k[0] == 0).n_words == 0


def test_license_join_is_exhaustive(spark):
    rng = random.Random(8)
    vocabulary = sorted({w for t, _ in license_scan.TEMPLATES for w in t.split()}) + ["x", "y"]
    rows = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 160))]
        sentence = rng.choice(license_scan.TEMPLATES)[0].split()
        rng.shuffle(sentence)
        at = rng.randint(0, len(words))
        rows.append((i, " ".join(words[:at] + sentence[rng.randint(0, 2) :] + words[at:])))
    got = {r.doc_id: r.labels for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        words, want = text.split(), set()
        for at in range(0, max(len(words) - 24, 1), 24):
            block = set(words[at : at + 48])
            want |= {label for t, label in license_scan.TEMPLATES if len(block & set(t.split())) >= 0.85 * len(set(t.split()))}
        joined = f" {text} "
        want |= {label for p, label in license_scan.PHRASES.items() if f" {p} " in joined}
        assert got[i] == ",".join(sorted(want))


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "b", "c", "d", None, "a", "a"])) for i in range(3000)] + [(5, "w w", "a"), (None, None, "z")]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 3002
    taken, target, source = Counter(), {}, {}
    for r in got:
        assert r.size == len(WORD.findall(r.text or "")) and r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        target[r.source], source[r.source] = r.target, r.source_size
    assert abs(sum(target.values()) - 1.5 * sum(source.values())) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 150 and target[s] <= 2 * source[s] for s in target)
    empty = mixing.mix_sources(spark.createDataFrame([], "doc_id long, text string, source string"))
    assert empty.collect() == []


def brute_top(vectors, k):
    out = {}
    for q, x in vectors:
        found = sorted((-sum(a * b for a, b in zip(x, y)), v) for v, y in vectors if v != q)[:k]
        out[q] = [(v, -s) for s, v in found]
    return out


def test_top_k(spark):
    rng = random.Random(9)
    vectors = [(i, [rng.randint(-2, 2) if rng.random() < 0.5 else 0 for _ in range(6)]) for i in range(120)]
    rows = [(i, [x / 256 + 0.001 for x in v], 1.0) for i, v in vectors] + [(500, None, 1.0), (501, [0.0, None], 1.0), (502, [float("nan")], 1.0), (None, [1.0], 1.0)]
    table = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double"), "vec_id", "embedding")
    got = defaultdict(list)
    for r in topk.top_k(table.filter("vec_id % 10 = 0"), table, 7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = brute_top(vectors, 7)
    assert dict(got) == {q: want[q] for q in range(0, 120, 10)}
    assert topk.top_k(table.limit(0), table).collect() == []
    twice = topk.top_k(table.filter("vec_id = 10").union(table.filter("vec_id = 10")), table, 7).collect()  # each row asks
    assert sorted((r["rank"], r.vec_id, r.score) for r in twice) == sorted((i + 1, *x) for i, x in enumerate(want[10]) for _ in range(2))
    huge = topk.quantised(spark.createDataFrame([(1, [3e300, 1.0]), (2, [2e300, 1.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    assert [(r.vec_id, r.score) for r in topk.top_k(huge.filter("vec_id = 1"), huge).orderBy("rank").collect()] == [(2, 2**63 - 1), (3, 256 * 256)]


def brute_groups(rows):
    sets = []
    for d, t in rows:
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}))
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            if a and len(a & sets[j][1]) * 100 >= 75 * len(a | sets[j][1]):
                group[find(i)] = find(j)
    least = defaultdict(lambda: 10**9)
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least[find(i)], d)
    return sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


def grouped(spark, rows, **options):
    got = jaccard.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"), **options)
    return sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()))


def near_copies(n, seed=4):
    rng, rows, base = random.Random(seed), [], []
    for i in range(n):
        if base and rng.random() < 0.6:
            words = list(rng.choice(base))
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                k = rng.randrange(len(words) + 1)
                words[k : k + rng.randint(0, 1)] = [str(rng.randint(0, 300))] * rng.randint(0, 2)
        else:
            words = [str(rng.randint(0, 300)) for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 7, 8, 10, 12, 20, 50, 100, 200]))]
            base.append(words)
        rows.append((i, " ".join(words + ([f"p{k}" for k in range(30)] if rng.random() < 0.3 else []))))
    return rows


def test_jaccard_groups(spark):
    rows = near_copies(350)
    rows += [(1000, None), (1001, ""), (3, rows[3][1]), (4, rows[7][1])]
    assert grouped(spark, rows) == brute_groups(rows)


def test_jaccard_without_spare_units(spark):
    """With so few segments that many sets have fewer units than differences, the prefix filter finds their partners."""
    rows = near_copies(300, 9)
    sizes = [len(set(zip(*[WORD.findall(t)[k:] for k in range(5)]))) for _, t in rows]
    assert any(n > 63 for n in sizes)
    assert grouped(spark, rows, spread=-20.0) == brute_groups(rows)


def test_jaccard_hot_list(spark, monkeypatch):
    """Thousands of near copies around the threshold, whose lists hold all of them: more than a block, and more pairs than are passed on at once."""
    rng = random.Random(11)
    base = [f"b{k}" for k in range(34)]
    rows = []
    for i in range(2600):
        words = list(base)
        for k in rng.sample(range(34), rng.choice([1, 1, 2])):
            words[k] = f"x{rng.randint(0, 9)}"
        rows.append((i, " ".join(words)))
    assert grouped(spark, rows) == brute_groups(rows)


def test_jaccard_keeps_groups_apart_that_share_an_id(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    got = jaccard.near_duplicate_groups(spark.createDataFrame([(1, a), (1, b), (2, a + " c"), (3, b + " c")], "doc_id long, text string")).collect()
    assert [r.component_id for r in got] == [1] * 4 and len({r.group for r in got}) == 2


def test_units_are_those_of_the_index():
    import numpy as np

    rng = np.random.default_rng(2)
    hashes = [np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)) for n in (1, 0, 5, 40, 63, 64, 300)]
    at = np.cumsum([0, *map(len, hashes)])
    units = np.zeros(len(hashes), int)
    for _, of, own, kind, seg in jaccard.index_entries(np.concatenate(hashes), at, 8.0):
        for o, k, s in zip(of[own], kind[own], seg[own], strict=True):
            units[o] += (k == jaccard.EXACT) * (1 + (s >= 0))
    assert jaccard.unit_counts(np.concatenate(hashes), at, 8.0).tolist() == units.tolist()


def test_jaccard_crowded_askers(spark):
    """Sets that look into a crowded list by a deletion, of which they are no entries: each is linked to the base only."""
    base = "one two three four five six seven"
    rows = [(0, base)] + [(i, f"{base} w{i}") for i in range(1, 301)]
    assert grouped(spark, rows) == brute_groups(rows)


def test_jaccard_odd(spark, docs):
    rows = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.near_duplicate_groups(docs).collect()}
    assert rows[(0, 0)] == 0 and rows[(7, 29996)] == 6 and rows[(None, 1)] is None
    assert jaccard.near_duplicate_groups(docs.limit(0)).collect() == []


def test_index_has_more_units_than_differences():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in [*range(1, 70), 100, 127, 128, 500, 3000]:
        hashes = np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        units = jaccard.unit_counts(hashes, np.array([0, n]), 8.0)
        assert units[0] > 2 * n // 7


def test_chat(spark):
    rng = random.Random(2)
    texts = ["hi", "", "[INST] x </s>", "back\\slash <<SYS>>", "ä[/ROLE]\\", "b"]
    rows = []
    for c in range(400):
        for t in range(rng.randint(1, 4)):
            rows.append((c, t, ["system", "user", "assistant", "tool"][min(t, 3)] if c % 2 else ["user", "assistant"][t % 2], rng.choice(texts) if t else "same start"))
    rows += [(900, None, None, None), (None, 1, "user", "x"), (901, 1, "assistant", "twice"), (901, 1, "assistant", "twice")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.formatted_digests(table, RANKS, P.PATTERN).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = sorted(turns)
        loss = "".join(x for _, role, x in turns if role == "assistant")
        r = got[c]
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == len("".join("".join(chat.parts(a, b)) for _, a, b in turns))
    packs = chat.format_packs(chat.paths(table), RANKS, P.PATTERN).collect()
    assert all(len(p.input_ids) == len(p.position_ids) for p in packs) and max(len(p.leaves) for p in packs) < 400
    for p in packs:
        for n in p.nodes:  # positions go on where the attended spans end
            assert n.position == sum(a.stop - a.start for a in n.attends) and list(p.position_ids[n.start : n.stop]) == list(range(n.position, n.position + n.stop - n.start))
    with pytest.raises(ValueError):
        chat.turns_of("[INST] open")
    assert chat.formatted_digests(table.limit(0), RANKS, P.PATTERN).collect() == []


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><a href="/">Home</a> site name</header><nav><ul><li><a href="/x">x</a></li></ul></nav><div class="cookie-notice">We use cookies and the like for you.</div>
<div class="ad">And buy this of that for the best.</div><article><h1>A  title</h1><p>The first <b>bold</b> paragraph of the text is long enough to be decided by what it holds and by its words.</p>
<p>Short one.<p>Fish &amp; chips&nbsp;&#233;. <a href="/y">A link</a> in the middle of the text that goes on for a while and on.</p><aside>Related</aside>
<section class="comments"><p>The reader says that this is the best of all the texts that there are on this site, and more.</p></section></article>
<form><label>Name</label><input></form><footer>&copy; 2020 of the site and the people</footer></body></html>"""


def test_html(spark):
    table = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (3, ""), (4, "<p>unclosed <b>" + "the word of " * 200), (5, "no markup at all, but the text of a page is here and it is as long as it has to be for the rule to keep it, or so it is said by all who have read the rules of this method to the end.")], "page_id long, html string")
    got = {r.page_id: r.text for r in html_extract.extract_main_text(table).collect()}
    assert got[1] == "A title The first bold paragraph of the text is long enough to be decided by what it holds and by its words. Short one. Fish & chips é. A link in the middle of the text that goes on for a while and on."
    assert got[2] == got[3] == "" and got[4].startswith("unclosed the word") and got[5].startswith("no markup")


def test_urls(spark):
    link = lambda h: f'<a href="http://{h}/p">x</a>'
    rows = [(1, "http://Good.org/a?x", link("friend.net") * 3), (2, "https://friend.net/", ""), (3, "http://x.com/de/1", ""), (4, "http://farm.net/a#/b", link("x.com")), (5, "http://x.com/fr/", ""), (6, None, None), (7, "nothing", "<"), (8, "http://a.example.org/es/1", ""), (9, "http://b.example.org/en/12", ""), (10, "http://example.org/en/2", ""), (11, "http://y.com/en?/de/", ""), (11, "http://y.com/en?/de/", "")]
    got = [r.asDict() for r in url_filters.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert len(got) == 12 and by[1] == ("good.org", "/a", "org/", "allow") and by[3] == ("x.com", "/de/1", "com/de/", "block") and by[5][2:] == ("com/fr/", "allow")
    assert by[6] == by[7] == ("", "", None, "allow") and by[8][2:] == ("example.org/es/", "block") and by[9][2:] == ("example.org/en/1", "block") and by[10][2:] == ("org/", "allow")
    assert by[2][3] == "allow" and by[4] == ("farm.net", "/a", None, "block") and by[11] == ("y.com", "/en", None, "allow")


def page_rank(edges, seeds):
    """Exactly, by solving for the scores."""
    import numpy as np

    hosts = sorted({h for e in edges for h in e} | set(seeds))
    at = {h: i for i, h in enumerate(hosts)}
    out = Counter()
    for (a, _), n in edges.items():
        out[a] += n
    m = np.eye(len(hosts))
    for (a, b), n in edges.items():
        m[at[b], at[a]] -= 0.85 * n / out[a]
    start = np.zeros(len(hosts))
    for h, w in seeds.items():
        start[at[h]] = 0.15 * w
    return dict(zip(hosts, np.linalg.solve(m, start), strict=True))


def test_propagation_is_page_rank(spark):
    rng = random.Random(1)
    edges = {(str(rng.randrange(12)), str(rng.randrange(12))): rng.randint(1, 4) for _ in range(40)}
    edges = {k: v for k, v in edges.items() if k[0] != k[1]} | {(f"c{i}", f"c{(i + 1) % 30}"): 1 for i in range(30)}
    table = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n long")
    seeds = {"1": 0.25, "2": 0.25, "c0": 0.5}
    got = {r.host: r.score for r in url_filters.propagated(table, spark.createDataFrame(list(seeds.items()), "host string, seed double"), 1e-4).collect()}
    want = page_rank(edges, seeds)
    assert sum(abs(got.get(h, 0) - s) for h, s in want.items()) <= 1e-4 and got["c25"] > 0


def test_verdicts_of_linked_hosts(spark):
    """Every page against rules, links and scores by brute force; the chain of hosts is longer than a dozen."""
    rng = random.Random(6)
    hosts = [f"h{i}.{'org' if i < 5 else 'net'}" for i in range(25)] + [f"k{i}.net" for i in range(20)] + ["bad.com"]
    rows = []
    for p in range(300):
        host = rng.choice(hosts[:25])
        to = [rng.choice(hosts[:25] + ["bad.com"]) for _ in range(rng.randint(0, 3))]
        rows.append((p, f"http://{host.upper() if p % 2 else host}/x{p}", "<a class=y href='http://%s/z'>" % "'></a><a href='https://".join(to) + "</a>" if to else "<link href='http://bad.com/'>"))
    rows += [(1000 + i, f"http://k{i}.net/", f'<a href="//k{i + 1}.net">' if i < 19 else '<a\nhref=http://bad.com/de/>') for i in range(20)]
    rows += [(2000 + i, "http://bad.com/de/" + str(i), "") for i in range(3)]
    edges, allowed, blocked = Counter(), Counter(), Counter()
    for _, url, html in rows:
        host = url.split("/")[2].lower()
        (allowed if host.endswith(".org") else blocked if host == "bad.com" else Counter())[host] += 1
        for to in re.findall(r"<a[^>]*href=['\"]?(?:https?:)?//([^/'\">]+)", html):
            if to != host:
                edges[host, to] += 1
    trust = page_rank(edges, {h: n / sum(allowed.values()) for h, n in allowed.items()})
    distrust = page_rank({(b, a): n for (a, b), n in edges.items()}, {h: n / sum(blocked.values()) for h, n in blocked.items()})
    got = url_filters.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and {r.verdict for r in got if r.rule is None} == {"allow", "block"}
    even, near = 0.15, 0.1 * 0.05 * 0.15
    for r in got:
        t, d = trust.get(r.host, 0), distrust.get(r.host, 0)
        assert abs(r.trust - t) <= near and abs(r.distrust - d) <= near
        if r.rule is None and min(abs(d - 1.5 * t), abs(d - 0.05 * even)) > 2.5 * near:
            assert r.verdict == ("block" if d > 1.5 * t and d > 0.05 * even else "allow"), r


def test_urls_odd_tables(spark):
    rows = spark.createDataFrame([(1, "http://a.org/", "<a href='http://b.net'>", "mine", 5)], "page_id long, url string, html string, host string, rows long")
    (r,) = url_filters.filter_urls(rows).collect()
    assert (r.host, r.rows, r.verdict) == ("a.org", 5, "allow")
    assert url_filters.filter_urls(rows.limit(0)).collect() == []


def brute_pipeline(rows, model):
    """What run() gives for rows (doc_id, text, lang, source, n_chars), without Spark."""
    lexicon = toxicity.Lexicon(model.terms)
    kept = []
    for row in rows:
        words, sums = WORD.findall(row[1] or ""), [0.0] * toxicity.KINDS
        for i, w in enumerate(words):
            if k := lexicon.kind(w):
                low = max(0, i - toxicity.WINDOW)
                sums[k - 1] += toxicity._context(words[low : i + toxicity.WINDOW + 1], i - low)
        found = [1 - math.exp(-x) for x in sums] + [min(1, x / (toxicity.DENSE * max(len(words), 50))) for x in sums]
        toxic = 1 / (1 + math.exp(-model.weights[0] - sum(w * x for w, x in zip(model.weights[1:], found, strict=True)))) >= 0.3
        if not toxic and good(words):
            kept.append(row)
    component = [(d, c) for d, _, c in brute_groups([(r[0], r[1]) for r in kept])]
    assert len({d for d, _ in component}) == len(kept)
    first = {d for d, c in component if d == c}
    kept = sorted((r for r in kept if r[0] in first), key=lambda r: (len(WORD.findall(r[1])), r[0]))
    size = Counter()
    for r in kept:
        size[r[3]] += len(WORD.findall(r[1]))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}
    target, free, left = {}, set(size), 1.5 * sum(size.values())
    while over := {s for s in free if weight[s] * left / sum(weight[x] for x in free) > 2 * size[s]}:
        target |= {s: 2 * size[s] for s in over}
        free -= over
        left = 1.5 * sum(size.values()) - sum(target.values())
    target |= {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
    enc, out, place = bpe.encoding(RANKS, P.PATTERN), Counter(), Counter()
    for r in kept:
        place[r[3]] += 1
        rate, offset = target[r[3]] / size[r[3]], int(hashlib.md5(f"s{r[3]}".encode()).hexdigest()[:8], 16) / 2**32
        copies = math.floor(place[r[3]] * rate + offset) - math.floor((place[r[3]] - 1) * rate + offset)
        if copies:
            ids = tuple(enc.encode_ordinary(r[1]))
            out[r[0], r[3], len(ids), ids] = copies
    return out


def good(w):
    n, longest = len(w), []
    for i in range(n):
        k = [0]
        for j in range(n):
            m = 0
            while i != j and i + m < n and j + m < n and w[i + m] == w[j + m]:
                m += 1
            k.append(m)
        longest.append(max(k))
    covered = lambda least: len({x for i, m in enumerate(longest) if m >= least for x in range(i, i + m)})
    return n >= 10 and 100 * covered(5) <= 20 * n and 100 * covered(quality.LONG) <= quality.MAX_LONG_PERCENT * n and max(longest) <= quality.MAX_LONGEST


def corpus(seed):
    rng = random.Random(seed)
    make = lambda n: " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(n))
    rows, labels = [], []
    for i in range(240):
        text = make(rng.randint(40, 120))
        if i % 6 == 0:
            text = "clown " + text + " you clown clown"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(i % 6 == 0)))
    for i in (1, 2, 3, 50, 51, 52):  # copies and near copies, a chain among them
        rows.append((300 + i, rows[i][1], "en", "s0", rows[i][4]))
        rows.append((400 + i, rows[i][1] + " " + make(6), "en", "s2", 0))
        rows.append((500 + i, rows[-1][1] + " " + make(6), "en", "s2", 0))
    part = make(15)
    rows += [(310, "again and again " * 30, "en", "s1", 1), (311, None, "en", None, 0), (312, f"{part} {make(120)} {part}", "de", "s1", 1), (313, make(9), "en", "s1", 1), (314, 'they said the word "clown" of ' + make(30), "en", "s1", 1)]
    return rows, labels


def written(spark, path, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows, labels = corpus(12)
    written(spark, tmp_path, rows, labels)
    tables = [spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels")]
    want = brute_pipeline(rows, toxicity.fit(*tables))
    assert any(n == 2 for n in want.values()) and 100 < len({k[0] for k in want}) < 215
    got = Counter((r.doc_id, r.source, r.n_tokens, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and len(corpus_pipeline.STAGES) == 5


def test_pipeline_odd_tables(spark, tmp_path):
    """No documents; no labels; rows that repeat an id, of which one is near another text and one is not."""
    import corpus_pipeline

    rows, _ = corpus(3)
    written(spark, f"{tmp_path}/none", [], [])
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    a, b, c = (r[1] for r in rows[1:4])
    rows = [(1, a, "en", "s", 1), (2, a + " more", "en", "s", 1), (2, b, "en", "s", 1), (2, b, "en", "s", 1), (3, b + " more", "en", "s", 1), (None, c, "en", "s", 1), (None, c, "en", "s", 1)]
    written(spark, f"{tmp_path}/some", rows, [])
    docs = spark.read.parquet(f"{tmp_path}/some/documents.parquet")
    kept = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert kept.columns == corpus_pipeline.COLUMNS
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == {(1, a): 1, (2, b): 1, (None, c): 2}
    assert corpus_pipeline.run(spark, f"{tmp_path}/some").count() == 6


def test_license_notices_of_any_case(spark):
    """Whole notices, spread over lines and set in capitals, among other text; odd tables."""
    rng = random.Random(4)
    other = lambda n: " ".join("".join(rng.choice("etaoins") for _ in range(5)) for _ in range(n))
    rows = []
    for i, (sentence, _) in enumerate(license_scan.TEMPLATES):
        words = sentence.upper().split() if i % 2 else sentence.split()
        rows.append((i, other(rng.randint(0, 90)) + ". " + "".join(w + rng.choice([" ", "\n * ", ", ", "-"]) for w in words) + other(rng.randint(0, 90)), "mine", 3.5))
    rows += [(100, other(500), "mine", 3.5), (100, other(500), None, None), (101, None, None, None)]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, labels string, score double")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (license_scan.TEMPLATES[r.doc_id][1] in r.labels.split(",")) if r.doc_id < 100 else (r.labels, r.n_base, r.score) == ("", 0, 0.0)
    assert license_scan.scan_licenses(spark.createDataFrame([], "doc_id long, text string, labels string")).collect() == []
