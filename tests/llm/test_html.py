"""HTML scanning against a state machine, the second pass against a search in all directions, odd and hostile pages."""

import random
import time

import pytest

from strandframe.llm import html_extract as H

ALPHABET = ["<", ">", "/", "=", '"', "'", " ", "\n", "a", "p", "div", "b", "script", "title=", "<p>", "</p>", "<a href=x>", "</a>", "<!--", "-->", "<!x>", "&amp;", "é", "it's", "<script>", "</script>", "<button>", "</button >", "text ", "<svg/>", "<br/>"]


def visible(page):
    """All text outside tags, comments and silent elements, character by character, as the standard's tokenizer has it."""
    out, i, n = [], 0, len(page)
    space = " \t\n\r\f\v"
    while i < n:
        if page[i] != "<":
            out.append(page[i])
            i += 1
        elif page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            i = n if end < 0 else end + 3
        elif i + 1 < n and (page[i + 1].isascii() and page[i + 1].isalpha() or page[i + 1] == "/" and i + 2 < n and page[i + 2].isascii() and page[i + 2].isalpha()):
            ends = page[i + 1] == "/"
            k = i + 1 + ends
            begin = k
            while k < n and page[k] not in space + "/>":
                k += 1
            tag, closed = page[begin:k].lower(), False
            while k < n and page[k] != ">":
                if page[k] in space + "/" or page[k] == "=":
                    closed = page[k] == "/"
                    k += 1
                    continue
                closed = False
                while k < n and page[k] not in space + "/>=":
                    k += 1
                m = k
                while m < n and page[m] in space:
                    m += 1
                if m < n and page[m] == "=":
                    m += 1
                    while m < n and page[m] in space:
                        m += 1
                    if m < n and page[m] in "\"'":
                        end = page.find(page[m], m + 1)
                        if end >= 0:
                            k = end + 1
                    elif m < n and page[m] != ">":
                        while m < n and page[m] not in space + ">":
                            m += 1
                        k, closed = m, page[m - 1] == "/"
            i = min(n, k + 1)
            if tag in H.SILENT and tag != "head" and not ends and not (tag in ("svg", "math") and closed):
                rest, at = page.lower(), i
                while (at := rest.find(f"</{tag}", at)) >= 0 and not (at + 2 + len(tag) < n and page[at + 2 + len(tag)] in space + "/>"):
                    at += 1
                if at >= 0:
                    end = page.find(">", at)
                    i = n if end < 0 else end + 1
                elif tag in H.RAW:
                    i = n
        elif i + 1 < n and page[i + 1] in "!?/":
            end = page.find(">", i)
            i = n if end < 0 else end + 1
        else:
            out.append("<")
            i += 1
    return "".join(out)


@pytest.mark.parametrize("seed", range(20))
def test_scan_is_that_of_a_state_machine(seed):
    rng = random.Random(seed)
    for _ in range(300):
        page = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40)))
        got = "".join(b.text for b in H.blocks(page))
        assert "".join(got.split()) == "".join(visible(page).replace("&amp;", "&").split()), page


def slow_classify(found):
    """Looks for the nearest decided blocks by going through all."""
    first = [H._decide(b) for b in found]
    out = list(first)
    for i, b in enumerate(found):
        if first[i]:
            continue
        near = []
        for side in (range(i - 1, -1, -1), range(i + 1, len(found))):
            decided = [j for j in side if first[j] and not (found[j].kind == 1 and first[j] == -1)]
            own = [j for j in decided if found[j].section == b.section]
            near += [(found[j].section != b.section, abs(j - i), -first[j]) for j in (own or decided)[:1]]
        near.sort()
        inside = [-x[2] for x in near if not x[0]]
        if b.kind == 1:
            out[i] = inside[0] if inside else 1
        elif not near:
            out[i] = 1 if len(b.text) >= H.LENGTH_LOW else -1
        else:
            out[i] = 1 if all(x[2] == -1 for x in near) or inside and inside[0] == 1 else -1
    return out


@pytest.mark.parametrize("seed", range(10))
def test_second_pass_against_search(seed):
    rng = random.Random(seed)
    for _ in range(60):
        found = []
        for _ in range(rng.randint(0, 25)):
            text = " ".join(rng.choice(["the", "of", "word", "thing", "©" if rng.random() < 0.05 else "x"]) for _ in range(rng.choice([1, 5, 20, 80])))
            found.append(H.Block(text, rng.choice([0, 0, len(text)]), rng.randint(0, 3), rng.choice([-1, 0, 0, 1]), rng.random() < 0.3))
        want = slow_classify(found)
        H.classify(found)
        assert [b.label for b in found] == want


def test_markup_never_is_text():
    text = "This is the text of it and that of the whole of which it is said that it is a part of the others."
    page = f"<article><p title=it's>{text}</p><p><a href=x>A paragraph that is one link</a></p><div class=story-header>The head</div><ul class=links><li><a href=y>More of this</a></li></ul><p data-x='a>b' y=\"c'd>\">End.</p></article>"
    assert H.main_text(page) == f"{text} A paragraph that is one link The head End."
    assert H.main_text("<p>1 < 2 and 3 > 2") == "" and H.main_text("<article>1 < 2 and 3 > 2 <p title='open") == "1 < 2 and 3 > 2"


@pytest.mark.parametrize("part", ["<div>of the text</div><p>some more of it</p>", "<a '\"", '<a b="', "<button>", "<!--", "<div>", "</p>", "<p class ", "</x", "<a b='x'c=", "& &#38"])
def test_time_is_linear(part):
    took = []
    for size in (1 << 20, 1 << 22):
        page = part * (size // len(part))
        began = time.process_time()
        H.main_text(page)
        took.append(time.process_time() - began)
    assert took[1] < 12 and took[1] < 12 * max(took[0], 0.05)


def test_odd_tables(spark):
    rows = spark.createDataFrame([(1, "<article>a", "mine", 5), (1, "<article>a", "mine", 5), (None, None, None, None)], "page_id long, html string, text string, n_chars int")
    got = H.extract_main_text(rows)
    assert sorted(got.columns) == ["html", "n_chars", "page_id", "text"] and [r.text for r in got.orderBy(H.F.desc("page_id")).collect()] == ["a", "a", ""]
    assert H.extract_main_text(rows.limit(0)).collect() == []
