"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides each block by stop-word density, length
and link density, with the evidence of the elements around it (an article's or a menu's); blocks that are
too short or too middling stay open. The second pass gives each open block the label of its nearest decided
neighbours, of which those in the same section come first: good if both or the nearer one is good.

Defined results: a null or empty page has the empty text; repeated rows give repeated rows; an empty table
gives an empty one. Whole pages are read, whatever their length; broken markup is read as far as it goes.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most of a block that links may be, outside an article and inside.
LINK_MOST, LINK_ARTICLE = 0.35, 0.8
LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.12, 0.22
#: Inside an article less is asked for.
STOP_ARTICLE = 0.05

#: Elements that end a block, that hold no text of the page, that frame it, and that mark the article.
BLOCK = set("address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
SILENT = "script style noscript template svg math iframe object canvas audio video textarea select button title head".split()
FRAME = set("nav aside footer form menu dialog".split())
ARTICLE = set("article main".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Words in a class, id or role that tell a frame or an article.
FRAME_WORDS = set("ad ads adv advert adverts advertisement advertising adbox adsense banner breadcrumb breadcrumbs byline comment comments commentlist consent contentinfo cookie cookies copyright complementary disclaimer disqus footer gdpr header hidden legal login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination paginator paywall popup privacy promo promoted promotion recommended related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets alert".split())
ARTICLE_WORDS = set("article articlebody content entry main maintext post story text".split())
#: Frequent short words of the languages that are read, without accents as well.
STOP_WORDS = set(
    "a about after all also an and any are as at be been but by can could did do does for from had has have he her his how i if in into is it its more no not of on one or other our out she so some than that the their them then there these they this to up was we were what when which who will with would you your "
    "au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais ne nous ont ou où par pas plus pour qu que qui sa sans se ses son sont sur un une vous à été être "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer eines er es für hat ich ihr im in ist kann mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wie wir wird zu zum zur "
    "al como con de del el ella en entre era es esta este fue ha hay la las le lo los más mi muy no o para pero por que se ser si sin sobre son su sus también un una y ya él está".split()
)
#: Silent elements whose content is no markup: without an end they last to that of the page.
RAW = set("script style iframe textarea title noscript".split())
#: Elements that items of a list of links stand in.
ITEM = set("li dd dt td th option".split())
#: Attributes up to the end of their tag. A quote opens a value only after an equals sign. No part is read twice.
_ATTRIBUTES = r"""(?>[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?>"[^"]*"|'[^']*'|[^\s>"'][^\s>]*+))?+|=)*+"""
_TOKEN = re.compile(rf"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})(?:>|\Z)|[!?/][^>]*+(?:>|\Z))", re.S)
_END = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for x in SILENT}
_NAME = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=>/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"\w+")


@dataclass(slots=True)
class Block:
    text: str
    linked: int  # characters in links
    section: int  # number of the framing or article element that it lies in
    kind: int  # of that element: 1 an article, -1 a frame, 0 neither
    item: bool  # it is an item of a list
    label: int = 0  # 1 good, -1 bad, 0 open


def _kind(tag: str, attributes: str, now: int) -> int:
    """What an element makes of its content: 1, -1, or 0 if it says nothing."""
    if tag in FRAME or tag == "header" and now != 1:
        return -1
    if attributes:
        if _HIDDEN.search(attributes):
            return -1
        words: set[str] = set()
        for name, *value in _NAME.findall(attributes):
            for word in re.split(r"[\s_\-:]+", "".join(value)):
                words.add(word.lower())
                words.update(x.lower() for x in _PART.findall(word))
        if now == 1:  # the head of an article is its own
            words.discard("header")
        if tag not in ("html", "body", "article", "main") and tag not in ("h1", "h2", "p") and words & FRAME_WORDS and not (tag == "header" and now == 1):
            return -1
        if words & FRAME_WORDS and tag == "p":
            return -1
        if words & ARTICLE_WORDS and now == 0 and tag in ("div", "section", "td"):
            return 1
    return 1 if tag in ARTICLE and now != -1 else 0


def blocks(page: str) -> list[Block]:
    """Each part of the page is looked at once, however its tags are closed or nested."""
    out: list[Block] = []
    text: list[str] = []
    open_elements: list[tuple[str, int, int]] = []  # tag, section and kind outside it
    opened: Counter = Counter()  # how often each tag is among them
    endless: set[str] = set()  # silent elements that have no end from here on
    section, kind, sections, link, linked, at, items = 0, 0, 0, 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            out.append(Block(joined, linked, section, kind, items > 0))
        text.clear()
        linked = 0

    def say(x: str) -> None:
        nonlocal linked
        if x:
            text.append(x)
            if link:
                linked += len(x.strip())

    while token := _TOKEN.search(page, at):
        say(page[at : token.start()])
        at = token.end()
        tag, ends = (token[2] or "").lower(), bool(token[1])
        if not tag:
            continue
        if tag in BLOCK:
            flush()
        if tag in _END and tag != "head":
            if not ends and tag not in endless and not (tag in ("svg", "math") and token[3].endswith("/")):
                if end := _END[tag].search(page, at):
                    at = end.end()
                elif tag in RAW:
                    at = len(page)
                else:
                    endless.add(tag)
            continue
        if tag == "a":
            link = 0 if ends else 1
        if ends:
            if opened[tag]:
                while True:
                    name, *outside = open_elements.pop()
                    opened[name] -= 1
                    items -= name in ITEM
                    if name == tag:
                        break
                if outside != [section, kind]:
                    flush()
                    section, kind = outside
        elif tag not in VOID and not token[3].endswith("/") and (tag in BLOCK and tag != "p" or tag in ("span", "p")):
            if tag == "p" and open_elements and open_elements[-1][0] == "p":  # a paragraph ends where the next begins
                section, kind = open_elements.pop()[1:]
                opened["p"] -= 1
            open_elements.append((tag, section, kind))
            opened[tag] += 1
            items += tag in ITEM
            told = -1 if tag == "head" else _kind(tag, token[3], kind)
            if told and not (kind == -1 and told == 1):
                if told != kind:
                    flush()
                sections += 1
                section, kind = sections, told
    say(page[at:])
    flush()
    return out


def _decide(b: Block) -> int:
    """The first pass: 1 good, -1 bad, 0 open."""
    words = _WORD.findall(b.text.lower())
    stop = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    links = b.linked / max(1, len(b.text))
    if b.kind == 1:
        if links > LINK_ARTICLE:  # a list of links is none of the article's text, a paragraph that is a link may be
            return -1 if b.item else 0
        return 1 if len(b.text) >= LENGTH_LOW and stop >= STOP_ARTICLE or len(b.text) >= LENGTH_HIGH else 0
    if b.kind == -1 or links > LINK_MOST or "©" in b.text:
        return -1
    if len(b.text) < LENGTH_LOW:
        return -1 if links else 0
    if stop >= STOP_HIGH and len(b.text) >= LENGTH_HIGH:
        return 1
    return -1 if stop < STOP_LOW else 0


def _nearest(found: list[Block], places: range) -> list[int | None]:
    """For each block the last decided one before it in the order of ``places``: of its own section if there is one. Lists of links inside an article say nothing of their neighbours."""
    out: list[int | None] = [None] * len(found)
    last, of_section = None, {}
    for i in places:
        out[i] = of_section.get(found[i].section, last)
        if found[i].label and (found[i].kind, found[i].label) != (1, -1):
            last = of_section[found[i].section] = i
    return out


def classify(found: list[Block]) -> None:
    for b in found:
        b.label = _decide(b)
    sides = _nearest(found, range(len(found))), _nearest(found, range(len(found) - 1, -1, -1))
    labels = [b.label for b in found]
    for i, b in enumerate(found):
        if labels[i]:
            continue
        near = sorted((found[j].section != b.section, abs(j - i), -labels[j]) for j in (sides[0][i], sides[1][i]) if j is not None)
        inside = near and not near[0][0]
        if b.kind == 1:  # only the article's own blocks speak; alone, it is the article
            b.label = -near[0][2] if inside else 1
        elif not near:  # a page without decided blocks: its longer ones are its text
            b.label = 1 if len(b.text) >= LENGTH_LOW else -1
        else:
            b.label = 1 if all(x[2] == -1 for x in near) or inside and near[0][2] == -1 else -1


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    classify(found)
    return " ".join(b.text for b in found if b.label == 1)


def extract_main_text(df: DataFrame, source: str = "html", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``text``: the main text of the whole page in ``source``. ``keep``: the other columns to pass on, all if None; an input column named as ``text`` is replaced."""
    kept = [c for c in (df.columns if keep is None else keep) if c != text]
    pages = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{source}`").alias("\x00page"))
    schema = T.StructType([pages.schema[c] for c in kept] + [T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = [part.column(i) for i in range(part.num_columns - 1)]
                out.append(pa.array([main_text(x.as_py()) for x in part.column(part.num_columns - 1)], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return pages.mapInArrow(run, schema)
