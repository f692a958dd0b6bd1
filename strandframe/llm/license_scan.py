"""License scans: phrases, and an exact set-similarity join with license templates. DataFrame operations only.

Words are runs of letters, digits and characters beyond ASCII, with A-Z in lower case. Base labels come from
phrases whose words stand consecutively. The method's labels come from text blocks: windows of ``BLOCK`` words that
begin every half block, over the whole text. A template's label is given if a block holds at least the share
``CONTAINED`` of its distinct words. The join: words of the templates are ordered by the number of documents that
hold them, rarest first, over all documents; of a template with n words, k of which must be found, a block holds
one of the n - k + 1 first (prefix filter); a block has k distinct words at least (length filter); a template whose
first common word with the block stands at place p has n - p common words at most (positional filter). Candidates are
verified on the sets.

Defined results: null and empty texts have 0 words, no places and empty labels; documents with equal text are
scanned each; an empty table gives an empty one; other columns are passed on, and an input column with the
name of an output column is replaced. The score is 1 with a base label, else the highest containment of the
labels, else 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import ascii_lower, checkpointed

#: Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Sentences of public license notices, at most half a block long, and their labels.
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under the gnu general public license version", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl-2"),
    ("licensed under a creative commons attribution license", "cc-by"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("creative commons attribution noncommercial license", "cc-by-nc"),
    ("creative commons attribution sharealike license", "cc-by-sa"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("free and unencumbered software released into the public domain", "unlicense"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache-2"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-2"),
    ("provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("without any express or implied warranty in no event will the authors be held liable for any damages arising from the use", "zlib"),
    ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary", "unlicense"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0"),
    ("distributed under the boost software license version 1 0", "boost"),
    ("made available under the terms of the eclipse public license", "epl"),
]
BLOCK, CONTAINED = 48, 0.85
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same characters before A-Z are lower-cased.
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
MADE = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def frequencies(docs: DataFrame, text: str, words: list[str]) -> dict[str, int]:
    """In how many documents each of the words stands. One row for each word is gathered."""
    held = F.array_intersect(F.split(F.lower(F.col(f"`{text}`")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.array(*map(F.lit, words)))
    return {w: n for w, n in docs.select(F.explode(held).alias("w")).groupBy("w").count().collect()}


def prefix_table(templates: list[tuple[str, str]], seen: dict[str, int], share: float) -> list[tuple[str, int, int, int, int, list[str], str]]:
    """(word, template, place of the word, words, words needed, the words, label) for the words of each template's prefix."""
    out = []
    for t, (sentence, label) in enumerate(templates):
        words = sorted(set(sentence.split()), key=lambda w: (seen.get(w, 0), w))
        needed = math.ceil(share * len(words) - 1e-9)
        out += [(w, t, place, len(words), needed, words, label) for place, w in enumerate(words[: len(words) - needed + 1])]
    return out


def _starts(words: Column, phrase: list[str]) -> Column:
    """Where the words of a phrase stand consecutively."""
    at = lambda i, k: F.get(words, i + k) == phrase[k]

    def fits(i: Column) -> Column:
        out = at(i, 0)
        for k in range(1, len(phrase)):
            out = out & at(i, k)
        return F.coalesce(out, F.lit(False))

    places = F.when(F.size(words) >= len(phrase), F.sequence(F.lit(0), F.size(words) - len(phrase))).otherwise(F.array().cast("array<int>"))
    return F.filter(places, fits)


def scan_licenses(docs: DataFrame, text: str = "text", keep: list[str] | None = None, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, share: float = CONTAINED) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels and score. ``keep``: the columns to pass on, all if None."""
    phrases, templates = phrases or PHRASES, templates or TEMPLATES
    kept = [c for c in (docs.columns if keep is None else keep) if c not in MADE]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("\x00text"))
    vocabulary = sorted({w for sentence in (*phrases, *(t for t, _ in templates)) for w in sentence.split()})
    seen = frequencies(rows, "\x00text", vocabulary)
    prefixes = prefix_table(templates, seen, share)
    # A row without any of these words has neither a phrase nor a template in it.
    telling = sorted({p[0] for p in prefixes} | {min(x.split(), key=lambda w: (seen.get(w, 0), w)) for x in phrases})
    tells = F.col("\x00text").rlike(rf"(?i)(?<!{ANY_CASE})(?:{'|'.join(telling)})(?!{ANY_CASE})")
    no_place = F.lit(None).cast("long")
    plain = rows.filter(~tells).select(*[F.col(f"`{c}`") for c in kept], F.regexp_count("\x00text", F.lit(ANY_CASE + "+")).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_base"), no_place.alias("first_word"), no_place.alias("last_word"), F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score"))
    told = rows.filter(tells).withColumn("\x00words", F.regexp_extract_all(ascii_lower(F.col("\x00text")), F.lit(WORD), F.lit(0))).drop("\x00text").withColumn("\x00row", F.monotonically_increasing_id())
    told = checkpointed(told)
    words = F.col("\x00words")
    half = BLOCK // 2
    # Block b is of the words from b * half; the last one may be short. One shorter than half lies in the one before.
    numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(words) / half).cast("int") - 2, F.lit(0)))
    blocks = told.select("\x00row", words, F.explode(numbers).alias("b")).select("\x00row", F.array_distinct(F.slice("\x00words", F.col("b") * half + 1, BLOCK)).alias("held"), "b")
    first_words = F.array(*[F.lit(w) for w in sorted({p[0] for p in prefixes})])
    table = docs.sparkSession.createDataFrame(prefixes, "word string, template int, place int, n int, needed int, words array<string>, label string")
    # The table has a few rows for each template, and templates are a parameter: it is small at any input size.
    met = blocks.select("\x00row", "b", "held", F.explode(F.array_intersect("held", first_words)).alias("word")).join(F.broadcast(table), "word")
    met = met.filter((F.size("held") >= F.col("needed")) & (F.col("n") - F.col("place") >= F.col("needed")))
    met = met.groupBy("\x00row", "b", "template").agg(F.min("place").alias("place"), F.first("held").alias("held"), F.first("words").alias("words"), F.first("needed").alias("needed"), F.first("n").alias("n"), F.first("label").alias("label"))
    common = F.size(F.array_intersect("held", "words"))
    found = met.withColumn("common", common).filter("common >= needed").groupBy("\x00row").agg(F.collect_set("label").alias("\x00found"), F.max(F.col("common") / F.col("n")).alias("\x00contained"))
    for i, phrase in enumerate(phrases):
        told = told.withColumn(f"\x00at{i}", _starts(words, phrase.split()))
    places = F.concat(*[F.col(f"\x00at{i}") for i in range(len(phrases))])
    based = F.array_compact(F.array(*[F.when(F.size(f"\x00at{i}") > 0, F.lit(label)) for i, label in enumerate(phrases.values())]))
    told = told.join(found, "\x00row", "left").withColumn("\x00base", F.array_sort(F.array_distinct(based)))
    every = F.array_sort(F.array_union("\x00base", F.coalesce("\x00found", F.array().cast("array<string>"))))
    scored = told.select(*[F.col(f"`{c}`") for c in kept], F.size("\x00words").cast("long").alias("n_words"), F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"), F.array_join("\x00base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), F.when(F.size("\x00base") > 0, 1.0).otherwise(F.coalesce("\x00contained", F.lit(0.0))).alias("score"))
    return plain.unionByName(scored)


def oracle(phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, share: float = CONTAINED) -> str:
    """DuckDB SQL of the same: without filters, each block against each template."""
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    phrase_rows = ", ".join(f"({listed(p.split())}, '{label}')" for p, label in phrases.items())
    template_rows = ", ".join(f"({listed(sorted(set(t.split())))}, {math.ceil(share * len(set(t.split())) - 1e-9)}, '{label}')" for t, label in templates)
    return rf"""
WITH p(words, label) AS (VALUES {phrase_rows}), t(words, needed, label) AS (VALUES {template_rows}),
     d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
     h AS (SELECT doc_id, label, i FROM d, p, unnest(range(len(w))) AS u(i) WHERE w[i + 1] = p.words[1] AND w[i + 1 : i + len(p.words)] = p.words),
     b AS (SELECT doc_id, count(*) AS n, min(i) AS low, max(i) AS high, list(DISTINCT label) AS labels FROM h GROUP BY doc_id),
     k AS (SELECT doc_id, w[j * {BLOCK // 2} + 1 : j * {BLOCK // 2} + {BLOCK}] AS held FROM d, unnest(range(greatest(ceil(len(w) / {BLOCK // 2})::BIGINT - 1, 1))) AS u(j)),
     m AS (SELECT doc_id, label, len(list_intersect(list_distinct(held), t.words)) / len(t.words) AS part FROM k, t
           WHERE len(list_intersect(list_distinct(held), t.words)) >= t.needed),
     f AS (SELECT doc_id, list(DISTINCT label) AS labels, max(part) AS part FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.low::BIGINT AS first_word, b.high::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ','), '') AS labels,
       CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(f.part, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN f USING (doc_id)
"""
