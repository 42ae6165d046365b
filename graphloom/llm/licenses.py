"""License scans through a positional rare-token index (native: DataFrame functions only).

Each template is a licence text with a mandatory key phrase. The index is over the templates: from a word to the
templates and places where it stands. Inverse document frequencies of the templates' words are taken over all documents.
Of each file, its licence words of highest inverse document frequency (each template's rarest word that its phrase can't
lack) are looked up in the index; each posting proposes a place where the template would begin. Postings are intersected
by relative position: enough of the template's rare words must stand where the template has them. Then the key phrase is
verified word for word. All of this is one narrow pass over the documents; nothing but document frequencies is shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: So many of a template's rarest words are intersected, and so many of them must stand in their places.
RARE, NEEDED = 4, 2


@dataclass(frozen=True)
class Template:
    """``key``: the phrase of ``text`` that must stand in full; all of the text, if it isn't given."""

    label: str
    text: str
    key: str = ""
    base: bool = False

    def words(self) -> list[str]:
        return self.text.split()

    def key_words(self) -> list[str]:
        return (self.key or self.text).split()

    def key_at(self) -> int:
        w, k = self.words(), self.key_words()
        return next(i for i in range(len(w)) if w[i : i + len(k)] == k)


# The base phrases and their labels.
BASE = (
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
)
# Templates of this operator's own: sentences of public licence texts and their mandatory phrases.
MORE = (
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    Template("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "shall be included in all copies"),
    Template("apache-2.0", "apache license version 2 0"),
    Template("apache-text", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "you may not use this file except in compliance"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("bsd-notice", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "must retain the above copyright notice"),
    Template("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "under the terms of the gnu general public license"),
    Template("gpl-warranty", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "distributed in the hope that it will be useful"),
    Template("mpl", "mozilla public license"),
    Template("mpl-text", "this source code form is subject to the terms of the mozilla public license v 2 0", "subject to the terms of the mozilla public license"),
    Template("lgpl", "lesser general public license"),
    Template("agpl", "affero general public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "released into the public domain"),
    Template("cc", "creative commons attribution"),
    Template("spdx", "spdx license identifier"),
    Template("licensed-under", "licensed under the"),
    Template("warranty", "the software is provided as is without warranty of any kind express or implied", "without warranty of any kind"),
)
TEMPLATES = BASE + MORE


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for t in templates for w in t.words()})


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _SEPARATORS, -1), lambda w: w != "")


def frequencies(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """Inverse document frequency of each word of the templates over all documents: ln((N + 1) / (df + 1)) + 1."""
    vocab = vocabulary()
    found = docs.select(F.array_intersect(words_of(F.col(text_col)), F.array(*[F.lit(w) for w in vocab])).alias("w"))
    # every document counts for the empty word, which no text holds; so at most one row for each word, and one more
    rows = found.select(F.explode(F.concat("w", F.array(F.lit("")))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    df = {r["w"]: r["df"] for r in rows.collect()}
    return {w: math.log((df.get("", 0) + 1) / (df.get(w, 0) + 1)) + 1 for w in vocab}


def _lookup(idf: dict[str, float]) -> tuple[dict[str, list[tuple[int, int]]], list[list[tuple[str, int]]]]:
    """The index, and the rare words of each template with their places.

    The index holds for each word that is looked up the postings (template, place). That word is the rarest of the key
    phrase, so no file with the phrase can lack it.
    """
    postings: dict[str, list[tuple[int, int]]] = {}
    rare = []
    for t, template in enumerate(TEMPLATES):
        w, first, key = template.words(), template.key_at(), template.key_words()
        anchor = min(range(first, first + len(key)), key=lambda k: (-idf[w[k]], k))
        postings.setdefault(w[anchor], []).append((t, anchor))
        rare.append([(w[k], k) for k in sorted(range(len(w)), key=lambda k: (-idf[w[k]], k))[:RARE]])
    return postings, rare


def license_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and ``places`` of each document: (template, start) in the order of TEMPLATES, and idf sums.

    ``start`` is the word at which the template would begin; below 0 if the text begins inside the template.
    """
    idf = frequencies(docs, text_col)
    postings, rare = _lookup(idf)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    looked = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("pos"))), lambda h: h["word"].isin(*postings))
    rows = rows.select("doc_id", "words", looked.alias("looked"))

    def of_template(t: int) -> Column:
        """(template, start) of one template: postings of its looked-up word, intersected, then verified."""
        template = TEMPLATES[t]
        word, anchor = next((w, at) for w, ps in postings.items() for p, at in ps if p == t)
        first, key = template.key_at(), template.key_words()
        at = lambda start, k: F.get(F.col("words"), start + F.lit(k))
        start_of = F.transform(F.filter("looked", lambda h: h["word"] == word), lambda h: h["pos"] - anchor)

        def holds(start: Column) -> Column:
            near = reduce(lambda a, b: a + b, [F.coalesce((at(start, k) == w).cast("int"), F.lit(0)) for w, k in rare[t]])
            phrase = reduce(lambda a, b: a & b, [F.coalesce(at(start, first + k) == w, F.lit(False)) for k, w in enumerate(key)])
            return (near >= min(NEEDED, len(rare[t]))) & phrase

        return F.transform(F.filter(start_of, holds), lambda s: F.struct(F.lit(t).alias("t"), s.alias("start")))

    places = F.when(F.size("looked") == 0, F.array().cast("array<struct<t:int,start:int>>")).otherwise(F.concat(*[of_template(t) for t in range(len(TEMPLATES))]))
    weights = F.array(*[F.lit(float(sum(idf[w] for w, _ in r))) for r in rare])
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), places.alias("places"), weights.alias("weights"))


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: the base places and labels, all labels and a score.

    The score is 1 - exp(-w / 10), where w sums the inverse document frequencies of the rare words of all places,
    rounded to six digits; 0 without a place. Null texts count as empty; null ids and repeated rows are kept; an empty
    table gives an empty result; other columns, whatever their names, are ignored. Texts of any length are scanned
    whole; the work on a text is in proportion to its length.
    """
    places, n_base = F.col("places"), len(BASE)
    base = F.filter(places, lambda p: p["t"] < n_base)
    label = F.array(*[F.lit(t.label) for t in TEMPLATES])
    joined = lambda ps: F.array_join(F.array_sort(F.array_distinct(F.transform(ps, lambda p: F.get(label, p["t"])))), ",")
    weight = F.aggregate(F.transform(places, lambda p: F.get(F.col("weights"), p["t"])), F.lit(0.0), lambda a, x: a + x)
    return license_places(docs, id_col, text_col).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda p: p["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda p: p["start"])).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(places).alias("labels"),
        F.round(1 - F.exp(-weight / 10), 6).alias("score"),
    )
