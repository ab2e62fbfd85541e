"""License scans with a positional index over rare licence words.

Templates (licence notices and short phrases) are indexed by word and position: an index of the two words of
each key phrase with the highest inverse document frequency over the corpus. A file looks up those of its
words that the index has, wherever they stand; the postings found are intersected by relative position, and
each alignment found is verified: the key phrase must stand there word for word, and enough of the whole
template around it must agree. A file's work follows the postings of its own words, not the number of
templates, which stand in the plan as one table. Built-in functions only.

A file that holds a key phrase holds its rarest words, so the choice of words by frequency decides the cost
and never the result. Defined results: a null text has no words; rows with equal id and text each
keep their result; ties of frequency go to the word that sorts first.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake.llm.common import let, texts

#: Words are separated by ASCII characters other than letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Least share of a template's words that must agree where its key phrase stands.
AGREES = 0.6


@dataclass(frozen=True)
class Template:
    """``key`` are the words start..start+len(key) of ``words``. ``base``: a phrase counted by place."""

    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_words(self) -> list[str]:
        return self.key.split()

    @property
    def start(self) -> int:
        w, k = self.words, self.key_words
        return next(i for i in range(len(w)) if w[i : i + len(k)] == k)


BASE = (
    Template("mit", "under the mit license", "under the mit license", True),
    Template("apache-2", "apache license version 2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", "cc by nc", True),
)
# Words of public licence notices.
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free of charge"),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "this file except in compliance with the license"),
    Template("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", "version 3 of the license"),
    Template("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", "version 2 of the license"),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms with or without modification"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
)
TEMPLATES = BASE + NOTICES


def words(text: Column) -> Column:
    """Lower-case words. ``lower`` also folds letters beyond ASCII, which neither moves a word's
    boundaries nor makes or breaks a word of a base phrase (none holds a k, whose Kelvin sign folds)."""
    return F.array_remove(F.split(F.lower(text), SEPARATORS), "")


def vocabulary(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for w in t.key_words})


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def document_frequencies(files: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text") -> dict[str, int]:
    """In how many texts each word of the key phrases occurs; as many counts as the templates have words."""
    low = files.select(F.split(F.lower(texts(files, text)), SEPARATORS).alias("w"))
    held = low.select(F.explode(F.array_intersect("w", _strings(vocabulary(templates)))).alias("word"))
    return {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}


def anchors(template: Template, df: dict[str, int]) -> list[tuple[str, int]]:
    """The rarest two distinct words of the key phrase and their places in it."""
    key = template.key_words
    rare = sorted(set(key), key=lambda w: (df.get(w, 0), w))[:2]
    return [(w, key.index(w)) for w in rare]


HITS = "array<struct<start:bigint,no:int,score:double>>"
INDEX = "map<string,array<struct<no:int,at:int>>>"
TABLE = "array<struct<key:array<string>,words:array<string>,before:int,anchors:int>>"


def index(templates: tuple[Template, ...], df: dict[str, int]) -> tuple[dict[str, list[dict[str, int]]], list[dict]]:
    """Postings (template number, place in its key phrase) by anchor word, and the templates as a table."""
    found: dict[str, list[dict[str, int]]] = {}
    for no, t in enumerate(templates):
        for w, at in anchors(t, df):
            found.setdefault(w, []).append({"no": no, "at": at})
    rows = [{"key": t.key_words, "words": t.words, "before": t.start, "anchors": len(anchors(t, df))} for t in templates]
    return found, rows


def _hits(ws: Column, postings: Column, table: Column, known: Column) -> Column:
    """The verified alignments of all templates in a list of words."""
    seen = F.filter(F.transform(ws, lambda w, p: F.struct(w.alias("w"), p.alias("p"))), lambda s: F.array_contains(known, s["w"]))
    laid = F.flatten(F.transform(seen, lambda s: F.transform(F.try_element_at(postings, s["w"]), lambda q: F.struct(q["no"].alias("no"), (s["p"] - q["at"]).alias("start")))))

    def met(cs: Column) -> Column:
        """Alignments that all anchors of their template ask for: each asks for one once."""
        return F.filter(cs, lambda c, k: (F.get(table, c["no"])["anchors"] == 1) | (F.get(cs, k + 1) == c))

    def scored(c: Column) -> Column:
        def of_template(t: Column) -> Column:
            start, before, whole = c["start"], t["before"], t["words"]
            head = F.slice(ws, F.greatest(start - before, F.lit(0)) + 1, F.least(start, before))
            tail = F.slice(ws, start + 1, F.size(whole) - before)
            expected = F.slice(whole, before - F.least(start, before) + 1, F.size(whole))
            agree = F.filter(F.zip_with(F.concat(head, tail), expected, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x)
            stands = F.slice(ws, start + 1, F.size(t["key"])) == t["key"]
            return F.struct(start.cast("long").alias("start"), c["no"].alias("no"), F.when(stands, F.size(agree) / F.size(whole)).alias("score"))

        return let(F.get(table, c["no"]), of_template)

    inside = F.filter(let(F.sort_array(F.coalesce(laid, F.array().cast("array<struct<no:int,start:int>>"))), met), lambda c: c["start"] >= 0)
    return F.filter(F.transform(inside, scored), lambda h: h["score"] >= AGREES)


def scan(files: DataFrame, templates: tuple[Template, ...] = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words and ``hits``: start (in words), template number and score of every alignment.

    A row makes its own hits, so no key, source or group of copies gathers anywhere; the corpus
    counts are the one shuffle. ``files`` is read twice.
    """
    found, rows = index(templates, document_frequencies(files, templates, text))
    known = _strings(sorted(found))
    postings, table = F.from_json(F.lit(json.dumps(found)), INDEX), F.from_json(F.lit(json.dumps(rows)), TABLE)
    split = files.select(F.col(doc_id).alias("doc_id"), words(texts(files, text)).alias("words"))
    none = F.array().cast(HITS)
    hits = F.when(F.arrays_overlap("words", known), let(F.col("words"), lambda ws: _hits(ws, postings, table, known)).cast(HITS)).otherwise(none)
    return split.select("doc_id", F.size("words").cast("long").alias("n_words"), hits.alias("hits"))


def labels(hits: Column, templates: tuple[Template, ...]) -> Column:
    """Distinct labels of some hits, sorted, comma-joined."""
    names = _strings([t.label for t in templates])
    return F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: F.get(names, h["no"])))), ",")
