"""License scans: an exact set-similarity join of text blocks with license templates.

Tokens are ordered by their frequency in all documents, rare ones first. Of a
template with n tokens, of which a block must hold o = ceil(THRESHOLD * n), only
the n - o + 1 rarest are indexed: a block that holds none of them can't reach o.
Then the length filter (a block with fewer than o known tokens is out) and the
positional filter (what is left of both after the first shared token must suffice)
leave the pairs that are verified. For a template of n words, the blocks are all
runs of n + n * ``SLACK`` words of the whole text, whatever lines and paragraphs
they span, so that a notice is found however it is wrapped, with some words put
between. Only runs that begin at a template's token and hold one of its indexed
tokens are looked at: no other can hold more.

Besides, three phrases are found wherever their words stand consecutively.

Plan: one scan for the frequencies of the templates' own tokens (a bounded list,
partial sums a task), one scan for the join, no shuffle of text; the templates
and their index go to the tasks with the function.

Defined cases: a null text is empty, with no words and null places; repeated rows
and null ids are kept; very long texts are taken whole, a document at a time; a text
shorter than a run is one run; an empty table gives an empty one. Only doc_id and
text are read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspan.llm.common import table, to_batches

THRESHOLD, SLACK = 0.8, 0.25
PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "dedicated to the public domain under the CC0 1.0 Universal dedication"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
]
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased; maximal runs of ASCII letters, digits and anything beyond ASCII."""
    return _WORD.findall((text or "").encode().lower())


def vocabulary(templates: list[tuple[str, str]] = TEMPLATES) -> set[bytes]:
    return {w for _, t in templates for w in words(t)}


def frequencies(documents: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> dict[bytes, int]:
    """In how many documents each token of the templates stands."""
    known = vocabulary(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                found.update(known.intersection(words(text.as_py())))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["token", "n"])

    rows = documents.select(F.col("text").cast("string")).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["token"]): r["n"] for r in rows}


class Index:
    """The templates' prefixes under the global order of tokens."""

    def __init__(self, seen: dict[bytes, int], templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> None:
        self.place = {w: i for i, w in enumerate(sorted(vocabulary(templates), key=lambda w: (seen.get(w, 0), w)))}
        self.labels = [label for label, _ in templates]
        self.tokens = [sorted({self.place[w] for w in words(t)}) for _, t in templates]
        self.sets = [frozenset(t) for t in self.tokens]
        self.least = [math.ceil(threshold * len(t) - 1e-9) for t in self.tokens]
        self.widths = [n + int(n * SLACK) for n in (len(words(t)) for _, t in templates)]
        self.postings: dict[int, list[int]] = {}
        self.prefixes: list[dict[int, int]] = []
        for k, (own, least) in enumerate(zip(self.tokens, self.least)):
            self.prefixes.append({token: i for i, token in enumerate(own[: len(own) - least + 1])})
            for token in self.prefixes[k]:
                self.postings.setdefault(token, []).append(k)
        self.starters = {w for w, i in self.place.items() if i in self.postings}

    def held(self, k: int, block: list[int]) -> int:
        """How many tokens of template k a block of sorted tokens holds, or 0 where a filter rules out enough."""
        if len(block) < self.least[k]:
            return 0
        j, i = next(((j, self.prefixes[k][token]) for j, token in enumerate(block) if token in self.prefixes[k]), (0, -1))
        if i < 0 or 1 + min(len(self.tokens[k]) - i - 1, len(block) - j - 1) < self.least[k]:
            return 0
        return len(self.sets[k].intersection(block))

    def matches(self, found: list[bytes]) -> Iterator[tuple[int, float]]:
        """Each template that a run of the words holds to the threshold, with the highest share."""
        known = [(at, self.place[w]) for at, w in enumerate(found) if w in self.place]
        ats = [at for at, _ in known]
        present = {token for _, token in known}
        indexed: dict[int, list[int]] = {}
        for at, token in known:
            for k in self.postings.get(token, ()):
                indexed.setdefault(k, []).append(at)
        for k, anchors in indexed.items():
            if len(self.sets[k] & present) < self.least[k]:
                continue
            most = following = 0
            for n, (at, token) in enumerate(known):
                if token not in self.sets[k]:
                    continue
                while following < len(anchors) and anchors[following] < at:
                    following += 1
                if following == len(anchors):
                    break
                if anchors[following] < at + self.widths[k]:
                    run = known[n : bisect_left(ats, at + self.widths[k], n)]
                    most = max(most, self.held(k, sorted({t for _, t in run})))
            if most >= self.least[k]:
                yield k, most / len(self.tokens[k])


def phrases(found: list[bytes], present: set[bytes]) -> list[tuple[int, str]]:
    """(place, label) of every phrase, in order of the phrases."""
    out = []
    for phrase, label in PHRASES.items():
        own = [w.encode() for w in phrase]
        if not all(w in present for w in own):
            continue
        at = -1
        while True:
            try:
                at = found.index(own[0], at + 1)
            except ValueError:
                break
            if found[at : at + len(own)] == own:
                out.append((at, label))
    return out


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def scan(documents: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document: its words, phrases, labels and its best containment."""
    index = Index(frequencies(documents, templates), templates, threshold)
    watched = {w.encode() for p in PHRASES for w in p} | index.starters

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = words(value.as_py())
                present = watched.intersection(found)
                base = phrases(found, present) if present else []
                best: dict[str, float] = {}
                for k, held in index.matches(found) if not present.isdisjoint(index.starters) else ():
                    best[index.labels[k]] = max(best.get(index.labels[k], 0.0), held)
                own = sorted({label for _, label in base})
                places = [at for at, _ in base]
                score = max([1.0 if base else 0.0, *best.values()])
                yield doc_id, len(found), len(base), min(places, default=None), max(places, default=None), ",".join(own), ",".join(sorted({*own, *best})), score

    kinds = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda b: to_batches(rows(b), SCHEMA), kinds)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _oracle() -> str:
    quoted = ",\n  ".join(f"('{label}', '{text}')" for label, text in TEMPLATES)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    pattern = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    stands = "list_filter(range(1, len(w) + 1), lambda i: {})"
    finds = " || ".join(
        stands.format(" AND ".join(f"w[i{f' + {k}' if k else ''}] IS NOT DISTINCT FROM '{x}'" for k, x in enumerate(phrase))).join(("[{place: i - 1, label: '" + label + "'} FOR i IN ", "]"))
        for phrase, label in PHRASES.items()
    )
    return f"""
WITH templates AS (
  SELECT label, list_distinct(w) AS tokens, len(w) AS n FROM (SELECT label, regexp_extract_all({lower.format("text")}, {pattern}) AS w FROM (VALUES
  {quoted}) t(label, text))
), docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({lower.format("coalesce(text, '')")}, {pattern}) AS w FROM documents
), found AS (
  SELECT row, doc_id, len(w) AS n_words, {finds} AS places FROM docs
), stands AS (
  SELECT row, unnest(w) AS token, unnest(range(0, len(w))) AS word FROM docs
), known AS (
  SELECT row, label, tokens, n, token, word FROM stands JOIN (SELECT label, tokens, n, unnest(tokens) AS token FROM templates) USING (token)
), runs AS (
  SELECT row, label, tokens, count(DISTINCT token) OVER (PARTITION BY row, label, tokens ORDER BY word RANGE BETWEEN CURRENT ROW AND n + CAST(floor(n * {SLACK}) AS BIGINT) - 1 FOLLOWING) AS held FROM known
), best AS (
  SELECT row, list(DISTINCT label) AS labels, max(held / len(tokens)) AS share FROM runs WHERE held >= ceil({THRESHOLD} * len(tokens) - 1e-9) GROUP BY row
)
SELECT doc_id, n_words, len(places) AS n_base, list_min([p.place FOR p IN places]) AS first_word, list_max([p.place FOR p IN places]) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct([p.label FOR p IN places])), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat([p.label FOR p IN places], coalesce(labels, [])))), ','), '') AS labels,
  CASE WHEN len(places) > 0 THEN CAST(1 AS DOUBLE) ELSE coalesce(share, CAST(0 AS DOUBLE)) END AS score
FROM found LEFT JOIN best USING (row)
"""


ORACLE = _oracle()
