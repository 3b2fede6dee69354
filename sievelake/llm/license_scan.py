"""License scans: an exact set-similarity join of text blocks with license templates.

The blocks of a text are its windows: for each template all runs of ``WINDOW`` times as many words as it has,
across line breaks, so a notice is found however it is wrapped and words scattered over a long line are not
one. A window matches when it holds at least ``threshold`` of the template's distinct words. Tokens are put
in one global order, rarest first, by their document frequency over the whole corpus (counted in a first
pass that moves one row per template word and task). For a template of n tokens that must share
t = ceil(threshold * n):

* prefix filter: a match holds one of the template's n - t + 1 rarest tokens. A document with none of them is
  done after one set test, and only the stretches within a window's length of such a token are looked at;
* a stretch of m distinct template tokens must meet the template within its own m - t + 1 rarest as well;
* length filter: m >= t;
* positional filter: meeting at places i and j of the two sorted sets with c tokens met before, at most
  c + 1 + min(n - i - 1, m - j - 1) can be shared; a stretch is left where that is less than t.

What passes is verified on the windows themselves, by one sweep. Base phrases go through the same join with
the whole text as the stretch and threshold 1, and are verified as places where their words stand
consecutively. Templates are a fixed parameter, so nothing that grows is broadcast; both passes are
narrow, so no key is hot.

Defined results: a null text counts as empty; no places give null first_word and last_word, empty labels
and score 0; a text shorter than a window is one window; of matching windows that overlap the fullest is
returned, of equally full ones the first; repeated documents are each scanned; input columns that clash
with the result's names are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, binaries, table, words_of

THRESHOLD = 0.9
WINDOW = 2
# The base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Notices and the labels they stand for.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("to the extent possible under law the author has waived all copyright and related rights", "cc0"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the software",
        "mit",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
        "permission notice appear in all copies",
        "isc",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source "
        "code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright "
        "notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "bsd",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
        "basis without warranties or conditions of any kind either express or implied",
        "apache-2.0",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version",
        "gpl-3.0",
    ),
    (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        "lgpl",
    ),
    (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in "
        "source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "unlicense",
    ),
)
MATCH = T.StructType([T.StructField("label", T.StringType()), T.StructField("start_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("containment", T.DoubleType())])


def vocabulary(templates) -> frozenset[bytes]:
    return frozenset(w for text, _ in templates for w in words_of(text.encode()))


def document_frequencies(docs: DataFrame, tokens: frozenset[bytes], text_col: str = "text") -> dict[bytes, int]:
    """In how many documents each token stands, over all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for raw in binaries(batch.column(0)):
                if raw:
                    seen.update(tokens.intersection(words_of(raw)))
        yield pa.RecordBatch.from_arrays([pa.array([t.decode() for t in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])

    found = docs.select(text_col).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r.token.encode(): r.n for r in found.collect()}  # one row for each template word at most


class TemplateIndex:
    """Templates as sets in the global token order, with an index over their prefixes."""

    def __init__(self, templates, frequency: dict[bytes, int], threshold: float):
        tokens = vocabulary(templates)
        self.rank = {t: i for i, t in enumerate(sorted(tokens, key=lambda t: (frequency.get(t, 0), t)))}
        self.sets = [(sorted(self.rank[w] for w in set(words_of(text.encode()))), label) for text, label in templates]
        self.places = [{r: i for i, r in enumerate(ranks)} for ranks, _ in self.sets]
        self.need = [math.ceil(threshold * len(s) - 1e-9) for s, _ in self.sets]
        self.reach = [WINDOW * len(words_of(text.encode())) for text, _ in templates]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for k, (ranks, _) in enumerate(self.sets):
            for i, r in enumerate(ranks[: len(ranks) - self.need[k] + 1]):
                self.prefix.setdefault(r, []).append((k, i))
        back = list(self.rank)
        self.prefix_tokens = frozenset(back[r] for r in self.prefix)

    def may_hold(self, k: int, block: list[int]) -> bool:
        """Whether a block, as sorted distinct ranks, passes the filters of template k and holds its threshold."""
        own, need = self.places[k], self.need[k]
        n, m = len(own), len(block)
        if m < need:
            return False
        met = 0
        for j, r in enumerate(block):
            i = own.get(r)
            if i is None:
                # No meeting within both prefixes, or too few left.
                if met + m - j - 1 < need:
                    return False
                continue
            if met + 1 + min(n - i - 1, m - j - 1) < need:
                return False
            met += 1
        return met >= need

    def matches(self, words: list[bytes]) -> list[tuple[int, float]]:
        """(template, containment) of all templates that this block holds to the threshold."""
        block = sorted({self.rank[w] for w in words if w in self.rank})
        near = sorted({k for r in block for k, _ in self.prefix.get(r, ())})
        have = set(block)
        return [(k, sum(r in have for r in self.sets[k][0]) / len(self.sets[k][0])) for k in near if self.may_hold(k, block)]

    def stretches(self, placed: list[tuple[int, int]]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(template, places of template words in it) of the stretches around a template's rarest words."""
        anchors: dict[int, list[int]] = {}
        for at, (_, r) in enumerate(placed):
            for k, _ in self.prefix.get(r, ()):
                anchors.setdefault(k, []).append(at)
        for k in sorted(anchors):
            reach, end = self.reach[k], 0
            for at in anchors[k]:
                if at < end:
                    continue
                a = b = at
                while a and placed[a - 1][0] > placed[at][0] - reach:
                    a -= 1
                last = placed[at][0]
                while b < len(placed) and placed[b][0] < last + reach:
                    if any(own == k for own, _ in self.prefix.get(placed[b][1], ())):
                        last = placed[b][0]
                    b += 1
                end = b
                yield k, placed[a:b]

    def windows(self, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(template, start, end, containment) of the windows that hold a template to the threshold."""
        rank = self.rank
        placed = [(p, rank[w]) for p, w in enumerate(words) if w in rank]
        out = []
        for k, stretch in self.stretches(placed):
            if not self.may_hold(k, sorted({r for _, r in stretch})):
                continue
            own, need = self.places[k], self.need[k]
            at = [(p, r) for p, r in stretch if r in own]
            held: Counter[int] = Counter()
            left, best = 0, None
            for p, r in at:
                held[r] += 1
                # Words too far back go, and those that come again further on.
                while at[left][0] <= p - self.reach[k] or held[at[left][1]] > 1:
                    held[at[left][1]] -= 1
                    if not held[at[left][1]]:
                        del held[at[left][1]]
                    left += 1
                if len(held) >= need:
                    found = (k, at[left][0], p + 1, len(held) / len(own))
                    if best and found[1] >= best[2]:
                        out.append(best)
                        best = None
                    if best is None or found[3] > best[3]:
                        best = found
            if best:
                out.append(best)
        return out


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    found, at, n = [], -1, len(phrase)
    try:
        while True:
            at = words.index(phrase[0], at + 1)
            if words[at : at + n] == phrase:
                found.append(at)
    except ValueError:
        return found


RESULT = [
    ("n_words", T.LongType()),
    ("n_base", T.LongType()),
    ("first_word", T.LongType()),
    ("last_word", T.LongType()),
    ("base_labels", T.StringType()),
    ("labels", T.StringType()),
    ("score", T.DoubleType()),
    ("matches", T.ArrayType(MATCH)),
]


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of ``RESULT``; score is the best containment, 1 where a phrase stands."""
    frequency = document_frequencies(docs, vocabulary(templates) | vocabulary(phrases), text_col)
    index = TemplateIndex(templates, frequency, threshold)
    whole = TemplateIndex(phrases, frequency, 1.0)
    split = [words_of(p.encode()) for p, _ in phrases]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("containment", pa.float64())]))]

    def one(raw: bytes | None) -> tuple:
        words = words_of(raw or b"")
        starts: list[int] = []
        base: set[str] = set()
        found: list[dict] = []
        if not whole.prefix_tokens.isdisjoint(words):
            for k, _ in whole.matches(words):
                if at := places(words, split[k]):
                    base.add(phrases[k][1])
                    starts += at
        if not index.prefix_tokens.isdisjoint(words):
            for k, a, b, share in index.windows(words):
                found.append({"label": templates[k][1], "start_word": a, "end_word": b, "containment": share})
        labels = base | {m["label"] for m in found}
        score = max([1.0 if base else 0.0, *(m["containment"] for m in found)])
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, found

    def run(texts: pa.Array):
        rows = [one(raw) for raw in binaries(texts)]
        return [pa.array([r[c] for r in rows], t) for c, t in enumerate(types)]

    return add_columns(docs, RESULT, run, text_col)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "matches")


_ROWS = ", ".join(f"({i}, '{t}', '{label}')" for i, (t, label) in enumerate(TEMPLATES))
_BASE = ", ".join(f"('{t}', '{label}')" for t, label in PHRASES)
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP4_SQL = rf"""
WITH docs AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents),
norm AS (SELECT doc_id, t, {_WORDS.format("t")} AS w FROM docs),
templates AS (
  SELECT k, label, list_distinct(string_split(body, ' ')) AS ts, len(list_distinct(string_split(body, ' '))) AS n,
         {WINDOW} * len(string_split(body, ' ')) AS reach FROM (VALUES {_ROWS}) v(k, body, label)),
tokens AS (SELECT k, unnest(ts) AS word, n, reach, label FROM templates),
phrases AS (SELECT string_split(body, ' ') AS p, label FROM (VALUES {_BASE}) v(body, label)),
starts AS (
  SELECT doc_id, i - 1 AS start, label FROM norm, phrases, unnest(range(1, len(w) - len(p) + 2)) r(i)
  WHERE len(w) >= len(p) AND list_contains(w, p[1]) AND w[i : i + len(p) - 1] = p),
base AS (
  SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM starts GROUP BY doc_id),
spots AS (SELECT doc_id, k, n, reach, label, p, t.word FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM norm) x JOIN tokens t USING (word)),
near AS (SELECT * FROM spots SEMI JOIN (SELECT doc_id, k FROM spots GROUP BY doc_id, k HAVING count(DISTINCT word) >= ceil({THRESHOLD} * any_value(n) - 1e-9)) USING (doc_id, k)),
held AS (
  SELECT doc_id, label, n, count(DISTINCT word) OVER (PARTITION BY doc_id, k ORDER BY p RANGE BETWEEN CURRENT ROW AND (reach - 1) FOLLOWING) AS c FROM near),
matched AS (SELECT doc_id, label, c / n AS share FROM held WHERE c >= ceil({THRESHOLD} * n - 1e-9)),
every AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM (SELECT * FROM matched UNION ALL SELECT doc_id, label, 1.0 FROM starts) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0)::DOUBLE AS score
FROM norm LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id)
"""
