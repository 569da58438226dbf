"""License scans by an exact set-similarity join.

A template is the set of its words; a text block is a run of words of one text, at most 1.25 times as
many as the template's text has with its repeats. Templates are whole licences with their conditions
and disclaimers as well as notices of a line. Every block that holds at least `threshold` of a template's words is found:

* template words are ordered by how often they occur in all documents, rare ones first;
* prefix filter: such a block holds one of the first m - ceil(threshold * m) + 1 words;
* length filter: a text with fewer words than the threshold needs holds no such block;
* positional filter: a block is only counted where enough template words lie near the prefix word.

Phrases are templates whose words must stand in a row: their places are found at their rarest word
and then compared word by word.

A null or empty text has no words, no labels and score 0. Repeated rows are scanned each. Whole
texts are scanned; blocks may begin anywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilescope.llm import wordhash
from tilescope.llm.license_texts import LICENSE_TEXTS

#: Wording of common licence notices, (label, text).
NOTICES = (
    ("all-rights-reserved", "all rights reserved"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "released under the mit license"),
    ("mpl-2", "subject to the terms of the mozilla public license version 2 0"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
)
#: One-line notices, and whole licences with their conditions and disclaimers.
TEMPLATES = NOTICES + LICENSE_TEXTS
#: Phrases that must stand word by word, (label, text).
PHRASES = (("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"), ("mit", "under the mit license"))
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, blocks array<struct<label: string, first_word: long, n_words: int, containment: double>>"
)


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return wordhash.word_hashes(data, np.array([0, len(data)]), wordhash.PUNCTUATION)[0]


def _documents(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for row, data, offsets in wordhash.text_blocks(batch.column(column)):
        yield row, *wordhash.word_hashes(data, offsets, wordhash.PUNCTUATION)


def _lookup(vocabulary: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, vocabulary numbers) of the words that are in the sorted vocabulary."""
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    places = np.flatnonzero(vocabulary[at] == hashes)
    return places, at[places]


def _count_words(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, hashes, _ in _documents(batch, 0):
                total += np.bincount(_lookup(vocabulary, hashes)[1], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["word", "n"])

    return run


class _Templates:
    """Templates and phrases in terms of a vocabulary and its order."""

    def __init__(self, templates, phrases, vocabulary: np.ndarray, seen: np.ndarray, threshold: float) -> None:
        self.vocabulary = vocabulary
        order = np.empty(len(vocabulary), np.int64)
        order[np.lexsort((vocabulary, seen))] = np.arange(len(vocabulary))
        number = lambda text: np.searchsorted(vocabulary, _hashes(text))
        self.sets = []
        for label, text in templates:
            spelled = number(text)
            words = np.unique(spelled)
            need = int(np.ceil(threshold * len(words) - 1e-9))
            rare = words[np.argsort(order[words])][: len(words) - need + 1]
            self.sets.append((label, words, need, np.isin(np.arange(len(vocabulary)), rare), -(-5 * len(spelled) // 4)))
        self.phrases = []
        for label, text in phrases:
            words = number(text)
            self.phrases.append((label, words, int(np.argmin(order[words]))))
        self.member = [np.isin(np.arange(len(vocabulary)), words) for _, words, *_ in self.sets]

    def bases(self, places: np.ndarray, words: np.ndarray) -> list[tuple[str, int]]:
        """(label, place) of every phrase of one text."""
        found = []
        for label, phrase, rarest in self.phrases:
            start = np.flatnonzero(words == phrase[rarest]) - rarest
            start = start[(start >= 0) & (start + len(phrase) <= len(words))]
            for k, word in enumerate(phrase):
                start = start[(words[start + k] == word) & (places[start + k] == places[start] + k)]
            found += [(label, int(places[s])) for s in start]
        return found

    def blocks(self, places: np.ndarray, words: np.ndarray, n_words: int) -> Iterator[tuple[str, int, int, float]]:
        """(label, first word, length, containment) of blocks that begin at a template word and meet the threshold."""
        for (label, template, need, rare, width), member in zip(self.sets, self.member, strict=True):
            if n_words < need:
                continue
            hit = np.flatnonzero(member[words])
            near = hit[rare[words[hit]]]
            if not len(near):
                continue
            at, what = places[hit], words[hit]
            # Words of the template in each block that begins at one of its words; then blocks around prefix words.
            reach = np.searchsorted(at, at + width)
            p = places[near]
            close = np.searchsorted(p, at) < np.searchsorted(p, at + width)
            for k in np.flatnonzero(close & (reach - np.arange(len(at)) >= need)).tolist():
                held = len(set(what[k : reach[k]].tolist()))
                if held >= need:
                    yield label, int(at[k]), int(at[reach[k] - 1] - at[k] + 1), held / len(template)


def _scan(templates, phrases, vocabulary: np.ndarray, seen: np.ndarray, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Templates(templates, phrases, vocabulary, seen, threshold)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for row, hashes, first in _documents(batch, 1):
                places, words = _lookup(vocabulary, hashes)
                cuts = np.searchsorted(places, first)
                for k in range(len(first) - 1):
                    lo, hi, n = cuts[k], cuts[k + 1], int(first[k + 1] - first[k])
                    bases, blocks = [], []
                    if hi > lo:
                        local, own = places[lo:hi] - first[k], words[lo:hi]
                        bases = known.bases(local, own)
                        blocks = list(known.blocks(local, own, n))
                    starts = [s for _, s in bases]
                    base_labels = sorted({label for label, _ in bases})
                    labels = sorted({*base_labels, *(b[0] for b in blocks)})
                    score = 1.0 if bases else max((b[3] for b in blocks), default=0.0)
                    rows.append(
                        (ids[row + k], n, len(bases), min(starts, default=None), max(starts, default=None),
                         ",".join(base_labels), ",".join(labels), score,
                         [dict(zip(("label", "first_word", "n_words", "containment"), b, strict=True)) for b in blocks])
                    )
            block = pa.struct(
                [("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int32()), ("containment", pa.float64())]
            )
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(block)]
            names = [c.strip().split()[0] for c in SCHEMA.split(", blocks")[0].split(",")] + ["blocks"]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return run


def scan_licenses(
    documents: DataFrame,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    phrases: tuple[tuple[str, str], ...] = PHRASES,
    threshold: float = 0.9,
) -> DataFrame:
    """Rows of SCHEMA for documents(doc_id, text): base places, labels, and the blocks found.

    n_base, first_word, last_word and base_labels tell of the phrases alone. score is 1 with a phrase,
    else the highest containment of a block found, else 0.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vocabulary = np.unique(np.concatenate([_hashes(text) for _, text in (*templates, *phrases)]))
    counted = rows.select("text").mapInArrow(_count_words(vocabulary), "word long, n long")
    seen = np.zeros(len(vocabulary), np.int64)  # as long as the templates have different words
    for word, n in counted.groupBy("word").agg(F.sum("n").alias("n")).collect():
        seen[word] = n
    return rows.mapInArrow(_scan(templates, phrases, vocabulary, seen, threshold), SCHEMA)


def scan_sql(docs: str = "documents") -> str:
    def words(text: str) -> str:
        return " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()))

    def rows(pairs) -> str:
        return ", ".join(f"({k}, '{label}', '{words(text)}')" for k, (label, text) in enumerate(pairs))

    return rf"""
WITH templates(t, label, body) AS (VALUES {rows(TEMPLATES)}), phrases(t, label, body) AS (VALUES {rows(PHRASES)}),
tw AS (
  SELECT t, label, list_distinct(string_split(body, ' ')) AS words, len(string_split(body, ' ')) AS spelled FROM templates
), d AS (
  SELECT doc_id, regexp_extract_all(
    translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM {docs}
), spread AS (
  SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos, w FROM d
), base AS (
  SELECT doc_id, label, pos FROM spread, phrases
  WHERE word = string_split(body, ' ')[1]
    AND array_to_string(w[pos + 1 : pos + len(string_split(body, ' '))], ' ') = body
), bases AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
    array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels, list(label) AS bl
  FROM base GROUP BY doc_id
), occ AS (
  SELECT doc_id, t, label, words, spelled, pos, word FROM spread JOIN (SELECT *, unnest(words) AS word FROM tw) USING (word)
  -- a document holds no block without enough different words of the template
  QUALIFY count(DISTINCT word) OVER (PARTITION BY doc_id, t) >= ceil(0.9 * len(words) - 1e-9)
), held AS (
  SELECT a.doc_id, a.label, a.t, a.pos, count(DISTINCT b.word) / len(any_value(a.words)) AS containment,
    count(DISTINCT b.word) >= ceil(0.9 * len(any_value(a.words)) - 1e-9) AS ok
  FROM occ a JOIN occ b ON a.doc_id = b.doc_id AND a.t = b.t
    AND b.pos BETWEEN a.pos AND a.pos + CAST(ceil(5 * a.spelled / 4) AS INT) - 1
  GROUP BY a.doc_id, a.label, a.t, a.pos
), found AS (
  SELECT doc_id, list(label) AS ml, max(containment) AS best FROM held WHERE ok GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_base, 0) AS n_base, first_word, last_word,
  COALESCE(base_labels, '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(COALESCE(bl, []), COALESCE(ml, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE COALESCE(best, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN bases USING (doc_id) LEFT JOIN found USING (doc_id)
"""
