"""Language identification by language-bitmask n-gram filters.

Training counts, per language, the documents that hold each character n-gram. An n-gram belongs to a
language if its share of that language's documents is at least `rate` and not below a fraction of
its highest share. All languages live in one bit-sliced Bloom filter: a slot is a bit mask of
languages, and the AND of an n-gram's slots gives every language that contains it. A text is decided
by the number of its n-grams per language, each corrected for the language's false positives.

n-grams are of 4 characters, taken from the lower-cased text with every run of characters other than
letters as one space, and one more space at either end. The number of accepted n-grams is bounded by
n-grams per document / rate for each language, so the filter has a fixed size.

A null text, and a text without a letter, is `und` with score 0; so is every text when nothing could
be learned. Ties go to the smaller language name. Repeated rows are learned and predicted each.
Whole texts are used.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilescope.llm.common import stored
from tilescope.llm.wordhash import mix

SLOT_BITS = 21
HASHES = 3
RATE = 0.002
FRACTION = 0.125
CHUNK_CHARS = 250_000
FLUSH_GRAMS = 1_500_000
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Lower-cased texts in runs of about CHUNK_CHARS characters, with the first row."""
    begin, size, held = 0, 0, []
    for row, text in enumerate(texts):
        t = text.as_py()
        t = "" if t is None else t.lower()
        held.append(t)
        size += len(t)
        if size > CHUNK_CHARS:
            yield begin, held
            begin, size, held = row + 1, 0, []
    if held:
        yield begin, held


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text) of every n-gram, and which texts hold a letter."""
    lengths = np.fromiter((len(t) + 4 for t in texts), np.int64, len(texts))
    code = np.frombuffer("".join(f"  {t}  " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), lengths)
    letter = _letters()[code]
    lettered = np.bincount(owner[letter], minlength=len(texts)) > 0
    code = np.where(letter, code, 32).astype(np.uint64)
    edge = np.zeros(len(code), bool)
    ends = np.cumsum(lengths)
    edge[ends - 1] = True
    edge[ends - lengths] = True
    keep = letter | edge
    keep[1:] |= letter[:-1]  # the first of a run of others
    code, owner = code[keep], owner[keep]
    if len(code) < 4:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), lettered
    packed = code[:-3] | (code[1:-2] << np.uint64(21)) | (code[2:-1] << np.uint64(42))
    value = mix(packed + code[3:] * np.uint64(0x9E3779B97F4A7C15))
    inside = (owner[:-3] == owner[3:]) & lettered[owner[:-3]]
    return value[inside], owner[:-3][inside], lettered


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, lang, docs) of the training texts in columns (text, lang); gram is null for the documents of a language."""
    held: dict[str, list] = {}
    total: dict[str, int] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            gram, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            docs = np.bincount(inverse, np.concatenate([p[1] for p in parts]), minlength=len(gram)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array([lang] * len(gram), pa.string()), pa.array(docs)],
                ["gram", "lang", "docs"],
            )
        held.clear()

    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), object)
        for begin, texts in _chunks(batch.column(0)):
            value, owner, lettered = _grams(texts)
            order = np.lexsort((owner, value))
            value, owner = value[order], owner[order]
            new = np.ones(len(value), bool)
            new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
            value, owner = value[new], owner[new]  # every n-gram once per document
            of = langs[begin : begin + len(texts)]
            for lang in sorted(set(of[lettered])):
                mine = (of == lang) & lettered
                total[lang] = total.get(lang, 0) + int(mine.sum())
                gram, docs = np.unique(value[mine[owner]], return_counts=True)
                held.setdefault(lang, []).append((gram, docs))
                size += len(gram)
            if size > FLUSH_GRAMS:
                yield from flush()
                size = 0
    yield from flush()
    yield pa.RecordBatch.from_arrays(
        [
            pa.nulls(len(total), pa.int64()),
            pa.array(list(total), pa.string()),
            pa.array(list(total.values()), pa.int64()),
        ],
        ["gram", "lang", "docs"],
    )


def _slots(value: np.ndarray) -> list[np.ndarray]:
    return [(mix(value + np.uint64(k)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for k in range(HASHES)]


def _fill(n_bytes: int):
    """(slot, byte, bits) of accepted n-grams (gram, languages)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            count = lists.value_lengths().to_numpy().astype(np.int64)
            lang = lists.flatten().to_numpy().astype(np.int64)
            gram = np.repeat(batch.column(0).to_numpy().view(np.uint64), count)
            slot = np.concatenate(_slots(gram))
            key = slot * n_bytes + np.tile(lang >> 3, HASHES)
            bits = np.tile(np.left_shift(1, lang & 7), HASHES)
            order = np.argsort(key, kind="stable")
            key, bits = key[order], bits[order]
            if len(key):
                start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                merged = np.bitwise_or.reduceat(bits, start)
                yield pa.RecordBatch.from_arrays([pa.array(key[start]), pa.array(merged)], ["key", "bits"])

    return run


class LanguageFilter:
    """The languages, the slots (slot, byte) and each language's rate of false positives."""

    def __init__(self, languages: list[str], slots: np.ndarray) -> None:
        self.languages, self.slots = languages, slots
        full = [float((slots[:, k >> 3] >> (k & 7) & 1).mean()) for k in range(len(languages))]
        self.false = np.array(full) ** HASHES

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of lower-cased texts; the score is the corrected share of the text's n-grams."""
        value, owner, lettered = _grams(texts)
        at = _slots(value)
        mask = self.slots[at[0]]
        for more in at[1:]:
            mask = mask & self.slots[more]
        n = np.bincount(owner, minlength=len(texts))
        share = np.zeros((len(texts), len(self.languages)))
        for k, false in enumerate(self.false):
            hit = (mask[:, k >> 3] >> (k & 7)) & 1
            raw = np.bincount(owner, hit, minlength=len(texts)) / np.maximum(n, 1)
            share[:, k] = np.clip((raw - false) / max(1 - false, 1e-9), 0, 1)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = np.argmax(share, axis=1)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
        return names, np.where(lettered, share[np.arange(len(texts)), best], 0.0)


def learn_languages(labelled: DataFrame, rate: float = RATE, fraction: float = FRACTION) -> LanguageFilter:
    """A filter from labelled(text, lang); rows with a null text or language teach nothing."""
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counted = rows.filter("text is not null and lang is not null").mapInArrow(_count, "gram long, lang string, docs long")
    counted = counted.groupBy("gram", "lang").agg(F.sum("docs").alias("docs"))
    counted = stored(counted)
    totals = {r["lang"]: r["docs"] for r in counted.filter("gram is null").collect()}  # one row per language
    languages = sorted(totals)
    n_bytes = max(1, -(-len(languages) // 8))
    slots = np.zeros((1 << SLOT_BITS, n_bytes), np.uint8)
    if languages:
        number = F.create_map(*[F.lit(x) for k, lang in enumerate(languages) for x in (lang, k)])
        total = F.create_map(*[F.lit(x) for lang in languages for x in (lang, float(totals[lang]))])
        shares = counted.filter("gram is not null").withColumn("share", F.col("docs") / total[F.col("lang")])
        shares = shares.filter(F.col("share") >= rate).select("gram", number[F.col("lang")].alias("k"), "share")
        held = shares.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("k", "share")).alias("all"))
        kept = F.filter("all", lambda x: x["share"] >= fraction * F.col("top"))
        accepted = held.select("gram", F.transform(kept, lambda x: x["k"]).alias("languages"))
        filled = accepted.mapInArrow(_fill(n_bytes), "key long, bits long").groupBy("key").agg(F.bit_or("bits").alias("bits"))
        table = filled.toPandas()  # at most one row per byte of the filter
        slots.reshape(-1)[table["key"].to_numpy(np.int64)] = table["bits"].to_numpy(np.uint8)
    return LanguageFilter(languages, slots)


def identify_languages(documents: DataFrame, model: LanguageFilter) -> DataFrame:
    """All columns of documents, with lang_pred and lang_score; they are predicted from `text` alone."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # fixed size
    own = [c for c in documents.columns if c not in ("lang_pred", "lang_score")]
    kept = documents.select(*own)
    text = own.index("text")
    schema = T.StructType(
        [*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names: list[str] = []
            scores: list[float] = []
            for _, texts in _chunks(batch.column(text).cast(pa.string())):
                found, score = shared.value.predict(texts)
                names += found
                scores += score.tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [*batch.schema.names, "lang_pred", "lang_score"],
            )

    return kept.mapInArrow(run, schema)
