"""Language identification against exact sets of n-grams, without filters or hashes."""

import zlib
from collections import Counter, defaultdict

from tests.conftest import ROOT
from tilescope.llm.language_id import FRACTION, RATE, UNKNOWN
from tilescope.llm.queries import all_queries


def grams(text):
    """All 4-character n-grams of the letters of a text, runs of others as one space, one more at the end."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    line = f" {' '.join(words)}  "
    return [line[k : k + 4] for k in range(len(line) - 3)] if words else []


def learned(rows):
    """{language: its n-grams}."""
    docs, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        if text is not None and lang is not None and (found := set(grams(text))):
            totals[lang] += 1
            for g in found:
                docs[g][lang] += 1
    sets = {lang: set() for lang in totals}
    for g, by in docs.items():
        share = {lang: n / totals[lang] for lang, n in by.items()}
        share = {lang: s for lang, s in share.items() if s >= RATE}
        for lang, s in share.items():
            if s >= FRACTION * max(share.values()):
                sets[lang].add(g)
    return sets


def test_filter_equals_exact_sets(spark):
    rows = spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text", "lang").collect()
    out = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows}
    sets = learned((r["text"], r["lang"]) for r in rows if not out[r["doc_id"]])
    got = {r["doc_id"]: r for r in all_queries()["op6_language_id"].run(spark, ROOT).collect()}
    assert set(got) == set(out) and len(sets) > 1
    for r in rows:
        found, mine = got[r["doc_id"]], grams(r["text"])
        assert found["held_out"] == out[r["doc_id"]]
        if not mine:
            assert (found["lang_pred"], found["score"]) == (UNKNOWN, 0.0)
            continue
        share = {lang: sum(g in held for g in mine) / len(mine) for lang, held in sets.items()}
        # The filter's false positives are corrected on average; what is left is small.
        assert abs(found["score"] - share[found["lang_pred"]]) < 0.02
        assert share[found["lang_pred"]] > max(share.values()) - 0.02
