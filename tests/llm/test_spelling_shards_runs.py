"""Spelling variants, interleaved shards and periodic runs: odd cases, planted cases, and whole tables against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from tests.conftest import ROOT
from tests.llm import brute
from tests.llm.test_llm_cases import LONG, none, odd, passage  # noqa: F401
from tests.llm.test_llm_queries import texts
from tilescope.llm import interleave, periodic, spelling
from tilescope.llm.interleave import interleaved, shard_documents, write_shards
from tilescope.llm.periodic import find_runs, text_runs
from tilescope.llm.queries import all_queries
from tilescope.llm.spelling import near_words, spelling_variants, word_counts


QUERIES = all_queries()


# -- periodic runs


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (4, 3), (2, 2), (1, 5)])
def test_runs_of_random_words(least, exponent):
    rng = random.Random(least * 10 + exponent)
    for _ in range(1500):
        n, kinds = rng.randint(0, 60), rng.choice([1, 2, 3, 6])
        words = [rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randint(0, 2) if n > 4 else 0):
            a, p = rng.randrange(n), rng.randint(1, 8)
            for i in range(a + p, min(n, a + p * rng.randint(2, 7))):
                words[i] = words[i - p]
        assert text_runs([b"%d" % w for w in words], least, exponent) == brute.runs(words, least, exponent)


def test_squares_hold_the_first_of_every_run():
    rng = random.Random(4)
    for _ in range(300):
        words = [rng.randrange(2) for _ in range(40)]
        found = set(periodic.squares(words))
        assert all(words[e - 2 * q + 1 : e - q + 1] == words[e - q + 1 : e + 1] for e, q in found)
        assert {(s + 2 * q - 1, q) for s, q, _ in brute.runs(words, 2, 2)} <= found


def test_stretches_leave_out_what_cannot_repeat():
    words = [b"w%d" % k for k in range(5000)]
    words[2000:2040] = [b"a", b"b"] * 20
    seen = {}
    ids = np.array([seen.setdefault(w, k) for k, w in enumerate(words)])
    assert [b - a for a, b in periodic.stretches(ids, 6, 4)][0] <= 60
    assert text_runs(words, 6, 4) == [(2000, 2, 40)]


def test_runs_odd_cases(odd, none):  # noqa: F811
    got = find_runs(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_words"] == by[2]["n_words"] == by[3]["n_words"] == 0 and by[1]["collapsed"] == ""
    long = text_runs(LONG.encode().split(), 6, 4)
    assert [(r["start"], r["period"], r["length"]) for r in by[6]["runs"]] == long == [(0, 5000, 60000)]
    assert len(by[6]["collapsed"].split()) == 5000
    assert by[4]["collapsed"] == "one" and by[10]["n_words"] == 3
    assert find_runs(none).count() == 0


def test_periodic_runs_query(spark):
    got = QUERIES["op13_periodic_runs"].run(spark, ROOT).collect()
    want = dict(texts(ROOT))
    assert len(got) == len(want) and sum(r["n_runs"] > 0 for r in got) > 50
    for r in got:
        words = brute.planted(r["doc_id"], brute.WORD.findall(want[r["doc_id"]] or ""))
        # Runs are looked for by brute force in planted texts and a share of the others: it compares all words q apart.
        if len(words) > 3000 or (r["n_runs"] == 0 and r["doc_id"] % 3):
            found = text_runs([w.encode() for w in words], 6, 4)
        else:
            found = brute.runs(words, 6, 4)
        assert r["n_runs"] == len(found)
        lines = "".join(f"{s},{n},{q}\n" for s, q, n in found)
        assert r["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(brute.collapsed(words, found)).encode()).hexdigest()
        if found:
            s, q, n = min(found, key=lambda x: (-x[2] / x[1], x[0], x[1]))
            assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (s, n, q, 1000 * n // q)
        else:
            assert r["start"] is r["length"] is r["period"] is r["exponent_milli"] is None


# -- shards


def test_shards_of_odd_rows(odd, none):  # noqa: F811
    got = shard_documents(odd, shards=4).collect()
    assert len(got) == odd.count()
    counts = collections.Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == {0, 1, 2, 3}
    for s, n in counts.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got}[1] == (1, 0)
    assert {r["doc_id"]: r["text_crc32"] for r in got}[6] == zlib.crc32(LONG.encode())
    assert shard_documents(none).count() == 0
    assert sorted(r["shard"] for r in shard_documents(odd.limit(3), shards=8).collect()) == [0, 2, 5]


def test_cells_do_not_change_the_order(spark, monkeypatch):
    rng = random.Random(8)
    kinds = ["hot"] * 900 + [None] * 50 + [f"s{k}" for k in range(300)] + ["b"] * 450
    rng.shuffle(kinds)
    rows = spark.createDataFrame([(s, str(k), (k,)) for k, s in enumerate(kinds)], "stratum string, identity string, row struct<k:int>")
    whole = sorted(map(tuple, interleaved(rows, 5, 3).collect()))
    monkeypatch.setattr(interleave, "CELL_ROWS", 16)
    assert sorted(map(tuple, interleaved(rows.repartition(7), 5, 3).collect())) == whole
    # Of every stratum a shard has its fifth, but for a row or two at each cut.
    mixture = collections.Counter((s, kinds[r[0]]) for r, s, _ in whole)
    for kind, n in (("hot", 900), (None, 50), ("b", 450)):
        assert all(abs(mixture[s, kind] - n / 5) <= 2 + n / 40 for s in range(5))
    single = collections.Counter(s for r, s, _ in whole if str(kinds[r[0]]).startswith("s"))
    assert max(single.values()) - min(single.values()) < 40


def test_write_shards(spark, odd, tmp_path):  # noqa: F811
    """Whole rows come back, in slot order, clashing columns as they were but for `shard` and `slot`."""
    write_shards(odd, str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    key = lambda r: str((r["doc_id"], r["text"], r["n"], r["key"], r["size"]))
    assert sorted(map(key, back.collect())) == sorted(map(key, odd.collect()))
    placed = {(r["doc_id"], r["shard"], r["slot"]) for r in shard_documents(odd, shards=3).collect() if r["doc_id"] not in (7, None)}
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in back.collect() if r["doc_id"] not in (7, None)} == placed


# -- spelling


def planted_words(seed, n):
    rng = random.Random(seed)
    base = [brute.lower(passage(seed * 100 + k, 1)) + "stem" for k in range(n)]
    words = set(base)
    for w in base:
        for _ in range(rng.randint(0, 4)):
            k, c = rng.randrange(len(w)), rng.choice("abcdeé")
            words.add(rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]]))
    return {w: rng.randint(3, 40) for w in words if len(w) >= 5}


@pytest.mark.parametrize("block", [2048, 5])
def test_near_words_against_brute_force(spark, monkeypatch, block):
    """With parts of five words, blocks meet in many tiles; results are the same."""
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block)
    counts = planted_words(3, 120) | {f"aaaaa{c}{d}": 3 + (i % 9) for i, c in enumerate("abcdefgh") for d in "abcdefg"}
    counts |= {"aaaaa": 30, "aaaaaa": 30, "ééééé": 4, "x" * 900: 5, "x" * 901: 9, "x" * 450 + "y" + "x" * 450: 3}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    got = {r["word"]: (r["n_near"], r["best"], r["best_n"]) for r in near_words(df, 5).collect()}
    want = {w: m for w, m in brute.near_words(counts).items() if m[0]}
    assert {w: g[:2] for w, g in got.items()} == want
    assert all(g[2] == counts[g[1]] for g in got.values())


def test_variants_of_texts(spark, odd, none):  # noqa: F811
    words = {"colour": 40, "colou": 9, "colouur": 3, "colr": 50, "colouu": 4, "Ünter": 3, "ünter": 9, "naïve": 8, "naive": 4}
    text = " ".join(" ".join([w] * n) for w, n in words.items()) + " COLOUR x×y colour's 9colour9"
    df = spark.createDataFrame([(1, text, "w"), (None, None, "w"), (2, "", "w")], "doc_id long, text string, word string")
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling_variants(df).collect()}
    words["colour"] += 3
    assert got == brute.variants({w: n for w, n in words.items() if len(w) >= 5})
    assert got["colouu"][2:] == ("colour", 43, "colour") and got["Ünter"][2] == "ünter"
    assert spelling_variants(none).count() == 0
    assert spelling_variants(odd).filter("n < 3 or length(word) < 5").count() == 0


def test_words_over_pieces_and_typos(spark, monkeypatch):
    text = " ".join(f"Wörter{'abcdefghij'[k % 10]}" for k in range(400)) + "z" * 300
    want = collections.Counter()
    for run in spelling.RUN.findall(text):
        word = run.translate(spelling._LOWER)
        h = zlib.crc32(f"7:{word}".encode())
        want[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 3 == 0 else word] += 1
    monkeypatch.setattr(spelling, "PIECE", 50)
    assert [p for p in spelling._pieces("aa bb")] == ["aa bb"]
    assert "".join(spelling._pieces(text)) == text and len(list(spelling._pieces(text))) > 40
    df = spark.createDataFrame([(7, text)], "doc_id long, text string")
    assert {r["word"]: r["n"] for r in word_counts(df, 1, 1, 3).collect()} == want
