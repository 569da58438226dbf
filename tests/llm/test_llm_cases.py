"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns, and planted cases."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tilescope.llm.decontaminate import drop_contaminated, find_contamination
from tilescope.llm.html_wrapper import _off, extract_main_text, slots
from tilescope.llm.jaccard_join import ngram_jaccard_join, trie_links
from tilescope.llm.language_id import identify_languages, learn_languages
from tilescope.llm.license_scan import TEMPLATES, scan_licenses, scan_sql
from tilescope.llm.license_texts import LICENSE_TEXTS
from tilescope.llm.mixing import mix_sources
from tilescope.llm.ngram_lm import CODES, EliasFano, TrieShard, quantised, score_texts
from tilescope.llm.queries import _piece_model
from tilescope.llm.token_counts import token_counts
from tilescope.llm.topk_search import exact_top_k, grid_weights
from tilescope.llm.url_filter import host_of, judge_urls, path_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, key string, n int, shard string, size string"
LONG = " ".join(f"word{k % 5000}x" for k in range(60_000))


def passage(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    base = passage(1, 120)
    texts = [
        (1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, "One"), (6, LONG), (7, base), (7, base),
        (8, base + " tail"), (9, base.upper()), (None, base), (None, None), (10, "x\u00e9\u4e2d\U0001f600 \x00 <s>"), (11, "1 2 3!"),
    ]
    rows = [(i, t, "en" if k % 2 else None, None if k % 5 == 0 else f"s{k % 3}", None, "w", "k", k, "s", "z") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_jaccard_join(odd, none):
    got = sorted(map(tuple, ngram_jaccard_join(odd, 5, 0.8).collect()), key=str)
    assert len(got) == odd.count()
    by = {r[0]: r for r in got}
    assert [by[i][2] for i in (1, 2, 3, 4, 5, 6, 7, 8, 9)] == [1, 2, 3, 4, 4, 6, 7, 7, 7]
    assert by[1][1] == by[3][1] == 0 and by[4][1] == 1 and by[7] == (7, 116, 7, 1)
    assert [r[2] for r in got if r[0] is None] == [None, None]
    assert ngram_jaccard_join(none).count() == 0


@pytest.mark.parametrize("threshold", [50, 80, 100])
def test_jaccard_join_in_blocks(spark, monkeypatch, threshold):
    """Many near copies, with clusters cut into small blocks and n-grams met often tied in tasks."""
    import tilescope.llm.jaccard_join as module

    monkeypatch.setattr(module, "CLUSTER_SHINGLES", 2000)
    monkeypatch.setattr(module, "FLUSH_ROWS", 500)
    rng = random.Random(5)
    texts = []
    for i in range(240):
        words = passage(rng.randint(0, 3), 60).split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(60)] = rng.choice("abc") * 3
        texts.append((i, " ".join(words[: rng.randint(50, 60)])))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = {r[0]: tuple(r[1:]) for r in ngram_jaccard_join(df, 3, threshold / 100).collect()}
    assert got == brute.classes(texts, 3, threshold)


def test_jaccard_join_of_copies_in_falling_order(spark):
    """The copy with the smallest id is not the one a task meets first."""
    a, b = passage(11, 40), passage(12, 40)
    texts = [(7, a), (2, a), (5, a + " more"), (30, b + " more"), (21, b), (20, b), (9, passage(13, 40))]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    got = {r[0]: tuple(r[1:]) for r in ngram_jaccard_join(df, 4, 0.85).collect()}
    assert got == brute.classes(texts, 4, 85)
    assert got[2][1:] == got[5][1:] == got[7][1:] == (2, 1)


def test_jaccard_join_ties_all_holders_of_a_cut_n_gram(spark):
    """A short passage in long texts, alone, and with a word more: its n-grams are met often in one task."""
    short, filler = passage(14, 13), passage(15, 97)
    texts = [(i, f"{filler} {short} only{i}") for i in range(15)] + [(15, short)] + [(i, f"{short} last{i}") for i in range(16, 22)]
    texts += [(i, filler) for i in range(100, 200)]  # so that the passage's n-grams are the rarer ones
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    got = {r[0]: tuple(r[1:]) for r in ngram_jaccard_join(df, 4, 0.85).collect()}
    assert got == brute.classes(texts, 4, 85)
    assert got[15] == (10, 15, 6)


def test_jaccard_pairs_tie_whatever_shares_a_marked_n_gram():
    """One task cut the n-gram and sends a marked row; a document of another task is tied, not paired by its size."""
    import pyarrow as pa

    from tilescope.llm.jaccard_join import _pairs

    columns = {"token": [1, 1, 2, 2, 2, 2], "doc": [10, 20, 10, 10, 20, 30], "n": [-1, 3, 50, 50, 3, 3], "tied": [-1] * 6, "has": [False] * 6}
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns.values(), kinds, strict=True)], list(columns))
    got = [tuple(r.values()) for out in _pairs(85, 100)(iter([batch])) for r in out.to_pylist()]
    assert sorted(got) == [(10, 20, 0), (20, 30, 1)]


def test_trie_links():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(80)]
    for num in (30, 60, 90):
        found = {(x, y) for y, xs in trie_links(sets, sets, num, 100) for x in xs.tolist()}
        both = lambda a, b: len(np.intersect1d(a, b))
        assert found == {
            (x, y) for x, a in enumerate(sets) for y, b in enumerate(sets)
            if 100 * both(a, b) >= num * (len(a) + len(b) - both(a, b))
        }


def test_token_counts(spark, odd, none):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=_piece_model())
    rng = random.Random(3)
    more = ["\u2581a \u2581", "a" * 2000, "ab" * 800, " " * 700 + "x", "\u597d" * 600, "<s></s><0x0A>"]
    more += ["".join(rng.choice("ab  e\u00e8t\u2581\n.,1\ufb01\u2163\u597dhTS") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(k, t) for k, t in enumerate(more)], "doc_id long, text string"))
    want = sorted((len((r[1] or "").encode()), len(model.encode(r[1] or ""))) for r in df.collect())
    got = token_counts(df, _piece_model, 100).collect()
    assert sorted((r[1], r[2]) for r in got) == want
    assert all(r[3] == (r[2] > 100) for r in got)
    assert token_counts(none, _piece_model, 1).count() == 0


def test_url_filter(spark):
    urls = [f"http://{h}.example.com/en/{k}" for h in ("bad-place", "fine", "other") for k in range(40)]
    labelled = spark.createDataFrame([(u, "bad" in u) for u in urls] + [(None, True), (urls[0], None)], "url string, bad boolean")
    pages = [
        (1, None), (2, "no host"), (3, "HTTP://X.NET/a?b"), (4, "http://a.example.net/en/x"), (5, "http://example.net/en"),
        (6, "https://www.bad-place.example.com/q#f"), (7, "http://sub.org/fr/"), (8, "http://net"), (9, "http://fine.example.com/de/1"),
        (None, "http://xexample.com/de/"), (9, "http://fine.example.com/de/1"), (10, "http://bad-place.example.com/de/1"),
    ]
    frame = spark.createDataFrame([(*p, "x", "y", "z") for p in pages], "page_id long, url string, host string, key string, tokens string")
    got = sorted(((r["page_id"] or 0, r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(frame, labelled).collect()), key=str)
    assert got == sorted([
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "x.net", "/a", "net/", "block"),
        (4, "a.example.net", "/en/x", "example.net/en/", "allow"), (5, "example.net", "/en", "net/", "block"),
        (6, "www.bad-place.example.com", "/q", None, "block"), (7, "sub.org", "/fr/", "org/fr/", "allow"), (8, "net", "", None, "allow"),
        (9, "fine.example.com", "/de/1", "example.com/de/", "block"), (0, "xexample.com", "/de/", None, "allow"),
        (9, "fine.example.com", "/de/1", "example.com/de/", "block"), (10, "bad-place.example.com", "/de/1", "example.com/de/", "block"),
    ], key=str)
    assert judge_urls(frame, labelled.limit(0)).count() == len(pages)
    assert judge_urls(frame.limit(0), labelled).count() == 0
    assert spark.range(1).select(host_of(F.lit("a://B//c")), path_of(F.lit("a://B//c"))).first() == ("b", "//c")


PAGE = """<html><head><title>t{i}</title></head><body class="home"><header><div class=logo>Site</div></header>
<div id="menu"><a href=1>Home</a></div><div class="cookie-notice">Cookies {i}</div><div class="wrap"><div class="post-content"><h2>Head {i}</h2>
<p>Para&nbsp;one {i} is  long &amp; good<br>more text here.<p>Second <b>bo</b>ld and <a href=x>link</a> {i} with words.<ul><li>one {i}<li>two</ul>
<form><label>name</label></form></div><div class="sidebar">side {i}</div></div><section id=comments><p>A long comment {i}, long indeed, very
long</p></section><footer>foot</footer><script>x="</p><p>no"</script></body></html>"""


def test_html_text(spark):
    pages = [(i, "u", PAGE.format(i=i), "x", "y") for i in range(8)] + [(20, "u", None, "", ""), (21, None, "", "", ""), (None, "u", "plain &lt; text", "", "")]
    pages += [(22, "v", "<div><!-- no --><p>only" + " word" * 30_000, "", ""), (0, "u", PAGE.format(i=0), "x", "y")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, key string, kind string")
    got = extract_main_text(frame, F.col("url")).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(pages)
    for i in range(8):
        assert text[i] == f"Head {i}\nPara one {i} is long & good more text here.\nSecond bold and link {i} with words.\none {i}\ntwo"
    assert text[20] == text[21] == ""
    assert text[22] == "only" + " word" * 30_000
    assert extract_main_text(frame.limit(0), F.col("url")).count() == 0


def test_html_text_of_mixed_templates_and_copies(spark):
    article = "<article><p>Story {i} is told here.</p></article>"
    div = "<div class=wrap><div class=inner><p>Plain page {i} has a text.</p></div></div>"
    other = "<section><div class=shop><p>Item {i}</p></div></section>"
    pages = [(0, "mixed", article.format(i=0))] + [(i, "mixed", div.format(i=f"{i} " + "long " * 30)) for i in range(1, 8)]
    pages += [(i, "mixed", other.format(i=i)) for i in (8, 9)] + [(i, "copies", div.format(i="same")) for i in range(10, 15)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    text = {r["page_id"]: r["text"] for r in extract_main_text(frame, F.col("url")).collect()}
    assert text[0] == "Story 0 is told here."
    assert all(text[i] == " ".join(f"Plain page {i} {'long ' * 30} has a text.".split()) for i in range(1, 8))
    assert [text[i] for i in (8, 9)] == ["Item 8", "Item 9"]
    assert all(text[i] == "Plain page same has a text." for i in range(10, 15))


def test_html_labels_keep_telling_words_and_closed_svg_is_empty():
    box = "<div class='elementor-section elementor-top-section elementor-section-boxed height-default' id='comments'>reader</div>"
    (found,) = slots(box)
    assert _off(found[0])
    assert [s[1] for s in slots("<p>one <svg viewBox='0 0'/> two</p><p>three <math/> four</p>")] == ["one two", "three four"]
    assert [s[1] for s in slots("<p>one <svg><text>x</text></svg> two</p>")] == ["one two"]


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 10), (1, 1), (500, 100), (500, 1 << 50), (1000, 1 << 63)):
        values = np.sort(rng.integers(0, top, n).astype(np.uint64))
        coded = EliasFano(values, top)
        coded.open()
        assert (coded.at(np.arange(n)) == values).all()
        keys = np.r_[values, rng.integers(0, top, 200).astype(np.uint64), np.array([0, top], np.uint64)]
        assert (coded.find(keys) == np.searchsorted(values, keys)).all()


def test_trie_shard():
    rng = np.random.default_rng(4)
    pairs = np.unique(rng.integers(0, 300, (2000, 2)), axis=0)
    count = rng.integers(1, 60, len(pairs)).astype(float)
    trie = TrieShard(pairs[:, 0].astype(np.uint64), pairs[:, 1].astype(np.uint64), count)
    asked = rng.integers(0, 320, (5000, 2)).astype(np.uint64)
    held = {(a, b): n for (a, b), n in zip(pairs.tolist(), count, strict=True)}
    assert trie.look_up(asked[:, 0], asked[:, 1]).tolist() == [held.get((a, b), 0) for a, b in asked.tolist()]


def test_lm_score(odd, none):
    got = score_texts(odd, F.col("doc_id") == 8).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"]}
    assert by[1]["n_tokens"] == by[2]["n_tokens"] == by[3]["n_tokens"] == 1
    assert by[1]["score"] == by[3]["score"]
    assert by[8]["held_out"] and by[8]["n_known"] == by[8]["n_tokens"] - 1
    assert score_texts(none, F.col("doc_id") == 8).count() == 0
    untaught = score_texts(odd, F.lit(True)).collect()
    assert {(r["n_known"], r["train_tokens"], r["base_score"]) for r in untaught} == {(0, 0, 0.0)}


def test_lm_counts_have_no_upper_end(spark):
    counts = np.array([3_736_700.0, 5e6, 4e7, 3e10, 1e15, 2.0**63])
    context, word = np.arange(6, dtype=np.uint64), np.full(6, 9, np.uint64)
    read = CODES[TrieShard(context, word, counts).look_up(context, word)]
    assert (abs(read / counts - 1) < 0.03).all()
    n = 5_000_000  # one word again and again: after it comes the word itself, but for the end
    (got,) = score_texts(spark.range(1).selectExpr("id as doc_id", f"repeat('a ', {n}) as text"), F.lit(False)).collect()
    pair, single = CODES[quantised(np.array([n - 1.0]))[0]], (n + 1) / (n + 1 + 2 + 1)
    assert got["score"] / n == pytest.approx(np.log10(0.2 * min(1, pair / n) + 0.8 * single), abs=1e-4)
    assert abs(min(1, pair / n) - 1) < 0.03


def test_language_id(spark, odd, none):
    taught = spark.createDataFrame(
        [("the cat and the dog are here " * 3, "en"), ("der hund und die katze sind hier " * 3, "de"), (None, "en"), ("x", None)], "text string, lang string"
    )
    model = learn_languages(taught)
    got = identify_languages(odd.withColumn("lang_pred", F.lit("old")), model)
    assert got.columns == [*odd.columns, "lang_pred", "lang_score"]
    by = {r["doc_id"]: r for r in got.collect()}
    assert [by[i]["lang_pred"] for i in (1, 2, 3, 11)] == ["und"] * 4
    assert by[1]["lang_score"] == 0 and got.count() == odd.count()
    seen = identify_languages(spark.createDataFrame([("Die Katze",), ("THE DOG",)], "text string"), model).collect()
    assert [r["lang_pred"] for r in seen] == ["de", "en"]
    assert {r["lang_pred"] for r in identify_languages(odd, learn_languages(taught.limit(0))).collect()} == {"und"}
    assert identify_languages(none, model).count() == 0


def test_mixing(odd, none):
    got = mix_sources(odd).toPandas()
    assert len(got) == odd.count() and (got["taken"] <= 2 * got["size"]).all()
    by = got.fillna({"source": "~"}).groupby("source").agg({"taken": "sum", "target": "first", "source_size": "first", "size": "sum"})
    assert (by["source_size"] == by["size"]).all() and (abs(by["taken"] - by["target"]) <= 32).all()
    assert mix_sources(none).count() == 0
    assert mix_sources(odd.filter("text is null")).toPandas()["target"].tolist() == [0.0, 0.0]


def test_decontamination(spark, odd, none):
    item = passage(9, 30)
    docs = [(1, f"{passage(2, 50)} {item.upper()}, {passage(3, 50)}"), (2, item), (3, passage(4, 200)), (None, item), (5, None), (2, item),
            (6, " ".join(item.split()[:-2])), (7, " ".join(item.split()[::2])), (8, item.replace(" ", ",\n"))]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, words string")
    bench = spark.createDataFrame([(1, item, 0), (2, "too short", 0), (3, None, 0), (4, passage(8, 30), 0)], "item_id long, text string, n int")
    got = sorted((r["doc_id"] or 0, r["item_id"], r["first_word"], r["similarity"]) for r in find_contamination(frame, bench).collect())
    assert [g[:3] for g in got] == [(0, 1, 0), (1, 1, 50), (2, 1, 0), (6, 1, 0), (8, 1, 0)]
    assert got[1][3] == 1.0 and 0.8 <= got[3][3] < 1
    assert sorted(r["doc_id"] for r in drop_contaminated(frame, bench).collect()) == [3, 5, 7]
    assert drop_contaminated(frame, bench.limit(0)).count() == len(docs)
    assert find_contamination(none, bench).count() == 0
    assert drop_contaminated(odd, bench).count() == odd.count()


def test_top_k(spark):
    rng = np.random.default_rng(6)
    vectors = [(i, [float(x) for x in rng.normal(size=rng.integers(1, 6))], "x") for i in range(300)]
    vectors += [(300, None, ""), (301, [1.0, None], ""), (302, [float("nan")], ""), (303, [float("inf")], ""), (None, [1.0], ""), (5, [9.0, 9.0], "")]
    vectors += [(400 + k, [1.0, 1.0], "") for k in range(50)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, weights string")
    rows = frame.select("vec_id", grid_weights(F.col("embedding"), 64).alias("weights"))
    got = exact_top_k(rows, rows.filter("vec_id % 20 = 0"), 7).orderBy("query_id", "rank").collect()
    clean = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v, _ in vectors if i is not None and v and None not in v and np.isfinite(v).all()]
    want = []
    for q, w in clean:
        if q % 20 == 0:
            scored = sorted((-int(np.dot(w[: len(v)], v[: len(w)])), i) for i, v in clean if i != q)[:7]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(scored, 1)]
    assert [tuple(r) for r in got] == sorted(want)
    assert exact_top_k(rows.limit(0), rows, 7).count() == 0
    few = rows.filter("vec_id < 4")
    assert exact_top_k(few, few.filter("vec_id = 0"), 7).count() == 3


def test_long_pre_tokens_are_merged_in_arrays(monkeypatch):
    """Long pre-tokens against the library: chains of one letter, pieces in a row, unknown characters; no order is lost."""
    import sentencepiece

    from tilescope.llm import token_counts as module

    path = _piece_model()
    model, table = sentencepiece.SentencePieceProcessor(model_file=path), module.MergeTable(path)
    rng = random.Random(8)
    pieces = [model.id_to_piece(k) for k in range(300, model.vocab_size(), 7)]
    pieces = [p for p in pieces if module.SPACE not in p]
    alphabets = [pieces, list("abehinorst"), list("aah"), ["a", "\u00e9", "\u6f22", "\u5b57", "\U0001f600", "\n", "==", "the", "ing", "aaaa"]]
    words = [" " + "".join(rng.choice(alphabets[k % 4]) for _ in range(rng.randint(150, 900))) for k in range(80)]
    want = [len(model.encode(w[1:])) for w in words]
    monkeypatch.setattr(module, "LONG", 2)  # all of them, and several sweeps
    monkeypatch.setattr(module, "SWEEP", 9_000)
    assert table.counts(words).tolist() == want
    whole = " " + "a" * 200_000 + "".join(words).replace(" ", "")
    assert table.counts([whole, " b"]).tolist() == [len(model.encode(whole[1:])), len(model.encode("b"))]



def test_license_scan(spark, odd, none):
    got = scan_licenses(odd).collect()
    assert len(got) == odd.count()
    assert all(r["labels"] == "" and r["score"] == 0 and r["first_word"] is None for r in got)
    texts = ["x Under the MIT-License, under the mit license", "Apache License, Version 2.0", "cc by-nc", "the GNU general public; license version 3 licensed under",
             "permission granted", "All rights\nreserved " * 3, "under the mit", "a" + " b" * 50_000 + " cc by nc"]
    rows = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows] == [
        (2, 1, 5, "mit"), (1, 0, 0, "apache-2"), (1, 0, 0, "cc-by-nc"), (0, None, None, ""), (0, None, None, ""),
        (0, None, None, ""), (0, None, None, ""), (1, 50_001, 50_001, "cc-by-nc")]
    assert [r["labels"] for r in rows][3:6] == ["gpl-3", "", "all-rights-reserved"]
    assert rows[5]["blocks"][0]["first_word"] == 0 and rows[5]["score"] == 1.0
    assert scan_licenses(none).count() == 0


def _contained(templates, words, threshold):
    """(label, first word) of blocks by trying every place of every template."""
    found = set()
    for label, text in templates:
        template = set(_plain(text))
        width, need = -(-5 * len(_plain(text)) // 4), int(np.ceil(threshold * len(template) - 1e-9))
        for k, word in enumerate(words):
            if word in template and len(template.intersection(words[k : k + width])) >= need:
                found.add((label, k))
    return found


def _plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def test_whole_licences_against_every_block(spark):
    """Licences inside prose, rewrapped, with words left out or put between; labels, places and SQL."""
    import duckdb

    rng = random.Random(11)
    texts = ["", None, "the software is provided as is " * 30]
    for label, text in LICENSE_TEXTS:
        words = text.split()
        few = [w for w in words if rng.random() > 0.04]
        half = [w for w in words if rng.random() > 0.5]
        mixed = [x for w in words for x in ([w, "zebra"] if rng.random() < 0.1 else [w])]
        texts += [f"{passage(1, 40)}\n{text} {passage(2, 9)}", " ".join(few), " ".join(half), "\n * ".join(mixed).upper(), text * 2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in scan_licenses(df).collect()}
    for k, text in enumerate(texts):
        want = _contained(TEMPLATES, _plain(text or ""), 0.9)
        assert {(b["label"], b["first_word"]) for b in got[k]["blocks"]} == want
    for k, (label, _) in enumerate(LICENSE_TEXTS):
        assert label in got[3 + 5 * k]["labels"].split(",") and label in got[7 + 5 * k]["labels"].split(",")
        assert label not in got[5 + 5 * k]["labels"].split(","), "half a licence is none"
    documents = df.toPandas()  # noqa: F841
    sql = duckdb.sql(scan_sql()).fetchall()
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels"]
    assert sorted(r[:7] for r in sql) == sorted(tuple(got[k][n] for n in names) for k in got)


def test_pipeline_stages_take_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, passage(1, 40))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    counts = []
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
        assert name == "mix" or docs.columns == odd.columns
    assert counts[0] > counts[1] > counts[2] == counts[3]


def test_top_k_blocks_that_begin_with_the_same_id(spark, monkeypatch):
    """Blocks of equal length whose first rows repeat an id are different blocks."""
    import tilescope.llm.topk_search as module

    monkeypatch.setattr(module, "BLOCK_ROWS", 2)
    rows = [(5, [1, 1]), (6, [2, 2]), (5, [1, 1]), (9, [7, 7]), (5, [3, 3]), (11, [5, 5])]
    vectors = spark.createDataFrame(rows, "vec_id long, weights array<long>").coalesce(1)
    queries = spark.createDataFrame([(1, [1, 1]), (5, [1, 1])], "vec_id long, weights array<long>")
    got = sorted(map(tuple, exact_top_k(vectors, queries, 4).collect()))
    assert got == [(1, 1, 9, 14), (1, 2, 11, 10), (1, 3, 5, 6), (1, 4, 6, 4), (5, 1, 9, 14), (5, 2, 11, 10), (5, 3, 6, 4)]


def test_jaccard_pairs_of_copies_over_batch_borders():
    """Rows of one n-gram fill a batch with copies of few sets: all pairs are formed, as in one batch."""
    import pyarrow as pa

    from tilescope.llm.jaccard_join import _pairs

    docs = [d for d in range(40) for _ in range(8)] + [40]

    def batches(cuts):
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            n = end - begin
            columns = {"token": [7] * n, "doc": docs[begin:end], "n": [30] * n, "tied": [-1] * n, "has": [False] * n}
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns.values(), kinds, strict=True)], list(columns))

    want = {(a, b) for b in range(41) for a in range(b)}
    for cuts in ([0, 321], [0, 320, 321], [0, 100, 300, 321]):
        got = [tuple(r.values()) for out in _pairs(85, 100)(batches(cuts)) for r in out.to_pylist()]
        assert {(a, b) for a, b, _ in got} == want and all(e > 0 for *_, e in got)


def test_url_rules_of_long_slugs(spark):
    """Six bad urls share a slug of 25 words, alone and with words that good urls hold too; rules are few and match."""
    slug = "-".join(f"w{c}" for c in "abcdefghijklmnopqrstuvwxy")
    often = "-".join(f"o{c}" for c in "abcdefghijklmnopqrstuvwxy")
    bad = [f"http://a.example.com/{slug}/{often}/{k}" for k in range(6)]
    good = [f"http://a.example.com/x/{often}/{k}" for k in range(6)] + [f"http://a.example.com/y/{k}" for k in range(30)]
    labelled = spark.createDataFrame([(u, True) for u in bad] + [(u, False) for u in good], "url string, bad boolean")
    pages = spark.createDataFrame(
        [(1, f"http://b.example.com/{slug}"), (2, "http://b.example.com/wc"), (3, f"http://b.example.com/{often}"), (4, "http://a.example.com/y/1")],
        "page_id long, url string",
    )
    assert [(r["page_id"], r["mined"]) for r in judge_urls(pages, labelled).orderBy("page_id").collect()] == [(1, True), (2, True), (3, False), (4, False)]


def test_url_rules_equal_all_combinations(spark):
    """Mined rules against counting every combination of tokens."""
    import itertools

    from tilescope.llm.url_filter import match_rules, mine_rules

    rng = random.Random(12)
    sets = [(sorted(rng.sample("abcdefg", rng.randint(1, 5))), rng.random() < 0.5) for _ in range(60)]
    sets += [(sorted({*t, "x", "y"} if "a" in t and "b" in t else t), bad) for t, bad in sets]
    sets += [(["a", "b", "x", "y"], True)] * 12
    df = spark.createDataFrame(sets, "tokens array<string>, bad boolean")
    rules = []
    for n in range(1, 5):
        for combo in itertools.combinations("abcdefgxy", n):
            seen = [bad for t, bad in sets if set(combo) <= set(t)]
            if sum(seen) >= 6 and sum(seen) >= 0.7 * len(seen) and not any(set(r) < set(combo) for r in rules):
                rules.append(combo)
    assert rules and any(len(r) > 1 for r in rules)
    asked = [list(c) for n in range(1, 6) for c in itertools.combinations("abcdefgxy", n)]
    keyed = spark.createDataFrame([("".join(t), t) for t in asked], "key string, tokens array<string>")
    got = {r["key"] for r in match_rules(keyed, *mine_rules(df, 6, 0.7)).collect()}
    assert got == {"".join(t) for t in asked if any(set(r) <= set(t) for r in rules)}


def test_decontamination_recall_and_slim_joins(spark, monkeypatch):
    """Edited passages with similarities about the threshold: every pair of 0.8 or more is found, with and without broadcasts."""
    import re

    import tilescope.llm.decontaminate as module

    rng = random.Random(21)
    items = [(k, passage(400 + k, rng.randint(12, 60))) for k in range(25)]
    docs = []
    for k, text in items:
        for copy in range(24):
            words = text.split()
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = "changed"
            docs.append((len(docs), f"{passage(900 + k, 7)} {' '.join(words)} {passage(950 + copy, 9)}"))

    def words(text):
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(text)) if w]

    def shingles(w):
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}

    want, near = {}, 0
    for i, text in docs:
        w = words(text)
        for item, other in items:
            o = words(other)
            # The windows that a shared shingle lines up with the item.
            shared = [(p, q) for p in range(len(w) - 4) for q in range(len(o) - 4) if w[p : p + 5] == o[q : q + 5]]
            starts = {max(0, min(p - q, len(w) - len(o))) for p, q in shared}
            sets = [shingles(w[start : start + len(o)]) for start in starts]
            best = max((sum(map(len, a & shingles(o))) / sum(map(len, a | shingles(o))) for a in sets), default=0)
            near += 0.8 <= best < 0.9
            if best >= 0.8:
                want[i, item] = best
    assert near > 20
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for limit in (module.BROADCAST_BYTES, 0):
        monkeypatch.setattr(module, "BROADCAST_BYTES", limit)
        got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in find_contamination(df, bench).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
