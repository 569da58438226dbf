"""Registered queries against their SQL, or against brute force over the same whole tables."""

import html
import re
import zlib

import duckdb
import numpy as np
import pytest

from tests.conftest import ROOT, TABLES
from tests.llm import brute
from tests.test_queries import rows
from tilescope.llm.mixing import mixing_sql
from tilescope.llm.ngram_lm import CODES, WEIGHT, quantised
from tilescope.llm.queries import OP8_SQL, all_queries

SMALL = "/root/testdata/sf0.001"
QUERIES = all_queries()


def texts(folder):
    return duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall()


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_equals_sql(spark, duck, name):
    result = QUERIES[name].run(spark, ROOT)
    expected = duck.execute(QUERIES[name].sql)
    names = [c[0] for c in expected.description]
    order = sorted(names)
    assert sorted(result.columns) == order
    want = rows(expected.fetchall(), names, order)
    assert want and rows(result.collect(), result.columns, order) == want


def test_jaccard_join(spark):
    got = {r[0]: tuple(r[1:]) for r in QUERIES["op1_ngram_jaccard_join"].run(spark, ROOT).collect()}
    assert got == brute.classes(texts(ROOT), 4, 85)


def test_token_counts(spark):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r[0]: tuple(r[1:]) for r in QUERIES["op2_token_counts"].run(spark, ROOT).collect()}
    for i, t in texts(ROOT):
        n = len(model.encode(t or ""))
        assert got[i] == (len((t or "").encode()), n, n > 4096)


def test_html_text(spark):
    got = {r["page_id"]: r for r in QUERIES["op4_html_text"].run(spark, ROOT).collect()}
    pages = duckdb.sql(f"SELECT page_id, html FROM '{ROOT}/pages.parquet'").fetchall()
    assert len(got) == len(pages)
    for i, page in pages:
        article = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>|<br>", article)
        lines = (" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in blocks)
        assert got[i]["text"] == "\n".join(x for x in lines if x)
        assert got[i]["n_chars"] == len(got[i]["text"])


def test_lm_score(spark):
    want = brute.lm_scores(texts(ROOT), WEIGHT, lambda n: CODES[quantised(np.array([float(n)]))[0]])
    got = QUERIES["op5_lm_score"].run(spark, ROOT).collect()
    assert len(got) == len(want)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[r["doc_id"]][:3]
        assert r["base_score"] == pytest.approx(want[r["doc_id"]][3], rel=1e-9)
        assert r["score"] == pytest.approx(want[r["doc_id"]][4], rel=1e-9)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_id(spark):
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{ROOT}/documents.parquet'").fetchall())
    got = QUERIES["op6_language_id"].run(spark, ROOT).collect()
    assert len(got) == len(lang)
    assert all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_mix_meets_its_targets(spark):
    got = QUERIES["op7_mix_sources"].run(spark, ROOT).toPandas()
    assert (got["taken"] <= 2 * got["size"]).all()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert (abs(by["taken"] - by["target"]) <= 32).all()
    assert abs(by["target"].sum() - 1.5 * by["size"].sum()) < 1
    again = QUERIES["op7_mix_sources"].run(spark, ROOT).toPandas()
    assert dict(zip(got["doc_id"], got["taken"], strict=True)) == dict(zip(again["doc_id"], again["taken"], strict=True))


def test_pipeline(spark):
    """run() against its stages in plain form, over the whole small tables."""
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SMALL).collect()
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    reach = brute.classes(texts(SMALL), 5, 80)  # every document holds words of its language, so the first stage keeps all
    kept = [i for i, (_, c, _) in reach.items() if i == c]
    leaked = {r[0] for r in con.execute(f"SELECT doc_id FROM ({OP8_SQL})").fetchall()}
    kept = [i for i in kept if i not in leaked]
    con.execute("CREATE TABLE left_over AS SELECT * FROM documents WHERE doc_id IN (SELECT unnest(?))", [kept])
    want = con.execute(mixing_sql("left_over"))
    names = [c[0] for c in want.description]
    assert rows(got, list(got[0].asDict()), sorted(names)) == rows(want.fetchall(), names, sorted(names))
    assert 0 < len(got) < len(reach)
