"""The registered query of every operator, with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilescope.llm.common import fold_of, words_of
from tilescope.llm.decontaminate import contamination_sql, find_contamination
from tilescope.llm.html_wrapper import extract_main_text
from tilescope.llm.interleave import shard_documents, sharding_sql
from tilescope.llm.jaccard_join import ngram_jaccard_join
from tilescope.llm.language_id import identify_languages, learn_languages
from tilescope.llm.license_scan import scan_licenses, scan_sql
from tilescope.llm.mixing import mix_sources, mixing_sql
from tilescope.llm.ngram_lm import score_texts
from tilescope.llm.periodic import find_runs
from tilescope.llm.registry import REGISTRY, query, read
from tilescope.llm.spelling import spelling_variants, variants_sql
from tilescope.llm.token_counts import token_counts
from tilescope.llm.topk_search import exact_top_k, grid_weights
from tilescope.llm.url_filter import host_of, judge_urls, path_of


def all_queries():
    return REGISTRY


@query("op1_ngram_jaccard_join")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_jaccard_join(read(spark, folder, "documents"), width=4, threshold=0.85)


def _piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op2_token_counts")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(read(spark, folder, "documents"), _piece_model, limit=4096)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op9_exact_top_k", OP9_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "embeddings").select("vec_id", grid_weights(F.col("embedding"), 64).alias("weights"))
    return exact_top_k(rows, rows.filter("vec_id % 20 = 0"), k=20)


@query("op7_mix_sources", mixing_sql())
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(read(spark, folder, "documents"))


OP3_SQL = r"""
WITH p AS (
  SELECT page_id, COALESCE(url, '') AS u FROM pages
), parts AS (
  SELECT page_id, u,
    translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM p
), tok AS (
  SELECT *, list_sort(list_distinct(list_concat(
    list_transform(regexp_extract_all(host, '[a-z0-9]+'), lambda w: 'h:' || w),
    list_transform(list_filter(regexp_extract_all(
      translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+'),
      lambda w: regexp_full_match(w, '[a-z]+')), lambda w: 'p:' || w)))) AS tokens,
    TRY_CAST(regexp_extract(path, '/([0-9]{1,18})(?:[./]|$)', 1) AS BIGINT) AS doc
  FROM parts
), lab AS (
  SELECT tokens, max(toxic) = 1 AS bad FROM tok JOIN labels ON labels.doc_id = tok.doc
  WHERE toxic IS NOT NULL GROUP BY page_id, u, tokens
), sub AS (
  SELECT bad, list_filter(tokens, lambda t, i: (m >> (i - 1)) & 1 = 1) AS rule
  FROM (SELECT bad, tokens, unnest(range(1, 1 << len(tokens))) AS m FROM lab)
), rules AS (
  SELECT rule FROM sub GROUP BY rule
  HAVING sum(CAST(bad AS INT)) >= 6 AND sum(CAST(bad AS INT)) >= 0.7 * count(*)
), hit AS (
  SELECT DISTINCT tokens FROM (SELECT DISTINCT tokens FROM tok) s JOIN rules r ON list_has_all(s.tokens, r.rule)
), given AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM tok
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN hit.tokens IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM given LEFT JOIN hit ON given.tokens = hit.tokens
"""


@query("op3_url_filter", OP3_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages").select("page_id", "url")
    # A page's path ends in the id of its document; the document's label is the url's.
    doc = F.expr(r"try_cast(regexp_extract(path, '/([0-9]{1,18})(?:[./]|$)', 1) as bigint)")
    numbered = pages.withColumn("path", path_of(F.col("url"))).withColumn("doc", doc)
    labels = read(spark, folder, "labels").filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labelled = numbered.join(labels, numbered["doc"] == labels["doc_id"]).select("url", (F.col("toxic") == 1).alias("bad"))
    return judge_urls(pages, labelled).select("page_id", "host", "path", "rule", "verdict")


@query("op10_license_scan", scan_sql())
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(read(spark, folder, "documents")).drop("blocks")


@query("op6_language_id")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"),
        F.col("text").cast("string").alias("text"),
        "lang",
    )
    model = learn_languages(documents.filter("not held_out"))
    found = identify_languages(documents.drop("lang"), model)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


OP8_SQL = f"""
WITH {contamination_sql()}
SELECT doc_id, item_id, CAST(s AS BIGINT) AS first_word, CAST(n AS BIGINT) AS n_words, similarity FROM leaked
"""


@query("op8_decontaminate", OP8_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return find_contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark")).drop("text_key")


@query("op4_html_text")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = extract_main_text(read(spark, folder, "pages"), host_of(F.col("url")))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query("op5_lm_score")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return score_texts(read(spark, folder, "documents"), fold_of(F.col("doc_id"), 7) == 2)


@query("op11_spelling_variants", variants_sql(97))
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(read(spark, folder, "documents"), typo_every=97)


@query("op12_shard_mix", sharding_sql())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(read(spark, folder, "documents"), shards=8)


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """(doc_id, text): texts of the documents whose crc32(doc_id) ends in 0 become periodic from a place on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("h", h).withColumn("w", F.when(F.col("h") % 10 == 0, words_of(F.col("text"))))
    rows = rows.withColumns({"n": F.size("w"), "g": F.expr("h div 10")})
    rows = rows.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    rows = rows.withColumn("p", (F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)) + 1).cast("int"))
    tail = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    planted = F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), F.col("n") - F.col("a")))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    found = find_runs(with_planted_runs(read(spark, folder, "documents")))
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    longer = lambda b, r: b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"])
    best = F.aggregate("runs", none, lambda b, r: F.when(longer(b, r), r).otherwise(b))
    line = lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.*",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
