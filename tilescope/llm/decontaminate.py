"""Benchmark decontamination by SimHash over item-sized windows.

Words are runs of digits, letters and non-ASCII characters, A-Z as a-z; shingles are five consecutive
words and weigh their number of characters. A window of a document has as many words as an item.

1. Windows that share no shingle with any item have similarity 0. A shared shingle puts the item's
   start at one place of the document: that window is taken, once.
2. Windows and items get 60-bit SimHash fingerprints from their weighted shingles.
3. The fingerprints are cut into 30 blocks of 2 bits, and windows meet the items of their size in any
   equal block: within a Hamming distance of 29 at least one block is equal. Sets of similarity 0.8 lie
   at 9 of 60 bits in the mean, with a deviation of 3, so the radius is seven deviations away.
4. A pair within the radius is verified by the exact weighted Jaccard similarity of its shingle sets.

Only DataFrame operations. Places meet marks in a join of slim rows (key, place, hash), and texts are fetched
for what was hit. What comes from the items or the hits is broadcast if its bytes are counted and few.

Items of fewer than five words hold no shingle and contaminate nothing; a document with fewer words
than an item is one window with all its words. Null texts hold nothing. A null id is reported as
null. Repeated rows give one row per (doc_id, text, item). Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilescope.llm.common import lower_ascii, stored

WIDTH = 5
BITS = 60
BLOCKS = 30  # of two bits each
RADIUS = BLOCKS - 1
THRESHOLD = 0.8
BROADCAST_BYTES = 64 << 20
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def _places(words: str) -> str:
    return f"if(size({words}) >= {WIDTH}, sequence(0, size({words}) - {WIDTH}), cast(array() as array<int>))"


def _hashed(words: str) -> Column:
    """Hash of every shingle in order."""
    parts = ", ".join(f"{words}[i + {k}]" for k in range(WIDTH))
    return F.expr(f"transform({_places(words)}, i -> xxhash64({parts}))")


def _shingles(words: str) -> Column:
    """Distinct shingles as text."""
    return F.expr(f"array_distinct(transform({_places(words)}, i -> array_join(slice({words}, i + 1, {WIDTH}), ' ')))")


def _fingerprint(shingles: str) -> Column:
    """60 bits: the sign of the weighted sum of every bit over the shingles' md5."""
    pairs = f"transform({shingles}, s -> struct(cast(conv(substr(md5(s), 1, {BITS // 4}), 16, 10) as bigint) as h, length(s) as w))"
    total = "aggregate(p, 0L, (t, x) -> t + x.w * (2L * (shiftright(x.h, b) & 1L) - 1L))"
    bits = f"transform(array({pairs}), p -> aggregate(sequence(0, {BITS - 1}), 0L, (f, b) -> if({total} > 0, f | shiftleft(1L, b), f)))"
    return F.expr(f"{bits}[0]")


def _weight(shingles: str) -> str:
    return f"aggregate({shingles}, 0L, (t, s) -> t + length(s))"


def _small(df: DataFrame, n_bytes: int) -> DataFrame:
    return F.broadcast(df) if n_bytes <= BROADCAST_BYTES else df


def _windows(docs: DataFrame, marks: DataFrame, mark_bytes: int) -> DataFrame:
    """(doc_id, text_key, n, s, window) of docs(doc_id, text): where a mark puts an item's start.

    Only keys, places and hashes meet the marks; a text is read again, and cut into words once, if it was hit.
    """
    key = F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "text").alias("key")
    docs = docs.select("doc_id", "text", key)
    words = docs.select("key", plain_words(F.col("text")).alias("words"))
    places = words.select("key", F.posexplode(_hashed("words")).alias("p", "h"))
    hits = places.join(_small(marks, mark_bytes), "h").groupBy("key").agg(
        F.collect_set(F.struct((F.col("p") - F.col("q")).alias("start"), "n")).alias("hits")
    )
    hits = stored(hits)
    hit_bytes = hits.agg(F.coalesce(F.sum(F.lit(64) + 16 * F.size("hits")), F.lit(0))).first()[0]
    hit = docs.join(_small(hits, hit_bytes), "key").withColumn("words", plain_words(F.col("text")))
    hit = hit.select("doc_id", F.xxhash64("text").alias("text_key"), "words", F.inline("hits"))
    start = F.greatest(F.lit(0), F.least(F.col("start"), F.size("words") - F.col("n")))
    cut = F.array_join(F.expr("slice(words, s + 1, n)"), " ").alias("window")
    return hit.withColumn("s", start).select("doc_id", "text_key", "n", "s", cut).distinct()


def find_contamination(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_key, item_id, first_word, n_words, similarity) of every document and item it holds.

    documents(doc_id, text), benchmark(item_id, text). text_key is the hash of the document's text; the
    window is the most similar one, the first if several are.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), plain_words(F.col("text")).alias("iw"))
    items = items.filter(F.size("iw") >= WIDTH).withColumn("n", F.size("iw")).withColumn("item_shingles", _shingles("iw"))
    items = items.withColumn("item_key", F.xxhash64(F.coalesce("item_id", F.lit(0)), F.col("item_id").isNull(), "iw"))
    items = stored(items.dropDuplicates(["item_key"]).withColumn("item_print", _fingerprint("item_shingles")))
    size = F.sum(F.aggregate("item_shingles", F.lit(0).cast("long"), lambda t, x: t + F.octet_length(x) + 24))
    n_items, item_bytes = items.agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    marks = stored(items.select("n", F.posexplode(_hashed("iw")).alias("q", "h")).distinct())
    mark_bytes = 32 * marks.count()

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    windows = _windows(docs.filter("text is not null"), marks, mark_bytes)
    windows = windows.withColumn("window_words", F.split("window", " ")).withColumn("shingles", _shingles("window_words"))
    windows = windows.withColumn("print", _fingerprint("shingles")).drop("window", "window_words")

    def blocks(print_: str) -> Column:
        pair = f"cast(shiftright({print_}, 2 * b) & 3L as int)"
        return F.explode(F.expr(f"transform(sequence(0, {BLOCKS - 1}), b -> struct(b, {pair} as d))")).alias("block")

    index = items.select(F.col("n").alias("i_n"), "item_id", "item_key", "item_print", blocks("item_print").alias("i_block"))
    probes = windows.select("*", blocks("print"))
    met = probes.join(_small(index, 64 * BLOCKS * n_items), (F.col("n") == F.col("i_n")) & (F.col("block") == F.col("i_block")))
    met = met.withColumn("x", F.col("print").bitwiseXOR(F.col("item_print")))
    # A pair is met in every equal block; the first stands for it.
    first = F.expr(f"filter(sequence(0, {BLOCKS - 1}), b -> (shiftright(x, 2 * b) & 3L) = 0)[0]")
    met = met.filter((F.bit_count("x") <= RADIUS) & (first == F.col("block.b")))
    met = met.join(_small(items.select("item_key", "item_shingles"), item_bytes), "item_key")
    both = F.expr(_weight("array_intersect(shingles, item_shingles)"))
    either = F.expr(_weight("array_union(shingles, item_shingles)"))
    met = met.withColumn("similarity", both / either).filter(F.col("similarity") >= threshold)
    best = F.max(F.struct("similarity", (-F.col("s")).alias("back"), "n")).alias("best")
    return (
        met.groupBy("doc_id", "text_key", "item_id")
        .agg(best)
        .select(
            "doc_id",
            "text_key",
            "item_id",
            (-F.col("best.back")).cast("long").alias("first_word"),
            F.col("best.n").cast("long").alias("n_words"),
            F.col("best.similarity").alias("similarity"),
        )
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents that hold no benchmark item."""
    found = find_contamination(documents, benchmark, threshold).select(
        F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")
    )
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_key"))
    return documents.join(found.distinct(), same, "left_anti")


def contamination_sql(docs: str = "documents") -> str:
    """(doc_id, text, item_id, first_word, n_words, similarity) over a relation, without fingerprints: windows with a shared shingle, exactly."""
    lower = "translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

    def shingles(w: str) -> str:
        return f"list_transform(range(1, len({w}) - 3), lambda i: array_to_string({w}[i : i + 4], ' '))"

    weight = "list_sum(list_transform({}, lambda s: length(s)))"
    return f"""
item0 AS (
  SELECT item_id, {words} AS w FROM benchmark
), item AS (
  SELECT *, len(w) AS n, list_distinct({shingles("w")}) AS sh FROM item0 WHERE len(w) >= 5
), marks AS (
  SELECT DISTINCT n, sh1 AS sh, q FROM (
    SELECT n, unnest({shingles("w")}) AS sh1, unnest(range(0, len(w) - 4)) AS q FROM item)
), doc AS (
  SELECT doc_id, text, {words} AS w FROM {docs} WHERE text IS NOT NULL
), placed AS (
  SELECT doc_id, text, w, unnest({shingles("w")}) AS sh, unnest(range(0, len(w) - 4)) AS p FROM doc WHERE len(w) >= 5
), win AS (
  SELECT DISTINCT doc_id, text, n, greatest(0, least(p - q, len(w) - n)) AS s,
    w[greatest(0, least(p - q, len(w) - n)) + 1 : greatest(0, least(p - q, len(w) - n)) + n] AS ww
  FROM placed JOIN marks ON placed.sh = marks.sh
), wins AS (
  SELECT *, list_distinct({shingles("ww")}) AS sh FROM win
), met AS (
  SELECT wins.doc_id, wins.text, item_id, wins.s, wins.n,
    CAST({weight.format("list_intersect(wins.sh, item.sh)")} AS DOUBLE)
      / {weight.format("list_distinct(list_concat(wins.sh, item.sh))")} AS similarity
  FROM wins JOIN item ON wins.n = item.n
), leaked AS (
  SELECT * FROM met WHERE similarity >= 0.8
  QUALIFY row_number() OVER (PARTITION BY doc_id, text, item_id ORDER BY similarity DESC, s) = 1
)"""
