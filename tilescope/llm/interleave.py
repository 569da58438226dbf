"""Sharding by proportional stratified interleaving.

Rows of a stratum (a source) stand in seeded order. A row's fractional rank is its place in that order,
plus a seeded part of a step of its own for every stratum, over the stratum's size: a stratum's rows lie
evenly in [0, 1), and many small strata do not meet in one point. All rows sorted by fractional rank are
cut into shards of equal count (law `rows`: counts at most one apart). A stretch of the order holds of each
stratum its share up to a row or two, so every shard has the mixture of the whole.

Only DataFrame operations. Both orders are exact and nothing is ordered in one task: a row's place is its
place in a cell plus the rows of the cells before it. Cells of the first order are equal ranges of the
seeded hash, those of the second equal ranges of the fractional rank; a cell has at most about CELL_ROWS rows
however large its stratum, and joins are by cell. Running sums go over counts of cells, and inside blocks of
BLOCK_CELLS cells first: a task adds up at most rows / (CELL_ROWS * BLOCK_CELLS) numbers at a time beyond that.

The order depends on seed, id and text, not on how rows are dealt. Rows equal in all of these are
interchangeable. A null source is a stratum of its own, a null text has no bytes, null ids are ids like
others. An empty table gives no rows; with fewer rows than shards some shards are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilescope.llm.common import stored

CELL_ROWS = 2048
BLOCK_CELLS = 4096
SEED = 20240817
LAW = "rows"


def _unit(digits: Column) -> Column:
    """The first 32 bits of hexadecimal digits as a double in [0, 1)."""
    return F.conv(F.substring(digits, 1, 8), 16, 10).cast("long").cast("double") / float(1 << 32)


def _seeded(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def _ahead(sizes: DataFrame, group: list[str]) -> DataFrame:
    """sizes(group, cell, n) as (_group, _cell, n, before): rows of the whole group, and of its cells before this one."""

    def before(*keys: str):
        return Window.partitionBy(F.lit(0), *keys).rowsBetween(Window.unboundedPreceding, -1)

    sizes = sizes.withColumn("block", F.expr(f"cell div {BLOCK_CELLS}"))
    blocks = sizes.groupBy(*group, "block").agg(F.sum("n").alias("m"))
    blocks = blocks.select(
        *(F.col(c).alias(f"_{c}") for c in group),
        F.col("block").alias("_block"),
        F.sum("m").over(Window.partitionBy(F.lit(0), *group)).alias("whole"),
        F.coalesce(F.sum("m").over(before(*group).orderBy("block")), F.lit(0)).alias("earlier"),
    )
    same = F.col("block") == F.col("_block")
    for c in group:
        same &= F.col(c) == F.col(f"_{c}")
    within = F.coalesce(F.sum("n").over(before(*group, "block").orderBy("cell")), F.lit(0))
    return sizes.withColumn("within", within).join(blocks, same).select(
        *(f"_{c}" for c in group), F.col("cell").alias("_cell"), F.col("whole").alias("n"), (F.col("earlier") + F.col("within")).alias("before")
    )


def interleaved(rows: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(row, shard, slot) of rows(stratum string, identity string, row struct); slots run from 0 in every shard.

    identity tells rows of a stratum apart; rows that share it have any order among themselves.
    """
    n_rows = rows.count()
    cells = max(1, -(-n_rows // CELL_ROWS))
    r = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("stratum")), F.lit("")).alias("skey"),
        _seeded(seed, F.coalesce("identity", F.lit("null"))).alias("digits"),
        "row",
    ).withColumn("cell", F.floor(_unit(F.col("digits")) * cells).cast("int"))
    sizes = _ahead(r.groupBy("skey", "cell").agg(F.count("*").alias("n")), ["skey"])
    r = r.join(sizes, (F.col("skey") == F.col("_skey")) & (F.col("cell") == F.col("_cell")))
    within = Window.partitionBy("skey", "cell").orderBy("digits")
    place = (F.col("before") + F.row_number().over(within) - 1).cast("double")
    rank = (place + _unit(_seeded(seed, F.col("skey")))) / F.col("n").cast("double")
    r = stored(r.select("skey", "digits", "row", rank.alias("rank")))
    r = r.withColumn("cell", F.least(F.lit(cells - 1), F.floor(F.col("rank") * cells)).cast("int"))
    sizes = _ahead(r.groupBy("cell").agg(F.count("*").alias("n")), [])
    r = r.join(sizes.drop("n"), F.col("cell") == F.col("_cell"))
    within = Window.partitionBy("cell").orderBy("rank", "digits", "skey")
    r = r.withColumn("place", F.col("before") + F.row_number().over(within) - 1)
    # Shard s has the places p with floor(p * shards / n) = s; its first is ceil(s * n / shards).
    r = r.withColumn("shard", F.expr(f"place * {shards} div {max(1, n_rows)}").cast("int"))
    first = F.expr(f"(shard * {n_rows}L + {shards - 1}) div {shards}")
    return r.select("row", "shard", (F.col("place") - first).cast("long").alias("slot"))


def _text(documents: DataFrame) -> Column:
    return F.coalesce(documents["text"].cast("string"), F.lit(""))


def _strata(documents: DataFrame, row: Column) -> DataFrame:
    identity = F.concat_ws(
        ":", F.coalesce(documents["doc_id"].cast("string"), F.lit("null")), F.crc32(_text(documents).cast("binary")).cast("string")
    )
    return documents.select(documents["source"].cast("string").alias("stratum"), identity.alias("identity"), row.alias("row"))


def shard_documents(documents: DataFrame, shards: int = 8, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, text_crc32, law, shard, slot, grown_shard) of every row of documents(doc_id, text, source)."""
    text = _text(documents)
    row = F.struct(
        documents["doc_id"].cast("long").alias("doc_id"),
        documents["source"].cast("string").alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = interleaved(stored(_strata(documents, row)), shards, seed)
    return placed.select(
        "row.*", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(documents: DataFrame, path: str, shards: int = 8, seed: int = SEED) -> None:
    """Whole rows of documents as Parquet, in folders shard=0 and so on; column `slot` is a row's place in its shard.

    The files of a shard hold consecutive ranges of slots, so reading them in order gives the shard's order.
    """
    names = [c for c in documents.columns if c.lower() not in ("shard", "slot")]
    row = F.struct(*(documents[f"`{c}`"].alias(c) for c in names))
    placed = interleaved(_strata(documents, row), shards, seed).select("row.*", "shard", "slot")
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


#: shard_documents over a relation documents. CRC-32 is folded byte by byte through its table of 256 remainders.
CRC_TABLE_SQL = """bits(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8)"""


def crc_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8, beside a row of crc_table."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce({octets}, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295), 4294967295)"


def sharding_sql(shards: int = 8, seed: int = SEED) -> str:
    return f"""
WITH RECURSIVE {CRC_TABLE_SQL}, d AS (
  SELECT doc_id, COALESCE('=' || source, '') AS skey, source, CAST(octet_length(encode(COALESCE(text, ''))) + 1 AS BIGINT) AS size,
         CAST({crc_sql("COALESCE(text, '')")} AS BIGINT) AS text_crc32
  FROM documents, crc_table
), h AS (
  SELECT *, md5('{seed}:' || COALESCE(CAST(doc_id AS VARCHAR), 'null') || ':' || text_crc32) AS digits FROM d
), r AS (
  SELECT *, (CAST(row_number() OVER (PARTITION BY skey ORDER BY digits) - 1 AS DOUBLE)
             + CAST('0x' || substr(md5('{seed}:' || skey), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)
            / CAST(count(*) OVER (PARTITION BY skey) AS DOUBLE) AS rank
  FROM h
), p AS (
  SELECT *, row_number() OVER (ORDER BY rank, digits, skey) - 1 AS place, count(*) OVER () AS n FROM r
), s AS (
  SELECT *, CAST(place * {shards} // n AS INTEGER) AS shard FROM p
)
SELECT doc_id, source, size, text_crc32, '{LAW}' AS law, shard,
       CAST(place - (shard * n + {shards - 1}) // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s
"""
