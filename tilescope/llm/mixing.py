"""Mixing sources to target weights by Sainte-Laguë apportionment.

A source's target is its share, by weight, of a budget of words; it stops at `repeats` times the
source's size and the excess goes to the others by weight. The budget is dealt in blocks of equal
size: blocks to sources by the highest quotients target / (2k + 1), then every source's blocks to
its shards by the highest quotients size / (2k + 1). A shard's documents stand in seeded order on a
circle of words; its quota covers the whole circle as often as it fits, and the remaining blocks
are a run of the circle from a seeded block on. So most documents are taken whole, and a rerun
takes the same words.

Only DataFrame operations. Word counts are taken once; a source is split into shards of about
SHARD_DOCUMENTS documents, at most MOST_SHARDS, so no task gets a hot source whole. Tables of
sources and of shards are aggregates; they are joined, never collected.

A null text has size 0, a null source is a source of its own and sorts last. Rows of size 0 are
taken 0 times. Repeated rows are separate documents. Without words all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilescope.llm.common import stored

SHARD_DOCUMENTS = 256
MOST_SHARDS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def _seeded(seed: int, *parts: Column) -> Column:
    """32 hexadecimal digits from the seed and the parts."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def _number(digits: Column) -> Column:
    """The first 32 bits as a long."""
    return F.conv(F.substring(digits, 1, 8), 16, 10).cast("long")


def sainte_lague(entries: DataFrame, group: list[str], key: str, weight: str, seats: str) -> DataFrame:
    """(group, key, quota): `seats` of each group dealt by highest quotients weight / (2k + 1).

    Quotas that rounding settles are not ranked; only quotients near the last seat are, about three
    and twice its share of the group's entries for each. Ties go to the smaller key.
    """
    whole = Window.partitionBy(*group)
    e = entries.filter(F.col(weight) > 0).withColumns(
        {"_sum": F.sum(weight).over(whole), "_n": F.count("*").over(whole), "_w": F.col(weight).cast("double")}
    )
    share = F.col("_w") / F.col("_sum").cast("double")
    e = e.withColumn("_near", (F.ceil(share * F.col("_n")) + 2).cast("long"))
    e = e.withColumn(
        "_base", F.greatest(F.lit(0), F.floor(F.col(seats) * share + 0.5).cast("long") - F.col("_near")).cast("long")
    )
    e = e.withColumn("_left", F.col(seats) - F.sum("_base").over(whole))
    last = F.col("_base") + 2 * F.col("_near")
    q = e.withColumn("_k", F.explode(F.sequence(F.col("_base"), last)))
    q = q.withColumn("_q", F.col("_w") / (2 * F.col("_k") + 1).cast("double"))
    order = Window.partitionBy(*group).orderBy(F.desc("_q"), key)
    q = q.withColumn("_won", (F.row_number().over(order) <= F.col("_left")).cast("long"))
    return q.groupBy(*group, key).agg((F.max("_base") + F.sum("_won")).alias("quota"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], budget: tuple[int, int], repeats: int) -> DataFrame:
    """(skey, source_size, n_docs, target) of sizes(skey, null_source, source, size)."""
    sources = sizes.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))
    sources = sources.withColumn("most", F.lit(repeats) * F.col("source_size"))
    # Sources fill in the order of most / weight. Before each, what is left of the budget and of the weights:
    every = Window.partitionBy(F.lit(0))
    filling = every.orderBy(F.col("most").cast("double") / F.col("weight"), "skey")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    over, under = budget
    sources = sources.withColumns(
        {
            "_rest": F.lit(over) * F.sum("source_size").over(every) - F.lit(under) * F.coalesce(F.sum("most").over(before), F.lit(0)),
            "_open": F.lit(under) * (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
            "_place": F.row_number().over(filling),
        }
    )
    level = F.col("weight") * F.col("_rest") > F.col("most") * F.col("_open")  # its share is more than it may give
    sources = sources.withColumn("_full", level)
    first = F.min(F.when(~F.col("_full"), F.struct("_place", "_rest", "_open"))).over(every)
    sources = sources.withColumn("_first", first)
    shared = (F.col("weight") * F.col("_first._rest")).cast("double") / F.col("_first._open").cast("double")
    target = F.when(
        F.col("_first").isNull() | (F.col("_place") < F.col("_first._place")), F.col("most").cast("double")
    ).otherwise(shared)
    return sources.select("skey", "source_size", "n_docs", target.alias("target"))


def mix_sources(
    documents: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    budget: tuple[int, int] = (3, 2),
    repeats: int = 2,
    block: int = 16,
    seed: int = 20240501,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of documents(doc_id, text, source).

    weights go to the sources in code-point order, repeating; budget is the share of all words to take.
    """
    sizes = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    sizes = stored(sizes).withColumn("skey", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    targets = stored(source_targets(sizes, weights, budget, repeats))
    total = F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block).cast("long")
    quotas = sainte_lague(targets.withColumns({"_all": F.lit(0), "_seats": total}), ["_all"], "skey", "target", "_seats")
    plan = targets.join(quotas.select(F.col("skey").alias("_skey"), F.col("quota")), F.col("skey") == F.col("_skey"), "left")
    plan = stored(
        plan.select(
            "skey",
            "source_size",
            "target",
            F.coalesce("quota", F.lit(0)).alias("source_quota"),
            F.least(F.lit(MOST_SHARDS), F.ceil(F.col("n_docs") / SHARD_DOCUMENTS)).cast("long").alias("shards"),
        )
    )
    docs = sizes.join(plan, "skey")
    digits = _seeded(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    docs = docs.withColumn("place", digits).withColumn("shard", _number(F.col("place")) % F.col("shards"))
    docs = docs.repartition("skey", "shard")
    per_shard = docs.groupBy("skey", "shard").agg(
        F.sum("size").alias("shard_size"), F.max("source_quota").alias("source_quota")
    )
    dealt = sainte_lague(per_shard, ["skey"], "shard", "shard_size", "source_quota")
    dealt = dealt.select(F.col("skey").alias("q_skey"), F.col("shard").alias("q_shard"), "quota")
    shard = Window.partitionBy("skey", "shard")
    ahead = shard.orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumns({"w": F.sum("size").over(shard), "a": F.coalesce(F.sum("size").over(ahead), F.lit(0))})
    docs = docs.join(dealt, (F.col("skey") == F.col("q_skey")) & (F.col("shard") == F.col("q_shard")), "left")
    words = F.least(F.coalesce("quota", F.lit(0)) * block, F.lit(repeats) * F.col("w"))
    docs = docs.withColumn("words", words)
    # The whole circle `times` times, then `rest` words from `start` on; what passes the end goes on at 0.
    docs = docs.withColumns(
        {
            "times": F.when(F.col("w") > 0, F.expr("words div w")).otherwise(F.lit(0)),
            "rest": F.when(F.col("w") > 0, F.expr("words % w")).otherwise(F.lit(0)),
            "start": (_number(_seeded(seed, F.col("skey"), F.col("shard").cast("string"))) % F.greatest(F.lit(1), F.ceil(F.col("w") / block)))
            * block,
        }
    )

    def covered(low: Column, high: Column) -> Column:
        end = F.col("a") + F.col("size")
        return F.greatest(F.lit(0), F.least(end, high) - F.greatest(F.col("a"), low))

    end = F.col("start") + F.col("rest")
    part = covered(F.col("start"), F.least(end, F.col("w"))) + covered(F.lit(0), end - F.col("w"))
    taken = (F.col("times") * F.col("size") + part).cast("long")
    return docs.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


#: The same over a relation named docs.
def mixing_sql(docs: str = "documents") -> str:
    return f"""
WITH sizes AS (
  SELECT doc_id, source, COALESCE('=' || source, '') AS skey,
         CAST(COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM {docs}
), src AS (
  SELECT skey, source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn
  FROM sizes GROUP BY skey, source
), weighed AS (
  SELECT *, CAST(CASE turn WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS weight, 2 * source_size AS most FROM src
), filling AS (
  SELECT *,
    3 * sum(source_size) OVER () - 2 * COALESCE(sum(most) OVER f, 0) AS rest,
    2 * (sum(weight) OVER () - COALESCE(sum(weight) OVER f, 0)) AS open,
    row_number() OVER (ORDER BY CAST(most AS DOUBLE) / weight, skey) AS place
  FROM weighed
  WINDOW f AS (ORDER BY CAST(most AS DOUBLE) / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT place AS first_place, rest AS first_rest, open AS first_open FROM filling
  WHERE NOT weight * rest > most * open ORDER BY place LIMIT 1
), targets AS (
  SELECT skey, source_size, n_docs,
    CASE WHEN first_place IS NULL OR place < first_place THEN CAST(most AS DOUBLE)
         ELSE CAST(weight * first_rest AS DOUBLE) / CAST(first_open AS DOUBLE) END AS target
  FROM filling LEFT JOIN level ON true
), seats AS (
  SELECT *, CAST(round(sum(target) OVER () / 16) AS BIGINT) AS n_seats FROM targets
), s1 AS (
  SELECT *, sum(target) OVER () AS total, count(*) OVER () AS n FROM seats WHERE target > 0
), s2 AS (
  SELECT *, CAST(ceil(target / total * n) + 2 AS BIGINT) AS near FROM s1
), s3 AS (
  SELECT *, greatest(0, CAST(floor(n_seats * (target / total) + 0.5) AS BIGINT) - near) AS base FROM s2
), s4 AS (
  SELECT *, n_seats - sum(base) OVER () AS open_seats, unnest(range(base, base + 2 * near + 1)) AS k FROM s3
), s5 AS (
  SELECT skey, base, row_number() OVER (ORDER BY target / CAST(2 * k + 1 AS DOUBLE) DESC, skey)
         <= (SELECT max(n_seats) FROM s3) - (SELECT sum(base) FROM s3) AS won FROM s4
), quotas AS (
  SELECT skey, max(base) + sum(CAST(won AS BIGINT)) AS quota FROM s5 GROUP BY skey
), plan AS (
  SELECT t.skey, source_size, target, COALESCE(quota, 0) AS source_quota,
         least(4096, CAST(ceil(n_docs / 256) AS BIGINT)) AS shards
  FROM targets t LEFT JOIN quotas q ON t.skey = q.skey
), docs0 AS (
  SELECT s.doc_id, s.source, s.size, p.*, md5('20240501:' || COALESCE(CAST(doc_id AS VARCHAR), 'null')) AS place
  FROM sizes s JOIN plan p ON s.skey = p.skey
), docs1 AS (
  SELECT *, CAST('0x' || substr(place, 1, 8) AS BIGINT) % shards AS shard FROM docs0
), per_shard AS (
  SELECT skey, shard, CAST(sum(size) AS BIGINT) AS shard_size, max(source_quota) AS n_seats FROM docs1 GROUP BY skey, shard
), h1 AS (
  SELECT *, sum(shard_size) OVER (PARTITION BY skey) AS total, count(*) OVER (PARTITION BY skey) AS n
  FROM per_shard WHERE shard_size > 0
), h2 AS (
  SELECT *, CAST(ceil(CAST(shard_size AS DOUBLE) / CAST(total AS DOUBLE) * n) + 2 AS BIGINT) AS near FROM h1
), h3 AS (
  SELECT *, greatest(0, CAST(floor(n_seats * (CAST(shard_size AS DOUBLE) / CAST(total AS DOUBLE)) + 0.5) AS BIGINT) - near) AS base
  FROM h2
), h4 AS (
  SELECT *, n_seats - sum(base) OVER (PARTITION BY skey) AS open_seats FROM h3
), h5 AS (
  SELECT *, unnest(range(base, base + 2 * near + 1)) AS k FROM h4
), h6 AS (
  SELECT skey, shard, base, row_number() OVER (
           PARTITION BY skey ORDER BY CAST(shard_size AS DOUBLE) / CAST(2 * k + 1 AS DOUBLE) DESC, shard) <= open_seats AS won
  FROM h5
), dealt AS (
  SELECT skey, shard, max(base) + sum(CAST(won AS BIGINT)) AS quota FROM h6 GROUP BY skey, shard
), line AS (
  SELECT d.*, CAST(sum(size) OVER (PARTITION BY d.skey, d.shard) AS BIGINT) AS w,
    CAST(COALESCE(sum(size) OVER (PARTITION BY d.skey, d.shard ORDER BY place, size
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a,
    COALESCE(q.quota, 0) AS quota
  FROM docs1 d LEFT JOIN dealt q ON d.skey = q.skey AND d.shard = q.shard
), words AS (
  SELECT *, CAST(least(quota * 16, 2 * w) AS BIGINT) AS words FROM line
), runs AS (
  SELECT *, CASE WHEN w > 0 THEN words // w ELSE 0 END AS times, CASE WHEN w > 0 THEN words % w ELSE 0 END AS rest,
    CAST('0x' || substr(md5('20240501:' || skey || ':' || shard), 1, 8) AS BIGINT)
      % greatest(1, CAST(ceil(w / 16) AS BIGINT)) * 16 AS start
  FROM words
)
SELECT doc_id, source, size, source_size, target,
  CAST(times * size + greatest(0, least(a + size, least(start + rest, w)) - greatest(a, start))
       + greatest(0, least(a + size, start + rest - w) - greatest(a, 0)) AS BIGINT) AS taken
FROM runs
"""
