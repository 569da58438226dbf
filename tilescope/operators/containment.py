"""Which texts contain which: a substring join through an index of grams, without comparing all with all.

Texts are compared once each, however often they occur. A needle looks for its longest possible grams of a size
of SIZES, and only where its rarest one stands: every text that contains the needle contains that gram. What is
found is checked exactly. Grams of a size are indexed only if some needle uses the size. A needle with a gram
that no text has is in none of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilescope.functions.ranking import top_per_key
from tilescope.session import written

SIZES = (32, 24, 16, 12, 8, 6, 4, 3, 2, 1)


def _grams(text: Column, size: Column) -> Column:
    """Hashes of the distinct substrings of a length."""
    places = F.sequence(F.lit(1), F.length(text) - size + 1)
    cut = F.transform(places, lambda i: F.xxhash64(size, F.substring(text, i, size)))
    return F.array_distinct(F.when(F.length(text) >= size, cut))


def contained_pairs(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, text): every text of texts(text) that contains a needle of needles(needle), equal ones included.

    Both come out distinct. Nulls and the empty needle match nothing.
    """
    asked = needles.select(F.col("needle").cast("string").alias("needle")).filter("needle <> ''").distinct()
    size = F.coalesce(*[F.when(F.length("needle") >= s, F.lit(s)) for s in SIZES])
    asked = written(asked.select("needle", size.alias("size")))
    sizes = sorted(r["size"] for r in asked.select("size").distinct().collect())  # at most len(SIZES)
    if not sizes:
        return needles.sparkSession.createDataFrame([], "needle string, text string")
    known = written(texts.select(F.col("text").cast("string").alias("text")).filter("text <> ''").distinct())
    by_size = known.select("text", F.explode(F.array(*map(F.lit, sizes))).alias("size"))
    index = written(by_size.select("text", F.explode(_grams(F.col("text"), F.col("size"))).alias("gram")))
    often = index.groupBy("gram").agg(F.count("*").alias("often"))
    own = asked.select("needle", F.posexplode(_grams(F.col("needle"), F.col("size"))).alias("k", "gram"))
    rarest = own.join(often, "gram", "left").withColumn("often", F.coalesce("often", F.lit(0)))
    rarest = top_per_key(rarest, ["needle"], [F.col("often"), F.col("k")]).filter("often > 0")
    met = rarest.select("needle", "gram").join(index, "gram")
    return met.filter(F.col("text").contains(F.col("needle"))).select("needle", "text")


def records_of_requests(queue: DataFrame, requests: DataFrame, k: int = 1) -> DataFrame:
    """The first k rows that each wanted id of requests(wanted) may mean, as review.record_fuzzy_match orders them.

    Of the rows of a tile only its first k can be among them, so a tile with many rows leaves few.
    """
    newest = [F.col("created_at").desc(), F.col("id").desc()]
    wanted = written(requests.select(F.col("wanted").cast("string").alias("wanted")).filter("wanted is not null").distinct())
    tiles = queue.select(F.col("tile_id").alias("text")).filter("text is not null").distinct()
    inside = contained_pairs(wanted.select(F.col("wanted").alias("needle")), tiles)
    around = contained_pairs(tiles.select(F.col("text").alias("needle")), wanted.select(F.col("wanted").alias("text")))
    pairs = inside.select(F.col("needle").alias("wanted"), F.col("text").alias("tile_id"))
    pairs = pairs.unionByName(around.select(F.col("text").alias("wanted"), F.col("needle").alias("tile_id"))).distinct()
    first = top_per_key(queue.filter("tile_id is not null"), ["tile_id"], newest, k)
    grade = F.when(F.col("tile_id") == F.col("wanted"), 1).otherwise(2)
    by_tile = pairs.join(first, "tile_id").withColumn("match_grade", grade)
    by_number = wanted.join(queue, F.col("wanted") == F.col("id").cast("string")).withColumn("match_grade", F.lit(0))
    best = top_per_key(
        by_number.unionByName(by_tile).withColumn("order_", F.col("match_grade")), ["wanted", "id"], [F.col("order_")]
    ).drop("order_")
    return top_per_key(best, ["wanted"], [F.col("match_grade"), *newest], k)
