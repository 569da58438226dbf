"""Vector search over tiles: metadata filters, top-k, and similar tiles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilescope import config
from tilescope.functions import identity, vectors
from tilescope.functions.ranking import top_per_key


def meta_filter(tiles: DataFrame, date: str | None = None, sensor: str | None = None) -> DataFrame:
    """Equality filters on date and sensor; an empty value means no filter."""
    if date:
        tiles = tiles.filter(F.col("date") == date)
    if sensor:
        tiles = tiles.filter(F.col("sensor") == sensor)
    return tiles


def dedupe_hits(hits: DataFrame, tie: Sequence[str | Column] = ()) -> DataFrame:
    """Best-scored row per tile_id; rows without an id are all kept."""
    order = [F.col("score").desc(), *[F.col(c) if isinstance(c, str) else c for c in tie]]
    blank = F.coalesce(F.col("tile_id"), F.lit("")) == ""
    # A number of its own keeps every blank row apart, in the same pass.
    keyed = hits.withColumn("__own", F.when(blank, F.monotonically_increasing_id()))
    return top_per_key(keyed, ["tile_id", "__own"], order).drop("__own")


def knn_search(
    tiles: DataFrame,
    query: Sequence[float],
    top_k: int = config.SEARCH_TOP_K,
    date: str | None = None,
    sensor: str | None = None,
    unique: bool = True,
    vector: str = "embedding",
    tie: Sequence[str] = ("tile_id",),
) -> DataFrame:
    """The top_k tiles by cosine similarity to one query vector.

    The query is a constant of the scan; vectors are dropped right after scoring
    and never shuffled. Repeats of a tile must not use up places: every task
    keeps the best row of each tile id, then the id does, then the first top_k
    are taken.
    """
    found = meta_filter(tiles, date, sensor)
    hits = found.withColumn("score", vectors.cosine_to_one(F.col(vector), query)).drop(vector)
    order = [F.col("score").desc(), *[F.col(c) for c in tie]]
    return (dedupe_hits(hits, tie) if unique else hits).orderBy(*order).limit(top_k)


def knn_batch(tiles: DataFrame, queries: Sequence[tuple[str, Sequence[float]]], top_k: int, vector: str = "embedding") -> DataFrame:
    """Top-k tiles for each of a few queries in one scan (one matrix product per batch)."""
    names = F.array(*[F.lit(name) for name, _ in queries])
    scores = vectors.cosine_to(F.col(vector), [vec for _, vec in queries])
    scored = tiles.withColumn("__s", scores).drop(vector)
    kept = [c for c in tiles.columns if c != vector]
    long = scored.select(*kept, F.posexplode("__s").alias("__i", "score")).withColumn("query", names[F.col("__i")])
    return top_per_key(long.drop("__i"), ["query"], [F.col("score").desc(), F.col("tile_id")], top_k, rank="rank")


QUERY_BLOCK = 16_384
TILE_BLOCK = 8192
QUERIES_AT_ONCE = 128


def knn_table(tiles: DataFrame, queries: DataFrame, top_k: int, vector: str = "embedding") -> DataFrame:
    """(query, tile_id, score, rank): top-k tiles of every row of queries(query, vector), however many there are.

    Tiles and queries are dealt into parts by hash; every pair of parts is one
    task, which takes a few queries at a time in one matrix product and selects
    the best top_k rows of each by partition. A tile travels once per
    QUERY_BLOCK queries. No side is broadcast. Rows without a vector take no part.
    """
    known = tiles.filter(F.col(vector).isNotNull()).select("tile_id", F.col(vector).alias("v"))
    asked = queries.filter(F.col("vector").isNotNull()).select("query", F.col("vector").alias("v"))
    tile_parts = max(1, -(-known.count() // TILE_BLOCK))
    query_parts = max(1, -(-asked.count() // QUERY_BLOCK))

    def parts(key: str, n: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = known.withColumn("tp", parts("tile_id", tile_parts)).withColumn("qp", each(query_parts))
    right = asked.withColumn("qp", parts("query", query_parts)).withColumn("tp", each(tile_parts))

    def best(t: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if t.empty or q.empty:
            return pd.DataFrame({"query": [], "tile_id": [], "score": []})
        t = t.sort_values("tile_id", kind="stable")
        ids, names = t["tile_id"].to_numpy(), q["query"].to_numpy()
        a, b = np.array(t["v"].tolist(), "float64"), np.array(q["v"].tolist(), "float64")
        found = []
        for begin in range(0, len(b), QUERIES_AT_ONCE):
            some = b[begin : begin + QUERIES_AT_ONCE]
            scale = np.linalg.norm(some, axis=1)[:, None] * np.linalg.norm(a, axis=1)[None, :]
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.round(np.where(scale <= config.ZERO_NORM, 0.0, some @ a.T / scale), vectors.SCORE_DIGITS)
            least = np.partition(score, -top_k, axis=1)[:, -top_k] if score.shape[1] > top_k else score.min(axis=1)
            # All rows of the last place's score stay until the smaller ids are known.
            row, col = np.nonzero(score >= least[:, None])
            order = np.lexsort((col, -score[row, col], row))
            row, col = row[order], col[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, col = row[place < top_k], col[place < top_k]
            found.append(pd.DataFrame({"query": names[begin + row], "tile_id": ids[col], "score": score[row, col]}))
        return pd.concat(found)

    cells = left.groupBy("tp", "qp").cogroup(right.groupBy("tp", "qp"))
    found = cells.applyInPandas(best, "query string, tile_id string, score double")
    return top_per_key(found, ["query"], [F.col("score").desc(), F.col("tile_id")], top_k, rank="rank")


def lookup_tile(tiles: DataFrame, tile_id: str, tie: str = "point_id") -> DataFrame:
    """The first record of a tile id."""
    return tiles.filter(F.col("tile_id") == tile_id).orderBy(tie).limit(1)


def scroll_payload(tiles: DataFrame, equals: dict[str, object], limit: int, order: str = "point_id") -> DataFrame:
    """The first `limit` records that satisfy all equalities."""
    for column, value in equals.items():
        tiles = tiles.filter(F.col(column) == value)
    return tiles.orderBy(order).limit(limit)


def resolve_alias(requests: DataFrame, tiles: DataFrame, request_id: str = "request_id") -> DataFrame:
    """For each requested id, the first of its aliases that exists (second half, first half, whole)."""
    wanted = requests.select(
        request_id, F.posexplode(identity.id_aliases(F.col(request_id))).alias("alias_rank", "tile_id")
    )
    found = wanted.join(tiles, "tile_id")
    return top_per_key(found, [request_id], [F.col("alias_rank"), F.col("tile_id")])


def stored_vector(tiles: DataFrame, request_id: str, vector: str = "embedding") -> tuple[list[str], list[float]]:
    """(aliases, vector) of a stored tile by id or change id. One row visits the driver; LookupError if there is none."""
    request = tiles.sparkSession.range(1).select(F.lit(request_id).alias("request_id"))
    aliases = request_id.split("__", 1)[::-1] + [request_id] if "__" in request_id else [request_id]
    stored = tiles.filter(F.col("tile_id").isin(aliases) & F.col(vector).isNotNull())
    match = resolve_alias(request, stored.select("tile_id", vector)).head(1)
    if not match:
        raise LookupError(f"no stored vector for {request_id}")
    return aliases, match[0][vector]


def similar_tile(
    tiles: DataFrame, request_id: str, top_k: int = 6, exclude_self: bool = True, vector: str = "embedding"
) -> DataFrame:
    """Tiles most similar to a stored tile, found by id or change id.

    One row (the query vector) visits the driver. Raises LookupError if no alias is stored.
    """
    aliases, query = stored_vector(tiles, request_id, vector)
    others = tiles.filter(F.coalesce(F.col("tile_id"), F.lit("")) != "")
    if exclude_self:
        others = others.filter(~F.col("tile_id").isin(aliases))
    return knn_search(others, query, top_k, vector=vector)


def filter_by_tag(ledger: DataFrame, tag: str, limit: int = 10) -> DataFrame:
    """Ledger rows that carry a tag."""
    return ledger.filter(F.col("primary_tag") == tag).orderBy("id").limit(limit)


def label_contains(label: Column, query: str) -> Column:
    """Either text contains the other, ignoring case; a blank query passes."""
    wanted = query.strip().lower()
    if not wanted:
        return F.lit(True)
    low = F.lower(label)
    return low.contains(wanted) | F.lit(wanted).contains(low)


def sensor_family(sensor: Column, selected: Sequence[str]) -> Column:
    """Whether a sensor belongs to one of the selected sensors or families."""
    families = ("landsat", "sentinel-1", "sentinel-2")  # fixed values: prefix families
    low = F.lower(F.coalesce(sensor, F.lit("")))
    passes = F.lit(False)
    for name in (s.lower() for s in selected if s):
        hit = low.startswith(name) if name in families else low.contains(name)
        passes = passes | hit
    return passes


def date_range(date: Column, start: str, end: str) -> Column:
    """Inclusive range on date text; missing dates pass, an inverted range is ignored."""
    if start > end:
        return F.lit(True)
    return date.isNull() | (date == "") | date.between(start, end)
