"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector's component number is a term, its integer weight the posting's weight. Rows are packed into
blocks that hold, per term, the rows and weights (a posting that covers most rows is kept with a zero
for each absent one). Query blocks meet row blocks in a grid of (query part, row part) cells: each
query's terms scatter their weighted postings into a dense array of scores, the k best of a block
are selected by partition, merged inside the task and once more over all cells.

Rows with a null id, a null vector, or a null or non-finite component take no part. Repeated rows
are candidates each; a query id that repeats is one query with its smallest vector, and no row with
the query's own id is its candidate. Ties go to the smaller id. Vectors of unequal length meet in
their common components.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 2048
QUERY_ROWS = 512
PART_ROWS = 8192  # rows of a cell of the grid
PART_QUERIES = 16384
AT_ONCE = 64  # queries whose score arrays are held together
HELD = 32  # query blocks whose best rows a task holds before it lets them go


def _packed(rows_per_block: int):
    """Blocks (first id, ids, offsets, terms, weights) of consecutive rows (id, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, rows_per_block):
                part = batch.slice(begin, rows_per_block)
                ids = part.column(0).to_numpy().astype(np.int64)
                lists = part.column(1)
                length = lists.value_lengths().to_numpy().astype(np.int64)
                weight = lists.flatten().to_numpy()
                row = np.repeat(np.arange(len(ids)), length)
                term = np.arange(len(weight)) - np.repeat(np.cumsum(length) - length, length)
                there = weight != 0
                block = pickle.dumps((ids, row[there], term[there], weight[there]), protocol=5)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(ids[0])], pa.int64()), pa.array([block], pa.binary())], ["first", "block"]
                )

    return run


def _postings(block: bytes) -> tuple[np.ndarray, dict[int, tuple[np.ndarray | None, np.ndarray]], int]:
    """Ids in rising order, postings by term, and the largest absolute weight."""
    ids, row, term, weight = pickle.loads(block)
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    row = place[row]
    by_term = np.lexsort((row, term))
    row, term, weight = row[by_term], term[by_term], weight[by_term]
    terms, starts = np.unique(term, return_index=True)
    ends = np.append(starts[1:], len(term))
    largest = int(np.abs(weight).max(initial=0))
    found = {}
    for t, a, b in zip(terms.tolist(), starts.tolist(), ends.tolist(), strict=True):
        if 2 * (b - a) > len(ids):
            full = np.zeros(len(ids), np.int64)
            full[row[a:b]] = weight[a:b]
            found[t] = (None, full)
        else:
            found[t] = (row[a:b], weight[a:b])
    return ids[order], found, largest


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first rows of every query by (score falling, id rising)."""
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    new = np.r_[True, query[1:] != query[:-1]] if len(query) else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(new, np.arange(len(query)), 0)) if len(query) else np.zeros(0, np.int64)
    keep = np.arange(len(query)) - begin < k
    return query[keep], vec[keep], score[keep]


def _scan(k: int):
    def accumulate(query_block: bytes, ids: np.ndarray, postings: dict, largest: int) -> Iterator[tuple]:
        q_ids, row, term, weight = pickle.loads(query_block)
        n_terms = int(term.max(initial=-1)) + 1
        bound = largest * int(np.abs(weight).max(initial=0)) * max(1, n_terms)
        kind = np.int32 if bound < 2**31 else np.int64
        table = np.zeros((len(q_ids), n_terms), np.int64)
        table[row, term] = weight
        typed = {t: (rows, w.astype(kind)) for t, (rows, w) in postings.items() if t < n_terms}
        for begin in range(0, len(q_ids), AT_ONCE):
            own, part = q_ids[begin : begin + AT_ONCE], table[begin : begin + AT_ONCE].astype(kind)
            scores = np.zeros((len(own), len(ids)), kind)
            scratch = np.empty_like(scores)
            for t in np.flatnonzero(part.any(axis=0)).tolist():
                if t not in typed:
                    continue
                rows, w = typed[t]
                if rows is None:
                    np.multiply(part[:, t, None], w, out=scratch)
                    scores += scratch
                else:
                    scores[:, rows] += part[:, t, None] * w
            other = ids[None, :] != own[:, None]
            least = np.where(other, scores, np.iinfo(kind).min)
            cut = np.partition(least, -k, axis=1)[:, -k] if least.shape[1] > k else least.min(axis=1)
            q, c = np.nonzero((least >= cut[:, None]) & other)
            yield _best(own[q], ids[c], scores[q, c].astype(np.int64), k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        last, opened = None, None  # the row block that is open, known by its bytes

        def let_go(key: int) -> pa.RecordBatch:
            query, vec, score = _best(*(np.concatenate(x) for x in zip(*held.pop(key), strict=True)), k)
            return pa.RecordBatch.from_arrays(
                [pa.array(query), pa.array(vec), pa.array(score)], ["query_id", "vec_id", "score"]
            )

        for batch in batches:
            for first, q_block, v_block in zip(*(batch.column(i) for i in range(3)), strict=True):
                if last is None or not v_block.as_buffer().equals(last):
                    last = v_block.as_buffer()
                    opened = _postings(last)
                key = first.as_py()
                found = [*held.get(key, []), *accumulate(q_block.as_buffer(), *opened)]
                held[key] = [_best(*(np.concatenate(x) for x in zip(*found, strict=True)), k)]
                if len(held) > HELD:
                    yield let_go(next(iter(held)))
        for key in list(held):
            yield let_go(key)

    return run


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of vectors(vec_id, weights) of highest inner product per query.

    queries(vec_id, weights) is held in parts too; neither side is broadcast.
    """

    def clean(df: DataFrame) -> DataFrame:
        return df.select(
            F.col("vec_id").cast("long").alias("vec_id"), F.col("weights").cast("array<long>").alias("weights")
        ).filter("vec_id is not null and weights is not null and not exists(weights, w -> w is null)")

    queries = clean(queries).groupBy("vec_id").agg(F.min("weights").alias("weights"))
    vectors = clean(vectors)
    n_queries, n_rows = queries.count(), vectors.count()
    q_parts, v_parts = max(1, -(-n_queries // PART_QUERIES)), max(1, -(-n_rows // PART_ROWS))
    packed = "first long, block binary"

    def spread(block: str, parts: int) -> Column:
        # By content: blocks that begin with the same repeated id go different ways.
        return F.pmod(F.xxhash64(block), F.lit(parts)).cast("int")

    q = queries.mapInArrow(_packed(QUERY_ROWS), packed).select(
        F.col("first").alias("q_first"),
        F.col("block").alias("q_block"),
        spread("block", q_parts).alias("qp"),
        F.explode(F.sequence(F.lit(0), F.lit(v_parts - 1))).alias("vp"),
    )
    v = vectors.mapInArrow(_packed(BLOCK_ROWS), packed).select(
        F.col("block").alias("v_block"),
        spread("block", v_parts).alias("vp"),
        F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))).alias("qp"),
    )
    met = v.join(q, ["qp", "vp"]).select("q_first", "q_block", "v_block")
    found = met.mapInArrow(_scan(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def grid_weights(vector: Column, steps: int) -> Column:
    """floor(steps * x) of every component; null if a component is null or not finite."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(~bad, F.transform(x, lambda c: F.floor(c * F.lit(float(steps))).cast("long")))
