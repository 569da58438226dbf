"""N-gram Jaccard join by prefix trees.

Every document is the set of its distinct word n-grams. Two documents link when the Jaccard
similarity of their sets reaches a threshold; the classes are the connected components.

1. One pass counts n-grams in a table of fixed size. It only serves to put n-grams in one global
   order, rare ones first; any order gives the same links.
2. Two sets that link share e of the first n - ceil(t*n) + e n-grams of each. Documents that share an
   n-gram of at most SMALL documents are paired, and pairs with e or more such n-grams are tied. The
   documents of a more common one are all tied to its first; a task does so itself for n-grams it
   meets often, so a hot n-gram leaves it as one row, marked as common: what other tasks hold of it
   is tied too, however little. Ties give candidate clusters: no link
   crosses two.
3. Equal sets of a cluster shrink to one. The sets of a cluster are stored in a trie, common n-grams
   first, and the trie is walked once with the overlaps of all sets at a time: a shared path is
   counted once, and a subtree is left as soon as no set can reach the threshold with what remains.
   A large cluster is cut into blocks of equal weight and walked block against block.

Results: texts without words and rows without an id link with nothing. Repeated rows and equal
sets form one class. An id with several texts has one row per text. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilescope.llm import wordhash
from tilescope.llm.common import as_batch, components, stored

ORDER_BITS = 23
BLOCK = 4096
CLUSTER_SHINGLES = 1 << 20  # a block of a cluster holds about this many n-grams
FLUSH_ROWS = 1_000_000
SMALL = 64
OFTEN = 16
MOST_SHARED = 4  # e: a tenth of the set, from 1 to this
FILTER_BITS = 25  # of the table that keeps sets outside all clusters from being shuffled
SET_SCHEMA = "doc_id long, n_shingles long, s1 long, s2 long, part int, counts binary"


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, n-gram hashes, offsets) of the texts in column 1."""
    for row, data, offsets in wordhash.text_blocks(batch.column(1)):
        hashes, first = wordhash.word_hashes(data, offsets)
        values, at = wordhash.shingle_sets(hashes, first, width)
        yield row, values, at


def _signatures(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, the same for equal sets."""
    out = []
    for salt in (0x51ED270B, 0x2545F4914F6CDD1D):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(wordhash.mix(values ^ np.uint64(salt)), out=total[1:])
        out.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
    return out[0], out[1]


def _describe(width: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        schema = pa.schema(
            [(c, pa.int64()) for c in ("doc_id", "n_shingles", "s1", "s2")] + [("part", pa.int32()), ("counts", pa.binary())]
        )
        for batch in batches:
            for row, values, at in _sets(batch, width):
                bucket, n = np.unique(values >> np.uint64(64 - bits), return_counts=True)
                counts[bucket.astype(np.int64)] += n.astype(np.uint32)
                size = len(at) - 1
                s1, s2 = _signatures(values, at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, size).cast(pa.int64()),
                        pa.array(np.diff(at)),
                        pa.array(s1),
                        pa.array(s2),
                        pa.nulls(size, pa.int32()),
                        pa.nulls(size, pa.binary()),
                    ],
                    schema=schema,
                )
        if counts.any():
            parts = counts.reshape(-1, BLOCK)
            for i, part in enumerate(parts):
                if part.any():
                    none = pa.nulls(1, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [none] * 4 + [pa.array([i], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())],
                        schema=schema,
                    )

    return run


def _merge_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the counts of parts sorted together; a count leaves as eight times its binary logarithm."""
    part, total = None, None

    def done() -> pa.RecordBatch:
        level = np.minimum(np.round(8 * np.log2(1 + total.astype(np.float64))), 255).astype(np.uint8)
        return as_batch({"part": pa.array([part], pa.int32()), "level": pa.array([level.tobytes()], pa.binary())})

    for batch in batches:
        for p, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if p != part:
                if part is not None:
                    yield done()
                part, total = p, np.zeros(BLOCK, np.uint64)
            total += np.frombuffer(zlib.decompress(blob), np.uint32)
    if part is not None:
        yield done()


def _shared(n: np.ndarray) -> np.ndarray:
    """How many prefix n-grams a pair must share, for either of its sizes."""
    return np.clip(n // 10, 1, MOST_SHARED)


def _prefix_size(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """n - ceil(num/den * n) + e leading n-grams, none of an empty set."""
    return np.where(n > 0, n + (-num * n) // den + _shared(n), 0)


def _prefixes(width: int, bits: int, num: int, den: int, levels):
    """Rows (token, doc, n, tied): prefix n-grams, and documents tied to the first one of a frequent n-gram.

    A document goes by the first sum of its set, so that copies are one wherever they are met. A
    negative n marks the row of a frequent n-gram.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows, seen = 0, set()

        def flush() -> pa.RecordBatch:
            token, doc, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((doc, token))
            token, doc, n = token[order], doc[order], n[order]
            start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            size = np.diff(np.r_[start, len(token)])
            often = np.repeat(size > OFTEN, size)
            place = np.arange(len(token)) - np.repeat(start, size)
            rest = often & (place > 0)
            n = np.where(often, -1, n)
            tied = np.unique(np.stack([doc[rest], doc[np.repeat(start, size)][rest]], 1), axis=0)
            tied = tied[tied[:, 0] != tied[:, 1]]
            keep = ~rest
            none = np.zeros(len(tied), np.int32)
            return as_batch(
                {
                    "token": np.concatenate([token[keep].view(np.int64), wordhash.mix(tied[:, 0].astype(np.uint64)).view(np.int64)]),
                    "doc": np.concatenate([doc[keep], tied[:, 0]]),
                    "n": np.concatenate([n[keep].astype(np.int32), none]),
                    "tied": np.concatenate([np.full(int(keep.sum()), -1), tied[:, 1]]),
                    "has": np.concatenate([np.zeros(int(keep.sum()), bool), np.ones(len(tied), bool)]),
                }
            )

        for batch in batches:
            for row, values, at in _sets(batch, width):
                n = np.diff(at)
                docs, other = _signatures(values, at)
                for i, key in enumerate(zip(docs, other, strict=True)):
                    if key in seen:
                        n[i] = 0
                    seen.add(key)
                owner = np.repeat(np.arange(len(n)), np.diff(at))
                order = np.lexsort((values, level[(values >> np.uint64(64 - bits)).astype(np.int64)], owner))
                rank = np.arange(len(values)) - at[:-1][owner]
                keep = rank < _prefix_size(n, num, den)[owner]
                held.append((values[order][keep], docs[owner[keep]], n[owner[keep]]))
                rows += int(keep.sum())
            if rows > FLUSH_ROWS:
                yield flush()
                held, rows, seen = [], 0, set()
        if held:
            yield flush()

    return run


def _pairs(num: int, den: int):
    """Rows (a, b, e) from rows sorted by token: pairs of small groups, ties (e = 0) of others and of marked ones to their first document."""

    def distinct(token: np.ndarray, doc: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((n, doc, token))
        token, doc, n = token[order], doc[order], n[order]
        new = np.ones(len(token), bool)  # copies of a set met in several tasks count once, a mark stays
        new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
        return token[new], doc[new], n[new]

    def of_runs(token: np.ndarray, doc: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        token, doc, n = distinct(token, doc, n)
        start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
        size = np.diff(np.r_[start, len(token)])
        common = (np.minimum.reduceat(n, start) < 0) | (size > SMALL) if len(token) else np.zeros(0, bool)
        out = []
        for m in np.unique(size[(size > 1) & ~common]).tolist():
            i, j = np.triu_indices(m, 1)
            first = start[(size == m) & ~common][:, None]
            x, y = (first + i).ravel(), (first + j).ravel()
            fits = den * np.minimum(n[x], n[y]) >= num * np.maximum(n[x], n[y])  # else their sizes alone differ too much
            x, y = x[fits], y[fits]
            out.append((doc[x], doc[y], np.minimum(_shared(n[x]), _shared(n[y]))))
        tied = np.repeat(common, size)
        out.append((np.repeat(doc[start], size)[tied], doc[tied], np.zeros(int(tied.sum()), np.int64)))
        a, b, c = (np.concatenate(x) for x in zip(*out, strict=True))
        keep = a != b
        a, b, c = a[keep], b[keep], c[keep]
        return as_batch({"a": np.minimum(a, b), "b": np.maximum(a, b), "e": c.astype(np.int32)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        for batch in batches:
            token, doc, n, tied, has = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            if has.any():
                yield as_batch(
                    {"a": np.minimum(doc, tied)[has], "b": np.maximum(doc, tied)[has], "e": np.zeros(int(has.sum()), np.int32)}
                )
                token, doc, n = token[~has], doc[~has], n[~has]
            if carried is not None:
                token, doc, n = (np.concatenate([x, y]) for x, y in zip(carried, (token, doc, n), strict=True))
            if not len(token):
                continue
            last = int(np.searchsorted(token, token[-1]))
            yield of_runs(token[:last], doc[:last], n[:last])
            carried = token[last:], doc[last:], n[last:]
            if len(carried[0]) > 4 * SMALL:
                carried = distinct(*carried)
                if len(carried[0]) > SMALL or carried[2].min() < 0:  # a common one: tie what is there, go on with its first document
                    yield of_runs(*carried)
                    carried = carried[0][:1], carried[1][:1], np.full(1, -1, carried[2].dtype)
        if carried is not None:
            yield of_runs(*carried)

    return run


def _maybe(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the bit of each id is set."""
    at = (wordhash.mix(ids.astype(np.uint64)) & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _mark(size: int):
    """The bits of a task's ids, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, np.uint8)
        for batch in batches:
            at = wordhash.mix(batch.column(0).to_numpy().astype(np.uint64)) & np.uint64(8 * size - 1)
            at = at.astype(np.int64)
            np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        parts = bits.reshape(-1, BLOCK)
        some = np.flatnonzero(parts.any(axis=1))
        yield as_batch(
            {
                "part": pa.array(some, pa.int32()),
                "bits": pa.array([zlib.compress(parts[k].tobytes(), 1) for k in some], pa.binary()),
            }
        )

    return run


def _merge_bits(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(BLOCK, np.uint8)
    for blob in rows["bits"]:
        total |= np.frombuffer(zlib.decompress(blob), np.uint8)
    return pd.DataFrame({"part": rows["part"].iloc[:1], "bits": [total.tobytes()]})


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A bit table of fixed size that holds every id; others pass by chance, the join drops them."""
    size = 1 << (FILTER_BITS - 3)
    parts = ids.mapInArrow(_mark(size), "part int, bits binary")
    parts = parts.groupBy("part").applyInPandas(_merge_bits, "part int, bits binary")
    table = np.zeros((size // BLOCK, BLOCK), np.uint8)
    for part, blob in parts.collect():
        table[part] = np.frombuffer(blob, np.uint8)
    return table.reshape(-1)


def _wanted(wanted):
    """The texts (doc_id, text) whose id is in the bit table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield batch.take(pa.array(np.flatnonzero(_maybe(ids, wanted.value))))

    return run


def _post(tokens: np.ndarray, starts: np.ndarray, holders: np.ndarray) -> np.ndarray:
    """All holders of the given tokens, repeats kept."""
    lo, count = starts[tokens], starts[tokens + 1] - starts[tokens]
    at = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    return holders[at]


def trie_links(probes: list[np.ndarray], stored_sets: list[np.ndarray], num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """For every stored set its index and the probes with Jaccard similarity of at least num/den.

    The trie of the stored sets is implicit: sets sorted as sequences, a node is a run of sets with a
    common path. Overlaps of all live probes are kept per node and grow along its path.
    """
    every = np.concatenate([*probes, *stored_sets])
    vocabulary, spread, seen = np.unique(every, return_inverse=True, return_counts=True)
    place = np.empty(len(vocabulary), np.int64)
    place[np.lexsort((vocabulary, -seen))] = np.arange(len(vocabulary))  # common n-grams first: long shared paths
    ranked = place[spread]
    cuts = np.cumsum([0, *map(len, probes), *map(len, stored_sets)])
    sequences = [np.sort(ranked[cuts[k] : cuts[k + 1]]) for k in range(len(cuts) - 1)]
    mine, theirs = sequences[: len(probes)], sequences[len(probes) :]
    owner = np.repeat(np.arange(len(mine)), [len(s) for s in mine])
    tokens = np.concatenate(mine)
    by_token = np.argsort(tokens, kind="stable")
    holders = owner[by_token]
    starts = np.searchsorted(tokens[by_token], np.arange(len(vocabulary) + 1))
    sizes = np.array([len(s) for s in mine])
    order = sorted(range(len(theirs)), key=lambda k: theirs[k].astype(">i8").tobytes())
    paths = [theirs[k] for k in order]
    common = [0] * (len(paths) + 1)  # length of the path shared with the set before
    for k in range(1, len(paths)):
        least = min(len(paths[k]), len(paths[k - 1]))
        differ = np.flatnonzero(paths[k][:least] != paths[k - 1][:least])
        common[k] = int(differ[0]) if len(differ) else least
    # Stack of (first set, last set + 1, depth, live probes, their overlaps).
    stack = [(0, len(paths), 0, np.arange(len(mine)), np.zeros(len(mine), np.int64))]
    while stack:
        lo, hi, depth, live, overlap = stack.pop()
        end = min(common[lo + 1 : hi]) if hi - lo > 1 else len(paths[lo])
        if end > depth:
            added = np.bincount(_post(paths[lo][depth:end], starts, holders), minlength=len(mine))
            overlap = overlap + added[live]
        # y has at least `end - overlap` n-grams that x lacks: with size |y| the overlap is at most |y| - that.
        longest = max(len(paths[k]) for k in range(lo, hi))
        shortest = min(len(paths[k]) for k in range(lo, hi))
        most = np.minimum(sizes[live], longest - end + overlap)
        fits = (den * most >= num * (sizes[live] + np.maximum(shortest, most) - most)) & (most > 0)
        live, overlap = live[fits], overlap[fits]
        if not len(live):
            continue
        k = lo
        while k < hi and len(paths[k]) == end:  # sets that end here
            fits = den * overlap >= num * (sizes[live] + end - overlap)
            yield order[k], live[fits]
            k += 1
        while k < hi:
            stop = k + 1
            while stop < hi and common[stop] > end:
                stop += 1
            stack.append((k, stop, end, live, overlap))
            k = stop


def _cluster_links(width: int, num: int, den: int):
    """Links of one pair of blocks of a cluster: (doc_id, smallest linked in reach, number of links)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        first, second = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
        texts = pa.RecordBatch.from_arrays([pa.nulls(len(rows)), pa.array(rows["text"], pa.string())], ["doc_id", "text"])
        sets, same = [], []
        for _, values, at in _sets(texts, width):
            sets += [values[at[k] : at[k + 1]] for k in range(len(at) - 1)]
            same.append(np.stack(_signatures(values, at)))
        # An id may have several texts, and rows may repeat: the one text whose set was meant stays.
        meant = (np.concatenate(same, axis=1) == rows[["s1", "s2"]].to_numpy().T).all(axis=0)
        meant &= ~rows["doc_id"].where(meant, -1 - np.arange(len(rows))).duplicated().to_numpy()
        sets = [s for s, keep in zip(sets, meant, strict=True) if keep]
        docs, block = rows["doc_id"].to_numpy()[meant], rows["block"].to_numpy()[meant]
        left = np.flatnonzero(block == first)
        right = left if first == second else np.flatnonzero(block == second)
        label, links = docs.copy(), np.zeros(len(docs), np.int64)
        if len(left) and len(right):
            for k, found in trie_links([sets[x] for x in left], [sets[x] for x in right], num, den):
                y, near = right[k], left[found]
                near = near[near != y]
                if len(near):
                    links[y] += len(near)
                    if first != second:
                        links[near] += 1
                    joined = np.unique(label[np.append(near, y)])
                    if len(joined) > 1:
                        label[np.isin(label, joined[1:])] = joined[0]
        return pd.DataFrame({"doc_id": docs, "label": label, "links": links})

    return run


def ngram_jaccard_join(documents: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row of documents(doc_id, text).

    n_links counts the different sets linked with the row's own; copies of one set count once.
    """
    spark = documents.sparkSession
    den = 100
    num = round(threshold * den)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = stored(texts.mapInArrow(_describe(width, ORDER_BITS), SET_SCHEMA))
    sets = described.filter("part is null").select("doc_id", "n_shingles", "s1", "s2")
    parts = (
        described.filter("part is not null")
        .select("part", "counts")
        .repartition("part")
        .sortWithinPartitions("part")
        .mapInArrow(_merge_counts, "part int, level binary")
    )
    level = np.zeros(((1 << ORDER_BITS) // BLOCK, BLOCK), np.uint8)  # bounded: 4 MiB whatever the input
    for part, blob in parts.collect():
        level[part] = np.frombuffer(blob, np.uint8)
    levels = spark.sparkContext.broadcast(level.reshape(-1))

    prefixes = texts.filter("doc_id is not null").mapInArrow(
        _prefixes(width, ORDER_BITS, num, den, levels), "token long, doc long, n int, tied long, has boolean"
    )
    pairs = prefixes.repartition("token").sortWithinPartitions("token").mapInArrow(_pairs(num, den), "a long, b long, e int")
    edges = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("e").alias("e")).filter("shared >= e")
    tied = components(edges, "a", "b")
    clusters = tied.select("node", "component").unionByName(
        tied.select(F.col("component").alias("node"), "component").distinct()
    )
    known = sets.filter("doc_id is not null and n_shingles > 0")
    # Every set stands under its smallest document, whichever copies were met.
    classes = stored(known.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep")))
    members = classes.join(clusters, classes["s1"] == clusters["node"])
    weight = members.groupBy("component").agg(F.count("*").alias("sets"), F.sum("n_shingles").alias("weight")).filter("sets > 1")
    members = stored(
        members.join(weight, "component").select(
            F.col("rep"),
            "s1",
            "s2",
            F.col("component").alias("cluster"),
            F.ceil(F.col("weight") / CLUSTER_SHINGLES).cast("int").alias("blocks"),
        )
    ).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    wanted = spark.sparkContext.broadcast(_filter_of(members.select("rep")))
    loaded = (
        texts.filter("doc_id is not null")
        .mapInArrow(_wanted(wanted), "doc_id long, text string")
        .join(members.withColumnRenamed("rep", "doc_id"), "doc_id")
    )
    against = F.explode(F.expr("sequence(0, blocks - 1)"))
    paired = loaded.withColumn("other", against).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    found = stored(
        paired.groupBy("cluster", "i", "j").applyInPandas(
            _cluster_links(width, num, den), "doc_id long, label long, links long"
        )
    )
    roots = components(found.filter("doc_id != label"), "doc_id", "label")
    linked = found.groupBy("doc_id").agg(F.sum("links").alias("n_links")).withColumnRenamed("doc_id", "linked")
    # What the smallest document of every set reaches.
    classes = classes.join(roots, classes["rep"] == roots["node"], "left").join(
        linked, F.col("rep") == linked["linked"], "left"
    )
    classes = classes.select(
        F.col("s1").alias("c1"),
        F.col("s2").alias("c2"),
        F.col("n_shingles").alias("c3"),
        F.coalesce("component", "rep").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
    same = (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")) & (F.col("n_shingles") == F.col("c3"))
    return sets.join(classes, same & F.col("doc_id").isNotNull(), "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )
