"""Spelling variants grouped by dense prefix-suffix tiling.

Two words differ by one inserted, deleted or replaced code point exactly if their common prefix and common
suffix together reach the longer length minus one. Words are rows of padded code-point matrices, one aligned
left and one aligned right; a tile compares every word of one block with every word of another at once: the
first unequal column from the left is the prefix length, from the right the suffix length.

Blocks: with m the shorter length, a single edit lies behind the first m // 2 code points or before the last
m // 2, so two near words share one of these halves. Words that share a half (of the same m) are a block. A
block of more than a tile is cut into parts by hash that meet in pairs, each pair of parts a tile of its own,
so no block goes to one task whole; all pairs inside a block are the comparison itself and only links leave
it, reduced in the task to one row per word: how many near words, and the best of them.

Counts come from whole texts, added up inside tasks first. A word's form is its near word of largest count
(ties: smallest in code-point order) if that count is at least `ratio` times its own, so forms only rise and
roots are found by pointer doubling. No table of words or links is collected.

Nulls and empty texts have no words; a null id is an empty id. Repeated rows count again. Words of any length
take part; tiles hold fewer words where words are long.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilescope.llm.common import LOWER, UPPER, stored
from tilescope.llm.interleave import CRC_TABLE_SQL, crc_sql

RUN = re.compile("[A-Za-zÀ-ÿ]+")
GAP = re.compile("[^A-Za-zÀ-ÿ]")
PIECE = 1 << 20  # code points of a text read at once; cuts fall between words
HELD_WORDS = 200_000  # words a task adds up before it sends them on
BLOCK_WORDS = 2048
BLOCK_POINTS = 1 << 18  # code points of a block, where words are long
PAIR_POINTS = 1 << 22  # matrix cells compared at once
TASK_PAIRS = 20_000_000

_LOWER = str.maketrans(UPPER, LOWER)


def _pieces(text: str) -> Iterator[str]:
    begin = 0
    while len(text) - begin > PIECE:
        gap = GAP.search(text, begin + PIECE)
        if gap is None:
            break
        yield text[begin : gap.start()]
        begin = gap.start()
    yield text[begin:]


def _counted(typo_every: int | None, least_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"]
            )
            total.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                own: Counter[str] = Counter()
                for piece in _pieces(text.as_py() or ""):
                    own.update(RUN.findall(piece))
                doc = "" if doc_id.as_py() is None else str(doc_id.as_py())
                begun = zlib.crc32(f"{doc}:".encode())
                same: Counter[str] = Counter()
                for word, n in own.items():
                    same[word.lower() if word.isascii() else word.translate(_LOWER)] += n
                for word, n in same.items():
                    if typo_every:
                        h = zlib.crc32(word.encode(), begun)
                        if h % typo_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                    if len(word) >= least_length:
                        total[word] += n
                if len(total) > HELD_WORDS:
                    yield flush()
        yield flush()

    return run


def word_counts(documents: DataFrame, least_length: int, least_count: int, typo_every: int | None = None) -> DataFrame:
    """(word, n) of words of enough code points and occurrences; A-Z count as a-z.

    With typo_every, a run of a document loses one code point where the CRC-32 of `<doc_id>:<run>` is divisible by it.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = rows.mapInArrow(_counted(typo_every, least_length), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def padded(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left-aligned matrix, right-aligned matrix, lengths); 0 stands beyond a word's ends.

    A code point is kept one higher, in the smallest integer that holds all.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    kind = next(k for k in (np.uint8, np.uint16, np.uint32) if points.max(initial=0) <= np.iinfo(k).max)
    width = int(lengths.max(initial=0)) + 1
    row = np.repeat(np.arange(len(words)), lengths)
    col = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left, right = np.zeros((len(words), width), kind), np.zeros((len(words), width), kind)
    left[row, col] = points
    right[row, col + np.repeat(width - lengths, lengths)] = points
    return left, right[:, ::-1], lengths


def compared(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(common prefix, common suffix) lengths of rows a and b of the matrices; equal words have 0 for both."""
    return (left[a] != left[b]).argmax(axis=1), (right[a] != right[b]).argmax(axis=1)


def _ranges(tile: np.ndarray, part: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows [low, high) every row is compared with; rows are sorted by tile, then part, then length.

    A tile of one part compares every shorter word with all that follow. A tile of two parts compares the
    first part with the second. Two of the longer words are never compared.
    """
    n = len(tile)
    new = np.r_[True, tile[1:] != tile[:-1]]
    number = np.cumsum(new) - 1
    ends = np.append(np.flatnonzero(new)[1:], n)[number]
    starts = np.flatnonzero(new)[number]
    second = part != part[starts]  # rows of a tile's second part
    n_second = np.bincount(number, second)[number].astype(np.int64)
    short_second = np.bincount(number, second & ~long)[number].astype(np.int64)
    low = np.where(n_second > 0, ends - n_second, np.arange(n) + 1)
    high = np.where(n_second > 0, np.where(long, low + short_second, ends), np.where(long, low, ends))
    high = np.where(second, low, high)
    return low, np.maximum(low, high)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (word, near, best_n, best) of what a word meets in a tile; rows arrive sorted by tile."""

    def links(t: pa.Table) -> Iterator[pa.RecordBatch]:
        words, counts = t["word"].to_pylist(), t["n"].to_numpy()
        m, side = t["m"].to_numpy().astype(np.int64), t["side"].to_numpy()
        tiles = [t[c].to_numpy() for c in ("m", "side", "half", "i", "j")]
        differs = np.zeros(len(words), bool)
        for c in tiles:
            differs[1:] |= c[1:] != c[:-1]
        left, right, lengths = padded(words)
        low, high = _ranges(np.cumsum(differs), t["part"].to_numpy(), lengths > m)
        n_pairs = high - low
        before = np.cumsum(n_pairs) - n_pairs
        at_once = max(1, PAIR_POINTS // left.shape[1])
        found = [np.zeros((2, 0), np.int64)]
        for begin in range(0, int(n_pairs.sum()), at_once):
            pair = np.arange(begin, min(begin + at_once, int(n_pairs.sum())))
            a = np.searchsorted(before, pair, "right") - 1
            b = low[a] + pair - before[a]
            prefix, suffix = compared(left, right, a, b)
            near = prefix + suffix >= np.maximum(lengths[a], lengths[b]) - 1
            # A pair that shares both halves counts where it shares the first.
            near &= np.where(side[a] == 0, prefix >= m[a] // 2, prefix < m[a] // 2)
            found.append(np.stack([a[near], b[near]]))
        a, b = np.concatenate(found, axis=1)
        own, other = np.r_[a, b], np.r_[b, a]
        if not len(own):
            return
        order = sorted(range(len(words)), key=lambda k: (-counts[k], words[k]))
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        near = np.bincount(own, minlength=len(words))
        best = np.full(len(words), len(words))
        np.minimum.at(best, own, place[other])
        rows = np.flatnonzero(near)
        picked = [order[k] for k in best[rows]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([words[k] for k in rows], pa.string()),
                pa.array(near[rows], pa.int64()),
                pa.array(counts[picked], pa.int64()),
                pa.array([words[k] for k in picked], pa.string()),
            ],
            ["word", "near", "best_n", "best"],
        )

    def by_width(t: pa.Table) -> Iterator[pa.RecordBatch]:
        # Rows come by rising m; matrices hold words of at most twice the shortest's length.
        width = np.frexp(t["m"].to_numpy())[1]
        bounds = [0, *(np.flatnonzero(np.diff(width)) + 1).tolist(), t.num_rows]
        for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
            yield from links(t.slice(begin, end - begin))

    held: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now]).combine_chunks()
        if not held.num_rows:
            continue
        # The last tile may go on in the next batch.
        last = np.ones(held.num_rows, bool)
        for c in ("m", "side", "half", "i", "j"):
            values = held[c].to_numpy()
            last &= values == values[-1]
        cut = held.num_rows - int(last.sum())
        if cut:
            yield from by_width(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield from by_width(held)


def near_words(counts: DataFrame, least_length: int) -> DataFrame:
    """(word, n_near, best, best_n) of the words of counts(word, n) that have a near word."""
    size = F.length("word")

    def halves(m):
        half = F.floor(m / 2).cast("int")
        return [
            F.struct(m.alias("m"), F.lit(side).alias("side"), F.xxhash64(F.substring("word", begin, half)).alias("half"))
            for side, begin in enumerate((F.lit(1), size - half + 1))
        ]

    both = F.array(*halves(size), *halves(size - 1))
    keys = F.when(size > least_length, both).otherwise(F.array(*halves(size)))
    rows = counts.select("word", "n", F.explode(keys).alias("k")).select("word", "n", "k.*")
    rows = stored(rows)
    block = F.greatest(F.lit(16), F.least(F.lit(BLOCK_WORDS), F.floor(F.lit(BLOCK_POINTS) / F.col("m")))).cast("int")
    sizes = rows.groupBy("m", "side", "half").agg(F.count("*").alias("words"), F.sum((size == F.col("m")).cast("long")).alias("short"))
    sizes = stored(sizes.filter("words > 1 and short > 0").withColumn("parts", F.ceil(F.col("words") / block).cast("int")))
    pairs = sizes.agg(F.sum(F.col("words") * F.col("words") / 2)).first()[0] or 0
    key = ["m", "side", "half"]
    rows = rows.join(sizes.select(*key, "parts"), key)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    rows = rows.select("word", "n", *key, "part", other)
    rows = rows.select("word", "n", *key, "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    # Tasks by the work in them, so that few bytes with many pairs are not put together.
    tasks = max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(pairs // TASK_PAIRS) + 1)
    tile = [*key, "i", "j"]
    rows = rows.repartition(tasks, *tile).sortWithinPartitions(*tile, "part", size, "word")
    met = rows.mapInArrow(_tiles, "word string, near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("first")
    found = met.groupBy("word").agg(F.sum("near").alias("n_near"), first)
    return found.select("word", "n_near", F.col("first.word").alias("best"), (-F.col("first.n")).alias("best_n"))


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) of forms(word, form): the last word on following forms, found by pointer doubling."""
    step = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        further = step.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        joined = step.join(further, F.col("root") == F.col("_word"), "left")
        moved = stored(joined.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")))
        step = moved.select("word", "root")
        if not moved.filter("moved").limit(1).count():
            return step


def spelling_variants(
    documents: DataFrame, least_length: int = 5, least_count: int = 3, ratio: int = 2, typo_every: int | None = None
) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of documents(doc_id, text)."""
    counts = stored(word_counts(documents, least_length, least_count, typo_every))
    near = stored(near_words(counts, least_length))
    better = F.col("best_n") >= ratio * F.col("n")
    found = counts.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(better, F.col("best")).alias("form"),
        F.when(better, F.col("best_n")).alias("form_n"),
    )
    found = stored(found)
    roots = roots_of(found.filter("form is not null"))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


#: spelling_variants of a relation documents with the usual lengths and counts. Near words share a word with one hole.
def variants_sql(typo_every: int) -> str:
    return f"""
WITH RECURSIVE {CRC_TABLE_SQL}, occurrence AS (
  SELECT COALESCE(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents
), low AS (
  SELECT d, translate(run, '{UPPER}', '{LOWER}') AS w, count(*) AS k FROM occurrence GROUP BY 1, 2
), hashed AS (
  SELECT w, k, {crc_sql("d || ':' || w")} AS h FROM low, crc_table
), typed AS (
  SELECT CASE WHEN h % {typo_every} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM hashed
), v AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM typed WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), holes AS (
  SELECT word, n, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
), pairs AS (
  SELECT x.word, y.word AS other, y.n AS other_n FROM holes x JOIN holes y ON x.a || '*' || x.b = y.a || '*' || y.b AND x.word <> y.word
  UNION SELECT h.word, v.word, v.n FROM holes h JOIN v ON h.a || h.b = v.word
  UNION SELECT v.word, h.word, h.n FROM holes h JOIN v ON h.a || h.b = v.word
), near AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS best, max(other_n) AS best_n FROM pairs GROUP BY word
), found AS (
  SELECT v.word, n, COALESCE(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * n THEN best END AS form, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n
  FROM v LEFT JOIN near ON v.word = near.word
), chain(word, last_form) AS (
  SELECT word, word FROM found
  UNION ALL SELECT chain.word, found.form FROM chain JOIN found ON chain.last_form = found.word WHERE found.form IS NOT NULL
)
SELECT found.word, n, n_near, form, form_n, last_form AS root
FROM found JOIN chain ON found.word = chain.word
WHERE last_form IN (SELECT word FROM found WHERE form IS NULL)
"""
