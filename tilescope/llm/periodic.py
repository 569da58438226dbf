"""Periodic runs of words, found with a suffix automaton whose link tree is accessed as a link-cut tree.

A run is a stretch of words with smallest period q and length of at least `exponent` times q that no
neighbouring word extends keeping q. The automaton of a text has a state for every prefix; the states from it
up its suffix links hold all suffixes of the prefix. For every appended word that path is accessed and
recoloured with the word's place: a path segment of one colour holds the suffixes, up to its longest, whose
last occurrence ended there. If the distance from a segment's colour to the new end lies within the lengths of
the segment, the two occurrences touch: a square whose root is not itself repeated, of that period. The first
square of a run ends twice its period behind its start; it is extended to both sides as far as words one
period apart are equal.

Before that, words outside of stretches where a run can lie are left out: a run of period q repeats each of
its three-word grams q later, so a stretch's positions all have their gram again within a bounded distance,
and the bound shrinks with the stretch. This is exact, what is left out holds no run.

A row is judged inside one task, row by row. Memory grows with the longest row: its words, and about a
kilobyte for every word of its longest stretch. Null and empty texts have no words and no runs; ids and
sources play no part; repeated rows are judged each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
SHRINKS = 16  # times the bound of a stretch is drawn closer; more would only leave out more
_STEPS = np.array([0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 1], np.uint64)


def suffix_automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(state of every prefix, suffix link, longest length) by state; state 0 is the empty word."""
    after: list[dict[int, int]] = [{}]
    link, length, ends, last = [-1], [0], [], 0
    for c in words:
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        after.append({})
        p = last
        while p >= 0 and c not in after[p]:
            after[p][c] = new
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                after.append(after[q].copy())
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
        ends.append(new)
    return ends, link, length


def squares(words: list[int]) -> Iterator[tuple[int, int]]:
    """(end, period) of squares with a root that is not repeated itself, by rising end.

    For each run its first square is among them. Splay trees hold the segments of a colour, shallow states
    to the left; the colour stands at a splay tree's top.
    """
    ends, link, length = suffix_automaton(words)
    up = [p if p > 0 else -1 for p in link]
    left, right, colour = [-1] * len(link), [-1] * len(link), [-1] * len(link)

    def is_top(x: int) -> bool:
        p = up[x]
        return p < 0 or (left[p] != x and right[p] != x)

    def turn(x: int) -> None:
        p = up[x]
        g = up[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b >= 0:
            up[b] = p
        up[p], up[x] = x, g
        if g >= 0:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    def raise_to_top(x: int) -> None:
        top = x
        while not is_top(top):
            top = up[top]
        if top == x:
            return
        shade = colour[top]
        while not is_top(x):
            p = up[x]
            if not is_top(p):
                turn(p if (left[up[p]] == p) == (left[p] == x) else x)
            turn(x)
        colour[x] = shade

    for end, state in enumerate(ends):
        x, below = state, -1
        while x >= 0:
            raise_to_top(x)
            shade = colour[x]
            if right[x] >= 0:
                colour[right[x]] = shade
            right[x] = below
            above = up[x]
            if shade >= 0 and (length[above] if above >= 0 else 0) < end - shade <= length[x]:
                yield end, end - shade
            below, x = x, above
        colour[below] = end


def runs_of(words: list[int], least: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, period, length) of every run of at least `least` words and `exponent` (2 or more) periods."""
    found, known, n = [], {}, len(words)
    for end, q in squares(words):
        if known.get(q, 0) > end:
            continue
        far = end + (exponent - 2) * q
        if far >= n or words[far] != words[far - q]:
            continue  # too short: the run's first square had to go on this far
        stop = end + 1
        while stop < n and words[stop] == words[stop - q]:
            stop += 1
        known[q] = stop
        start = end - 2 * q + 1
        while start > 0 and words[start - 1] == words[start - 1 + q]:
            start -= 1
        if stop - start >= max(least, exponent * q):
            found.append((start, q, stop - start))
    return found


def stretches(words: np.ndarray, least: int, exponent: int) -> list[tuple[int, int]]:
    """Disjoint ranges of words, each run wholly inside one."""
    gram = 3 if exponent >= 3 and least >= 5 else 1
    n = len(words) - gram + 1
    if len(words) < max(least, exponent):
        return []
    key = sum(words[k : n + k].astype(np.uint64) * _STEPS[k] for k in range(gram))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    gap = np.zeros(n, np.int64)
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    hit = gap > 0
    for _ in range(SHRINKS):
        edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        # A run of period q has at least (exponent - 1) q - gram + 1 positions here, all with a gap of at most q.
        bound = (end - begin + gram - 1) // (exponent - 1)
        near = gap[hit] <= np.repeat(bound, end - begin)
        if near.all():
            break
        hit[np.flatnonzero(hit)[~near]] = False
    if not len(begin):
        return []
    end = np.minimum(end + bound + gram - 1, len(words))
    furthest = np.maximum.accumulate(end)
    first = np.r_[True, begin[1:] >= furthest[:-1]]
    last = np.r_[first[1:], True]
    wide = furthest[last] - begin[first] >= max(least, exponent)
    return list(zip(begin[first][wide].tolist(), furthest[last][wide].tolist(), strict=True))


def text_runs(words: list[bytes], least: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, period, length) of a text's runs by start, then period."""
    if len(words) < max(least, exponent):
        return []
    seen: dict[bytes, int] = {}
    ids = np.fromiter(map(seen.setdefault, words, count()), np.int64, len(words))
    found = []
    for begin, end in stretches(ids, least, exponent):
        found += [(begin + s, q, n) for s, q, n in runs_of(ids[begin:end].tolist(), least, exponent)]
    return sorted(found)


def _judged(least: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, runs, texts = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                words = (text.as_py() or b"").split()
                found = text_runs(words, least, exponent)
                sizes.append(len(words))
                runs.append([{"start": s, "length": n, "period": q} for s, q, n in found])
                if found:
                    dropped = np.zeros(len(words) + 1, np.int64)
                    for s, q, n in found:
                        dropped[s + q] += 1
                        dropped[s + n] -= 1
                    keep = np.cumsum(dropped[:-1]) == 0
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                texts.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, RUNS), pa.array(texts, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    return run


def find_runs(documents: DataFrame, least: int = 6, exponent: int = 4) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of documents(doc_id, text).

    runs: start, length and period of every run, by start, then period. collapsed: the words that are not in
    any run behind its first period, joined by one space.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return rows.mapInArrow(_judged(least, exponent), kinds)
