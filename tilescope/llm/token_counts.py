"""Token counts by rank-synchronous array merging.

Counts the tokens that a BPE model of the sentencepiece kind (identity normaliser, a space put in
front, byte fallback) gives each text. Texts fall apart before a space that follows another
character: no vocabulary entry crosses that place. The distinct pre-tokens of a batch are laid into
one ragged array of symbols; in every step each sequence merges its lowest-ranked pair, leftmost
first, all sequences at once, until no pair is left. Symbols that survive are the tokens; a
character outside the vocabulary counts one token per UTF-8 byte.

A null or empty text has no bytes and no tokens. Repeated rows are counted each. Whole texts are
counted whatever their length. Pre-tokens of more than LONG symbols are merged in arrays too, about
SWEEP symbols together, but all non-overlapping places of the lowest pair in one step.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
LONG = 512
SWEEP = 2_000_000
CACHE_WORDS = 300_000
NONE = np.iinfo(np.int32).max
_PRE_TOKEN = re.compile(" *[^ ]+| +")


class MergeTable:
    """Ranks of symbol pairs of one vocabulary."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for probe in ("a  b ", "½ﬁ\t"):
            if model.normalize(probe) != SPACE + probe.replace(" ", SPACE):
                raise ValueError(f"{path}: only models that leave texts as they are can be counted")
        pieces = {}
        for i in range(model.vocab_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                pieces[model.id_to_piece(i)] = -model.get_score(i)
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError(f"{path}: an entry crosses a word end")
        ids = {p: k for k, p in enumerate(pieces)}
        for p in list(pieces):  # characters that only occur inside entries
            for c in p:
                ids.setdefault(c, len(ids))
        ordered = {s: k for k, s in enumerate(sorted(set(pieces.values())))}
        self.size = len(ids) + 1
        self.chars = np.full(0x110000, len(ids), np.int32)  # the last id is any other character
        for p, k in ids.items():
            if len(p) == 1:
                self.chars[ord(p)] = k
        self.chars[ord(" ")] = self.chars[ord(SPACE)]
        self.known = np.zeros(self.size, bool)
        self.known[: len(pieces)] = True
        pairs = [
            (ids[p[:k]] * self.size + ids[p[k:]], ordered[score], ids[p])
            for p, score in pieces.items()
            for k in range(1, len(p))
            if p[:k] in ids and p[k:] in ids
        ]
        pairs.sort()
        self.keys = np.array([k for k, _, _ in pairs], np.int64)
        self.ranks = np.array([r for _, r, _ in pairs], np.int32)
        self.merged = np.array([m for _, _, m in pairs], np.int32)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or NONE, merged symbol) of pairs."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE).astype(np.int32), self.merged[at]

    def counts(self, words: list[str]) -> np.ndarray:
        """Number of tokens of every pre-token."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out = np.zeros(len(words), np.int64)
        long = np.flatnonzero(lengths > LONG)
        for part in np.split(long, np.flatnonzero(np.diff(np.cumsum(lengths[long]) // SWEEP)) + 1) if len(long) else []:
            out[part] = self._counts_long([words[k] for k in part])
        ids = np.flatnonzero(lengths <= LONG)
        if not len(ids):
            return out
        code = np.frombuffer("".join(words[k] for k in ids).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbol = self.chars[code]
        extra = np.where(code < 0x80, 0, np.where(code < 0x800, 1, np.where(code < 0x10000, 2, 3)))  # further UTF-8 bytes
        owner = np.repeat(ids, lengths[ids])
        while len(symbol):
            rank = np.full(len(symbol), NONE, np.int32)
            merged = np.zeros(len(symbol), np.int32)
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            rank[inner], merged[inner] = self.look_up(symbol[inner], symbol[inner + 1])
            while True:
                start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                lowest = np.minimum.reduceat(rank, start)
                ended = lowest == NONE
                if 2 * ended.sum() >= len(start):  # take finished sequences out before the arrays are copied again
                    break
                size = np.diff(np.r_[start, len(symbol)])
                place = np.flatnonzero((rank == np.repeat(lowest, size)) & (rank != NONE))
                place = place[np.r_[True, owner[place[1:]] != owner[place[:-1]]]]
                symbol[place] = merged[place]
                stay = np.ones(len(symbol), bool)
                stay[place + 1] = False
                at = (np.cumsum(stay) - 1)[place]
                symbol, owner, rank, merged, extra = symbol[stay], owner[stay], rank[stay], merged[stay], extra[stay]
                again = np.unique(np.r_[at, at - 1])
                again = again[(again >= 0) & (again < len(symbol))]
                pair = again[again + 1 < len(symbol)]
                pair = pair[owner[pair] == owner[pair + 1]]
                rank[again] = NONE
                rank[pair], merged[pair] = self.look_up(symbol[pair], symbol[pair + 1])
            done = np.repeat(ended, np.diff(np.r_[start, len(symbol)]))
            tokens = 1 + np.where(self.known[symbol[done]], 0, extra[done])
            out += np.bincount(owner[done], tokens, minlength=len(out)).astype(np.int64)
            symbol, owner, extra = symbol[~done], owner[~done], extra[~done]
        return out

    def _counts_long(self, words: list[str]) -> np.ndarray:
        """counts() by a sweep over ranks: one step merges the lowest rank wherever it stands in any sequence.

        The flat arrays keep every symbol's place and link it to its neighbours, and places wait under the rank of
        their pair, so a step touches only what it merges. Of overlapping places the left one goes first. A merge may
        make a pair of the same or a lower rank: in that sequence the places to the right of it wait, as such a pair
        has to go first.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbol = self.chars[code].copy()
        extra = np.where(code < 0x80, 0, np.where(code < 0x800, 1, np.where(code < 0x10000, 2, 3)))
        owner = np.repeat(np.arange(len(words)), lengths)
        ends, begins = np.cumsum(lengths) - 1, np.cumsum(lengths) - lengths
        after, before = np.arange(1, len(symbol) + 1), np.arange(-1, len(symbol) - 1)
        after[ends], before[begins] = -1, -1
        alive = np.ones(len(symbol), bool)
        rank = np.full(len(symbol), NONE, np.int32)
        merged = np.zeros(len(symbol), np.int32)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def wait(level: int, places: np.ndarray) -> None:
            if level not in waiting:
                waiting[level] = []
                heapq.heappush(ranks, level)
            waiting[level].append(places)

        def renew(places: np.ndarray) -> None:
            """Ranks of the pairs that begin at some places, which then wait under them."""
            rank[places] = NONE
            places = places[after[places] >= 0]
            rank[places], merged[places] = self.look_up(symbol[places], symbol[after[places]])
            places = places[rank[places] != NONE]
            places = places[np.argsort(rank[places], kind="stable")]
            cuts = np.flatnonzero(np.diff(rank[places])) + 1
            for part in np.split(places, cuts) if len(places) else []:
                wait(int(rank[part[0]]), part)

        renew(np.arange(len(symbol)))
        while ranks:
            level = heapq.heappop(ranks)
            found = np.unique(np.concatenate(waiting.pop(level)))
            found = found[alive[found] & (rank[found] == level)]
            if not len(found):
                continue
            # Every other place of a chain of overlapping ones.
            linked = np.r_[False, after[found[:-1]] == found[1:]]
            chain = np.maximum.accumulate(np.where(linked, 0, np.arange(len(found))))
            place = found[(np.arange(len(found)) - chain) % 2 == 0]
            new, second, left = merged[place], after[place], before[place]
            right = after[second]
            # Neighbours at the time of the merge: left ones may be merged already, right ones are not.
            beside = np.r_[False, (second[:-1] == left[1:])]
            left_symbol = np.where(beside, np.r_[0, new[:-1]], symbol[left])
            least = np.where(left >= 0, self.look_up(left_symbol, new)[0], NONE)
            least = np.minimum(least, np.where(right >= 0, self.look_up(new, symbol[right])[0], NONE))
            hinders = least <= level
            if hinders.any():
                earlier = np.cumsum(hinders) - hinders
                first = np.r_[True, owner[place[1:]] != owner[place[:-1]]]
                earlier -= np.maximum.accumulate(np.where(first, earlier, 0))
                wait(level, found[np.isin(owner[found], owner[place[hinders]])])
                place = place[earlier == 0]
                new, second = new[earlier == 0], second[earlier == 0]
                right = after[second]
            symbol[place] = new
            alive[second] = False
            after[place] = right
            inner = right >= 0
            before[right[inner]] = place[inner]
            left = before[place]
            renew(np.unique(np.r_[place, left[left >= 0]]))
        tokens = 1 + np.where(self.known[symbol[alive]], 0, extra[alive])
        return np.bincount(owner[alive], tokens, minlength=len(words)).astype(np.int64)


def _counter(path: Callable[[], str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, cache = MergeTable(path()), {}
        for batch in batches:
            texts, totals = batch.column(1), np.zeros(batch.num_rows, np.int64)
            for begin in range(0, batch.num_rows, 256):
                split = [
                    _PRE_TOKEN.findall(" " + t.replace(SPACE, " ")) if t else []
                    for t in texts.slice(begin, 256).to_pylist()
                ]
                new = list(set().union(*split).difference(cache))
                if len(cache) + len(new) > CACHE_WORDS:
                    cache.clear()
                    new = list(set().union(*split))
                cache.update(zip(new, table.counts(new).tolist(), strict=True))
                for k, words in enumerate(split, begin):
                    totals[k] = sum(map(cache.__getitem__, words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(totals)], ["doc_id", "n_bytes", "n_tokens"]
            )

    return run


def token_counts(documents: DataFrame, model: Callable[[], str], limit: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of documents(doc_id, text).

    `model` is called in the tasks and names the vocabulary file there.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = rows.mapInArrow(_counter(model), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
