"""Language-model scores from an n-gram trie in Elias-Fano levels.

The model interpolates word pairs with single words:
p(w | c) = L * C(c, w) / C(c) + (1 - L) * (C(w) + 1) / (N + V + 1), and the second part alone after a
context c that was never seen. Every text begins after a start mark and ends with an end mark.

Documents are dealt into chunks of bounded size. A chunk asks for the counts of its distinct words
and pairs, each once however often it has them, and brings its own training counts; so a hot word or
pair is a row per chunk at most. Askings meet in shards, a pair by its context and a few bits of its
word, so that a hot context is spread. A shard holds its part of the trie: contexts, monotone
pointers to their successors, successors as an Elias-Fano sequence made monotone by the context's
number, and pair counts quantised on a logarithmic scale without an upper end; codes travel as bytes,
and as two bytes each where a shard's answer holds a count above 3.7 million. Successors are searched relative to their
context. Answers go back to the chunks, aligned with what was asked, and each chunk scores its texts.
No table of the whole vocabulary is ever in one place; all moved data grows with the input.

A null text is empty: one end token. Repeated rows are learned and scored each; ids only decide the
fold, a null id is in fold 0. Without training documents the model knows nothing: N = V = 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilescope.llm import wordhash

WEIGHT = 0.2
CHUNK_BYTES = 8 << 20
SPREAD_BITS = 4  # a context's pairs go to up to 16 shards
END = wordhash.mix(np.array([0x1D], np.uint64))[0]
START = wordhash.mix(np.array([0x1C], np.uint64))[0]
#: Counts that a code stands for: 0 to 64 exactly, then steps of a twelfth of a factor 2 up to the largest 64-bit count.
CODES = np.unique(np.r_[np.arange(65), np.round(64 * 2.0 ** (np.arange(1, 12 * 58 + 1) / 12))].astype(np.float64))


def quantised(counts: np.ndarray) -> np.ndarray:
    """Code of the nearest count that has one."""
    at = np.clip(np.searchsorted(CODES, counts), 1, len(CODES) - 1)
    nearer = (counts - CODES[at - 1]) < (CODES[at] - counts)
    return (at - nearer).astype(np.uint16)


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary; successor search within a given range."""

    def __init__(self, values: np.ndarray, universe: int) -> None:
        n = max(1, len(values))
        self.n, self.low_bits = len(values), max(0, (max(universe, 1) // n).bit_length() - 1)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        self.low = _pack(values & np.uint64((1 << self.low_bits) - 1), self.low_bits)
        unary = np.zeros((int(high[-1]) + 1 if len(high) else 0) + len(values), np.uint8)
        unary[high + np.arange(len(values))] = 1
        self.unary = np.packbits(unary)
        self.bits = len(unary)

    def open(self) -> None:
        """Directory of the zeros: where each high part begins."""
        unary = np.unpackbits(self.unary, count=self.bits)
        zeros = np.flatnonzero(unary == 0)
        self.begin = np.r_[0, zeros - np.arange(len(zeros)), self.n]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of the first element not below each key; keys are searched within their high part's range."""
        high = np.minimum(keys >> np.uint64(self.low_bits), np.uint64(max(0, len(self.begin) - 2))).astype(np.int64)
        past = (keys >> np.uint64(self.low_bits)).astype(np.int64) > high
        lo, hi = self.begin[high], np.where(past, self.begin[high], self.begin[high + 1])
        wanted = keys & np.uint64((1 << self.low_bits) - 1)
        lo = np.where(past, self.n, lo)
        hi = np.maximum(lo, hi)
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi) >> 1
            less = open_ & (self._low(np.minimum(mid, max(0, self.n - 1))) < wanted)
            lo = np.where(less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)

    def at(self, index: np.ndarray) -> np.ndarray:
        high = np.searchsorted(self.begin, index, "right") - 1
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self._low(index)

    def _low(self, index: np.ndarray) -> np.ndarray:
        return _unpack(self.low, self.low_bits, index)


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Values of `bits` bits each, one after the other in 64-bit words."""
    words = np.zeros((len(values) * bits + 63) // 64 + 2, np.uint64)
    if bits:
        at = np.arange(len(values), dtype=np.int64) * bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        np.bitwise_or.at(words, word, values << shift)
        over = np.where(shift > 0, values >> np.minimum(np.uint64(64) - shift, np.uint64(63)), np.uint64(0))
        np.bitwise_or.at(words, word + 1, np.where(shift.astype(np.int64) + bits > 64, over, np.uint64(0)))
    return words


def _unpack(words: np.ndarray, bits: int, index: np.ndarray) -> np.ndarray:
    if not bits:
        return np.zeros(len(index), np.uint64)
    at = index.astype(np.int64) * bits
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << np.minimum(np.uint64(64) - shift, np.uint64(63)), np.uint64(0))
    return (low | high) & np.uint64((1 << bits) - 1)


class TrieShard:
    """Contexts, pointers, successors and quantised counts of the pairs that fell to one shard."""

    SUCCESSOR_BITS = 40

    def __init__(self, context: np.ndarray, successor: np.ndarray, count: np.ndarray) -> None:
        """Distinct pairs in order, with counts; successors of one context differ in their top 40 bits."""
        new = np.r_[True, context[1:] != context[:-1]] if len(context) else np.zeros(0, bool)
        self.contexts = context[new]
        pointer = np.r_[np.flatnonzero(new), len(context)].astype(np.uint64)
        number = (np.cumsum(new) - 1).astype(np.uint64)
        level = (number << np.uint64(self.SUCCESSOR_BITS)) | successor
        self.pointers = EliasFano(pointer, len(context) + 1)
        self.successors = EliasFano(level, max(1, len(self.contexts)) << self.SUCCESSOR_BITS)
        self.codes = quantised(count)
        self.pointers.open()
        self.successors.open()

    def look_up(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Code of every pair; 0 where the pair was never seen."""
        out = np.zeros(len(context), np.uint16)
        if not len(self.contexts):
            return out
        number = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        known = np.flatnonzero(self.contexts[number] == context)
        number, wanted = number[known], successor[known]
        key = (number.astype(np.uint64) << np.uint64(self.SUCCESSOR_BITS)) | wanted
        place = self.successors.find(key)
        inside = place < self.pointers.at(number + 1).astype(np.int64)  # still below the same context
        safe = np.minimum(place, self.successors.n - 1)
        hit = inside & (self.successors.at(safe) == key)
        out[known[hit]] = self.codes[safe[hit]]
        return out


def _numbers(values: np.ndarray) -> bytes:
    """Non-negative integers in as few bytes each as the largest needs, that width first."""
    values = np.ascontiguousarray(values, np.uint64)
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _read_numbers(data: bytes) -> np.ndarray:
    width = data[0]
    packed = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    out = np.zeros((len(packed), 8), np.uint8)
    out[:, :width] = packed
    return out.reshape(-1).view(np.uint64)


def _gaps(values: np.ndarray) -> bytes:
    """A rising sequence by its differences."""
    return _numbers(np.diff(values, prepend=np.uint64(0)))


def _read_gaps(data: bytes) -> np.ndarray:
    return np.cumsum(_read_numbers(data), dtype=np.uint64)


class _Chunk:
    """Tokens of a chunk's texts, its distinct words and pairs, and where they go."""

    def __init__(self, texts: pa.ChunkedArray, held_out: np.ndarray, shards: int) -> None:
        parts, lengths = [], []
        texts = texts.combine_chunks()
        for piece in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
            for _, data, offsets in wordhash.text_blocks(piece):
                hashes, first = wordhash.word_hashes(data, offsets)
                parts.append(np.insert(hashes, first[1:], END))
                lengths.append(np.diff(first) + 1)
        token = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        length = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(length)), length)
        self.length = length
        learned = ~held_out[self.owner]
        begins = np.cumsum(length) - length
        # Distinct words, and shards of words in rising order: a word's shard is its hash's upper part.
        self.words, self.word_of = np.unique(token, return_inverse=True)
        self.word_counts = np.bincount(self.word_of[learned], minlength=len(self.words)).astype(np.uint64)
        self.word_shards = self._shard(self.words, shards)
        # Context of each token by number; the start mark is one past the last word.
        context = np.r_[0, self.word_of[:-1]] if len(token) else np.zeros(0, np.int64)
        context[begins] = len(self.words)
        contexts = np.append(self.words, START)
        short = token >> np.uint64(64 - TrieShard.SUCCESSOR_BITS)
        spread = token >> np.uint64(64 - SPREAD_BITS)
        shard = self._shard(wordhash.mix(contexts[context] + spread), shards)
        order = np.lexsort((short, contexts[context], shard))
        s, c, w = shard[order], contexts[context][order], short[order]
        new = np.r_[True, (s[1:] != s[:-1]) | (c[1:] != c[:-1]) | (w[1:] != w[:-1])] if len(s) else np.zeros(0, bool)
        self.pair_of = np.empty(len(token), np.int64)
        self.pair_of[order] = np.cumsum(new) - 1
        self.pair_shards, self.pair_context, self.pair_word = s[new], c[new], w[new]
        self.pair_counts = np.bincount(self.pair_of[learned], minlength=int(new.sum())).astype(np.uint64)
        self.context_of = context

    @staticmethod
    def _shard(values: np.ndarray, shards: int) -> np.ndarray:
        """Number of equal parts of the hash range, so that rising hashes have rising shards."""
        return ((values >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)

    def askings(self) -> Iterator[tuple[int, bytes, bytes, bytes, bytes, bytes, bytes]]:
        """(shard, words, counts, contexts, pairs per context, successors, counts) for every shard asked."""
        for shard in np.union1d(self.word_shards, self.pair_shards).tolist():
            a, b = np.searchsorted(self.word_shards, [shard, shard + 1])
            i, j = np.searchsorted(self.pair_shards, [shard, shard + 1])
            context = self.pair_context[i:j]
            start = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if j > i else np.zeros(0, np.int64)
            yield (
                shard,
                _gaps(self.words[a:b]),
                _numbers(self.word_counts[a:b]),
                _gaps(context[start]),
                _numbers(np.diff(np.r_[start, j - i])),
                _numbers(self.pair_word[i:j]),
                _numbers(self.pair_counts[i:j]),
            )


ASKED = "chunk int, shard int, words binary, word_counts binary, contexts binary, fan binary, successors binary, pair_counts binary"
ANSWERED = "chunk int, shard int, word_counts binary, codes binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, score double"


def _ask(shards: int):
    def run(rows: pa.Table) -> pa.Table:
        chunk = rows["chunk"][0].as_py()
        held = rows["held_out"].to_numpy().astype(bool)
        asked = [(chunk, *x) for x in _Chunk(rows["text"], held, shards).askings()]
        kinds = [pa.int32()] * 2 + [pa.binary()] * 6
        names = [c.split()[0] for c in ASKED.split(", ")]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*asked, strict=True), kinds, strict=True)], names)

    return run


def _summed(order_by: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    order = np.lexsort(order_by[::-1])
    keys = [k[order] for k in order_by]
    if not len(order):
        return keys, counts
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    start = np.flatnonzero(new)
    return [k[start] for k in keys], np.add.reduceat(counts[order], start)


def _answer(rows: pa.Table) -> pa.Table:
    """Counts of words and codes of pairs for all askings of one shard."""
    columns = {c: rows[c].to_pylist() for c in ("words", "word_counts", "contexts", "fan", "successors", "pair_counts")}
    words = [_read_gaps(x) for x in columns["words"]]
    word_counts = [_read_numbers(x) for x in columns["word_counts"]]
    (known,), totals = _summed([np.concatenate(words)], np.concatenate(word_counts))
    contexts = [
        np.repeat(_read_gaps(c), _read_numbers(f).astype(np.int64))
        for c, f in zip(columns["contexts"], columns["fan"], strict=True)
    ]
    successors = [_read_numbers(x) for x in columns["successors"]]
    (c, w), n = _summed(
        [np.concatenate(contexts), np.concatenate(successors)],
        np.concatenate([_read_numbers(x) for x in columns["pair_counts"]]),
    )
    seen = n > 0
    trie = TrieShard(c[seen], w[seen], n[seen].astype(np.float64))
    answers = [_numbers(totals[np.searchsorted(known, x)]) for x in words]
    codes = [_numbers(trie.look_up(a, b)) for a, b in zip(contexts, successors, strict=True)]
    return pa.table(
        [rows["chunk"], rows["shard"], pa.array(answers, pa.binary()), pa.array(codes, pa.binary())],
        ["chunk", "shard", "word_counts", "codes"],
    )


def _score(shards: int, n: int, v: int, starts: int, weight: float):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        held = texts["held_out"].to_numpy().astype(bool)
        chunk = _Chunk(texts["text"], held, shards)
        answers = answers.sort_by("shard")
        counts = [_read_numbers(x) for x in answers["word_counts"].to_pylist()]
        count = np.concatenate(counts) if counts else np.zeros(0, np.uint64)
        codes = [_read_numbers(x).astype(np.uint16) for x in answers["codes"].to_pylist()]
        code = np.concatenate(codes) if codes else np.zeros(0, np.uint16)
        c = count.astype(np.float64)[chunk.word_of]
        after = np.append(count.astype(np.float64), float(starts))[chunk.context_of]
        pair = CODES[code[chunk.pair_of]]
        single = (c + 1) / (n + v + 1)
        p = np.where(after > 0, weight * np.minimum(pair, after) / np.maximum(after, 1) + (1 - weight) * single, single)
        docs = len(chunk.length)
        return pa.table(
            [
                texts["doc_id"],
                texts["held_out"],
                pa.array(chunk.length, pa.int64()),
                pa.array(np.bincount(chunk.owner, c > 0, minlength=docs).astype(np.int64)),
                pa.array(np.bincount(chunk.owner, np.log10(c + 1), minlength=docs)),
                pa.array(np.bincount(chunk.owner, np.log10(p), minlength=docs)),
            ],
            [x.split()[0] for x in SCORED.split(", ")],
        )

    return run


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, n) of the distinct training words of a task, end marks included."""
    held: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        (words,), n = _summed([np.concatenate(held)], np.concatenate(counts))
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    for batch in batches:
        for _, data, offsets in wordhash.text_blocks(batch.column(0)):
            hashes, first = wordhash.word_hashes(data, offsets)
            words, n = np.unique(hashes, return_counts=True)
            held.append(np.append(words, END))
            counts.append(np.append(n, len(first) - 1))
            size += len(words) + 1
        if size > 4_000_000:
            yield flush()
            held, counts, size = [], [], 0
    if held:
        yield flush()


def score_texts(documents: DataFrame, held_out: Column, weight: float = WEIGHT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of documents(doc_id, text).

    The model learns from the rows where held_out is false or null. base_score is that of single words alone,
    with log10((c + 1) / (N + V + 1)) per token.
    """
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    learned = rows.filter("not held_out").select("text").mapInArrow(_tally, "word long, n long")
    words = learned.groupBy("word").agg(F.sum("n").alias("n"))
    n, v, starts = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(F.col("word") == int(END.view(np.int64)), F.col("n"))), F.lit(0))
    ).first()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    chunks = max(1, -(-size // CHUNK_BYTES))
    # The text itself takes part, so that rows without an id spread too.
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")
    dealt = rows.withColumn("chunk", chunk).repartition("chunk")
    asked = dealt.groupBy("chunk").applyInArrow(_ask(chunks), ASKED)
    answered = asked.groupBy("shard").applyInArrow(_answer, ANSWERED)
    scored = dealt.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(_score(chunks, n, v, starts, weight), SCORED)
    # log10 of the common denominator once per text
    base = F.col("log_counts") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score"
    )
