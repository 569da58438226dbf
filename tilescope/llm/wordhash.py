"""Word and shingle hashes of many texts at once, in numpy.

A text is a run of UTF-8 bytes. Words are maximal runs of bytes other than space and
0x09-0x0D; A-Z count as a-z. Every word gets a 64-bit polynomial hash read off a running
sum over the whole block, so no Python loop runs per word or character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # texts are hashed in blocks of about this many bytes; a longer text is a block of its own

_rng = np.random.default_rng(20240607)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE[65:91] = _TABLE[97:123]
#: Bytes between words: space and 0x09-0x0D; or all of ASCII but digits and letters.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_STEPS = [0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0xB564EF22EC7AECE5, 0xF7C2EBC08F67F2B5, 0xC6A4A7935BD1E995]

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows; a null text has no bytes."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, index of each text's first word, one longer than the texts)."""
    solid = ~between[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    bounds = offsets[1:-1]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    begins[inner] |= solid[inner]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    ends[inner - 1] |= solid[inner - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _power_table(_BASE, len(data)), out=total[1:])
    hashes = mix((total[stop] - total[start]) * _power_table(_UNBASE, len(data) + 1)[start])
    return hashes, np.searchsorted(start, offsets)


def shingle_sets(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes text by text in rising order, index of each text's first).

    A shingle is `width` consecutive words; a shorter text is one shingle, a text without words none.
    """
    texts = len(first) - 1
    words = np.diff(first)
    count = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    owner = np.repeat(np.arange(texts), count)
    begin = np.repeat(first[:-1] - (np.cumsum(count) - count), count) + np.arange(len(owner))
    value = np.zeros(len(owner), np.uint64)
    short = words[owner] < width
    for k in range(width):
        inside = np.minimum(begin + k, len(hashes) - 1)
        part = hashes[inside] * np.uint64(_STEPS[k % len(_STEPS)])
        value += np.where(short & (k >= words[owner]), np.uint64(k + 1), part)
    value = mix(value)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[keep], owner[keep]
    return value, np.searchsorted(owner, np.arange(texts + 1))
