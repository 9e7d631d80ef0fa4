"""Words of whole texts and their 64-bit hashes, made by numpy over Arrow's buffers.

The hash of a word is a polynomial over its bytes modulo 2**64 whose coefficients come from a seeded table,
then mixed; prefix sums give all words of a block at once. Two different words share a hash with a chance
of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[int, np.ndarray] = {}


def byte_class(keep: str) -> tuple[np.ndarray, np.ndarray]:
    """(whether each byte belongs to a word, its coefficient); A-Z count as a-z.

    ``space``: words are runs of all but ``[\\x20\\x09-\\x0D]``. ``alnum``: runs of digits, letters and
    everything beyond ASCII.
    """
    values = np.random.RandomState(7).randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    values[65:91] = values[97:123]
    inside = np.ones(256, bool)
    if keep == "space":
        inside[[9, 10, 11, 12, 13, 32]] = False
    else:
        inside[:128] = False
        inside[48:58] = inside[65:91] = inside[97:123] = True
    values[~inside] = 0
    return inside, values


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.cumprod(have, dtype=np.uint64)
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def text_blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of rows in them) of about BLOCK_BYTES; a longer text makes a block alone. Nulls count as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, kind: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, index of each row's first word and the end, first byte of each word)."""
    inside, values = kind
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
    w = inside[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start, end = w.copy(), w.copy()
    start[1:] &= ~w[:-1] | cut[1:n]
    end[:-1] &= ~w[1:] | cut[1:n]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * _power(_BASE, n + 1)[:n], out=total[1:])
    h = (total[end] - total[start]) * _power(_INVERSE, n + 1)[start]
    h += (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mixed(h), np.searchsorted(start, offsets), start


def beginnings(data: np.ndarray, offsets: np.ndarray, kind: tuple[np.ndarray, np.ndarray], size: int) -> np.ndarray:
    """The hash of each word's first ``size`` bytes, or of all if it has no more; as ``words`` orders them."""
    _, at, start = words(data, offsets, kind)
    if not len(start):
        return np.zeros(0, np.uint64)
    inside, values = kind
    row_end = np.repeat(offsets[1:], np.diff(at))
    h, alive = np.zeros(len(start), np.uint64), np.ones(len(start), bool)
    for d in range(size):
        place = start + d
        alive &= place < row_end
        place = np.minimum(place, len(data) - 1)
        alive &= inside[data[place]]
        h[alive] = (h[alive] + values[data[place[alive]]]) * np.uint64(_BASE)
    return mixed(h + np.uint64(size))


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of fewer words, one for the whole sequence; of none, none."""
    k = min(size, len(h))
    if not k:
        return h
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mixed(out * np.uint64(0x2545F4914F6CDD1D) + h[i : len(h) - k + 1 + i])
    return out


def word_hash(word: str, kind: tuple[np.ndarray, np.ndarray]) -> int:
    """The hash that ``words`` gives a single word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(words(data, np.array([0, len(data)]), kind)[0][0])
