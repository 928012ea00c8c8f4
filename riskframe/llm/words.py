"""Words of many texts as numpy arrays: runs of bytes other than 0x20 and 0x09-0x0D, with 64-bit hashes."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words longer than this are hashed one by one.
LONG_WORD = 64
_LANE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose result bits depend on all bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """Words of documents joined by a line feed: places in the bytes, hashes, and the first word of each document (one more at the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def documents(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: lanes of eight bytes, mixed one after the other, so no arithmetic structure of a word survives."""
    size = ends - starts
    out = mixed(size.astype(np.uint64) + _LANE)
    if not len(size):
        return out
    padded = np.append(data, np.zeros(8, np.uint8))
    lanes = np.ndarray(len(padded) - 7, "<u8", padded, 0, (1,))
    short = np.flatnonzero(size <= LONG_WORD)
    for at in range(0, LONG_WORD, 8):
        short = short[size[short] > at]
        if not len(short):
            break
        spare = np.uint64(8) * (np.uint64(8) - np.minimum(size[short] - at, 8).astype(np.uint64))
        out[short] = mixed(out[short] * _LANE ^ ((lanes[starts[short] + at] << spare) >> spare))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def words_of(texts: list[bytes | None], lower: bool = False) -> Words:
    """The words of texts; ``lower`` maps A-Z first. A null text has none."""
    data = np.frombuffer(b"\n".join(t or b"" for t in texts), np.uint8)
    if lower:
        data = LOWER[data]
    space = np.ones(len(data) + 2, bool)
    np.take(SPACE, data, out=space[1:-1])
    places = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = places[0::2], places[1::2]
    begins = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    return Words(data, starts, ends, _word_hashes(data, starts, ends), np.searchsorted(starts, begins))


def runs_hashed(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of ``n`` words, by its first word; runs may cross documents. Runs of 2k words come from two of k."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out, reach, power, size = None, 0, hashes, 1
    while True:
        if n & size:
            out = power if out is None else _joined(out[:len(power) - reach], power[reach:])
            reach += size
        size *= 2
        if size > n:
            return mixed(out[:len(hashes) - n + 1] ^ np.uint64(n))
        power = _joined(power[:len(power) - size // 2], power[size // 2:])


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(left[:len(right)] * _LANE + right[:len(left)])


def run_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Words at which a run of ``n`` words of one document begins."""
    sizes = np.maximum(np.diff(first) - n + 1, 0)
    return np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if sizes.sum() else np.zeros(0, np.int64)


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in the ordered array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    return ordered[np.minimum(at, len(ordered) - 1)] == values
