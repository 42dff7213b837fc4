"""Hashes of five-word shingles, for many texts at a time in numpy.

Texts are joined into one buffer; words are found by comparing bytes, and hashed eight bytes at a step over all words at once,
so nothing is done word by word in Python and no table of words is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

from .common import LOWER

WIDTH = 5
#: Bytes of texts hashed together, at least one text; longer words than LONG are hashed one by one.
TOGETHER, LONG = 2_000_000, 256
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
# Odd multipliers, one for each place in a shingle.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of every word in a buffer (lower-cased, white space before and behind), its bytes and its hash."""
    a = np.frombuffer(raw + bytes(16), np.uint8)
    space = _SPACE[a]
    space[len(raw) :] = True
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    size = end - start
    window = np.lib.stride_tricks.as_strided(a[:-8].view(np.uint8), (len(a) - 15, 8), (1, 1))
    h = mixed(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    left, at, k = np.arange(len(start)), start, 0
    long = size > LONG
    if long.any():
        for i in np.flatnonzero(long):
            h[i] = xxhash.xxh64_intdigest(raw[start[i] : end[i]])
        left = np.flatnonzero(~long)
    while len(left):
        rest = size[left] - 8 * k
        chunk = window[start[left] + 8 * k].copy().view(np.uint64).ravel() & _MASKS[np.minimum(rest, 8)]
        h[left] = mixed(h[left] ^ chunk)
        left = left[rest > 8]
        k += 1
    return start, size, h


def buffers(raws: list[bytes | None], table: bytes = LOWER) -> Iterator[tuple[bytes, list[bytes]]]:
    """The texts, some together: a buffer of texts with their bytes replaced by a table (lower-cased), with a line end before and behind each, and these texts."""
    at = 0
    while at < len(raws):
        some, total = [], 0
        while at < len(raws) and (not some or total + len(raws[at] or b"") <= TOGETHER):
            some.append(raws[at] or b"")
            total += len(some[-1]) + 1
            at += 1
        yield b"\n" + b"\n".join(some).translate(table) + b"\n", some


def batch_shingles(raws: list[bytes | None], width: int = WIDTH) -> list[np.ndarray]:
    """For each text, the hashes of its shingles in order; of a shorter text, one of the whole sequence."""
    out: list[np.ndarray] = []
    for buffer, some in buffers(raws):
        start, _, h = word_hashes(buffer)
        ends = np.searchsorted(start, 1 + np.cumsum([len(x) + 1 for x in some]))
        full = max(0, len(h) - width + 1)
        s = np.full(full, width, np.uint64)
        for i in range(width):
            s += h[i : full + i] * _PLACES[i]
        s = mixed(s)
        low = 0
        for high in ends.tolist():
            n = high - low
            if n >= width:
                out.append(s[low : high - width + 1])
            elif n:
                out.append(mixed(np.array([n], np.uint64) + (h[low:high] * _PLACES[:n]).sum(keepdims=True)))
            else:
                out.append(np.zeros(0, np.uint64))
            low = high
    return out


def distinct(s: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    s = np.sort(s)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def fingerprint(s: np.ndarray) -> int | None:
    """A signed 64-bit hash of hashes in order; None of none."""
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), seed=7)).astype(np.int64)) if len(s) else None
