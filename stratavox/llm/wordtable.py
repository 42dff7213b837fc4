"""A table of words by hash, for many look-ups at a time in numpy."""

from __future__ import annotations

import numpy as np

#: Slots at first, a power of two.
TABLE = 1 << 16


class WordTable:
    """Numbers 0, 1, ... of words, which are told apart by hashes of 64 bits other than 0, in an open table that doubles before it
    is half full."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.size = 0
        self._empty(TABLE)

    def _empty(self, slots: int) -> None:
        self.keys, self.numbers, self.mask = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), np.uint64(slots - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The numbers of words, -1 for those that the table has not."""
        out, left, slot = np.full(len(h), -1), np.arange(len(h)), h & self.mask
        while len(left):
            key = self.keys[slot]
            same = key == h[left]
            out[left[same]] = self.numbers[slot[same]]
            go = ~same & (key != 0)
            left, slot = left[go], (slot[go] + np.uint64(1)) & self.mask
        return out

    def add(self, h: np.ndarray) -> np.ndarray:
        """The numbers of new words, whose hashes are distinct."""
        numbers = np.arange(self.size, self.size + len(h), dtype=np.int32)
        self.size += len(h)
        if 2 * self.size > len(self.keys):
            used, slots = self.keys != 0, len(self.keys)
            keys, kept = self.keys[used], self.numbers[used]
            while 2 * self.size > slots:
                slots *= 2
            self._empty(slots)
            self._put(keys, kept)
        self._put(h, numbers)
        return numbers

    def _put(self, h: np.ndarray, numbers: np.ndarray) -> None:
        left, slot = np.arange(len(h)), h & self.mask
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[left[free]]
            mine = free & (self.keys[slot] == h[left])
            self.numbers[slot[mine]] = numbers[left[mine]]
            left, slot = left[~mine], (slot[~mine] + np.uint64(1)) & self.mask

    def numbered(self, buffer: bytes, start: np.ndarray, size: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """The number of every word of a buffer, and the words that are new, which got the next numbers in this order."""
        h = np.where(h == 0, np.uint64(1), h)
        number = self.find(h)
        new = np.flatnonzero(number < 0)
        if not len(new):
            return number, []
        hashes, first, back = np.unique(h[new], return_index=True, return_inverse=True)
        at = new[first]
        number[new] = self.add(hashes)[back]
        return number, [buffer[a:b] for a, b in zip(start[at].tolist(), (start[at] + size[at]).tolist(), strict=True)]
