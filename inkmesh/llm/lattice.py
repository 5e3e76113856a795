"""All pieces of a vocabulary in many words at once."""

from __future__ import annotations

import numpy as np

_BASE, _MIX, _BITS = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93), 19


def code_points(words: list[str]) -> np.ndarray:
    """The words' code points behind one another, a zero after each."""
    return np.frombuffer("\0".join([*words, ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class PieceTable:
    """Pieces by a 64-bit polynomial hash, in one open-addressed table that numpy looks up for all places abreast."""

    def __init__(self, pieces: list[str]):
        self.keys, self.numbers = np.zeros(1 << _BITS, np.uint64), np.full(1 << _BITS, -1, np.int32)
        for i, piece in enumerate(pieces):
            h = 0
            for c in piece:
                h = (h * _BASE + ord(c)) & 0xFFFFFFFFFFFFFFFF
            at = int(self._place(np.array([h], np.uint64))[0])
            while self.numbers[at] >= 0:
                at = (at + 1) & ((1 << _BITS) - 1)
            self.keys[at], self.numbers[at] = h, i

    @staticmethod
    def _place(h: np.ndarray) -> np.ndarray:
        return ((h * _MIX) >> np.uint64(64 - _BITS)).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        at = self._place(h)
        held, right = self.numbers[at], self.keys[at] == h
        out = np.where(right, held, -1)
        left = np.flatnonzero((held >= 0) & ~right)
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << _BITS) - 1)
            held, right = self.numbers[at], self.keys[at] == h[left]
            out[left[right]] = held[right]
            go = (held >= 0) & ~right
            left, at = left[go], at[go]
        return out

    def rows(self, letters: np.ndarray, longest: int) -> np.ndarray:
        """rows[k, p]: the number of the piece of k letters that begins at place p, or -1. No piece holds the zero between words."""
        n = len(letters)
        out = np.full((longest + 1, n), -1, np.int32)
        h = np.zeros(n, np.uint64)
        live = np.arange(n)  # places whose next k letters hold no zero
        for k in range(1, longest + 1):
            live = live[live + k <= n]
            live = live[letters[live + k - 1] > 0]
            if not len(live):
                break
            h[live] = h[live] * np.uint64(_BASE) + letters[live + k - 1]
            out[k, live] = self._find(h[live])
        return out
