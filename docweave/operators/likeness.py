"""Upper bounds of the Ratcliff-Obershelp likeness of one text to many names (T15), so that only names that may be among the likest are compared in full.

The blocks that it matches are in the same order in both texts, so together they are no longer than the longest common subsequence, and that is no longer than the letters
that both texts hold.  The first bound is taken for all names at once, the second, bit by bit in whole words, for those that the first leaves.
"""

from __future__ import annotations

from collections import Counter

import numpy as np

#: Characters with a place of their own; rarer ones share one, which only raises a bound.
OWN_PLACES = 254
#: Cells of the table of characters that a batch of common subsequences takes at most.
CELLS = 4_000_000
_ALL = np.uint64(0xFFFF_FFFF_FFFF_FFFF)


class Names:
    """Names with the number of each character in them (``counts``, by character), and their characters one after another (``flat``, from ``starts`` on)."""

    def __init__(self, texts: list[str]):
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        there = np.bincount(points)
        known = np.flatnonzero(there)
        place = np.zeros(len(there), np.uint8)
        place[known] = OWN_PLACES + 1
        own = known[np.argsort(-there[known], kind="stable")[:OWN_PLACES]]
        place[own] = np.arange(1, len(own) + 1)
        self.places = dict(zip(map(chr, known.tolist()), place[known].tolist(), strict=True))
        longest = int(self.lengths.max(initial=0))
        self.flat = np.concatenate([place[points], np.zeros(longest + 1, np.uint8)])
        self.counts = np.zeros((int(place.max(initial=0)) + 1, len(texts)), np.min_scalar_type(longest))
        rows = np.argsort(-self.lengths, kind="stable")
        left = np.searchsorted(-self.lengths[rows], -np.arange(longest), "left")
        for p in range(longest):
            own = rows[: left[p]]
            self.counts[self.flat[self.starts[own] + p], own] += 1

    def _bounds(self, shared: np.ndarray, size: int, lengths: np.ndarray) -> np.ndarray:
        return 2.0 * shared / np.maximum(lengths + size, 1)

    def by_letters(self, text: str) -> np.ndarray:
        """A bound for each name."""
        own: Counter[int] = Counter(self.places[c] for c in text if c in self.places)
        shared = np.zeros(len(self.lengths), np.min_scalar_type(len(text)))
        most, spare = np.iinfo(self.counts.dtype).max, np.empty(len(self.lengths), self.counts.dtype)
        for p, n in own.items():
            shared += np.minimum(self.counts[p], min(n, most), out=spare).astype(shared.dtype, copy=False)
        return self._bounds(shared, len(text), self.lengths)

    def by_subsequence(self, text: str, picked: np.ndarray) -> np.ndarray:
        """A closer bound for the picked names."""
        if not len(picked):
            return np.zeros(0)
        longest = max(int(self.lengths[picked].max()), 1)
        step = max(CELLS // longest, 1)
        shared = np.concatenate([self._common(text, picked[a : a + step]) for a in range(0, len(picked), step)])
        return self._bounds(shared, len(text), self.lengths[picked])

    def _common(self, text: str, picked: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences: the zeros of Hyyrö's bit vector, one bit for each character of ``text``, after all characters of a name."""
        words = -(-len(text) // 64)
        where = np.zeros((words, len(self.counts)), np.uint64)
        for i, c in enumerate(text):
            if c in self.places:
                where[i // 64, self.places[c]] |= np.uint64(1 << i % 64)
        longest = max(int(self.lengths[picked].max()), 1)
        chars = np.lib.stride_tricks.sliding_window_view(self.flat, longest)[self.starts[picked]]
        chars[np.arange(longest) >= self.lengths[picked, None]] = 0  # beyond a name's end there is place 0, which no character has
        state = np.full((words, len(picked)), _ALL)
        for held in np.ascontiguousarray(chars.T):
            carry = None
            for w in range(words):
                old, hit = state[w], where[w].take(held)
                both = old & hit
                new = old + both
                over = new < old
                if carry is not None:
                    new += carry
                    over |= new < carry
                state[w] = new | (old ^ both)
                carry = over.astype(np.uint64)
        out = np.zeros(len(picked), np.int64)
        for w in range(words):
            out += np.bitwise_count(~state[w] & (_ALL >> np.uint64(64 - min(64, len(text) - 64 * w))))
        return out
