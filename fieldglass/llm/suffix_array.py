"""Enhanced suffix arrays in numpy: order, common prefixes, the interval tree, maximal repeats.

A collection is a list of byte strings that are valid UTF-8 or pieces of it (no byte 0xFF). They are laid out one after
the other with a separator that sorts before every byte, so no common prefix crosses an end.
"""

from __future__ import annotations

import numpy as np


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and the rank of each (equal keys share one)."""
    order = np.argsort(keys)
    s = keys[order]
    rank = np.zeros(len(keys), np.int32)
    rank[order[1:]] = np.cumsum(s[1:] != s[:-1], dtype=np.int32)
    return order, rank


class SuffixArray:
    """Suffixes in order of their first ``depth`` bytes, with common-prefix lengths up to ``depth``.

    Only suffixes of at least ``least`` bytes are listed. Built by prefix doubling from eight bytes up; the ranks of each
    step are kept, and from them the common prefix of neighbours is found by descending through the steps. The steps beyond a
    third of ``depth`` rank only the suffixes listed."""

    def __init__(self, strings: list[bytes], least: int, depth: int) -> None:
        self.least, self.depth = least, depth
        sizes = np.array([len(s) for s in strings], np.int64)
        flat = np.frombuffer(b"\0".join([s.translate(_UP) for s in strings] + [b"\0" * (2 * depth + 16)]), np.uint8)
        n = int(sizes.sum() + len(sizes))
        self.n, self.flat = n, flat
        self.first = np.cumsum(sizes + 1) - sizes - 1  # where each string starts
        self.owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
        left = (self.first + sizes)[self.owner].astype(np.int32) - np.arange(n, dtype=np.int32)  # bytes up to the end
        starts = np.flatnonzero(left >= least)
        key = np.zeros(n, np.uint64)
        for i in range(8):
            key <<= np.uint64(8)
            key |= flat[i : i + n]
        _, rank = _ranks(key)
        self.steps, size = [(8, rank)], 8
        while 3 * size < depth:
            key = rank.astype(np.uint64)
            key *= np.uint64(n + 2)
            key[: max(n - size, 0)] += rank[size:].astype(np.uint64) + np.uint64(1)
            size *= 2
            _, rank = _ranks(key)
            self.steps.append((size, rank))
        del key
        # The last two steps rank the listed suffixes only: what they go on with has a rank in the step before.
        own, done = rank[starts], size
        order = np.argsort(own) if done >= depth else None
        while done < depth:
            more = min(size, depth - done)
            then = starts + (done + more - size)  # the two parts may overlap: together they are done + more bytes
            key = own.astype(np.uint64) * np.uint64(n + 2)
            key += np.where(then < n, rank[np.minimum(then, n - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0))
            done += more
            order, own = _ranks(key)
            last = np.zeros(n, np.int32)
            last[starts] = own
            self.steps.append((done, last))
        self.order = starts[order]
        self.lcp = self._common(left)
        self.steps = []  # ranks are the bulk of the memory: the scan needs none

    def _common(self, left: np.ndarray) -> np.ndarray:
        """lcp[i]: of the suffixes at i - 1 and i in the order; lcp[0] is 0."""
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        out = np.zeros(len(a), np.int64)
        whole = self.steps[-1][1][a] == self.steps[-1][1][b] if len(a) else np.zeros(0, bool)
        for size, rank in reversed(self.steps[:-1]):
            # What is left to match is under twice the size, so it matches at most once.
            at_a, at_b = np.minimum(a + out, self.n - 1), np.minimum(b + out, self.n - 1)
            out += np.where((rank[at_a] == rank[at_b]) & (out + size <= self.depth), size, 0)
        # The rest, under eight bytes.
        for _ in range(8):
            same = self.flat[np.minimum(a + out, self.n)] == self.flat[np.minimum(b + out, self.n)]
            out += same & (out < self.depth)
        out = np.where(whole, self.depth, out)
        return np.r_[np.int64(0), np.minimum(out, np.minimum(left[a], left[b]))] if len(self.order) else np.zeros(0, np.int64)

    def before(self, at: np.ndarray) -> np.ndarray:
        """The byte before each position; a value of its own for each start of a string."""
        inside = at > self.first[self.owner[at]]
        return np.where(inside, self.flat[at - 1].astype(np.int64), -1 - at)

    def _classes(self) -> tuple[np.ndarray, list[int], list[int]]:
        """Order, common prefixes and bytes before of the suffixes that can start a maximal repeat: those in classes of an
        equal prefix of ``least`` bytes that differ in the byte before. Intervals inside other classes can't be maximal."""
        if len(self.order) < 2:
            return self.order[:0], [], []
        new = self.lcp < self.least
        starts = np.flatnonzero(new)
        before = self.before(self.order)
        differ = np.minimum.reduceat(before, starts) != np.maximum.reduceat(before, starts)
        keep = np.repeat(differ, np.diff(np.r_[starts, len(new)]))
        return self.order[keep], np.where(new, 0, self.lcp)[keep].tolist(), before[keep].tolist()

    def maximal_repeats(self) -> list[tuple[int, np.ndarray]]:
        """(length, positions) of every maximal repeat of at least ``least`` bytes: an interval of the common-prefix tree
        (so longer on the right for none of its occurrences together) in which different bytes stand before."""
        order, _, found = self._scan(None)
        return [(length, order[begin:end]) for length, begin, end in found]

    def later(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and lengths: for each position that isn't the first of some maximal repeat, the longest such repeat.

        ``place`` numbers the positions in the order that tells which is first; equal numbers are one place. Every position
        is reported once, where it stops being a first, so nested repeats cost nothing."""
        order, covered, _ = self._scan(place)
        at = np.array([i for i, _ in covered], np.int64)
        return order[at], np.array([n for _, n in covered], np.int64)

    def _scan(self, place: np.ndarray | None) -> tuple[np.ndarray, list[tuple[int, int]], list[tuple[int, int, int]]]:
        """The stack scan of the interval tree. An open interval is [length, begin, byte before (None: different ones), its
        firsts]: suffixes that aren't yet later occurrences of a maximal repeat inside."""
        order, depth, before = self._classes()
        number = place[order].tolist() if place is not None else []
        covered: list[tuple[int, int]] = []
        found: list[tuple[int, int, int]] = []
        stack: list[list] = []
        for i in range(1, len(depth) + 1):
            here = depth[i] if i < len(depth) else 0
            begin, left, firsts = i - 1, before[i - 1], [i - 1]
            while stack and stack[-1][0] > here:
                length, begin, other, waiting = stack.pop()
                left = left if left == other else None
                if len(waiting) < len(firsts):
                    waiting, firsts = firsts, waiting
                waiting += firsts
                firsts = waiting
                if left is None:
                    if place is None:
                        found.append((length, begin, i))
                        firsts = []
                    else:
                        least = min(map(number.__getitem__, firsts))
                        covered += [(k, length) for k in firsts if number[k] != least]
                        firsts = [next(k for k in firsts if number[k] == least)]
            if here:
                if not stack or stack[-1][0] < here:
                    stack.append([here, begin, left, firsts])
                else:
                    top = stack[-1]
                    top[2] = left if left == top[2] else None
                    top[3] += firsts
        return order, covered, found


_UP = bytes(min(i + 1, 255) for i in range(256))


def maximal_repeats(strings: list[bytes], least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """All maximal repeats of at least ``least`` bytes of a collection that fits in memory: (length, occurrences as
    (string, start))."""
    sa = SuffixArray(strings, least, max([least, *map(len, strings)]))
    return [(n, sorted((int(sa.owner[p]), int(p - sa.first[sa.owner[p]])) for p in at)) for n, at in sa.maximal_repeats()]
