"""A run-length index of some byte strings: where a string of a given length occurs a second time.

Suffixes are sorted by prefix doubling. From the Burrows-Wheeler transform only its runs are kept, with the suffix
positions sampled at both ends of each run. The length of the match with the suffix above (below) is measured at
run heads (run tails) alone: inside a run the match one place further on in the text is exactly one byte shorter,
so streaming over the text from sample to sample gives the matching statistic of every position. The more
repetitive the strings, the fewer runs there are to measure.
"""

from __future__ import annotations

import numpy as np


def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their keys, and the dense rank of each position."""
    order = np.argsort(key)
    held = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(held[1:] != held[:-1])])[: len(key)]
    return order, rank


class RunIndex:
    """Index of `strings`; matches never cross from one string into the next."""

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(s) for s in strings], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1].astype(np.int64)
        n = int((sizes + 1).sum())
        symbols = np.empty(n, np.int64)
        stops = self.starts + sizes
        inside = np.ones(n, bool)
        inside[stops] = False
        symbols[inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + len(strings)
        symbols[stops] = np.arange(len(strings))  # each end is a symbol of its own, below all bytes
        self.symbols = symbols
        self.longest = int(sizes.max(initial=0)) + 1
        self.suffixes, self.levels = self.sorted_suffixes()

    def sorted_suffixes(self) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """The suffix array, and the ranks by the first 4, 8, 16, ... symbols it was built from."""
        n, base = len(self.symbols), int(self.symbols.max(initial=0)) + 2
        width = next(w for w in (4, 2, 1) if base**w < 1 << 62)
        padded = np.concatenate([self.symbols + 1, np.zeros(width, np.int64)])
        key = np.zeros(n, np.int64)
        for k in range(width):
            key = key * base + padded[k : k + n]
        order, rank = ranked(key)
        levels = [(width, rank.astype(np.int32))]
        while width < self.longest:
            behind = np.zeros(n, np.int64)
            behind[: max(0, n - width)] = rank[width:] + 1
            key = rank * (n + 1) + behind
            order, rank = ranked(key)
            width *= 2
            levels.append((width, rank.astype(np.int32)))
            if int(rank.max(initial=0)) == n - 1:
                break
        return order, levels

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b, pair by pair."""
        n, length = len(self.symbols), np.zeros(len(a), np.int64)
        for width, rank in reversed(self.levels):
            x, y = a + length, b + length
            fits = (x < n) & (y < n)
            same = np.zeros(len(a), bool)
            same[fits] = rank[x[fits]] == rank[y[fits]]
            length[same] += width
        for _ in range(self.levels[0][0] - 1):
            x, y = a + length, b + length
            fits = (x < n) & (y < n)
            fits[fits] = self.symbols[x[fits]] == self.symbols[y[fits]]
            length[fits] += 1
        return length

    def statistics(self) -> np.ndarray:
        """For each text position the length of its longest match that starts anywhere else."""
        n = len(self.symbols)
        if n < 2:
            return np.zeros(n, np.int64)
        order = self.suffixes
        transform = self.symbols[order - 1]
        turns = np.nonzero(transform[1:] != transform[:-1])[0] + 1
        heads = np.concatenate([[0], turns])
        tails = np.concatenate([turns - 1, [n - 1]])
        above, below = np.zeros(len(heads), np.int64), np.zeros(len(tails), np.int64)
        above[1:] = self.common(order[heads[1:]], order[heads[1:] - 1])
        below[:-1] = self.common(order[tails[:-1]], order[tails[:-1] + 1])
        return np.maximum(self.streamed(order[heads], above), self.streamed(order[tails], below))

    def streamed(self, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Match lengths at all text positions from those at the sampled ones."""
        n = len(self.symbols)
        reach, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
        reach[places] = places + lengths
        last[places] = places
        last = np.maximum.accumulate(last)
        return np.maximum(reach[last] - np.arange(n), 0)

    def repeated(self, length: int) -> list[np.ndarray]:
        """Per string, the start positions whose `length` bytes also start anywhere else."""
        hit = np.nonzero(self.statistics() >= length)[0]
        owner = np.searchsorted(self.starts, hit, side="right") - 1
        cuts = np.searchsorted(owner, np.arange(len(self.starts) + 1))
        return [hit[cuts[k] : cuts[k + 1]] - self.starts[k] for k in range(len(self.starts))]
