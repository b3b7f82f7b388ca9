"""A run-length index over byte strings: a run-compressed Burrows-Wheeler transform of bounded context with sampled run ends.

The rows of the transform are the strings' places with at least `depth` - 1 bytes to come, their context, ordered by context; those that agree in it by the byte before
them and then from the youngest owner to the oldest. So every (context, byte before) is one run, however many strings repeat it, and the
row at a run's end, whose text position is sampled, belongs to the run's oldest owner. Rows themselves are dropped once the runs are built.

A backward step goes from a context to the run of the byte before it, which is a match of `depth` bytes; the run's sample says whose it is at the
oldest, and its first depth - 1 bytes are the next context. Matching statistics are streamed so from right to left; where a step finds
no run, the next context is searched for among the sorted ones.
"""

from __future__ import annotations

import numpy as np


def strings_at(data: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """The strings of so many bytes at places, as an array that compares and sorts them."""
    held = np.lib.stride_tricks.sliding_window_view(data, size)[places]
    return np.ascontiguousarray(held).view(f"S{size}").reshape(-1)


def places_of(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... of each i, counts[i] of them."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


class RunIndex:
    """data: distinct strings end to end, at starts and of sizes; ages: the age of each one's oldest owner, the least being the oldest."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ages: np.ndarray, depth: int = 50) -> None:
        self.depth = depth
        counts = np.maximum(sizes - depth + 2, 0)
        rows = places_of(starts, counts)
        text = np.repeat(np.arange(len(starts)), counts)
        if not len(rows):
            self.contexts, self.keys, self.sampled, self.oldest, self.next = np.zeros(0, f"S{depth - 1}"), *(np.zeros(0, np.int64),) * 4
            return
        #: All contexts, sorted.
        self.contexts, context = np.unique(strings_at(data, rows, depth - 1), return_inverse=True)
        inner = np.flatnonzero(rows > starts[text])  # rows with a byte before them
        symbol = data[rows[inner] - 1].astype(np.uint64)
        run = context[inner].astype(np.uint64) << np.uint64(8) | symbol
        order = np.argsort(run << np.uint64(32) | (np.uint64((1 << 32) - 1) - ages[text[inner]].astype(np.uint64)))
        run = run[order]
        ends = np.flatnonzero(np.append(run[1:] != run[:-1], True)[: len(run)])
        by = np.argsort(symbol[order[ends]].astype(np.int64) * len(self.contexts) + context[inner[order[ends]]])
        ends = order[ends[by]]
        #: Runs by their byte and then their context, as a backward step asks for them.
        self.keys = symbol[ends].astype(np.int64) * len(self.contexts) + context[inner[ends]]
        #: Text positions of the matches at the ends of runs, the age of their owners, and the contexts that they begin with.
        self.sampled = rows[inner[ends]] - 1
        self.oldest = ages[text[inner[ends]]]
        self.next = context[inner[ends] - 1]

    def step(self, context: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The run of the byte before each context; -1 where there is none."""
        key = byte.astype(np.int64) * len(self.contexts) + context
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((context >= 0) & (self.keys[at] == key), at, -1)

    def find(self, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The number of the context at each place; -1 where there is none."""
        asked = strings_at(data, places, self.depth - 1)
        at = np.minimum(np.searchsorted(self.contexts, asked), len(self.contexts) - 1)
        return np.where(self.contexts[at] == asked, at, -1)

    def oldest_matches(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, none: int) -> np.ndarray:
        """For each place of data the age of the oldest owner of the `depth` bytes there, else `none`; strings of data are streamed from their ends."""
        out = np.full(len(data), none, np.int64)
        if not len(self.keys):
            return out
        context = np.full(len(starts), -1)
        going = np.flatnonzero(sizes >= self.depth)
        for k in range(self.depth, int(sizes.max(initial=0)) + 1):
            going = going[sizes[going] >= k]
            at = starts[going] + sizes[going] - k
            lost = np.flatnonzero(context[going] < 0)
            if len(lost):
                context[going[lost]] = self.find(data, at[lost] + 1)
            run = self.step(context[going], data[at])
            out[at] = np.where(run >= 0, self.oldest[run], none)
            context[going] = np.where(run >= 0, self.next[run], -1)
        return out
