"""Cutting texts into chunks that a byte-level BPE pattern never joins, and encoding each distinct chunk once.

Under the pattern a boundary lies before every space that has a non-space on at least one side. Splitting at
single spaces is therefore exact unless a space has white space (or the end) after it and white space before
it; such texts are split by the pattern itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from itertools import chain, islice

import numpy as np
import regex


def flattened(ids: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(all ids one after another, how many each chunk has)."""
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths


def distinct(parts: list[list[str]]) -> tuple[dict[str, None], dict[str, None]]:
    """What texts, split at spaces, have behind a space and at their beginnings: each once, in the order of first occurrence."""
    tails: dict[str, None] = {}
    for x in parts:
        tails.update(dict.fromkeys(islice(x, 1, None)))
    return tails, dict.fromkeys([x[0] for x in parts])


class _Growing:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.data, self.n = np.zeros(1024, kind), 0

    def extend(self, more: np.ndarray) -> None:
        end = self.n + len(more)
        if end > len(self.data):
            grown = np.zeros(max(end, 2 * len(self.data)), self.data.dtype)
            grown[: self.n] = self.data[: self.n]
            self.data = grown
        self.data[self.n : end] = more
        self.n = end


class ChunkEncoder:
    """Encodes whole texts as token ids; encode_many sees every distinct chunk once while it is remembered.

    encode_many returns the ids of all its chunks one after another, and how many each chunk has.

    The memory is bounded: beyond max_chunks chunks or max_units characters and ids it is emptied between batches.
    """

    def __init__(self, pattern: str, encode_many: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], max_chunks: int = 1_000_000, max_units: int = 24_000_000):
        self.pattern = regex.compile(pattern)
        self.encode_many = encode_many
        self.max_chunks, self.max_units = max_chunks, max_units
        self.forget()

    def forget(self) -> None:
        """Empty the memory."""
        self.rows: dict[str, int] = {}
        self.heads: dict[str, int] = {}
        self.flat = _Growing(np.uint32)
        self.start = _Growing(np.int64)
        self.length = _Growing(np.int64)
        self.opens = _Growing(bool)
        self.closes = _Growing(bool)
        self.units = 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.rows) + len(self.heads) > self.max_chunks or self.units > self.max_units:
            self.forget()
        parts = [t.split(" ") for t in texts]
        self._learn(*distinct(parts))
        return [self._one(t, x) for t, x in zip(texts, parts)]

    def _learn(self, tails: Iterable[str], heads: Iterable[str]) -> None:
        """tails follow a space, heads begin a text."""
        rows, firsts = self.rows, self.heads
        tails, heads = [p for p in tails if p not in rows], [p for p in heads if p not in firsts]
        if not tails and not heads:
            return
        n, edge = self.start.n, tails + heads
        self.rows.update(zip(tails, range(n, n + len(tails))))
        self.heads.update(zip(heads, range(n + len(tails), n + len(edge))))
        flat, lengths = self.encode_many([" " + p for p in tails] + heads)
        self.start.extend(self.flat.n + np.cumsum(lengths) - lengths)
        self.length.extend(lengths)
        self.flat.extend(flat)
        size = np.fromiter(map(len, edge), np.int64, len(edge))
        spaced = (np.fromiter(map(len, map(str.strip, edge)), np.int64, len(edge)) < size) | (size == 0)
        opens, closes = np.zeros(len(edge), bool), np.zeros(len(edge), bool)
        for i in np.flatnonzero(spaced).tolist():
            p = edge[i]
            opens[i], closes[i] = not p or p[0].isspace(), not p or p[-1].isspace()
        self.opens.extend(opens)
        self.closes.extend(closes)
        self.units += int(size.sum() + lengths.sum())

    def _one(self, text: str, parts: list[str]) -> np.ndarray:
        rows = np.fromiter(map(self.rows.__getitem__, parts[1:]), np.int64, len(parts) - 1)
        rows = np.concatenate([[self.heads[parts[0]]], rows])
        closed = self.closes.data[rows[:-1]]
        if len(closed) and parts[0] == "":
            closed[0] = False  # nothing stands before the first space
        if (closed & self.opens.data[rows[1:]]).any():
            return self.encode_many(self.pattern.findall(text))[0]
        lengths = self.length.data[rows]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(self.start.data[rows] - ends + lengths, lengths)
        return self.flat.data[at]
