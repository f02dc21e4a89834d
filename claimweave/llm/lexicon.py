"""A minimal acyclic transducer from byte strings to id sequences, kept in one buffer that can be memory-mapped.

Words that end alike share states. Each arc carries the number of words that come before those behind it, so the sum
along a word's path is the word's number in sorted order; the output table holds the ids of word k at place k.
"""

from __future__ import annotations

import mmap
import os
import struct
import tempfile
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

MAGIC = b"MATL0001"
_BYTES = [bytes([b]) for b in range(256)]


def compile_lexicon(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """Build the minimal automaton incrementally from entries; of equal words the last entry counts."""
    items = sorted(dict(entries).items())
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}

    def shared(state: int) -> int:
        return register.setdefault((final[state], tuple(arcs[state].items())), state)

    path = [0]
    before = b""
    for word, _ in items:
        same = len(os.path.commonprefix([before, word]))
        _fold(path, before, same, arcs, shared)
        for byte in word[same:]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][byte] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        before = word
    _fold(path, before, 0, arcs, shared)

    order, number = [0], {0: 0}
    for state in order:
        for to in arcs[state].values():
            if to not in number:
                number[to] = len(order)
                order.append(to)
    words: dict[int, int] = {}
    todo = [0]
    while todo:
        state = todo[-1]
        if missing := [to for to in arcs[state].values() if to not in words]:
            todo += missing
        else:
            words[state] = final[state] + sum(words[to] for to in arcs[state].values())
            todo.pop()
    first, labels, targets, skips = [0], bytearray(), [], []
    for state in order:
        skip = int(final[state])
        for byte, to in arcs[state].items():
            labels.append(byte)
            targets.append(number[to])
            skips.append(skip)
            skip += words[to]
        first.append(len(labels))
    starts = np.cumsum([0, *(len(ids) for _, ids in items)])
    ids = [i for _, own in items for i in own]
    parts = [np.array(x, dtype="<u4").tobytes() for x in (first, targets, skips, starts, ids)]
    parts += [bytes(final[s] for s in order), bytes(labels)]
    return MAGIC + struct.pack("<7I", *map(len, parts)) + b"".join(parts)


def _fold(path: list[int], word: bytes, keep: int, arcs: list[dict[int, int]], shared) -> None:
    """Replace the states of the last word beyond its first keep bytes by equal ones seen before."""
    while len(path) > keep + 1:
        child = path.pop()
        arcs[path[-1]][word[len(path) - 1]] = shared(child)


class Lexicon:
    """Look words up in a compiled buffer, which is memory-mapped from a file that is gone once it is open."""

    def __init__(self, buffer: bytes) -> None:
        with tempfile.TemporaryFile() as f:
            f.write(buffer)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if self.map[:8] != MAGIC:
            raise ValueError("not a compiled lexicon")
        sizes = struct.unpack("<7I", self.map[8:36])
        at = [sum(sizes[:i]) + 36 for i in range(7)]
        whole = memoryview(self.map)
        self.first, self.targets, self.skips, self.starts = (whole[p : p + n].cast("I") for n, p in zip(sizes[:4], at, strict=False))
        self.ids, self.final, self.labels = at[4:]
        # Arcs as sorted numbers of state and byte, and views of the mapped tables, for many words at a time.
        views = [np.frombuffer(x, "<u4") for x in (self.first, self.targets, self.skips)]
        self._first, self._targets, self._skips = views
        n, arcs = len(self._first) - 1, len(self._targets)
        self._final = np.frombuffer(whole, np.uint8, n, self.final)
        self._arcs = np.repeat(np.arange(n), np.diff(self._first.astype(np.int64))) << 8 | np.frombuffer(whole, np.uint8, arcs, self.labels)

    def __len__(self) -> int:
        return len(self.starts) - 1

    def number(self, word: bytes) -> int:
        """The word's place in sorted order, or -1."""
        state = rank = 0
        find, base, first, targets, skips = self.map.find, self.labels, self.first, self.targets, self.skips
        for byte in word:
            arc = find(_BYTES[byte], base + first[state], base + first[state + 1]) - base
            if arc < 0:
                return -1
            rank += skips[arc]
            state = targets[arc]
        return rank if self.map[self.final + state] else -1

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """number() of each word."""
        return self.numbers_flat(np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words)))

    def numbers_flat(self, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """number() of each word of size bytes in flat, byte by byte for all words together."""
        start = np.cumsum(size) - size
        state, rank = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        live = np.arange(len(size))
        for p in range(int(size.max(initial=0))):
            live = live[size[live] != p] if p else live[size[live] > 0]
            wanted = state[live] << 8 | flat[start[live] + p]
            arc = np.minimum(np.searchsorted(self._arcs, wanted), max(0, len(self._arcs) - 1))
            there = self._arcs[arc] == wanted if len(self._arcs) else np.zeros(len(live), bool)
            rank[live[~there]] = -1
            state[live[~there]] = -1
            live, arc = live[there], arc[there]
            rank[live] += self._skips[arc]
            state[live] = self._targets[arc]
        return np.where((state >= 0) & (self._final[state] > 0), rank, -1)

    def get(self, word: bytes) -> bytes | None:
        """The word's ids as little-endian 32-bit integers, or None."""
        return self._ids(self.number(word))

    def get_all(self, words: list[bytes]) -> list[bytes | None]:
        """get() of each word."""
        return [self._ids(k) for k in self.numbers(words).tolist()]

    def all_ids(self) -> pa.LargeBinaryArray:
        """The ids of each number."""
        starts = np.frombuffer(self.starts, "<u4").astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(4 * starts), pa.py_buffer(self.map[self.ids : self.ids + 4 * int(starts[-1])])])

    def _ids(self, k: int) -> bytes | None:
        return None if k < 0 else self.map[self.ids + 4 * self.starts[k] : self.ids + 4 * self.starts[k + 1]]
