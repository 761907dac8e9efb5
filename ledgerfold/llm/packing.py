"""Packing of token sequences by the online sum-of-squares rule.

Documents are tokenised and packed where they are read: each task keeps its own
partially filled windows and needs no shuffle.  With ``N(h)`` windows filled to
level ``h`` (an array of counts), a document of ``s`` tokens goes to the level
for which the sum of all ``N(h)^2`` becomes smallest; moving a window from
``h`` to ``h + s`` changes the sum by ``2 (N(h + s) - N(h)) + 2``, opening a
window by ``2 N(s) + 1``, filling one up by ``1 - 2 N(h)``.  So levels stay
balanced and most windows find what fills them exactly.  Ties go to the fullest
level.  Documents of a window or more fill whole windows first; only their rest
is placed.

A task holds at most ``open_windows`` partially filled windows (2 kB a window of
ids and more).  Beyond them, and when its rows end, the emptiest windows are cut
up to fill the fullest; what is left in the end, less than one window, is cut
into powers of two, which need no padding.  So nothing is padded, a document
shorter than a window is cut only there, and no token is lost.

Sequence ids are the partition's number and a count, so a task that runs again
gives the same rows.

Defined results: null text counts as empty; an empty text has the end token
only; repeated rows are packed each for itself; null ids stay; very long texts
are encoded whole; an empty table has no pieces.  Other columns do not matter;
those of ``keep`` must not have the names of the results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ledgerfold.llm.common import batch, positional
from ledgerfold.llm.vocab import ByteLevel

OPEN_WINDOWS = 4096
ROWS = 4096             # of an output batch

#: document's row, first token, tokens
Piece = tuple[object, int, np.ndarray]


class Packer:
    """Windows of one task."""

    def __init__(self, capacity: int, open_windows: int = OPEN_WINDOWS):
        self.capacity, self.open_windows = capacity, open_windows
        self.count = np.zeros(capacity + 1, np.int64)           # of windows a level, N
        self.windows: list[list[list[Piece]]] = [[] for _ in range(capacity)]
        self.open = 0

    def level_for(self, size: int) -> int:
        """The level that ``size`` tokens go to; 0 opens a window."""
        own, after = self.count[1:self.capacity - size + 1], self.count[1 + size:]
        if len(own):
            change = np.where(own > 0, 2 * (after - own) + 2, np.int64(1 << 60))
            if own[-1]:
                change[-1] = 1 - 2 * own[-1]
            best = len(change) - 1 - int(change[::-1].argmin())
            if change[best] <= 2 * self.count[size] + 1:
                return best + 1
        return 0

    def add(self, row, ids: np.ndarray) -> Iterator[list[Piece]]:
        """Place a document; yields the windows that are full."""
        whole = len(ids) - len(ids) % self.capacity
        for at in range(0, whole, self.capacity):
            yield [(row, at, ids[at:at + self.capacity])]
        size = len(ids) - whole
        if size:
            level = self.level_for(size)
            window = self._take(level) if level else []
            window.append((row, whole, ids[whole:]))
            if level + size == self.capacity:
                yield window
            else:
                self._put(level + size, window)
                if self.open > self.open_windows:
                    yield from self.joined()

    def _take(self, level: int) -> list[Piece]:
        self.count[level] -= 1
        self.open -= 1
        return self.windows[level].pop()

    def _put(self, level: int, window: list[Piece]) -> None:
        self.windows[level].append(window)
        self.count[level] += 1
        self.open += 1

    def joined(self) -> Iterator[list[Piece]]:
        """Cut up the emptiest windows to fill the fullest, until at most one
        partially filled window is left."""
        levels = [h for h in range(self.capacity - 1, 0, -1) for _ in self.windows[h]]
        first, last = 0, len(levels) - 1
        rest: list[Piece] = []
        while first <= last:
            window, room = self._take(levels[first]), self.capacity - levels[first]
            first += 1
            while room and (rest or first <= last):
                if not rest:
                    rest = self._take(levels[last])
                    last -= 1
                row, start, ids = rest.pop()
                if len(ids) > room:
                    rest.append((row, start, ids[:-room]))
                    start, ids = start + len(ids) - room, ids[-room:]
                window.append((row, start, ids))
                room -= len(ids)
            if room:
                self._put(self.capacity - room, window)
            else:
                yield window
        if rest:
            self._put(sum(len(p[2]) for p in rest), rest)

    def rest(self) -> Iterator[list[Piece]]:
        """All windows that are still open, none of them with padding."""
        yield from self.joined()
        pieces = [p for windows in self.windows for w in windows for p in w]
        left = sum(len(p[2]) for p in pieces)
        self.__init__(self.capacity, self.open_windows)
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            window = []
            while room:
                row, start, ids = pieces.pop()
                if len(ids) > room:
                    pieces.append((row, start + room, ids[room:]))
                    ids = ids[:room]
                window.append((row, start, ids))
                room -= len(ids)
            yield window


def pack(docs: DataFrame, path: str, keep: list[str], capacity: int = 2048, end_id: int = 1,
         text: str = "text", ids: bool = False, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """One row per piece: ``keep`` columns, start (place in its document),
    length, ids_crc32, doc_tokens, sequence_id, offset (place in its sequence);
    with ``ids`` also the token ids.  ``end_id`` follows each document."""
    shared = docs.sparkSession.sparkContext.broadcast(ByteLevel(path, special=True))
    n = len(keep)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields]
    names = [*keep, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if ids else [])]
    schema = [*kinds, *[f"`{c}` long" for c in names[n:n + 6]], *(["ids array<int>"] if ids else [])]

    def run(batches):
        vocabulary, packer = shared.value, Packer(capacity, open_windows)
        sequence = TaskContext.get().partitionId() << 40
        kept, numbers, lists, types = [], [], [], None

        def rows():
            columns = [pa.array([row[0][c] for row in kept], types[c]) for c in range(n)]
            columns += [pa.array([x[c] for x in numbers], pa.int64()) for c in range(6)]
            if ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
            out = batch(names, columns)
            for x in (kept, numbers, lists):
                x.clear()
            return out

        def store(windows):
            nonlocal sequence
            for window in windows:
                offset = 0
                for row, start, own in window:
                    kept.append(row)
                    numbers.append((start, len(own), zlib.crc32(own.tobytes()), row[1], sequence, offset))
                    if ids:
                        lists.append(own.astype(np.int32))
                    offset += len(own)
                sequence += 1

        for item in batches:
            types = [c.type for c in item.columns[:n]]
            for at in range(0, item.num_rows, 256):
                part = item.slice(at, 256)
                for row, value in enumerate(part.column(n)):
                    own = np.append(vocabulary.encode(value.as_py() or ""), np.array([end_id], "<u4"))
                    store(packer.add((tuple(part.column(c)[row].as_py() for c in range(n)), len(own)), own))
                    if len(kept) >= ROWS:
                        yield rows()
        if types is not None:
            store(packer.rest())
            if kept:
                yield rows()

    return positional(docs.select(*keep, text)).mapInArrow(run, ", ".join(schema))
