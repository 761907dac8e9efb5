"""Periodic runs of words by block convolution.

A run is a stretch of words with smallest period ``q`` and at least ``repeats``
periods (and ``min_words`` words) that no neighbouring word extends.

Texts are cut into blocks of ``L`` words at every dyadic scale ``L = 1, 2, 4,
...``.  A run of four periods ``L <= q < 2 L`` holds a whole block and its
occurrence ``q`` words on.  For each block the sums of squared differences to
the words ``d`` on, for all ``L <= d < 2 L`` at once, follow from two sums of
squares and one correlation of the block with the window behind it, which an
integer number-theoretic transform gives exactly: words are small integers (the
place of their first occurrence in the text), and as many primes are used as the
largest possible sum needs, so a sum of zero means no mismatch.  Distances
without a mismatch are seeds, from which the stretch is extended word by word in
both directions.

Blocks that cannot be part of a run at their scale need no transform: those
with a word that does not come again within ``2 L`` words, and those that with
their window lie in a run found at a smaller scale (a second, smaller period
would divide theirs).  Time so grows with the words, not with the square of a
text's length, also for texts that are one run.

Words are ``[^\\x20\\x09-\\x0D]+``, as they are written; two words of one text are
equal if their 64-bit hashes are.

Defined results: null, empty and blank texts have no words and no runs; a run's
ties do not arise (each is listed, by start and then period); repeated rows get
equal results; null ids stay; very long texts are handled whole, in memory of
some hundred bytes a word; an empty table gives no rows.  Other columns do not
matter; those of ``keep`` must not be called n_words, runs or collapsed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerfold.llm.common import batch, positional
from ledgerfold.llm.textkernel import hash_spans, slices, utf8, word_spans

#: Primes of which 2^26 divides one less, and a primitive root of each.
PRIMES = ((2013265921, 31), (1811939329, 13), (469762049, 3))
CELLS = 1 << 18         # numbers of a batch of transforms
NEVER = np.int64(1 << 62)

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def _mod(x: np.ndarray, p: int) -> np.ndarray:
    return x - x // np.uint64(p) * np.uint64(p)


def _powers(root: int, n: int, p: int) -> np.ndarray:
    """root^0 .. root^(n-1)."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, _mod(out * np.uint64(pow(root, len(out), p)), p)])
    return out[:n]


def transform(rows: np.ndarray, p: int, root: int) -> np.ndarray:
    """Number-theoretic transform of each row; ``root`` is a primitive root of
    unity modulo ``p`` of the rows' length, a power of two."""
    m, size = rows.shape
    powers = _powers(root, size // 2, p)
    x, n = rows.reshape(m, size, 1), size
    while n > 1:
        half, width = n // 2, size // n
        one, two = x[:, :half], x[:, half:]
        y = np.empty((m, half, 2, width), np.uint64)
        y[:, :, 0] = _mod(one + two, p)
        y[:, :, 1] = _mod((one + np.uint64(p) - two) * powers[::width][:half, None], p)
        x, n = y.reshape(m, half, 2 * width), half
    return x.reshape(m, size)


def differences(blocks: np.ndarray, windows: np.ndarray, p: int, generator: int) -> np.ndarray:
    """Sums of squared differences, modulo ``p``, of each block of ``L`` numbers
    with the ``L`` numbers from each of the first ``L`` places of its window of
    ``2 L``."""
    m, size = blocks.shape
    n = 2 * size
    blocks, windows = _mod(blocks.astype(np.uint64), p), _mod(windows.astype(np.uint64), p)
    backwards = np.zeros((m, n), np.uint64)
    backwards[:, 0] = blocks[:, 0]
    backwards[:, size + 1:] = blocks[:, :0:-1]
    root = pow(generator, (p - 1) // n, p)
    product = _mod(transform(backwards, p, root) * transform(windows, p, root), p)
    correlation = transform(product, p, pow(root, -1, p))[:, :size]
    correlation = _mod(correlation * np.uint64(pow(n, -1, p)), p)
    squares = np.zeros((m, n + 1), np.uint64)
    np.cumsum(_mod(windows * windows, p), axis=1, out=squares[:, 1:])
    own = _mod(blocks * blocks, p).sum(axis=1, dtype=np.uint64)
    return _mod(own[:, None] + (squares[:, size:n] - squares[:, :size]) + np.uint64(2) * (np.uint64(p) - correlation), p)


def occurrences(x: np.ndarray, start: np.ndarray, stop: np.ndarray, limit: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance) for each block ``x[start:start + size]`` and each
    distance ``size <= d < 2 size`` at which its words stand again before
    ``stop``.  ``limit``: above all numbers of the block's text."""
    found_block, found_distance = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    # sums are below size * limit^2; with that many primes none but 0 is 0 for all
    needed, product = np.zeros(len(start), np.int64), 1
    for p, _ in PRIMES:
        needed += size * limit.astype(float) ** 2 * 1.001 >= product
        product *= p
    offsets = np.arange(3 * size)
    for k in range(1, len(PRIMES) + 1):
        own = np.flatnonzero(needed == k)
        step = max(1, CELLS // (2 * size))
        for a in range(0, len(own), step):
            rows = own[a:a + step]
            at = start[rows, None] + offsets
            values = np.where(at < stop[rows, None], x[np.minimum(at, len(x) - 1)], limit[rows, None])
            zero = np.ones((len(rows), size), dtype=bool)
            for p, generator in PRIMES[:k]:
                zero &= differences(values[:, :size], values[:, size:], p, generator) == 0
            block, distance = np.nonzero(zero)
            found_block.append(rows[block])
            found_distance.append(distance + size)
    return np.concatenate(found_block), np.concatenate(found_distance)


def extended(x: np.ndarray, at: np.ndarray, distance: np.ndarray, edge: np.ndarray, step: int) -> np.ndarray:
    """From ``at`` on, by ``step`` (1 or -1) while words equal those ``distance``
    on: the first place, ``edge`` at the latest, that is not reached."""
    at, active, width = at.copy(), np.arange(len(at)), 8
    while len(active):
        go = []
        for a in range(0, len(active), max(1, CELLS // width)):
            rows = active[a:a + max(1, CELLS // width)]
            places = at[rows, None] + step * np.arange(width)
            inside = places < edge[rows, None] if step > 0 else places > edge[rows, None]
            places = np.where(inside, places, 0)
            differ = ~inside | (x[places] != x[np.minimum(places + distance[rows, None], len(x) - 1)])
            stays = differ.any(axis=1)
            at[rows] += step * np.where(stays, differ.argmax(axis=1), width)
            go.append(rows[~stays])
        active, width = np.concatenate(go), min(2 * width, 1 << 12)
    return at


def _numbered(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's first place in its text, and the distance to its next place."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.argsort(words, kind="stable")
    same = (words[order][1:] == words[order][:-1]) & (text[order][1:] == text[order][:-1])
    head = np.flatnonzero(np.r_[True, ~same])
    number, after = np.empty(len(words), np.int64), np.full(len(words), NEVER)
    number[order] = np.repeat(order[head], np.diff(np.r_[head, len(order)]))
    number -= first[text]
    after[order[:-1][same]] = np.diff(order)[same]
    return number, after


def find_runs(words: np.ndarray, first: np.ndarray, repeats: int = 4, min_words: int = 6) -> Runs:
    """(start, length, period) of all runs of consecutive texts, whose words are
    ``words[first[t]:first[t + 1]]``, by start and then period."""
    if repeats < 4:
        raise ValueError("blocks find runs of four periods or more")
    none = np.empty(0, np.int64)
    runs: Runs = (none, none, none)
    if not len(words):
        return runs
    x, after = _numbered(words, first)
    count = np.diff(first)
    size = 1
    while max(repeats * size, min_words) <= count.max():
        text = np.flatnonzero(count >= max(repeats * size, min_words))
        blocks = (count[text] - 2 * size) // size + 1
        of = np.repeat(text, blocks)
        start = first[of] + size * (np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        near = np.maximum.reduceat(after, np.stack([start, start + size], axis=1).ravel())[::2] < 2 * size
        start, of = start[near], of[near]
        # runs known so far, each with a period below ``size``
        order = np.argsort(runs[0])
        ends = np.concatenate([np.zeros(1, np.int64), np.maximum.accumulate((runs[0] + runs[1])[order])])
        covered = ends[np.searchsorted(runs[0][order], start, side="right")]
        stop = first[of + 1]
        open_ = covered < np.minimum(start + 3 * size - 1, stop)
        start, of, stop, covered = start[open_], of[open_], stop[open_], covered[open_]
        block, distance = occurrences(x, start, stop, count[of], size)
        new = start[block] + distance + size > covered[block]
        block, distance = block[new], distance[new]
        # neighbouring blocks at one distance are of one stretch
        order = np.lexsort((start[block], distance))
        block, distance = block[order], distance[order]
        at = start[block]
        lead = np.r_[True, (distance[1:] != distance[:-1]) | (at[1:] != at[:-1] + size)] if len(at) else np.empty(0, bool)
        block, distance, at = block[lead], distance[lead], at[lead]
        begin = extended(x, at, distance, first[of[block]] - 1, -1) + 1
        end = extended(x, at, distance, stop[block] - distance, 1) + distance
        long = end - begin >= np.maximum(repeats * distance, min_words)
        found = np.unique(np.stack([begin, end - begin, distance])[:, long], axis=1)
        runs = tuple(np.concatenate(v) for v in zip(runs, found, strict=True))
        size *= 2
    order = np.lexsort((runs[2], runs[0]))
    return runs[0][order], runs[1][order], runs[2][order]


def collapsed(raw: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, runs: Runs) -> pa.Array:
    """The texts' words joined by one space, without the words of a run after
    its first period."""
    change = np.zeros(len(start) + 1, np.int64)
    np.add.at(change, runs[0] + runs[2], 1)
    np.add.at(change, runs[0] + runs[1], -1)
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    text = np.searchsorted(first, kept, side="right")
    # the byte behind a word is white space, unless it is its text's last
    joined = np.r_[text[1:] == text[:-1], False] if len(kept) else np.empty(0, bool)
    out = raw.copy()
    out[end[kept[joined]]] = 32
    marks = np.zeros(len(raw) + 2, np.int8)
    marks[start[kept]] += 1
    np.add.at(marks, end[kept] + joined, -1)
    solid = np.cumsum(marks, dtype=np.int8)[:len(raw)].astype(bool)
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(solid, dtype=np.int64)])[offsets]
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out[solid]))


def periodic_runs(docs: DataFrame, keep: list[str], text: str = "text", repeats: int = 4, min_words: int = 6) -> DataFrame:
    """Per row: ``keep`` columns, n_words, runs (array of start, length, period
    in words, by start and then period) and collapsed (the text with each run cut
    to its first period, words joined by one space)."""
    n = len(keep)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields]
    names = [*keep, "n_words", "runs", "collapsed"]

    def run(batches):
        for item in batches:
            raw, offsets = utf8(item.column(n))
            for i, j in slices(offsets):
                own, at = raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
                start, end, first = word_spans(own, at)
                runs = find_runs(hash_spans(own, start, end), first, repeats, min_words)
                text_of = np.searchsorted(first, runs[0], side="right") - 1
                fields = pa.StructArray.from_arrays([pa.array(v) for v in (runs[0] - first[text_of], runs[1], runs[2])], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(runs[0], first).astype(np.int32)), fields)
                texts = collapsed(own, at, start, end, first, runs).cast(pa.string())
                yield batch(names, [*[c.slice(i, j - i) for c in item.columns[:n]], np.diff(first), lists, texts])

    schema = ", ".join([*kinds, "n_words long", "runs array<struct<start: long, length: long, period: long>>", "collapsed string"])
    return positional(docs.select(*keep, text)).mapInArrow(run, schema)
