"""Vectorised text kernels shared by the operators of this subpackage.

Executors receive Arrow batches; the functions here work on the raw UTF-8
buffer of a string column, so a batch of documents is split into words and
hashed without creating a Python string per word.  Work is cut into slices of
at most ``slice_bytes`` (one longer text forms a slice of its own), which
bounds the temporaries whatever the batch size.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  Bytes of multi-byte
UTF-8 characters are all >= 0x80, so byte-wise splitting and lower-casing equal
the character-wise rule.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

M64 = (1 << 64) - 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SOLID = np.ones(256, dtype=bool)      # bytes that belong to words
SOLID[[32, 9, 10, 11, 12, 13]] = False
LONG_WORD = 64          # longer words are hashed one by one
SLICE_BYTES = 1 << 21


def u64(x: int) -> np.uint64:
    return np.uint64(x & M64)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective), elementwise."""
    h = h ^ (h >> np.uint64(33))
    h = h * u64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * u64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & M64], dtype=np.uint64))[0])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes as uint8, offsets as int64) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset:]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of about ``slice_bytes`` bytes, at least one row each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + slice_bytes, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words(NamedTuple):
    """Words of consecutive texts: byte spans in ``raw``, 64-bit hashes, and
    for each text the range ``first[t]:first[t+1]`` of its words."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return LOWER[raw]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, ends and per-text word ranges; a word never crosses texts."""
    n = len(raw)
    solid = np.zeros(n + 2, dtype=bool)
    solid[1:n + 1] = SOLID[raw]
    begins = solid[1:] > solid[:-1]
    ends = solid[1:] < solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    begins[inner] = solid[inner + 1]
    ends[inner] = solid[inner]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return start, end, np.searchsorted(start, offsets)


def hash_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: eight bytes a step, all spans at once."""
    length = end - start
    h = mix(length.astype(np.uint64) + u64(0x9E3779B97F4A7C15))
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    at_byte = np.ndarray(shape=(len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    at, left, g, active = start, length, h, None       # active: None means all spans
    step = 0
    while len(left) and step < LONG_WORD:
        drop = np.left_shift(8 - np.minimum(left, 8), 3).astype(np.uint64)
        chunk = at_byte[at] << drop                     # bytes past the span's end do not count
        g = (g ^ chunk) * u64(0x9FB21C651E98DF25)
        g ^= g >> np.uint64(29)
        if active is None:
            h = g
        else:
            h[active] = g
        more = np.flatnonzero(left > 8)
        active = more if active is None else active[more]
        at, left, g = at[more] + 8, left[more] - 8, g[more]
        step += 8
    for i in (active if active is not None else ()):   # rare: spans over LONG_WORD bytes
        digest = hashlib.blake2b(raw[start[i]:end[i]].tobytes(), digest_size=8).digest()
        h[i] = np.uint64(int.from_bytes(digest, "little"))
    return mix(h)


def words_of(raw: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the texts, lower-cased (A-Z) and hashed."""
    raw = lower_ascii(raw)
    start, end, first = word_spans(raw, offsets)
    return Words(raw, start, end, hash_spans(raw, start, end), first)


def shingles(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of ``k`` words; fewer words: the whole sequence as
    one window; no word: empty."""
    n = len(word_hash)
    if n == 0:
        return np.empty(0, np.uint64)
    m = min(k, n)
    out = np.full(n - m + 1, u64(0x2545F4914F6CDD1D + m), dtype=np.uint64)
    for j in range(m):
        out = (out ^ word_hash[j:n - m + 1 + j]) * u64(0x9DDFEA08EB382D69)
        out ^= out >> np.uint64(32)
    return mix(out)


def word_slices(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) over a string column, slice by slice."""
    raw, offsets = utf8(column)
    for i, j in slices(offsets):
        yield i, j, words_of(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
