"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts.

A text's tokens of both kinds cover the same bytes.  Where a token of each kind
ends at the same byte the text can be cut.  From a whole text on, each interval
looks for a common end near its middle: the ends of its A tokens, from the
middle outwards, are looked up among the ends of the B tokens by bisection.  The
first that is found cuts the interval in two, and both halves go on, without the
ends just tried; an interval without a common end is a leaf.  All intervals of a
level are handled at once (numpy), those of all texts of a slice together, and
each end is looked up once.  Leaves are the groups; within a group, tokens are
linked whose bytes overlap.

Corpus statistics: the texts' results and distinct linked id pairs are written
once; Spark adds up how many documents hold each pair; counts above 1 are stored
as sorted hash arrays, whose shards tasks memory-map to look up the pairs of
their documents (a pair that is not there was counted once).  The highest count
of each A id is an array of the vocabulary's size.

Defined results: null and empty texts, and texts that one of the tokenizers does
not give back byte by byte, have no tokens and count for nothing; each row is a
document, repeated rows too; ties for the highest count are all best; null ids
stay; very long texts are aligned whole; an empty table gives no rows.  Other
columns do not matter; those of ``keep`` must not have the names of the results.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.common import SortedArrays, batch, column, partitions, positional, remove, saved, shard_of, workspace
from ledgerfold.llm.textkernel import SLICE_BYTES, mix, slices, utf8
from ledgerfold.llm.vocab import ByteLevel, Pieces

#: pairs that a counting task adds up before it hands them on
PENDING = 1 << 22
#: pairs of a shard, about
SHARD_ROWS = 1 << 20


def common_ends(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (in ``a``, in ``b``) of the ends that both sorted arrays hold, for
    ``a``'s index ranges [low, high), in no order."""
    found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while True:
        real = low < high
        low, high = low[real], high[real]
        if not len(low):
            return np.concatenate(found_a), np.concatenate(found_b)
        middle = (low + high) >> 1
        left, right = middle.copy(), middle + 1          # [left, right) has been tried
        cut = np.full(len(low), -1, np.int64)
        active, at = np.arange(len(low)), middle
        outward = 0
        while len(active):
            place = np.searchsorted(b, a[at])
            hit = b[np.minimum(place, len(b) - 1)] == a[at]
            cut[active[hit]] = at[hit]
            found_a.append(at[hit])
            found_b.append(place[hit])
            active = active[~hit]
            # one more to the right, then one more to the left, while there are any
            outward += 1
            can_right, can_left = right[active] < high[active], left[active] > low[active]
            go_right = can_right if outward & 1 else can_right & ~can_left
            active, go_right = active[can_right | can_left], go_right[can_right | can_left]
            at = np.where(go_right, right[active], left[active] - 1)
            right[active] += go_right
            left[active] -= ~go_right
        halves = np.flatnonzero(cut >= 0)
        low, high = np.concatenate([low[halves], right[halves]]), np.concatenate([left[halves], high[halves]])


class Aligned(NamedTuple):
    """Tokens of consecutive texts; per-text ranges ``first_*[t]:first_*[t+1]``."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    group_a: np.ndarray         # number of each token's group
    group_b: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    n_groups: np.ndarray        # a text
    link_a: np.ndarray          # ids of each link, by place
    link_b: np.ndarray
    first_link: np.ndarray


def _ids(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], np.int64)
    return np.array([i for x in lists for i in x], np.int64), np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])


def align(lists_a: list[list[int]], lists_b: list[list[int]], length_a: np.ndarray, length_b: np.ndarray) -> Aligned:
    """Groups and links of texts whose tokens of both kinds cover the same bytes."""
    ids_a, first_a = _ids(lists_a)
    ids_b, first_b = _ids(lists_b)
    end_a, end_b = np.cumsum(length_a[ids_a]), np.cumsum(length_b[ids_b])
    filled = first_a[1:] > first_a[:-1]
    last = first_a[1:][filled] - 1                        # texts end in a common end
    cut_a, cut_b = common_ends(end_a, end_b, first_a[:-1][filled], last)
    group_a, group_b = np.zeros(len(ids_a) + 1, np.int64), np.zeros(len(ids_b) + 1, np.int64)
    group_a[np.concatenate([cut_a, last]) + 1] = 1
    group_b[np.concatenate([cut_b, first_b[1:][filled] - 1]) + 1] = 1
    group_a, group_b = np.cumsum(group_a), np.cumsum(group_b)
    n_groups = group_a[first_a[1:]] - group_a[first_a[:-1]]
    # links: the stretches between any two neighbouring ends belong to one token of each kind
    total = int(end_a[-1]) if len(end_a) else 0
    mark_a, mark_b = np.zeros(total + 1, np.int8), np.zeros(total + 1, np.int8)
    mark_a[end_a] = 1
    mark_b[end_b] = 1
    ends = np.flatnonzero(mark_a | mark_b)
    own_a, own_b = mark_a[ends].astype(np.int64), mark_b[ends].astype(np.int64)
    link_a, link_b = np.cumsum(own_a) - own_a, np.cumsum(own_b) - own_b
    text_end = np.concatenate([np.zeros(1, np.int64), end_a])[first_a]
    return Aligned(ids_a, ids_b, group_a[:-1], group_b[:-1], first_a, first_b, n_groups,
                   ids_a[link_a], ids_b[link_b], np.searchsorted(ends, text_end, side="right"))


def _digits(n: int) -> np.ndarray:
    """Decimal digits of 0..n-1, padded with zero bytes."""
    width = len(str(max(n - 1, 0)))
    return np.array([str(i) for i in range(n)], dtype=f"S{width}").view(np.uint8).reshape(n, width)


def group_strings(x: Aligned, digits: np.ndarray) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3` of each text."""
    n_a, n_b = len(x.ids_a), len(x.ids_b)
    ids, separator = np.empty(n_a + n_b, np.int64), np.empty(n_a + n_b, np.uint8)
    if not n_a:
        return [b""] * len(x.n_groups)
    last_a, last_b = np.r_[x.group_a[1:] != x.group_a[:-1], True], np.r_[x.group_b[1:] != x.group_b[:-1], True]
    begin_b, end_a = np.concatenate([[0], np.flatnonzero(last_b) + 1]), np.flatnonzero(last_a) + 1
    at_a, at_b = np.arange(n_a) + begin_b[x.group_a], np.arange(n_b) + end_a[x.group_b]
    ids[at_a], ids[at_b] = x.ids_a, x.ids_b
    separator[at_a], separator[at_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
    first = x.first_a + x.first_b
    separator[first[1:][first[1:] > first[:-1]] - 1] = 0
    out = np.concatenate([digits[ids], separator[:, None]], axis=1).ravel()
    solid = out != 0
    size = np.concatenate([np.zeros(1, np.int64), np.cumsum(solid.reshape(len(ids), -1).sum(axis=1))])[first]
    raw = out[solid].tobytes()
    return [raw[a:z] for a, z in zip(size[:-1].tolist(), size[1:].tolist(), strict=True)]


def _pairs_of(x: Aligned, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct linked id pairs of each text in order, how often each is
    linked, and the texts' ranges."""
    # vocabularies under 2^21 entries, fewer than 2^22 texts in a slice
    text = np.repeat(np.arange(len(x.n_groups), dtype=np.uint64), np.diff(x.first_link))
    both = np.sort(text << np.uint64(42) | (x.link_a * width + x.link_b).astype(np.uint64))
    new = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.empty(0, np.int64)
    at = np.searchsorted(both[new], np.arange(len(x.n_groups) + 1, dtype=np.uint64) << np.uint64(42))
    return both[new] & np.uint64((1 << 42) - 1), np.diff(np.r_[new, len(both)]), at


def _encoded(docs: DataFrame, byte_level: ByteLevel, pieces: Pieces, keep: list[str], names: list[str], text: str, groups: bool) -> DataFrame:
    """Per document: counts, digest of the groups, and its pairs."""
    shared = docs.sparkSession.sparkContext.broadcast((byte_level, pieces))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).toDF(*names).schema.fields]
    columns = [*names, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if groups else []), "pairs", "times"]
    schema = [*kinds, *[f"{c} long" for c in columns[len(keep):len(keep) + 4]], "groups_sha256 string",
              *(["groups string"] if groups else []), "pairs binary", "times binary"]

    def run(batches):
        first, second = shared.value
        length_a, length_b = (np.array([len(t) for t in v.bytes], np.int64) for v in (first, second))
        width = len(length_b)
        digits = _digits(max(len(length_a), width))
        for item in batches:
            _, offsets = utf8(item.column(len(keep)))
            for i, j in slices(offsets, SLICE_BYTES // 2):
                texts = [t or "" for t in item.column(len(keep)).slice(i, j - i).to_pylist()]
                lists_a, lists_b = first.encode_all([" " + t if t else "" for t in texts]), second.encode_all(texts)
                for row, t in enumerate(texts):
                    whole = b" " + t.encode("utf-8")
                    if not t or any(b"".join([v.bytes[k] for k in own[row]]) != whole for v, own in ((first, lists_a), (second, lists_b))):
                        lists_a[row], lists_b[row] = [], []
                x = align(lists_a, lists_b, length_a, length_b)
                strings = group_strings(x, digits)
                keys, times, at = _pairs_of(x, width)
                keys = keys.astype("<u4" if len(length_a) * width < 1 << 32 else "<u8")
                yield batch(columns, [
                    *[c.slice(i, j - i) for c in item.columns[:len(keep)]],
                    *[pa.array(v.astype(np.int64)) for v in (np.diff(x.first_a), np.diff(x.first_b), x.n_groups, np.diff(x.first_link))],
                    pa.array([hashlib.sha256(s).hexdigest() if s else "" for s in strings], pa.string()),
                    *([pa.array([s.decode() for s in strings], pa.string())] if groups else []),
                    *[pa.array([v[a:z].tobytes() for a, z in zip(at[:-1], at[1:], strict=True)], pa.binary()) for v in (keys, times.astype("<u4"))]])

    return positional(docs.select(*keep, text)).mapInArrow(run, ", ".join(schema))


def _blobs(values, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a binary column, and each row's range."""
    rows = values.to_pylist()
    data = np.frombuffer(b"".join(rows), kind)
    return data, np.concatenate([np.zeros(1, np.int64), np.cumsum([len(r) for r in rows]) // np.dtype(kind).itemsize]).astype(np.int64)


def _counted(rows: DataFrame, kind: str) -> DataFrame:
    """(key, n): how many documents hold each pair."""
    def count(batches):
        held, size = [], 0

        def total():
            keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(inverse, weights=np.concatenate([n for _, n in held]), minlength=len(keys)).astype(np.int64)

        for b in batches:
            for at in range(0, b.num_rows, 512):
                keys, n = np.unique(_blobs(b.column(0).slice(at, 512), kind)[0], return_counts=True)
                held.append((keys, n))
                size += len(keys)
                if size > PENDING:
                    held = [total()]
                    size = len(held[0][0])
                    if size > PENDING // 2:
                        yield batch(["key", "n"], [held[0][0].astype(np.int64), held[0][1]])
                        held, size = [], 0
        if held:
            keys, n = total()
            yield batch(["key", "n"], [keys.astype(np.int64), n])

    return rows.select("pairs").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _stored(pairs: DataFrame, uri: str, bits: int) -> SortedArrays:
    """Counts above 1, by the hash of their pair."""
    def deal(batches):
        for b in batches:
            key = mix(column(b, "key").astype(np.uint64))
            yield batch(["shard", "key", "n"], [shard_of(key, bits), key.view(np.int64), b.column(1)])

    def store(batches):
        parts = [b for b in batches if b.num_rows]
        if parts:
            t = pa.Table.from_batches(parts)
            for row in SortedArrays.write(uri, bits, t["key"].to_numpy().view(np.uint64), [t["n"].to_numpy()]):
                yield batch([*SortedArrays.STORED], [[v] for v in row])

    # about one shard a partition
    rows = (pairs.where("n > 1").mapInArrow(deal, "shard long, key long, n long").repartition(max(1 << bits, 1), "shard")
            .mapInArrow(store, ", ".join(f"{c} long" for c in SortedArrays.STORED)).collect())
    return SortedArrays(uri, bits, {r.shard: tuple(r)[1:] for r in rows})


def alignments(docs: DataFrame, path_a: str, path_b: str, keep: list[str], text: str = "text", groups: bool = False) -> DataFrame:
    """Per document: ``keep`` columns, n_a, n_b, n_groups, n_links, n_best (links
    whose pair has the highest count of its A id), count_sum (of the links'
    counts), groups_sha256; with ``groups`` the groups themselves."""
    spark = docs.sparkSession
    uri = workspace(spark, "alignment")
    byte_level, pieces = ByteLevel(path_a, special=False), Pieces(path_b)
    width, size_a = len(pieces.bytes), len(byte_level.bytes)
    kind = "<u4" if size_a * width < 1 << 32 else "<u8"
    names = [f"keep_{i}" for i in range(len(keep))]
    encoded = saved(_encoded(docs, byte_level, pieces, keep, names, text, groups), f"{uri}/encoded")
    pairs = saved(_counted(encoded, kind), f"{uri}/pairs")
    # one row an A id at most
    best = np.zeros(size_a, np.int64)
    for row in pairs.groupBy(F.expr(f"key div {width}").alias("a")).agg(F.max("n").alias("n")).collect():
        best[row.a] = row.n
    bits = max(pairs.count() // SHARD_ROWS, partitions(spark) // 2, 1).bit_length()
    table = _stored(pairs, f"{uri}/counts", bits)
    shared = spark.sparkContext.broadcast(best)
    n = len(keep)
    out = [*encoded.columns[:n + 4], "n_best", "count_sum", *encoded.columns[n + 4:-2]]
    kinds = {f.name: f.dataType.simpleString() for f in encoded.schema.fields}

    def look_up(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                keys, first = _blobs(part.column(part.num_columns - 2), kind)
                times = _blobs(part.column(part.num_columns - 1), "<u4")[0].astype(np.int64)
                distinct, inverse = np.unique(keys, return_inverse=True)
                hashed = mix(distinct.astype(np.uint64))
                order = np.argsort(hashed)
                counts = np.empty(len(distinct), np.int64)
                counts[order] = np.maximum(table.find(hashed[order], 1)[1][0], 1)
                is_best = counts == shared.value[distinct.astype(np.int64) // width]
                sums = [np.concatenate([np.zeros(1, np.int64), np.cumsum(v)]) for v in (times * is_best[inverse], times * counts[inverse])]
                yield batch(out, [*part.columns[:n + 4], *[pa.array(s[first[1:]] - s[first[:-1]]) for s in sums], *part.columns[n + 4:-2]])

    found = saved(encoded.mapInArrow(look_up, ", ".join(f"`{c}` {kinds.get(c, 'long')}" for c in out)), f"{uri}/found")
    for part in ("encoded", "pairs", "counts"):
        remove(f"{uri}/{part}")
    return found.toDF(*keep, *out[n:])
