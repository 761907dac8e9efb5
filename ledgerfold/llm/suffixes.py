"""Exact substring removal: every byte covered by a string of ``length`` bytes
that also starts elsewhere, by a depth-limited radix sort of suffixes.

Suffixes are ordered only through their first ``length`` bytes, most significant
digit first; after each pass groups of one are dropped, and the groups that are
left after the last pass are exactly the repeated windows.

First digit.  Sorting all suffixes by their first bytes would shuffle a row a
byte.  Instead the first pass orders by an anchor: of the ``GRAM``-byte strings
inside a window, the one with the smallest hash (leftmost on ties).  It depends
on the window's content alone, so equal windows have equal anchors at equal
offsets, and the windows between two changes of the anchor form one run.  Only
the runs' anchors are shuffled and counted; runs whose anchor occurs once hold
no repeated window and are dropped.

Further digits.  The bytes of the remaining runs are dealt by anchor, and each
task orders the windows of its anchors by offset and then by digits of 40
bytes.  Anchors that very many runs share (a boilerplate line) are not sent to
one task: equal runs are counted by ``groupBy``, the distinct runs' windows are
counted by ``groupBy`` over their hash, with partial sums before the shuffle,
and the result is joined back.  Both ways are exact and whole.

Digits and anchors are compared by 64-bit hashes of their bytes (windows of
hot anchors by 128 bits).

Defined results: null text counts as empty; texts shorter than ``length`` lose
nothing; repeated rows are copies of each other and lose all they share, whatever
their ids; matches never cross documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.common import batch, partitions, saved, signed, workspace
from ledgerfold.llm.textkernel import mix, slices, u64, utf8

GRAM = 32
DIGIT = 40
PIECE = 1 << 21
PLACE = 24                  # bits of a position inside a piece
HOT = 1 << 14               # anchors with more runs are dealt with by groupBy: bounds a task's memory
TOGETHER = 1 << 12          # runs that a task solves at once, if they are of several anchors
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * u64(0x9E3779B97F4A7C15))
_BASE = u64(0xD6E8FEB86659FD93)


def rolling(raw: np.ndarray, width: int, table: np.ndarray = _TABLE) -> np.ndarray:
    """Polynomial hash of each ``width`` bytes, by doubling."""
    have, power = table[raw], _BASE
    out, done, at = None, 0, 1
    with np.errstate(over="ignore"):
        while True:
            if width & at:
                if out is None:
                    out = have
                else:
                    scale = np.uint64(pow(int(_BASE), at, 1 << 64))
                    n = len(raw) - done - at + 1
                    out = out[:max(n, 0)] * scale + have[done:done + max(n, 0)]
                done += at
            if at * 2 > width:
                return out[:max(len(raw) - width + 1, 0)]
            n = len(have) - at
            have = have[:max(n, 0)] * power + have[at:] if n > 0 else have[:0]
            power = power * power
            at *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row, by doubling."""
    have, at = values, 1
    while at * 2 <= width:
        have = np.minimum(have[:-at], have[at:]) if len(have) > at else have[:0]
        at *= 2
    rest = width - at
    return np.minimum(have[:-rest], have[rest:]) if rest and len(have) > rest else have[:0] if rest else have


def runs_of(raw: np.ndarray, offsets: np.ndarray, length: int):
    """Runs of windows with one anchor in the texts: anchor hash, text, first
    window, number of windows, offset of the anchor in the first window."""
    out = []
    n = len(raw)
    for p in range(0, max(n - length + 1, 0), PIECE):
        part = raw[p:p + PIECE + length - 1]
        grams = mix(rolling(part, GRAM))
        places = np.arange(len(grams), dtype=np.uint64)
        low = sliding_min((grams >> u64(PLACE) << u64(PLACE)) | places, length - GRAM + 1)
        windows = len(low)
        start = np.arange(p, p + windows)
        text = np.searchsorted(offsets, start, side="right") - 1
        valid = start + length <= offsets[text + 1]
        anchor = (low & u64((1 << PLACE) - 1)).astype(np.int64)
        new = np.ones(windows, dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.r_[at, windows])
        keep = valid[at]
        at, size = at[keep], size[keep]
        out.append((grams[anchor[at]], text[at], start[at] - offsets[text[at]], size, anchor[at] - at))
    if not out:
        return [np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 4]
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def anchors(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for b in batches:
            uid = b.column(0).to_numpy(zero_copy_only=False)
            raw, offsets = utf8(b.column(1))
            for i, j in slices(offsets):
                gram, text, start, n, offset = runs_of(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], length)
                yield batch(["gram", "uid", "start", "n", "offset"], [signed(gram), uid[i:j][text], start, n.astype(np.int32), offset.astype(np.int32)])

    return docs.select("uid", "text").mapInArrow(run, "gram long, uid long, start long, n int, offset int")


def _packed(docs: DataFrame, kind: str) -> DataFrame:
    """uid, _id and the text's compressed bytes, as they are shuffled."""
    def run(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for b in batches:
            data = [packer.compress(t.as_buffer()) for t in b.column(2).cast(pa.binary())]
            yield batch(["uid", "_id", "packed"], [b.column(0), b.column(1), pa.array(data, pa.binary())])

    return docs.select("uid", "_id", "text").mapInArrow(run, f"uid long, _id {kind}, packed binary")


def unpack(value: pa.Scalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(value.as_buffer())


def _extract(joined: DataFrame, length: int, hot: bool) -> DataFrame:
    """The bytes of each candidate run of the joined documents."""
    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                uid, text = b.column(0)[row].as_py(), unpack(b.column(1)[row])
                own = list({(r["start"], r["n"]): r for r in b.column(2)[row].as_py()}.values())   # repeated rows list them twice
                data = [text[r["start"]:r["start"] + r["n"] + length - 1] for r in own]
                yield batch(["gram", "uid", "start", "n", "offset", "data"],
                            [pa.array([r["gram"] for r in own], pa.int64()), pa.array([uid] * len(own), pa.int64()), pa.array([r["start"] for r in own], pa.int64()),
                             pa.array([r["n"] for r in own], pa.int32()), pa.array([r["offset"] for r in own], pa.int32()), pa.array(data, pa.binary())])

    # texts without such runs are not unpacked
    return (joined.select("uid", "packed", F.filter("runs", lambda r: r["hot"] == F.lit(hot)).alias("runs")).where(F.size("runs") > 0)
            .mapInArrow(run, "gram long, uid long, start long, n int, offset int, data binary"))


def _ranges(at: np.ndarray, owner: np.ndarray):
    """Maximal runs of consecutive ``at`` of one owner: owner, first, last."""
    if not len(at):
        return owner, at, at
    new = np.r_[True, (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(at)] - 1
    return owner[first], at[first], at[last]


def repeated_windows(gram: np.ndarray, offset: np.ndarray, n: np.ndarray, weight: np.ndarray, data: list[bytes], length: int):
    """MSD passes over the windows of the given runs; (run, window) of those
    whose weights sum to two or more."""
    raw = np.frombuffer(b"".join(data), np.uint8)
    begin = np.r_[0, np.cumsum([len(d) for d in data])][:-1]
    run = np.repeat(np.arange(len(n)), n)
    window = np.arange(len(run)) - np.repeat(np.r_[0, np.cumsum(n)][:-1], n)
    at = begin[run] + window
    digit = rolling(raw, DIGIT)
    key = mix(gram.view(np.uint64)[run]) ^ (offset[run] - window).astype(np.uint64)
    for depth in range(0, length + DIGIT - 1, DIGIT):
        if depth:
            here = min(depth, length) - DIGIT
            key = mix((key ^ digit[at + here]) * u64(0x9E3779B97F4A7C15))
        distinct, group = np.unique(key, return_inverse=True)
        keep = np.bincount(group, weights=weight[run], minlength=len(distinct))[group] > 1.5
        run, window, at, key = run[keep], window[keep], at[keep], group[keep].astype(np.uint64)
        if not len(run):
            break
    return run, window


def _cold(runs: DataFrame, length: int) -> DataFrame:
    """uid, first, end of bytes covered by repeated windows; all runs of an
    anchor are in one task and at most HOT."""
    dealt = runs.repartition(partitions(runs.sparkSession), "gram").sortWithinPartitions("gram")

    def solve(t: pa.Table):
        gram, uid, start, n, offset = (t[c].to_numpy() for c in ("gram", "uid", "start", "n", "offset"))
        data = t["data"].to_pylist()
        # equal runs count as one with their number as weight
        classes: dict[tuple, int] = {}
        of = np.array([classes.setdefault((g, o, d), len(classes)) for g, o, d in zip(gram.tolist(), offset.tolist(), data, strict=True)])
        _, first = np.unique(of, return_index=True)
        weight = np.bincount(of)
        run, window = repeated_windows(gram[first], offset[first], n[first].astype(np.int64), weight, [data[i] for i in first], length)
        owner, a, z = _ranges(window, run)
        order = np.argsort(of, kind="stable")
        edges = np.searchsorted(of[order], np.arange(len(first) + 1))
        count = edges[owner + 1] - edges[owner]
        take = np.repeat(edges[owner], count) + np.arange(count.sum()) - np.repeat(np.r_[0, np.cumsum(count)][:-1], count)
        rows = order[take]
        return batch(["uid", "first", "end"], [uid[rows], start[rows] + np.repeat(a, count), start[rows] + np.repeat(z, count) + length])

    def run(batches):
        waiting: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            gram = b.column(0).to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))      # the last anchor may go on in the next batch
            if cut and size + b.num_rows >= TOGETHER:
                yield solve(pa.Table.from_batches([*waiting, b.slice(0, cut)]))
                waiting, size = [b.slice(cut)], b.num_rows - cut
            else:
                waiting.append(b)
                size += b.num_rows
        if waiting:
            yield solve(pa.Table.from_batches(waiting))

    return dealt.mapInArrow(run, "uid long, first long, end long")


def _hot(runs: DataFrame, length: int) -> DataFrame:
    """As _cold for the runs of hot anchors, counted by groupBy."""
    other = mix(_TABLE + u64(0x5EED))

    def classed(batches):
        for b in batches:
            keys = [hashlib.blake2b(d, digest_size=8, key=f"{g},{o}".encode()).digest()
                    for g, o, d in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield batch(["class", "gram", "uid", "start", "n", "offset", "data"], [np.frombuffer(b"".join(keys), "<i8"), *[b.column(c) for c in (0, 1, 2, 5, 3, 4)]])

    keyed = runs.select("gram", "uid", "start", "offset", "data", "n").mapInArrow(classed, "class long, gram long, uid long, start long, n int, offset int, data binary")
    classes = keyed.groupBy("class").agg(F.min("gram").alias("gram"), F.min("n").alias("n"), F.min("offset").alias("offset"), F.min("data").alias("data"), F.count(F.lit(1)).alias("weight"))

    def exploded(batches):
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                own, gram, n, offset = (part.column(c).to_numpy() for c in range(4))
                data = part.column(4).to_pylist()
                raw = np.frombuffer(b"".join(data), np.uint8)
                begin = np.r_[0, np.cumsum([len(d) for d in data])][:-1]
                run = np.repeat(np.arange(len(n)), n)
                window = np.arange(len(run)) - np.repeat(np.r_[0, np.cumsum(n)][:-1], n)
                at = begin[run] + window
                salt = mix(gram.view(np.uint64)[run]) ^ (offset[run] - window).astype(np.uint64)
                one, two = (mix(rolling(raw, length, t)[at] ^ salt) for t in (_TABLE, other))
                yield batch(["class", "window", "one", "two", "weight"], [own[run], window.astype(np.int32), signed(one), signed(two), part.column(5).to_numpy()[run]])

    windows = classes.select("class", "gram", "n", "offset", "data", "weight").mapInArrow(exploded, "class long, window int, one long, two long, weight long")
    twice = windows.groupBy("one", "two").agg(F.sum("weight").alias("w")).where("w > 1").select("one", "two")
    found = windows.join(twice, ["one", "two"], "left_semi").groupBy("class").agg(F.sort_array(F.collect_list("window")).alias("windows"))

    def ranged(batches):
        for b in batches:
            for own, at in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                at = at.values.to_numpy()
                _, a, z = _ranges(at, np.zeros(len(at), np.int64))
                yield batch(["class", "a", "z"], [np.full(len(a), own), a.astype(np.int64), z.astype(np.int64)])

    spans = found.mapInArrow(ranged, "class long, a long, z long")
    return keyed.select("class", "uid", "start").join(spans, "class").select("uid", (F.col("start") + F.col("a")).alias("first"), (F.col("start") + F.col("z") + length).alias("end"))


def without_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text: str = "text", kept_text: bool = False) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256 (and
    the kept bytes)."""
    if length < GRAM + 2 or length < DIGIT:
        raise ValueError(f"length must be at least {max(GRAM + 2, DIGIT)} bytes")
    uri = workspace(docs.sparkSession, "suffixes")
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    own = docs.select(F.xxhash64(id_col, text).alias("uid"), F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    runs = anchors(own, length)
    repeated = runs.groupBy("gram").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    listed = runs.join(repeated, "gram").select("uid", F.struct("gram", "start", "n", "offset", (F.col("times") > HOT).alias("hot")).alias("run"))
    wanted = saved(listed.groupBy("uid").agg(F.collect_list("run").alias("runs")), f"{uri}/runs")

    # one shuffle of the texts serves the three joins
    packed = _packed(own, kind)
    joined = packed.join(wanted, "uid")
    covered = _cold(_extract(joined, length, False), length).union(_hot(_extract(joined, length, True), length))
    spans = saved(covered.groupBy("uid").agg(F.collect_set(F.struct("first", "end")).alias("spans")), f"{uri}/spans")
    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if kept_text else "")

    def cut(batches):
        for b in batches:
            rows = []
            for value, found in zip(b.column(1), b.column(2), strict=True):
                raw = unpack(value)
                merged: list[list[int]] = []
                for x in sorted((s["first"], s["end"]) for s in found.as_py() or ()):
                    if merged and x[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x[1])
                    else:
                        merged.append([*x])
                kept, at = [], 0
                for a, z in merged:
                    kept.append(raw[at:a])
                    at = z
                left = b"".join([*kept, raw[at:]])
                rows.append((len(raw), len(raw) - len(left), len(merged), hashlib.sha256(left).hexdigest(), left))
            if rows:
                columns = list(zip(*rows, strict=True))[:5 if kept_text else 4]
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield batch([id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if kept_text else [])],
                            [b.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=False)]])

    return packed.join(spans, "uid", "left").select("_id", "packed", "spans").mapInArrow(cut, schema)
