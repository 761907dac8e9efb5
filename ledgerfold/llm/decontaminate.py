"""Benchmark decontamination by SimHash of item-sized windows.

Shingles are ``k`` words (a shorter item is one shingle of all its words); the
similarity of a window and an item is the weighted Jaccard of their shingles,
each weighted by how often it occurs: sum of minima / sum of maxima.

1. The items' shingles are stored as sorted hash arrays in the shared folder.
2. One pass over the texts forms, for every item length, the windows of as many
   words (a shorter text is one window).  Windows in which too few shingles are
   any such item's for the similarity to reach the threshold are skipped: exact,
   because the overlap cannot exceed that count.  The rest get a 64-bit SimHash.
   Equal windows of a document are one row with all their starts.
3. Equal windows of different documents are one row, too.  Their fingerprints
   meet the items' in a multi-index: 64 bits are cut into ``radius + 1`` blocks,
   so every pair of fingerprints within ``radius`` bits agrees in at least one
   block.  The join is on (length, block, value).
4. Candidates within the radius are verified by the exact weighted similarity.

At similarity 0.8 fingerprints differ in 10 bits on average (standard deviation
3); the default radius of 24 misses such a pair about once in a million.

Defined results: a text or item without words (null, empty) matches nothing;
repeated rows match alike; ties keep every match; ids may be null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.common import SortedArrays, batch, partitions, saved, shard_of, signed, workspace
from ledgerfold.llm.textkernel import mix, shingles, u64, word_slices

BITS = 64


def fingerprint(items: np.ndarray) -> int:
    """SimHash of a weighted set of shingle hashes (repeats weigh more)."""
    bits = np.unpackbits(mix(items ^ u64(0x51A0BEEF)).view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(items)).tobytes(), "little", signed=True)


def _of_length(items: np.ndarray, length) -> np.ndarray:
    """Key of a shingle as one of an item of that many words."""
    return mix(items ^ mix(np.array([length], dtype=np.uint64) + u64(0x1E46)))


def item_table(items: DataFrame, k: int, id_col: str, text: str) -> DataFrame:
    """item uid, id, length (words), fp and shingles of items with words."""
    def run(batches):
        for b in batches:
            for i, j, words in word_slices(b.column(2)):
                rows = []
                for d in range(j - i):
                    own = words.hash[words.first[d]:words.first[d + 1]]
                    if len(own):
                        sh = np.sort(shingles(own, k))
                        rows.append((i + d, len(own), fingerprint(sh), sh.tobytes()))
                if rows:
                    at, length, fp, blob = zip(*rows, strict=True)
                    at = pa.array(at)
                    yield batch(["item", "item_id", "length", "fp", "shingles"],
                                [b.column(0).take(at), b.column(1).take(at), pa.array(length, pa.int64()), pa.array(fp, pa.int64()), pa.array(blob, pa.binary())])

    kind = items.select(id_col).schema[0].dataType.simpleString()
    rows = items.select(F.xxhash64(id_col, text).alias("item"), F.col(id_col).alias("item_id"), text).distinct()
    return rows.mapInArrow(run, f"item long, item_id {kind}, length long, fp long, shingles binary")


def _arrays(items: DataFrame, uri: str) -> SortedArrays:
    """The items' shingles, alone and by item length, as sorted arrays."""
    bits = 6

    def keys(batches):
        for b in batches:
            for length, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.unique(np.frombuffer(blob, np.uint64))
                both = np.concatenate([own, _of_length(own, length)])
                yield batch(["shard", "key"], [shard_of(both, bits), signed(both)])

    def store(batches):
        parts = [b for b in batches if b.num_rows]
        if parts:
            own = pa.Table.from_batches(parts)["key"].to_numpy().view(np.uint64)
            for row in SortedArrays.write(uri, bits, own, []):
                yield batch([*SortedArrays.STORED], [[v] for v in row])

    found = items.select("length", "shingles").mapInArrow(keys, "shard long, key long").distinct()
    rows = found.repartition(partitions(items.sparkSession), "shard").mapInArrow(store, ", ".join(f"{c} long" for c in SortedArrays.STORED)).collect()
    return SortedArrays(uri, bits, {r.shard: tuple(r)[1:] for r in rows})


def windows(docs: DataFrame, arrays: SortedArrays, lengths: list[int], k: int, percent: int, text: str) -> DataFrame:
    """uid, length, content, fp, shingles, starts, n_words of the windows that
    can reach the similarity.  ``docs`` has uid and text."""
    sizes = sorted({min(k, n) for n in lengths})

    def of_document(own: np.ndarray, hits: dict[int, np.ndarray], sh: dict[int, np.ndarray]):
        known = {size: np.concatenate([np.zeros(1, np.int64), np.cumsum(hit)]) for size, hit in hits.items()}
        for length in lengths:
            size = min(k, length)
            items, any_ = sh[size], known[size]
            n = length - size + 1
            m = min(n, len(items))
            need = percent * (n + m) / (100 + percent) - 1e-9
            # shingles of items of any length bound those of this length
            if not m or any_[-1] < need or (any_[m:] - any_[:-m]).max() < need:
                continue
            # of the shingles found in any item, those of items of this length
            at = np.flatnonzero(hits[size])
            mask = np.zeros(len(items), dtype=np.int64)
            key = _of_length(items[at], length)
            order = np.argsort(key)
            mask[at[order]] = arrays.find(key[order])[0] >= 0
            total = np.r_[0, np.cumsum(mask)]
            start = np.flatnonzero(total[m:] - total[:-m] >= need)
            if not len(start):
                continue
            content = np.r_[np.zeros(1, np.uint64), np.cumsum(mix(items ^ u64(0xC0117E17)), dtype=np.uint64)]
            content = mix((content[start + m] - content[start]) ^ u64(m))
            _, first, inverse = np.unique(content, return_index=True, return_inverse=True)
            by = np.argsort(inverse, kind="stable")
            edges = np.searchsorted(inverse[by], np.arange(len(first) + 1))
            for c, f in enumerate(first):
                own_items = np.sort(items[start[f]:start[f] + m])
                yield (length, int(signed(content[f:f + 1])[0]), fingerprint(own_items), own_items.tobytes(),
                       start[by[edges[c]:edges[c + 1]]].tolist(), min(length, len(own)))

    names = ["uid", "length", "content", "fp", "shingles", "starts", "n_words"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64()]

    def run(batches):
        for b in batches:
            uids = b.column(0)
            for i, j, words in word_slices(b.column(1)):
                rows, per, some = [], {}, set()
                for size in sizes:              # all documents of the slice at once
                    whole = shingles(words.hash, size) if len(words.hash) >= size else np.empty(0, np.uint64)
                    distinct = np.unique(whole)
                    known = distinct[arrays.find(distinct)[0] >= 0]
                    hit = np.zeros(len(whole), dtype=bool)
                    if len(known):
                        at = np.searchsorted(known, whole)
                        hit = known[np.minimum(at, len(known) - 1)] == whole
                    at = np.flatnonzero(hit)
                    text_of = np.searchsorted(words.first, at, side="right") - 1
                    some.update(text_of[at + size <= words.first[text_of + 1]].tolist())
                    per[size] = whole, hit
                for d in sorted(some):
                    lo, hi = words.first[d], words.first[d + 1]
                    part = {size: slice(lo, max(hi - size + 1, lo)) for size in sizes}
                    rows += [(uids[i + d].as_py(), *r) for r in of_document(words.hash[lo:hi], {z: per[z][1][part[z]] for z in sizes}, {z: per[z][0][part[z]] for z in sizes})]
                if rows:
                    yield batch(names, [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)])

    return docs.select("uid", text).mapInArrow(run, "uid long, length long, content long, fp long, shingles binary, starts array<long>, n_words long")


def _blocks(fp: str, radius: int) -> Column:
    """(block, value) of each of the radius+1 blocks of a fingerprint."""
    edges = [BITS * b // (radius + 1) for b in range(radius + 2)]
    return F.explode(F.array(*[F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(F.col(fp), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("value"))
                               for b, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]))


def matches(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80, radius: int = 24,
            id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """uid, doc id, item_id, similarity, starts (word positions) and n_words of
    every window of every text that is at least ``percent`` similar to an item."""
    if not 0 <= radius < BITS:
        raise ValueError("radius must be 0 to 63")
    uri = workspace(docs.sparkSession, "decontaminate")
    docs = docs.select(F.xxhash64(id_col, text).alias("uid"), F.col(id_col).alias("_id"), text)
    bench = saved(item_table(items, k, item_id, item_text), f"{uri}/items")
    arrays = _arrays(bench, f"{uri}/shingles")
    lengths = sorted(r.length for r in bench.select("length").distinct().collect())
    if not lengths:
        lengths = [k]
    found = saved(windows(docs, arrays, lengths, k, percent, text), f"{uri}/windows")

    content = ["length", "content"]
    distinct = saved(found.groupBy(*content).agg(F.min("fp").alias("fp"), F.min("shingles").alias("shingles")), f"{uri}/contents")
    one = distinct.select(*content, "fp", _blocks("fp", radius).alias("b")).select(*content, "fp", "b.block", "b.value")
    two = bench.select("item", "length", F.col("fp").alias("item_fp"), _blocks("fp", radius).alias("b")).select("item", "length", "item_fp", "b.block", "b.value")
    near = (one.join(two, ["length", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
            .select(*content, "item").distinct())
    pairs = (near.join(distinct.select(*content, "shingles"), content)
             .join(bench.select("item", "item_id", F.col("shingles").alias("item_shingles")), "item"))

    def weight(blob):
        return np.unique(np.frombuffer(blob, np.uint64), return_counts=True)

    def verify(batches):
        for b in batches:
            out = []
            for left, right in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                (x, n), (y, m) = weight(left), weight(right)
                _, at, to = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                both = int(np.minimum(n[at], m[to]).sum())
                union = int(n.sum() + m.sum()) - both
                out.append(both / union if 100 * both >= percent * union else None)
            similar = pa.array(out, pa.float64())
            keep = similar.is_valid()
            yield batch(["length", "content", "item", "item_id", "similarity"], [*[b.column(c).filter(keep) for c in range(4)], similar.filter(keep)])

    kind = items.select(item_id).schema[0].dataType.simpleString()
    sure = (pairs.select(*content, "item", "item_id", "shingles", "item_shingles")
            .mapInArrow(verify, f"length long, content long, item long, item_id {kind}, similarity double"))
    hits = found.select("uid", *content, "starts", "n_words").distinct().join(sure, content)
    return hits.join(docs.select("uid", F.col("_id").alias(id_col)).distinct(), "uid").select("uid", id_col, "item_id", "similarity", "starts", "n_words")


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The best window of each (document, item): doc id, item_id, similarity,
    start_word, end_word (exclusive) and the number of windows found."""
    best = F.max(F.struct("similarity", (-F.array_min("starts")).alias("s"), "n_words")).alias("b")
    return (found.groupBy("uid", id_col, "item_id").agg(best, F.sum(F.size("starts")).alias("n_windows"))
            .select(id_col, "item_id", "b.similarity", (-F.col("b.s")).alias("start_word"), (F.col("b.n_words") - F.col("b.s")).alias("end_word"), "n_windows"))


def clean(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any match.  Columns go by their place, so
    that no name can clash."""
    names = docs.columns
    own = docs.toDF(*[f"c{i}" for i in range(len(names))])
    uid = F.xxhash64(f"c{names.index(id_col)}", f"c{names.index(text)}")
    return own.join(found.select("uid").distinct(), uid == F.col("uid"), "left_anti").toDF(*names)
