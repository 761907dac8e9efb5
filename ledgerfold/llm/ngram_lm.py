"""Interpolated modified Kneser-Ney language model.

Training counts n-grams in Spark, level by level.  Tokens get dense ids (their
place in the sorted array of token hashes).  A level's n-grams are combined
inside each task, shuffled by a hash of the whole n-gram (so that a frequent
context or word is spread over all tasks), counted by ``groupBy`` and stored as
sorted hash arrays in the shared folder.  The tasks that store a level also
yield its context sums, its counts of counts and the continuation counts that
are the level below.  Scoring tasks memory-map the arrays and look up the
distinct n-grams of each slice of text in sorted order.

Discounts follow the modified Kneser-Ney estimates Y = t1/(t1+2*t2),
D1 = 1-2Y*t2/t1, D2 = 2-3Y*t3/t2, D3+ = 3-4Y*t4/t3 per level; where a needed
count of counts is 0 the discount falls back to half of the count it applies
to.  The lowest level interpolates with the uniform distribution over the
training vocabulary and one unknown word, so each context's probabilities sum
to 1.

Defined results: null text counts as empty, and an empty text is the one token
"end".  A null id is never held out.  Repeated rows count once per row.  With
no training rows, every token has the probability 1 (the vocabulary is the
unknown word alone) and the base score is 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.common import SortedArrays, batch, column, partitions, positional, remove, saved, shard_of, signed, workspace
from ledgerfold.llm.textkernel import mix, mix_int, slices, u64, utf8, words_of

END = np.uint64(mix_int(0x656E64))      # the token after each text's last word
BEFORE = -2                             # id of the padding before the first word
UNKNOWN = -1
COUNT_SLICE = 1 << 22     # bytes of text whose n-grams are combined before the shuffle
SCORE_SLICE = 1 << 21
ROWS_PER_SHARD = 1 << 18
SHARDS_PER_TASK = 16


def _tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the texts, each followed by END, and where texts begin."""
    words = words_of(raw, offsets)
    n = len(offsets) - 1
    return np.insert(words.hash, words.first[1:], END), words.first + np.arange(n + 1)


def _token_slices(col: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, offsets = utf8(col)
    for i, j in slices(offsets, size):
        yield i, j, *_tokens(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])


def _ngram_key(ids: list[np.ndarray]) -> np.ndarray:
    key = np.full(len(ids[0]), u64(len(ids)), dtype=np.uint64)
    for part in ids:
        key = mix((key ^ part.view(np.uint64)) * u64(0x9E3779B97F4A7C15))
    return key


def _history(ids: np.ndarray, begins: np.ndarray, order: int) -> list[np.ndarray]:
    """Id columns of the n-gram that ends at each token, oldest first."""
    place = np.arange(len(ids)) - np.repeat(begins[:-1], np.diff(begins))
    out = [ids]
    for back in range(1, order):
        older = np.full(len(ids), BEFORE, dtype=np.int64)
        older[back:] = ids[:-back]
        older[place < back] = BEFORE
        out.insert(0, older)
    return out


def _vocabulary_ids(vocabulary: SortedArrays, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, inverse = np.unique(tokens, return_inverse=True)
    position, (counts,) = vocabulary.find(distinct, 1)
    return position[inverse], counts[inverse]


@dataclass
class Level:
    grams: SortedArrays                     # key -> count
    contexts: SortedArrays | None           # key -> total, distinct with count 1, 2, 3+
    discounts: tuple[float, float, float]
    total: int = 0                          # level 1: the sum and its 1, 2, 3+
    spread: tuple[int, int, int] = (0, 0, 0)


@dataclass
class Model:
    order: int
    train_tokens: int
    vocabulary: SortedArrays
    levels: dict[int, Level] = field(default_factory=dict)


def _discounts(t: list[int]) -> tuple[float, float, float]:
    y = t[0] / (t[0] + 2 * t[1]) if t[0] else 0.0
    out = []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * t[k] / t[k - 1] if t[k - 1] else k / 2
        out.append(d if 0 < d < k else k / 2)
    return tuple(out)


def _bits(rows: int, tasks: int) -> int:
    """Shards for so many rows; also so many for each task that tasks are even."""
    return min(20, max(2, math.ceil(math.log2(max(rows, 1) / ROWS_PER_SHARD)) if rows > ROWS_PER_SHARD else 2, (SHARDS_PER_TASK * tasks - 1).bit_length()))


def _sharded(df: DataFrame, keys: list[str]) -> DataFrame:
    return (df.repartition(partitions(df.sparkSession), "shard").groupBy("shard", *keys)
            .agg(F.sum("n").alias("n")))


def _store_shards(uri: str, bits: int, make):
    """mapInArrow body: gathers its partition (whole shards), stores it."""
    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if parts:
            yield from make(pa.Table.from_batches(parts), uri, bits)
    return run


def _count_vocabulary(train: DataFrame, text: str, uri: str, bits: int) -> tuple[SortedArrays, int]:
    def count(batches):
        for b in batches:
            for _, _, tokens, _ in _token_slices(b.column(0), COUNT_SLICE):
                token, n = np.unique(tokens, return_counts=True)
                yield batch(["shard", "token", "n"], [shard_of(token, bits), signed(token), n])

    def make(t, uri, bits):
        n = t["n"].to_numpy()
        stored = SortedArrays.write(uri, bits, t["token"].to_numpy().view(np.uint64), [n])
        total = int(n.sum())
        for row in stored:
            yield batch([*SortedArrays.STORED, "total"], [[v] for v in (*row, total)])
            total = 0

    counted = _sharded(train.select(text).mapInArrow(count, "shard long, token long, n long"), ["token"])
    rows = counted.mapInArrow(_store_shards(uri, bits, make), ", ".join(f"{c} long" for c in (*SortedArrays.STORED, "total"))).collect()
    return SortedArrays(uri, bits, {r.shard: tuple(r)[1:4] for r in rows}), sum(r.total for r in rows)


def _store_level(grams: DataFrame, k: int, uri: str, bits: int) -> tuple[Level, DataFrame | None]:
    """Store one level's counted n-grams; returns it and the level below's
    partial rows (g1.., n)."""
    spark = grams.sparkSession
    names = [f"g{i}" for i in range(1, k + 1)]
    stats = ["kind", *names[1:], "n", "n1", "n2", "n3"]

    def sums(keys: list[np.ndarray], values: list[np.ndarray]):
        order = np.lexsort(keys[::-1])
        keys, values = [x[order] for x in keys], [v[order] for v in values]
        new = np.r_[True, np.any([x[1:] != x[:-1] for x in keys], axis=0)]
        at = np.flatnonzero(new)
        return [x[at] for x in keys], [np.add.reduceat(v, at) for v in values]

    def make(t, uri, bits):
        ids = [np.ascontiguousarray(t[g].to_numpy()) for g in names]
        n = t["n"].to_numpy()
        none = np.zeros(1, np.int64)
        stored = SortedArrays.write(f"{uri}/grams", bits, _ngram_key(ids), [n])
        for shard, file, keys, widths in stored:
            yield rows(0, [], none + keys, none + widths, none + shard, none + file)
        t4 = [int((n == c).sum()) for c in (1, 2, 3, 4)]
        yield rows(1, [], *[none + c for c in t4])
        one, two, more = [(x).astype(np.int64) for x in (n == 1, n == 2, n > 2)]
        if k == 1:
            yield rows(2, [], none + int(n.sum()), none + int(one.sum()), none + int(two.sum()), none + int(more.sum()))
            return
        keys, values = sums(ids[:-1], [n, one, two, more])
        yield rows(2, keys, *values)
        keys, values = sums(ids[1:], [np.ones(len(n), np.int64)])
        zero = np.zeros(len(values[0]), np.int64)
        yield rows(3, keys, values[0], zero, zero, zero)

    def rows(kind, keys, *values):
        size = len(values[0])
        keys = [*keys, *[np.zeros(size, np.int64)] * (k - 1 - len(keys))]
        return batch(stats, [np.full(size, kind, np.int64), *keys, *values])

    out = saved(_sharded(grams, names).mapInArrow(_store_shards(uri, bits, make), ", ".join(f"{c} long" for c in stats)),
                f"{uri}/stats")
    t4 = out.where("kind = 1").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "n1", "n2", "n3")]).first()
    discounts = _discounts(list(t4))
    shards = {r["n2"]: (r["n3"], r["n"], r["n1"]) for r in out.where("kind = 0").select("n", "n1", "n2", "n3").collect()}
    if k == 1:
        s = out.where("kind = 2").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "n1", "n2", "n3")]).first()
        return Level(SortedArrays(f"{uri}/grams", bits, shards), None, discounts, s[0], tuple(s[1:])), None
    contexts = _store_contexts(out.where("kind = 2"), names[1:], f"{uri}/contexts", bits)
    level = Level(SortedArrays(f"{uri}/grams", bits, shards), contexts, discounts)
    below = out.where("kind = 3").select(*[F.col(f"g{i + 1}").alias(f"g{i}") for i in range(1, k)], "n")
    return level, below


def _store_contexts(rows: DataFrame, names: list[str], uri: str, bits: int) -> SortedArrays:
    values = ["n", "n1", "n2", "n3"]

    def key(batches):
        for b in batches:
            shard = shard_of(_ngram_key([np.ascontiguousarray(column(b, g)) for g in names]), bits)
            yield batch(["shard", *names, *values], [shard, *[b.column(c) for c in (*names, *values)]])

    def make(t, uri, bits):
        keys = _ngram_key([np.ascontiguousarray(t[g].to_numpy()) for g in names])
        for row in SortedArrays.write(uri, bits, keys, [t[v].to_numpy() for v in values]):
            yield batch([*SortedArrays.STORED], [[v] for v in row])

    summed = rows.groupBy(*names).agg(*[F.sum(v).alias(v) for v in values])
    keyed = summed.mapInArrow(key, ", ".join(f"{c} long" for c in ("shard", *names, *values)))
    stored = (keyed.repartition(partitions(rows.sparkSession), "shard")
              .mapInArrow(_store_shards(uri, bits, make), ", ".join(f"{c} long" for c in SortedArrays.STORED)).collect())
    return SortedArrays(uri, bits, {r.shard: tuple(r)[1:] for r in stored})


def train(docs: DataFrame, order: int = 2, text: str = "text") -> Model:
    """Count and store the model of the texts in ``docs`` (any order >= 2)."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession
    uri = workspace(spark, "lm")
    bits = _bits(0, partitions(spark))
    vocabulary, total = _count_vocabulary(docs, text, f"{uri}/vocabulary", bits)
    bits = _bits(total, partitions(spark))
    names = [f"g{i}" for i in range(1, order + 1)]

    def count(batches):
        for b in batches:
            for _, _, tokens, begins in _token_slices(b.column(0), COUNT_SLICE):
                grams = _history(_vocabulary_ids(vocabulary, tokens)[0], begins, order)
                keys, at, n = np.unique(_ngram_key(grams), return_index=True, return_counts=True)
                shard, grams = shard_of(keys, bits), [g[at] for g in grams]
                by = np.lexsort((*grams[::-1], shard))      # like ids together: the shuffle compresses better
                yield batch(["shard", *names, "n"], [shard[by], *[g[by] for g in grams], n[by]])

    below = docs.select(text).mapInArrow(count, ", ".join(f"{c} long" for c in ("shard", *names, "n")))
    model = Model(order, total, vocabulary)
    for k in range(order, 0, -1):
        own = [f"g{i}" for i in range(1, k + 1)]
        if k < order:
            def key(batches, own=own):
                for b in batches:
                    ids = [np.ascontiguousarray(column(b, g)) for g in own]
                    yield batch(["shard", *own, "n"], [shard_of(_ngram_key(ids), bits), *ids, b.column("n")])
            below = below.mapInArrow(key, ", ".join(f"{c} long" for c in ("shard", *own, "n")))
        model.levels[k], below = _store_level(below, k, f"{uri}/level{k}", bits)
    for k in range(1, order + 1):
        remove(f"{uri}/level{k}/stats")
    return model


def _probabilities(model: Model, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The model's probability of each token."""
    grams = _history(ids, begins, model.order)

    def discounted(level: Level, counts: np.ndarray) -> np.ndarray:
        d = np.array([0.0, *level.discounts])
        return counts - d[np.minimum(counts, 3)]

    low = model.levels[1]
    distinct, inverse = np.unique(_ngram_key([ids]), return_inverse=True)
    counts = low.grams.find(distinct, 1)[1][0][inverse]
    if low.total:
        back = float(np.dot(low.discounts, low.spread)) / low.total
        p = discounted(low, counts) / low.total + back / (model.vocabulary.size + 1)
    else:
        p = np.full(len(ids), 1.0 / (model.vocabulary.size + 1))
    for k in range(2, model.order + 1):
        level, own = model.levels[k], grams[model.order - k:]
        distinct, inverse = np.unique(_ngram_key(own[:-1]), return_inverse=True)
        found, (total, n1, n2, n3) = level.contexts.find(distinct, 4)
        back = np.where(found >= 0, (n1 * level.discounts[0] + n2 * level.discounts[1] + n3 * level.discounts[2]) / np.maximum(total, 1), 1.0)
        total = np.maximum(total, 1)[inverse]
        distinct, at = np.unique(_ngram_key(own), return_inverse=True)
        counts = level.grams.find(distinct, 1)[1][0][at]
        p = discounted(level, counts) / total + back[inverse] * p
    return p


def score(model: Model, docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Score every text: ``keep`` columns plus n_tokens, n_known, train_tokens,
    base_score, score (log10 probability) and perplexity."""
    schema = [*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields],
              "n_tokens long", "n_known long", "train_tokens long", "base_score double", "score double", "perplexity double"]

    def run(batches):
        for b in batches:
            for i, j, tokens, begins in _token_slices(b.column(len(keep)), SCORE_SLICE):
                ids, counts = _vocabulary_ids(model.vocabulary, tokens)
                base = np.log10((counts + 1) / (model.train_tokens + model.vocabulary.size + 1))
                logs, at = np.log10(_probabilities(model, ids, begins)), begins[:-1]
                n, total = np.diff(begins), np.add.reduceat(logs, at)
                yield batch([*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                            [*[b.column(c).slice(i, j - i) for c in range(len(keep))], n,
                             np.add.reduceat((ids >= 0).astype(np.int64), at), np.full(j - i, model.train_tokens),
                             np.add.reduceat(base, at), total, 10.0 ** np.minimum(-total / n, 300.0)])

    return positional(docs.select(*keep, text)).mapInArrow(run, ", ".join(schema))


def lm_scores(docs: DataFrame, held_out: Column, order: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on the rows that are not ``held_out`` and score all rows."""
    marked = docs.select(F.col(id_col), held_out.alias("held_out"), F.col(text))
    return score(train(marked.where(~F.col("held_out")), order, text), marked, [id_col, "held_out"], text)
