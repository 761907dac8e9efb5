"""Quality classifier: a factorisation machine over hashed words, structure
statistics and metadata.

A text's features are its distinct words (hashed, log frequency, scaled to unit
length), binned structure statistics (shares of character kinds, repetition,
word and line lengths) and binned numeric metadata columns.  The score is

    logistic(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

so all pairwise interactions are scored in time linear in the features.

Fitting uses at most ``max_fit_rows`` labelled rows (those with the smallest
hash of their id; a documented bound, the only one).  Their features are made
in Spark and the machine (``2**bits`` weights and factors, a fixed size) is
fitted on the driver by Adagrad and broadcast.  Scoring covers every row and
every text in full.

Defined results: null text counts as empty; an empty text has its statistics'
lowest bins and gets a score like any other.  Null metadata is a bin of its
own.  Labels that are null take no part; a document with several labels is fitted
with each.  With no labelled rows the score is 0.5 for all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.common import batch, positional
from ledgerfold.llm.textkernel import mix, slices, u64, utf8, words_of

BINS = 12


def _bytes_in(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


KINDS = {
    "upper": _bytes_in(bytes(range(65, 91))),
    "digit": _bytes_in(b"0123456789"),
    "space": _bytes_in(b" \t"),
    "line": _bytes_in(b"\n"),
    "stop": _bytes_in(b".,;:"),
    "shout": _bytes_in(b"!?"),
    "symbol": _bytes_in(b"#$%&*+/<=>@\\^_`{|}~"),
    "bracket": _bytes_in(b"()[]\"'"),
    "high": _bytes_in(bytes(range(128, 256))),
}


def _binned(value: np.ndarray) -> np.ndarray:
    """Bin of a statistic scaled to 0..1, finer near 0."""
    return np.clip((np.sqrt(np.clip(value, 0, 1)) * BINS).astype(np.int64), 0, BINS - 1)


def features(raw: np.ndarray, offsets: np.ndarray, metadata: list[np.ndarray], bits: int):
    """Sparse features of the texts: (first, index, value)."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(np.float64)
    stats = []
    for kind in KINDS.values():
        total = np.r_[0, np.cumsum(kind[raw], dtype=np.int64)]
        stats.append(np.diff(total[offsets]) / size)
    words = words_of(raw, offsets)
    count = np.diff(words.first)
    doc = np.repeat(np.arange(n), count)
    order = np.lexsort((words.hash, doc))
    d, h = doc[order], words.hash[order]
    new = np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])] if len(h) else np.empty(0, bool)
    at = np.flatnonzero(new)
    tf = np.diff(np.r_[at, len(h)])
    d, h = d[at], h[at]
    many = np.maximum(count, 1).astype(np.float64)
    distinct = np.bincount(d, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, d, tf)
    letters = np.r_[0, np.cumsum(words.end - words.start)]
    mean_length = np.diff(letters[words.first]) / many
    lines = np.diff(np.r_[0, np.cumsum(KINDS["line"][raw], dtype=np.int64)][offsets]) + 1
    repeat = np.zeros(len(words.hash), dtype=np.int64)
    repeat[1:] = (words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1])
    repeats = np.bincount(doc, weights=repeat, minlength=n) / many
    stats += [distinct / many, top / many, repeats, mean_length / 20, np.log1p(count) / 12, np.log1p(count / lines) / 8]
    fixed = [u64(0xABCD0000 + k * 64) + _binned(s).astype(np.uint64) for k, s in enumerate(stats)]
    for k, column in enumerate(metadata):
        known = np.isfinite(column)
        bin_ = np.where(known, _binned(np.log1p(np.abs(np.where(known, column, 0))) / 20), BINS)
        fixed.append(u64(0xEF010000 + k * 64) + bin_.astype(np.uint64))
    value = np.log1p(tf)
    norm = np.sqrt(np.bincount(d, weights=value ** 2, minlength=n))
    value = value / norm[d]
    index = np.concatenate([h, mix(np.stack(fixed)).ravel()])
    owner = np.concatenate([d, np.tile(np.arange(n), len(fixed))])
    value = np.concatenate([value, np.full(n * len(fixed), 1 / np.sqrt(len(fixed)))])
    order = np.argsort(owner, kind="stable")
    return np.searchsorted(owner[order], np.arange(n + 1)), (index[order] >> np.uint64(64 - bits)).astype(np.int64), value[order].astype(np.float32)


@dataclass
class Machine:
    bits: int
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def score(self, first: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        at = first[:-1]
        linear = np.add.reduceat(self.weight[index] * value, at).astype(np.float64)
        pair = np.zeros(len(at))
        for f in range(self.factor.shape[1]):
            vx = (self.factor[index, f] * value).astype(np.float64)
            pair += np.add.reduceat(vx, at) ** 2 - np.add.reduceat(vx ** 2, at)
        z = np.clip(self.bias + linear + pair / 2, -60, 60)
        return 1 / (1 + np.exp(-z))


def _slices(item: pa.RecordBatch, text_at: int, metadata_at: list[int], bits: int):
    raw, offsets = utf8(item.column(text_at))
    columns = [np.asarray(item.column(m).cast(pa.float64()).fill_null(float("nan"))) for m in metadata_at]
    for i, j in slices(offsets):
        yield i, j, features(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], [c[i:j] for c in columns], bits)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", metadata: list[str] = ("n_chars",), max_fit_rows: int = 8000,
        bits: int = 18, rank: int = 8, epochs: int = 6, rate: float = 0.1, decay: float = 1e-6,
        id_col: str = "doc_id", text: str = "text") -> Machine:
    """Fit on ``labels`` (id, label); at most ``max_fit_rows`` rows."""
    metadata = list(metadata)
    chosen = (labels.select(id_col, F.col(label).cast("int").alias("_label")).where("_label is not null")
              .orderBy(F.xxhash64(id_col), id_col, "_label").limit(max_fit_rows))
    rows = docs.select(id_col, text, *metadata).join(F.broadcast(chosen), id_col).select(text, *metadata, "_label")

    def run(batches):
        for item in batches:
            y = item.column(1 + len(metadata)).to_numpy(zero_copy_only=False)
            for i, j, (first, index, value) in _slices(item, 0, [*range(1, 1 + len(metadata))], bits):
                yield batch(["y", "index", "value"], [pa.array(y[i:j], pa.int32()),
                            pa.array([index[a:b].astype("<i4").tobytes() for a, b in zip(first, first[1:], strict=False)], pa.binary()),
                            pa.array([value[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)], pa.binary())])

    sample = sorted(rows.mapInArrow(run, "y int, index binary, value binary").collect())    # sorted: the fit is repeatable
    return train([(np.frombuffer(r["index"], "<i4"), np.frombuffer(r["value"], np.float32), r["y"]) for r in sample], bits, rank, epochs, rate, decay)


def train(sample: list[tuple[np.ndarray, np.ndarray, int]], bits: int, rank: int, epochs: int, rate: float, decay: float) -> Machine:
    """Adagrad on the logistic loss, in small batches."""
    rng = np.random.default_rng(7)
    size = 1 << bits
    w, v = np.zeros(size, np.float32), rng.normal(0, 0.02, (size, rank)).astype(np.float32)
    if not sample:
        return Machine(bits, 0.0, w, np.zeros_like(v))
    positive = np.mean([y for _, _, y in sample])
    bias, bias_square = float(np.log((positive + 1e-3) / (1 - positive + 1e-3))), 1.0
    w_square, v_square = np.full(size, 1.0, np.float32), np.full((size, rank), 1.0, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(sample))
        for i in range(0, len(order), 64):
            rows = [sample[r] for r in order[i:i + 64]]
            index, x = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
            lengths = np.array([len(r[0]) for r in rows])
            first = np.r_[0, np.cumsum(lengths)]
            y = np.array([r[2] for r in rows], np.float64)
            p = Machine(bits, bias, w, v).score(first, index, x)
            g = np.repeat((p - y).astype(np.float32), lengths)
            vx = v[index] * x[:, None]
            sums = np.repeat(np.add.reduceat(vx, first[:-1]), lengths, axis=0)
            gw, gv = g * x, (g * x)[:, None] * (sums - vx)
            used, inverse = np.unique(index, return_inverse=True)
            order_ = np.argsort(inverse, kind="stable")
            edges = np.searchsorted(inverse[order_], np.arange(len(used)))
            gw = np.add.reduceat(gw[order_], edges) + decay * w[used]
            gv = np.add.reduceat(gv[order_], edges) + decay * v[used]
            w_square[used] += gw ** 2
            v_square[used] += gv ** 2
            w[used] -= rate * gw / np.sqrt(w_square[used])
            v[used] -= rate * gv / np.sqrt(v_square[used])
            gb = float((p - y).sum())
            bias_square += gb * gb
            bias -= rate * gb / bias_square ** 0.5
    return Machine(bits, bias, w, v)


def score(docs: DataFrame, machine: Machine, keep: list[str], metadata: list[str] = ("n_chars",), text: str = "text") -> DataFrame:
    """``keep`` columns, score (0 to 1) and predicted (score >= 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    metadata = list(metadata)
    schema = [*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields], "score double", "predicted int"]

    def run(batches):
        for item in batches:
            at = len(keep)
            for i, j, sparse in _slices(item, at, [*range(at + 1, at + 1 + len(metadata))], shared.value.bits):
                p = shared.value.score(*sparse)
                yield batch([*keep, "score", "predicted"], [*[item.column(c).slice(i, j - i) for c in range(at)], p, (p >= 0.5).astype(np.int32)])

    return positional(docs.select(*keep, text, *metadata)).mapInArrow(run, ", ".join(schema))


def accepted(docs: DataFrame, machine: Machine, metadata: list[str] = ("n_chars",), text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more, with their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    names, at = docs.columns, len(docs.columns)

    def run(batches):
        for item in batches:
            columns = [*range(at + 1, at + 1 + len(metadata))]
            good = [shared.value.score(*sparse) >= 0.5 for _, _, sparse in _slices(item, at, columns, shared.value.bits)]
            if good:
                keep = pa.array(np.concatenate(good))
                yield batch(names, [item.column(c).filter(keep) for c in range(at)])

    return positional(docs.select(*names, text, *metadata)).mapInArrow(run, docs.schema)
