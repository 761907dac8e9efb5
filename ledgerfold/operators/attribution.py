"""Per-row feature attributions for Spark tree ensembles (Tree SHAP).

The fitted ensemble's node table (a bounded object: trees × 2^(depth+1)
nodes, checked) is broadcast once; ``mapInPandas`` walks each row through
the exact path-dependent Tree SHAP recursion (Lundberg, Erion & Lee, 2018)
and emits long rows ``(key, feature, value, importance)``.  Ranking the
top-n per row is then ordinary DataFrame work.

Scales: gradient-boosted trees are explained in log-odds (Spark's GBT
probability is ``1/(1+exp(-2·F))``, so attributions are those of ``2·F``);
random forests in probability of class 1.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_NODES = 2_000_000


class Tree:

    __slots__ = ("left", "right", "feature", "threshold", "value", "cover", "depth")

    def __init__(self, left, right, feature, threshold, value, cover):
        self.left, self.right, self.feature = left, right, feature
        self.threshold, self.value, self.cover = threshold, value, cover
        self.depth = self._depth()

    def _depth(self) -> int:
        best, stack = 0, [(0, 0)]
        while stack:
            j, dep = stack.pop()
            best = max(best, dep)
            if self.left[j] >= 0:
                stack += [(self.left[j], dep + 1), (self.right[j], dep + 1)]
        return best

    def expected(self) -> float:
        leaves = self.left < 0
        return float(np.sum(self.value[leaves] * self.cover[leaves]) / self.cover[0])

    def predict(self, x) -> float:
        j = 0
        while self.left[j] >= 0:
            j = self.left[j] if x[self.feature[j]] <= self.threshold[j] else self.right[j]
        return float(self.value[j])


def collect_ensemble(nodes: DataFrame, kind: str, weights: Sequence[float]) -> list[tuple[float, Tree]]:
    """Bring a node table to the driver after proving its size bound."""
    n = nodes.limit(MAX_NODES + 1).count()
    if n > MAX_NODES:
        raise ValueError(f"ensemble has more than {MAX_NODES} nodes; not broadcast")
    return trees_from_nodes(nodes.toPandas(), kind, weights)


def trees_from_nodes(nodes: pd.DataFrame, kind: str, weights: Sequence[float]) -> list[tuple[float, Tree]]:
    """Node table (pandas, one tree per treeID) -> [(scale, Tree)]."""
    if len(nodes) > MAX_NODES:
        raise ValueError("ensemble too large to broadcast")
    out = []
    for t, g in nodes.groupby("treeID", sort=True):
        g = g.sort_values("id")
        n = int(g["id"].max()) + 1
        left = np.full(n, -1, np.int64)
        right = np.full(n, -1, np.int64)
        feat = np.zeros(n, np.int64)
        thr = np.zeros(n)
        val = np.zeros(n)
        cov = np.zeros(n)
        for r in g.itertuples(index=False):
            i = int(r.id)
            left[i], right[i] = int(r.leftChild), int(r.rightChild)
            feat[i] = int(r.featureIndex) if r.leftChild >= 0 else 0
            thr[i] = float(r.threshold) if r.leftChild >= 0 else 0.0
            if kind == "rf":
                stats = np.asarray(r.impurityStats, float)
                val[i] = stats[1] / stats.sum() if stats.sum() > 0 else 0.0
            else:
                val[i] = float(r.prediction)
            cov[i] = float(r.rawCount)
        w = float(weights[int(t)])
        scale = 2.0 * w if kind == "gbt" else w / len(weights)
        out.append((scale, Tree(left, right, feat, thr, val, cov)))
    return out


# -- path-dependent Tree SHAP --------------------------------------------------------

def _extend(d, z, o, w, depth, pz, po, pi):
    d[depth], z[depth], o[depth] = pi, pz, po
    w[depth] = 1.0 if depth == 0 else 0.0
    for i in range(depth - 1, -1, -1):
        w[i + 1] += po * w[i] * (i + 1) / (depth + 1)
        w[i] = pz * w[i] * (depth - i) / (depth + 1)


def _unwind(d, z, o, w, depth, k):
    one, zero = o[k], z[k]
    nxt = w[depth]
    for i in range(depth - 1, -1, -1):
        if one != 0:
            tmp = w[i]
            w[i] = nxt * (depth + 1) / ((i + 1) * one)
            nxt = tmp - w[i] * zero * (depth - i) / (depth + 1)
        else:
            w[i] = w[i] * (depth + 1) / (zero * (depth - i))
    for i in range(k, depth):
        d[i], z[i], o[i] = d[i + 1], z[i + 1], o[i + 1]


def _unwound_sum(z, o, w, depth, k):
    one, zero = o[k], z[k]
    nxt = w[depth]
    total = 0.0
    if one != 0:
        for i in range(depth - 1, -1, -1):
            tmp = nxt / ((i + 1) * one)
            total += tmp
            nxt = w[i] - tmp * zero * (depth - i)
    else:
        for i in range(depth - 1, -1, -1):
            total += w[i] / (zero * (depth - i))
    return total * (depth + 1)


def tree_shap(tree: Tree, x, phi, scale: float) -> None:
    """Add ``scale ×`` the Shapley values of one tree at ``x`` into ``phi``."""
    max_d = 64

    def rec(j, d, z, o, w, depth, pz, po, pi):
        d, z, o, w = d.copy(), z.copy(), o.copy(), w.copy()
        _extend(d, z, o, w, depth, pz, po, pi)
        if tree.left[j] < 0:
            for i in range(1, depth + 1):
                s = _unwound_sum(z, o, w, depth, i)
                phi[d[i]] += scale * s * (o[i] - z[i]) * tree.value[j]
            return
        f = tree.feature[j]
        hot, cold = ((tree.left[j], tree.right[j]) if x[f] <= tree.threshold[j]
                     else (tree.right[j], tree.left[j]))
        iz = io = 1.0
        k = next((i for i in range(1, depth + 1) if d[i] == f), None)
        if k is not None:
            iz, io = z[k], o[k]
            _unwind(d, z, o, w, depth, k)
            depth -= 1
        c = tree.cover[j]
        rec(hot, d, z, o, w, depth + 1, iz * tree.cover[hot] / c, io, f)
        rec(cold, d, z, o, w, depth + 1, iz * tree.cover[cold] / c, 0.0, f)

    d = np.zeros(max_d, np.int64)
    z = np.zeros(max_d)
    o = np.zeros(max_d)
    w = np.zeros(max_d)
    rec(0, d, z, o, w, 0, 1.0, 1.0, -1)


# -- the same recursion, vectorised over the rows of a batch -------------------------
#
# Every row visits every node (hot and cold children are both followed), and
# the sequence of split features on the path is the same for all rows; only
# the zero/one fractions differ.  So the path state becomes ``rows × depth``
# arrays, per-row branches become ``np.where``, and one pass over the tree
# explains a whole Arrow batch.

def _extend_v(d, z, o, w, depth, pz, po, pi):
    d[depth] = pi
    z[:, depth], o[:, depth] = pz, po
    w[:, depth] = 1.0 if depth == 0 else 0.0
    for i in range(depth - 1, -1, -1):
        w[:, i + 1] += po * w[:, i] * (i + 1) / (depth + 1)
        w[:, i] = pz * w[:, i] * (depth - i) / (depth + 1)


def _unwind_v(d, z, o, w, depth, k):
    one, zero = o[:, k].copy(), z[:, k].copy()
    has_one = one != 0
    safe_one = np.where(has_one, one, 1.0)
    safe_zero = np.where(zero != 0, zero, 1.0)
    nxt = w[:, depth].copy()
    for i in range(depth - 1, -1, -1):
        wa = nxt * (depth + 1) / ((i + 1) * safe_one)
        nxt_a = w[:, i] - wa * zero * (depth - i) / (depth + 1)
        wb = w[:, i] * (depth + 1) / (safe_zero * (depth - i))
        w[:, i] = np.where(has_one, wa, wb)
        nxt = np.where(has_one, nxt_a, nxt)
    for i in range(k, depth):
        d[i] = d[i + 1]
        z[:, i], o[:, i] = z[:, i + 1], o[:, i + 1]


def _unwound_sum_v(z, o, w, depth, k):
    one, zero = o[:, k], z[:, k]
    has_one = one != 0
    safe_one = np.where(has_one, one, 1.0)
    safe_zero = np.where(zero != 0, zero, 1.0)
    nxt = w[:, depth].copy()
    tot_a = np.zeros(len(one))
    tot_b = np.zeros(len(one))
    for i in range(depth - 1, -1, -1):
        tmp = nxt / ((i + 1) * safe_one)
        tot_a += tmp
        nxt = w[:, i] - tmp * zero * (depth - i)
        tot_b += w[:, i] / (safe_zero * (depth - i))
    return np.where(has_one, tot_a, tot_b) * (depth + 1)


def tree_shap_batch(tree: Tree, X: np.ndarray, phi: np.ndarray, scale: float) -> None:
    """Add ``scale ×`` the Shapley values of one tree for every row of ``X``."""
    n = X.shape[0]
    max_d = tree.depth + 2  # path length never exceeds the tree depth + 1

    def rec(j, d, z, o, w, depth, pz, po, pi):
        d, z, o, w = d.copy(), z.copy(), o.copy(), w.copy()
        _extend_v(d, z, o, w, depth, pz, po, pi)
        if tree.left[j] < 0:
            for i in range(1, depth + 1):
                s = _unwound_sum_v(z, o, w, depth, i)
                phi[:, d[i]] += scale * s * (o[:, i] - z[:, i]) * tree.value[j]
            return
        f = tree.feature[j]
        goes_left = X[:, f] <= tree.threshold[j]
        iz = np.ones(n)
        io = np.ones(n)
        k = next((i for i in range(1, depth + 1) if d[i] == f), None)
        if k is not None:
            iz, io = z[:, k].copy(), o[:, k].copy()
            _unwind_v(d, z, o, w, depth, k)
            depth -= 1
        c = tree.cover[j]
        left, right = tree.left[j], tree.right[j]
        rec(left, d, z, o, w, depth + 1, iz * tree.cover[left] / c, np.where(goes_left, io, 0.0), f)
        rec(right, d, z, o, w, depth + 1, iz * tree.cover[right] / c, np.where(goes_left, 0.0, io), f)

    d = np.zeros(max_d, np.int64)
    z = np.zeros((n, max_d))
    o = np.zeros((n, max_d))
    w = np.zeros((n, max_d))
    rec(0, d, z, o, w, 0, np.ones(n), np.ones(n), -1)


# -- the same values from tables per leaf ----------------------------------------------
#
# A row's share in a leaf depends only on which of the path's features let it
# pass: d features, 2^d patterns.  The recursion runs over the patterns of all
# leaves of a tree at once; a row then costs a look-up a leaf and feature, however
# many rows there are.

TABLE_FEATURES = 10     # features of a path with a table of patterns; deeper trees take the recursion
BLOCK_ROWS = 1 << 16    # rows explained together
OUT_ROWS = 10000        # rows whose attributions are handed on together


def _leaf_paths(tree: Tree):
    """(leaf, features in order of first use, their zero fractions) of each leaf."""
    stack = [(0, [], [])]
    while stack:
        j, feats, zero = stack.pop()
        if tree.left[j] < 0:
            yield j, feats, zero
            continue
        f = int(tree.feature[j])
        at = feats.index(f) if f in feats else len(feats)
        own = feats if at < len(feats) else [*feats, f]
        for child in (tree.left[j], tree.right[j]):
            z = [*zero, 1.0] if at == len(zero) else list(zero)
            z[at] *= tree.cover[child] / tree.cover[j]
            stack.append((int(child), own, z))


def leaf_tables(tree: Tree, scale: float) -> dict[int, np.ndarray]:
    """Per leaf the contribution of each of its path's features (rows) for each
    pattern of passed features (columns; bit i: the i-th feature lets pass)."""
    by_depth: dict[int, list[tuple[int, list]]] = {}
    for leaf, feats, zero in _leaf_paths(tree):
        by_depth.setdefault(len(feats), []).append((leaf, zero))
    out = {}
    for depth, leaves in by_depth.items():
        codes = np.tile(np.arange(1 << depth), len(leaves))
        zeros = np.repeat(np.array([z for _, z in leaves]).reshape(len(leaves), depth), 1 << depth, axis=0)
        n = len(codes)
        d, z, o, w = np.zeros(depth + 1, np.int64), *(np.zeros((n, depth + 1), order="F") for _ in range(3))
        _extend_v(d, z, o, w, 0, np.ones(n), np.ones(n), -1)
        for i in range(depth):
            _extend_v(d, z, o, w, i + 1, zeros[:, i], (codes >> i & 1).astype(float), i)
        value = scale * np.repeat(tree.value[[leaf for leaf, _ in leaves]], 1 << depth)
        parts = np.array([_unwound_sum_v(z, o, w, depth, i) * (o[:, i] - z[:, i]) * value for i in range(1, depth + 1)]).reshape(depth, len(leaves), 1 << depth)
        for i, (leaf, _) in enumerate(leaves):
            out[leaf] = parts[:, i]
    return out


def tree_shap_tables(tree: Tree, X: np.ndarray, phi: np.ndarray, scale: float) -> None:
    """``tree_shap_batch`` by look-up."""
    tables = leaf_tables(tree, scale)

    def rec(j, feats, code):
        if tree.left[j] < 0:
            for f, column in zip(feats, tables[j], strict=True):
                phi[:, f] += column[code]
            return
        f = int(tree.feature[j])
        goes_left = X[:, f] <= tree.threshold[j]
        at = feats.index(f) if f in feats else len(feats)
        own = feats if at < len(feats) else [*feats, f]
        before = code if at < len(feats) else code | np.int64(1 << at)
        rec(tree.left[j], own, np.where(goes_left, before, before & ~np.int64(1 << at)))
        rec(tree.right[j], own, np.where(goes_left, before & ~np.int64(1 << at), before))

    rec(0, [], np.zeros(len(X), np.int64))


def explain_rows(ensemble: list[tuple[float, Tree]], X: np.ndarray,
                 vectorised: bool = True) -> tuple[np.ndarray, float]:
    """(phi matrix rows × features, expected value) for a batch."""
    phi = np.zeros(X.shape, order="F")
    if vectorised:
        X = np.asfortranarray(X)
        for scale, tree in ensemble:
            # patterns must not outnumber rows by far, nor covers be empty
            if tree.depth <= TABLE_FEATURES and len(X) > tree.depth ** 2 and tree.cover[tree.left < 0].all():
                tree_shap_tables(tree, X, phi, scale)
            else:
                tree_shap_batch(tree, X, phi, scale)
    else:
        for r in range(X.shape[0]):
            for scale, tree in ensemble:
                tree_shap(tree, X[r], phi[r], scale)
    base = float(sum(scale * t.expected() for scale, t in ensemble))
    return phi, base


def _plain(ensemble: list[tuple[float, Tree]]) -> list[tuple]:
    """The ensemble as plain tuples of numpy arrays (broadcast with plain
    pickle, so executors need not import this package)."""
    return [(scale, t.left, t.right, t.feature, t.threshold, t.value, t.cover)
            for scale, t in ensemble]


def _from_plain(plain: list[tuple]) -> list[tuple[float, Tree]]:
    return [(p[0], Tree(*p[1:])) for p in plain]


def shap_long(df: DataFrame, key: str, features_col: str, ensemble: list[tuple[float, Tree]],
              feature_names: Sequence[str]) -> DataFrame:
    """Long attributions ``(key, feature, value, importance)`` plus one
    ``__base__`` row per key holding the expected value.

    The functions of this module travel to executors by value (cloudpickle)
    and the ensemble as plain arrays, so executors need only numpy/pandas,
    not this package installed."""
    import sys
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast(_plain(ensemble))
    names = list(feature_names)
    src = df.select(F.col(key).cast("long").alias("key"),
                    vector_to_array(F.col(features_col)).alias("x"))

    def blocks(batches):
        # a tree's tables are made once a block
        held, size = [], 0
        for pdf in batches:
            held, size = [*held, pdf], size + len(pdf)
            if size >= BLOCK_ROWS:
                yield pd.concat(held)
                held, size = [], 0
        if size:
            yield pd.concat(held)

    def run(batches):
        ens = _from_plain(bc.value)
        for pdf in blocks(batches):
            X = np.vstack(pdf["x"].to_numpy())
            phi, base = explain_rows(ens, X)
            keys = pdf["key"].to_numpy()
            for i in range(0, len(keys), OUT_ROWS):
                own, vals = keys[i:i + OUT_ROWS], phi[i:i + OUT_ROWS].reshape(-1)
                yield pd.DataFrame({"key": np.repeat(own, X.shape[1]), "feature": np.tile(np.array(names, dtype=object), len(own)),
                                    "value": vals, "importance": np.abs(vals)})
                yield pd.DataFrame({"key": own, "feature": "__base__",
                                    "value": base, "importance": 0.0})

    out = src.mapInPandas(run, "key long, feature string, value double, importance double")
    return out.withColumnRenamed("key", key)
