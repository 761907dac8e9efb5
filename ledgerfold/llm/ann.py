"""Nearest neighbours by largest inner product, as a block matrix join.

Vectors are dealt to data groups and the query rows to query groups (by a hash
of their id, group sizes bounded by ``tile``).  Each query group meets each
data group in one task.  There, int8 copies of both sides give a tile of
products; with the exact norms of what quantisation left over, each product
bounds the true inner product from both sides.  Vectors whose upper bound does
not reach the query's k-th best lower bound are dropped; the others are
computed again in double precision from the original vectors.  Each tile keeps
its k nearest a query, and the tiles' lists are merged by heaps.  The result is
exact: the bounds hold for every pair.

Equal vectors are multiplied once a tile: of a set of equal vectors only the
k+1 smallest ids can be among a query's k nearest (one may be the query itself),
so a vector that a third of the rows share costs one row of the tile.

Defined results: vectors that are null, zero, empty or hold null or non-finite
components take no part, nor do null ids; vectors are compared only with
vectors of the same length.  A repeated id is a row like any other, except that
rows with the query's own id are never its candidates; of repeated query rows
each distinct vector is searched and the best k of the id are returned.
"""

from __future__ import annotations

import heapq
import math
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP = "query_id long, ids array<long>, scores array<double>"


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, dtype=np.float64).reshape(table.num_rows, -1)


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, norms of the quantised rows and of the rest."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    near = q * scale[:, None]
    return q, scale, np.sqrt((near ** 2).sum(axis=1)), np.sqrt(((x - near) ** 2).sum(axis=1))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact int8 products: single precision holds sums of 1024 of them."""
    out = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], 1024):
        out += a[:, i:i + 1024].astype(np.float32) @ b[:, i:i + 1024].astype(np.float32).T
    return out


def nearest_in_tile(query_ids, queries, ids, vectors, k: int, rows: int = 64):
    """For each query row the k nearest of ``vectors``: (ids, scores) lists."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
    _, first, inverse = np.unique(vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_index=True, return_inverse=True)
    by_class = np.argsort(inverse, kind="stable")
    starts = np.searchsorted(inverse[by_class], np.arange(len(first) + 1))
    distinct = vectors[first]
    q8, q_scale, q_near, q_rest = _quantised(queries)
    v8, v_scale, v_near, v_rest = _quantised(distinct)
    sizes = np.diff(starts)
    out = []
    for i in range(0, len(queries), rows):
        part = slice(i, i + rows)
        mid = _product(q8[part], v8) * q_scale[part, None] * v_scale
        # q.v = q'.v' + q'.(v-v') + (q-q').v' + (q-q').(v-v'), primes quantised
        err = q_near[part, None] * v_rest + q_rest[part, None] * (v_near + v_rest)
        err += 1e-12 * (q_near[part, None] + q_rest[part, None]) * (v_near + v_rest)
        low, high = mid - err, mid + err
        # k + 1 vectors of other classes or of one class suffice, the query's own row may be among them
        if len(distinct) > k + 1:
            bar = np.partition(low, len(distinct) - (k + 1), axis=1)[:, len(distinct) - (k + 1)]
        else:
            bar = np.full(len(low), -np.inf)
        for r in range(len(low)):
            live = np.flatnonzero(high[r] >= bar[r])
            # summed in order, so equal vectors have equal scores wherever they lie
            score = (distinct[live] * queries[i + r]).cumsum(axis=1)[:, -1]
            found = []
            best = np.lexsort((ids[by_class[starts[live]]], -score))
            # classes of equal score are merged by id; stop when k candidates of better score are in
            at = 0
            while at < len(best) and len(found) < k:
                same = at
                while same < len(best) and score[best[same]] == score[best[at]]:
                    same += 1
                members = [ids[by_class[starts[c]:starts[c] + min(sizes[c], k + 1)]] for c in live[best[at:same]]]
                members = np.sort(np.concatenate(members))
                members = members[members != query_ids[i + r]][:k - len(found)]
                found += [(int(m), float(score[best[at]])) for m in members]
                at = same
            out.append(([m for m, _ in found], [s for _, s in found]))
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, tile: int = 16384,
            id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Each query row's k nearest other rows: query_id, rank, id, score."""
    usable = (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec).alias("vec"), is_query.alias("is_query"))
              .where("id is not null and vec is not null")
              .where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0))
              .withColumn("dim", F.size("vec")))
    n, queries = usable.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    groups, query_groups = max(1, math.ceil(n / tile)), max(1, math.ceil(queries / tile))
    # small tables: more, smaller data groups, so that all cores have a tile
    groups = max(groups, min(12, math.ceil(n / 1024)))

    def dealt(count: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")

    # the query side of a pair of groups is tagged so that one grouping sees both
    data = (usable.withColumn("g", dealt(groups)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_groups - 1))))
            .select("dim", "g", "q", F.lit(False).alias("asks"), "id", "vec"))
    asks = (usable.where("is_query").withColumn("q", dealt(query_groups)).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
            .select("dim", "g", "q", F.lit(True).alias("asks"), "id", "vec"))

    def run(cell: pa.Table) -> pa.Table:
        mask = cell["asks"]
        ask, own = cell.filter(mask), cell.filter(pa.compute.invert(mask))
        if not ask.num_rows or not own.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "scores": pa.array([], pa.list_(pa.float64()))})
        query_ids = ask["id"].to_numpy()
        found = nearest_in_tile(query_ids, _matrix(ask), own["id"].to_numpy(), _matrix(own), k)
        return pa.table({"query_id": query_ids, "ids": pa.array([f[0] for f in found], pa.list_(pa.int64())), "scores": pa.array([f[1] for f in found], pa.list_(pa.float64()))})

    tiles = data.union(asks).groupBy("dim", "g", "q").applyInArrow(run, TOP)

    def merge(lists: pa.Table) -> pa.Table:
        streams = [[(-s, i) for i, s in zip(x, y, strict=True)] for x, y in zip(lists["ids"].to_pylist(), lists["scores"].to_pylist(), strict=True)]
        best = list(islice(heapq.merge(*streams), k))
        return pa.table({"query_id": pa.array([lists["query_id"][0].as_py()] * len(best), pa.int64()), "rank": pa.array(range(1, len(best) + 1), pa.int32()),
                         id_col: pa.array([i for _, i in best], pa.int64()), "score": pa.array([-s for s, _ in best], pa.float64())})

    return tiles.groupBy("query_id").applyInArrow(merge, f"query_id long, rank int, `{id_col}` long, score double")
