"""Pearson and Spearman correlation.

Integral columns use exact moments: with Σx, Σy, Σx², Σy², Σxy kept in
decimal(38,0), ``r = (nΣxy − ΣxΣy) / sqrt((nΣx² − (Σx)²)(nΣy² − (Σy)²))``
is computed with one cast per factor, so it does not depend on partitioning.
Other columns use Spark's ``corr``.  Pairs with a null are skipped
(pairwise-complete, as pandas).
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions.nullsafe import is_integral
from ledgerfold.operators.scan import running


def _scaled(n: Column, moment: Column) -> Column:
    """``n · moment`` as double: exact before the one cast if it has 38 digits,
    else the product of doubles."""
    return F.coalesce(F.try_multiply(n, moment).cast("double"), n.cast("double") * moment.cast("double"))


def corr_expr(x: Column, y: Column, exact: bool) -> Column:
    if not exact:
        return F.corr(x.cast("double"), y.cast("double"))
    both = x.isNotNull() & y.isNotNull()
    xd = F.when(both, x).cast("decimal(38,0)")
    yd = F.when(both, y).cast("decimal(38,0)")
    n = F.count(xd).cast("decimal(38,0)")

    def central(a, b, sum_a, sum_b):
        return F.try_subtract(F.try_multiply(n, F.try_sum(F.try_multiply(a, b))), F.try_multiply(sum_a, sum_b))

    sx, sy = F.try_sum(xd), F.try_sum(yd)
    sxy, sxx, syy = (central(a, b, s, t) for a, b, s, t in ((xd, yd, sx, sy), (xd, xd, sx, sx), (yd, yd, sy, sy)))
    r = F.try_divide(sxy.cast("double"), F.sqrt(sxx.cast("double")) * F.sqrt(syy.cast("double")))
    fits = sxy.isNotNull() & sxx.isNotNull() & syy.isNotNull()
    # moments beyond 38 digits: Spark's merged central moments
    return F.when(F.count(xd) > 1, F.when(fits, r).otherwise(F.corr(x.cast("double"), y.cast("double"))))


def _types(df):
    return {f.name: f.dataType for f in df.schema.fields}


def _exact(t, a, b, exact):
    """Exact moments for integral pairs unless ``exact=False`` (fast double
    path, e.g. on very large tables where last-bit reproducibility is not
    needed)."""
    return (exact is not False) and is_integral(t[a]) and is_integral(t[b])


PAIRS_PER_PASS = 256


def _pairwise(df: DataFrame, pairs: Sequence[tuple[str, str]], exact, names) -> DataFrame:
    """Long ``(names..., corr)`` rows for column pairs: one aggregation pass
    per chunk of ``PAIRS_PER_PASS`` pairs (a wide table has O(k²) pairs; one
    giant aggregate would not plan), the chunks unioned."""
    t = _types(df)
    out = None
    for start in range(0, len(pairs), PAIRS_PER_PASS):
        chunk = pairs[start:start + PAIRS_PER_PASS]
        wide = df.agg(*[corr_expr(F.col(a), F.col(b), _exact(t, a, b, exact)).alias(f"_r{i}")
                        for i, (a, b) in enumerate(chunk)])
        arr = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, ab)],
                                 F.col(f"_r{i}").alias("corr"))
                        for i, ab in enumerate(chunk)])
        part = wide.select(F.explode(arr).alias("kv")).select(*[f"kv.{n}" for n in names], "kv.corr")
        out = part if out is None else out.unionByName(part)
    return out


def corr_with_target(df: DataFrame, cols: Sequence[str], target: str,
                     exact: bool | None = None) -> DataFrame:
    """``(feature, corr)`` for every column against the target, by corr desc."""
    long = _pairwise(df, [(c, target) for c in cols], exact, ["feature", "_target"])
    return long.select("feature", "corr").orderBy(F.desc_nulls_last("corr"), "feature")


def top_abs_corr(df: DataFrame, cols: Sequence[str], target: str, k: int = 10,
                 exact: bool | None = None) -> DataFrame:
    """k strongest correlations by absolute value (a top-k report)."""
    c = corr_with_target(df, cols, target, exact)
    return (c.select("*", F.abs("corr").alias("abs_corr"))
            .orderBy(F.desc_nulls_last("abs_corr"), "feature").limit(k))


def corr_matrix(df: DataFrame, cols: Sequence[str], exact: bool | None = None) -> DataFrame:
    """Upper triangle (incl. diagonal) of the pairwise-complete matrix as
    long rows ``(a, b, corr)``: one aggregate up to ``PAIRS_PER_PASS`` pairs,
    blocked matrix products (``gram_matrix``) beyond, one scan either way."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    if len(pairs) > PAIRS_PER_PASS:
        return gram_matrix(df, cols, exact)
    return _pairwise(df, pairs, exact, ["a", "b"])


# -- wide tables: Gram matrices of values, squares and masks ----------------------------

LIMB = 18               # bits of a limb: products of two, added over BLOCK_ROWS rows, are exact in double
BLOCK_ROWS = 1 << 16
_MOMENTS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """Whole numbers as doubles in base 2^LIMB, the last limb signed."""
    out = []
    while len(out) < 3 and (np.abs(x) >> LIMB).any():
        out.append((x & ((1 << LIMB) - 1)).astype(float))
        x = x >> LIMB
    return [*out, x.astype(float)]


class _Products:
    """Sums of products over rows: exact integers as one int64 matrix for each
    power of 2^LIMB, other numbers as doubles."""

    def __init__(self):
        self.parts: dict[int, np.ndarray] = {}

    def add(self, one: list[np.ndarray], two: list[np.ndarray]) -> None:
        for i, a in enumerate(one):
            for j, b in enumerate(two):
                m = (a.T @ b).astype(np.int64)
                self.parts[i + j] = self.parts.get(i + j, 0) + m

    def total(self) -> np.ndarray:
        return sum((m.astype(object) << (LIMB * power) for power, m in self.parts.items()), 0)


def _moments(batches, whole: list[bool], centre: list):
    """Rows (a, b, exact or not, n, sx, sy, sxx, syy, sxy) of a task's rows; x
    and y are the values less the column's centre, where both are there."""
    k = len(whole)
    ints, floats = np.flatnonzero(whole), np.flatnonzero(~np.array(whole))
    sums = {name: _Products() for name in ("n", "s", "ss", "xy")}
    real = {name: np.zeros((k, k)) for name in ("s", "ss", "xy")}
    seen = 0

    def rows():
        n = np.asarray(sums["n"].total())
        exact = {name: np.asarray(sums[name].total()) for name in ("s", "ss", "xy")} if len(ints) else {}
        place = {c: i for i, c in enumerate(ints.tolist())}
        out = []
        for a in range(k):
            for b in range(a, k):
                both = whole[a] and whole[b]
                if both:
                    i, j = place[a], place[b]
                    values = [exact["s"][i, b], exact["s"][j, a], exact["ss"][i, b], exact["ss"][j, a], exact["xy"][i, j]]
                else:
                    values = [real["s"][a, b], real["s"][b, a], real["ss"][a, b], real["ss"][b, a], real["xy"][a, b]]
                out.append((a, b, int(n[a, b]), *([Decimal(int(v)) for v in values] if both else [None] * 5), *([None] * 5 if both else map(float, values))))
        names = ["a", "b", "n", *[f"{m}_exact" for m in _MOMENTS[1:]], *_MOMENTS[1:]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.decimal128(38, 0)] * 5, *[pa.float64()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    for item in batches:
        for at in range(0, item.num_rows, BLOCK_ROWS):
            part = item.slice(at, BLOCK_ROWS)
            mask = np.stack([np.asarray(part.column(c).is_valid()) for c in range(k)], axis=1).astype(float)
            values = np.zeros((part.num_rows, k))
            sums["n"].add([mask], [mask])
            if len(ints):
                x = np.stack([np.asarray(part.column(c).fill_null(0)) - centre[c] for c in ints.tolist()], axis=1)
                x = np.where(mask[:, ints] > 0, x, 0)
                limbs = _limbs(x)
                sums["s"].add(limbs, [mask])
                sums["xy"].add(limbs, limbs)
                for i, p in enumerate(limbs):
                    for j, q in enumerate(limbs):
                        m = ((p * q).T @ mask).astype(np.int64)
                        sums["ss"].parts[i + j] = sums["ss"].parts.get(i + j, 0) + m
                values[:, ints] = x
            for c in floats.tolist():
                own = np.asarray(part.column(c).fill_null(0.0)) - centre[c]
                values[:, c] = np.where(mask[:, c] > 0, own, 0.0)
            if len(floats):
                real["s"] += values.T @ mask
                real["ss"] += (values * values).T @ mask
                real["xy"] += values.T @ values
            seen += 1
            if seen % 512 == 0:         # int64 sums of blocks stay exact
                yield rows()
                for p in sums.values():
                    p.parts.clear()
                for m in real.values():
                    m[:] = 0
    if seen % 512:
        yield rows()


def gram_matrix(df: DataFrame, cols: Sequence[str], exact: bool | None = None) -> DataFrame:
    """``corr_matrix`` of any number of columns in one scan, after a narrow one
    for the columns' means.  Each task multiplies blocks of rows -- values,
    squares and masks, less the column's mean -- into its pairs' moments; Spark
    adds the tasks' moments.  Whole numbers are exact: they are cut into limbs
    whose products a block adds without rounding."""
    cols, t = list(cols), _types(df)
    whole = [exact is not False and is_integral(t[c]) for c in cols]
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    centre = [(int(m) if w else float(m)) if m is not None else 0 for m, w in zip(means, whole, strict=True)]
    values = df.select(*[F.col(c).cast("bigint" if w else "double").alias(f"x{i}") for i, (c, w) in enumerate(zip(cols, whole, strict=True))])
    kinds = ", ".join(["a int", "b int", "n long", *[f"{m}_exact decimal(38,0)" for m in _MOMENTS[1:]], *[f"{m} double" for m in _MOMENTS[1:]]])
    parts = values.mapInArrow(lambda batches: _moments(batches, whole, centre), kinds)
    sums = parts.groupBy("a", "b").agg(F.sum("n").alias("n"), *[F.try_sum(f"{m}_exact").alias(f"{m}_exact") for m in _MOMENTS[1:]],
                                       *[F.sum(m).alias(m) for m in _MOMENTS[1:]])
    n = F.col("n").cast("decimal(38,0)")

    def central(m, one, two):
        whole_ = F.try_subtract(F.try_multiply(n, F.col(f"{m}_exact")), F.try_multiply(F.col(f"{one}_exact"), F.col(f"{two}_exact"))).cast("double")
        size = n.cast("double")
        far = size * F.col(f"{m}_exact").cast("double") - F.col(f"{one}_exact").cast("double") * F.col(f"{two}_exact").cast("double")
        return F.coalesce(whole_, far, size * F.col(m) - F.col(one) * F.col(two))

    r = F.try_divide(central("sxy", "sx", "sy"), F.sqrt(central("sxx", "sx", "sx")) * F.sqrt(central("syy", "sy", "sy")))
    names = F.split(F.lit("\x00".join(cols)), "\x00")
    return sums.select(F.get(names, F.col("a")).alias("a"), F.get(names, F.col("b")).alias("b"), F.when(n > 1, r).alias("corr"))


def average_rank(counts: DataFrame, col: str, count: str, out: str,
                 n_buckets: int | None = None) -> DataFrame:
    """Centred average rank of each distinct ``col`` of a table of counts:
    twice the rank less ``n + 1`` (ranks are 1-based, ties share the mean of
    their positions, like ``rank(method='average')``).  Centred ranks add up to
    0 and are whole numbers."""
    margin = counts.groupBy(col).agg(F.sum(count).alias("_m"))
    r = running(margin, col, ["_m"], inclusive=False, n_buckets=n_buckets, prefix="_below", total_prefix="_all")
    # mean of positions below+1 .. below+m is below + (m + 1) / 2; the mean of all is (n + 1) / 2
    return r.select(col, (2 * F.col("_below_m") + F.col("_m") - F.col("_all_m")).alias(out))


def spearman_of_counts(counts: DataFrame, x: str, y: str, count: str = "_c") -> DataFrame:
    """Spearman rank correlation of rows ``(x, y, how often)``: Pearson of the
    centred ranks.  Their sums are 0, so no moment exceeds ``n^3``: exact up to
    some 10^12 rows."""
    rx = average_rank(counts, x, count, "_rx").withColumnRenamed(x, "_vx")
    ry = average_rank(counts, y, count, "_ry").withColumnRenamed(y, "_vy")
    # both sides of a join hold a value once or a pair once, so no value is hot beyond its distinct partners
    d = counts.join(rx, F.col(x) == F.col("_vx")).join(ry, F.col(y) == F.col("_vy"))
    c, a, b = (F.col(v).cast("decimal(38,0)") for v in (count, "_rx", "_ry"))
    d = d.agg(F.sum(count).cast("decimal(38,0)").alias("_n"), F.count(F.lit(1)).alias("_pairs"),
              *[F.try_sum(F.try_multiply(c, F.try_multiply(p, q))).alias(m) for m, p, q in (("_xy", a, b), ("_xx", a, a), ("_yy", b, b))])
    n = F.col("_n")
    r = F.try_divide(_scaled(n, F.col("_xy")), F.sqrt(_scaled(n, F.col("_xx"))) * F.sqrt(_scaled(n, F.col("_yy"))))
    return d.select(F.when(n > 1, r).alias("spearman"), F.coalesce(n.cast("bigint"), F.lit(0).cast("bigint")).alias("n"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman rank correlation (pairs with a null are dropped first), from
    the counts of distinct pairs."""
    d = (df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
         .groupBy(F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_c")))
    return spearman_of_counts(d, "_x", "_y")
