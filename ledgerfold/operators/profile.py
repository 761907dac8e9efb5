"""Data profiling: counts, moments, exact quantiles, histograms, KDE.

Exact quantiles are computed without holding a group's values in one task:
values are first reduced to ``(group, value, count)``, a bucketed running
count (``ledgerfold.operators.scan.running``) gives each distinct value its
rank interval, and the values at the two ranks around ``p·(n−1)`` are picked
by a partial-aggregating ``groupBy``.  Linear interpolation as pandas /
``quantile_cont``.  ``method="approx"`` uses ``percentile_approx`` instead.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerfold.functions.nullsafe import exact_mean, exact_var_samp, is_integral
from ledgerfold.operators.joins import DEFAULT_BROADCAST_ROWS, join_on
from ledgerfold.operators.scan import running


def _pname(p: float) -> str:
    s = f"{p:g}".replace("0.", "").replace(".", "_")
    return f"p{s}" if p not in (0.5,) else "median"


def mean_expr(x: Column, integral: bool) -> Column:
    return exact_mean(x) if integral else F.avg(x)


def var_expr(x: Column, integral: bool) -> Column:
    return exact_var_samp(x) if integral else F.var_samp(x)


def std_expr(x: Column, integral: bool) -> Column:
    return F.sqrt(var_expr(x, integral))


def quantiles(df: DataFrame, value: str, probs: Sequence[float],
              groups: Sequence[str] = (), names: Sequence[str] | None = None,
              method: str = "exact", n_buckets: int | None = None) -> DataFrame:
    """One row per group with one column per probability (nulls ignored)."""
    groups = list(groups)
    names = list(names) if names else [_pname(p) for p in probs]
    x = F.col(value)
    if method == "approx":
        return df.groupBy(*groups).agg(*[
            F.percentile_approx(x, F.lit(p), 10000).cast("double").alias(n)
            for p, n in zip(probs, names)])
    if method != "exact":
        raise ValueError("method must be 'exact' or 'approx'")
    dv = (df.where(x.isNotNull()).groupBy(*groups, value)
          .agg(F.count(F.lit(1)).alias("_c")))
    sized = running(dv, value, ["_c"], partition_cols=groups, inclusive=False,
                    n_buckets=n_buckets, prefix="_below", total_prefix="_all")
    return _pick(sized.withColumnRenamed("_all_c", "_n"), value, probs, names, groups)


def _pick(j: DataFrame, value: str, probs, names, groups) -> DataFrame:
    aggs = []
    below, cnt, n = F.col("_below_c"), F.col("_c"), F.col("_n")
    x = F.col(value).cast("double")
    for p, name in zip(probs, names):
        pos = (n - 1).cast("double") * F.lit(float(p))
        lo = F.floor(pos)
        hi = F.least(lo + 1, n - 1)
        frac = pos - lo
        at_lo = (below <= lo) & (lo < below + cnt)
        at_hi = (below <= hi) & (hi < below + cnt)
        aggs += [F.max(F.when(at_lo, x)).alias(f"_lo_{name}"),
                 F.max(F.when(at_hi, x)).alias(f"_hi_{name}"),
                 F.max(frac).alias(f"_fr_{name}")]
    a = j.groupBy(*groups).agg(*aggs)
    outs = []
    for name in names:
        lo, hi, fr = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_fr_{name}")
        outs.append((lo + (hi - lo) * fr).alias(name))
    return a.select(*groups, *outs)


# -- counts -----------------------------------------------------------------

def with_one_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row (the one-row
    side is broadcast: its size is fixed)."""
    return (df.withColumn("_one", F.lit(1))
            .join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one").drop("_one"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value (null is its own value), most frequent first."""
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc_nulls_last(col)))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows, positives, negatives, positive rate and negative:positive ratio."""
    y = F.col(label)
    n_pos, n_neg = F.count_if(y == 1), F.count_if(y == 0)
    return df.agg(
        F.count(F.lit(1)).alias("n"), n_pos.alias("n_pos"), n_neg.alias("n_neg"),
        F.try_divide(n_pos.cast("double"), F.count(y).cast("double")).alias("positive_rate"),
        F.try_divide(n_neg.cast("double"), n_pos.cast("double")).alias("imbalance_ratio"))


def sentinel_share(df: DataFrame, col: str, sentinel) -> DataFrame:
    hit = F.count_if(F.col(col) == F.lit(sentinel))
    return df.agg(hit.alias("n_sentinel"), F.count(F.lit(1)).alias("n"),
                  F.try_divide(hit.cast("double") * 100.0,
                               F.count(F.lit(1)).cast("double")).alias("pct_sentinel"))


# -- long-form statistics -----------------------------------------------------

def to_long(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (),
            value_type: str = "double") -> DataFrame:
    """``(keep..., column, value)`` rows: one per input row and column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"),
                               F.col(c).cast(value_type).alias("value"))
                      for c in cols])
    return (df.select(*keep, F.explode(pairs).alias("_kv"))
            .select(*keep, "_kv.column", "_kv.value"))


def _common_type(df: DataFrame, cols: Sequence[str]) -> tuple[str, bool]:
    types = {f.name: f.dataType for f in df.schema.fields}
    integral = all(is_integral(types[c]) for c in cols)
    return ("bigint" if integral else "double"), integral


def describe(df: DataFrame, cols: Sequence[str], groups: Sequence[str] = (),
             method: str = "exact") -> DataFrame:
    """count, mean, std, min, quartiles, max per (group, column)."""
    vt, integral = _common_type(df, cols)
    long = to_long(df, cols, groups, vt)
    keys = [*groups, "column"]
    v = F.col("value")
    mom = long.groupBy(*keys).agg(
        F.count(v).alias("count"), mean_expr(v, integral).alias("mean"),
        std_expr(v, integral).alias("std"),
        F.min(v).cast("double").alias("min"), F.max(v).cast("double").alias("max"))
    q = quantiles(long, "value", [0.25, 0.5, 0.75], keys,
                  ["p25", "median", "p75"], method=method)
    return join_on(mom, q, keys, "left").select(
        *keys, "count", "mean", "std", "min", "p25", "median", "p75", "max")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in skip]


COLUMNS_PER_PASS = 128


def _chunks(cols: Sequence[str], size: int = None) -> list[list[str]]:
    size = size or COLUMNS_PER_PASS
    return [list(cols[i:i + size]) for i in range(0, len(cols), size)]


def null_rates(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null count and percent per column, most missing first (one
    aggregation pass per chunk of columns)."""
    cols = list(cols or df.columns)
    n = F.count(F.lit(1))
    parts = []
    for chunk in _chunks(cols):
        wide = df.agg(n.alias("_n"), *[
            (n - F.count(F.col(c))).alias(f"_null_{i}") for i, c in enumerate(chunk)])
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_null_{i}").alias("n_null"))
                          for i, c in enumerate(chunk)])
        parts.append(wide.select("_n", F.explode(pairs).alias("kv"))
                     .select("kv.column", "kv.n_null",
                             F.try_divide(F.col("kv.n_null") * 100.0, F.col("_n")).alias("pct_null")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.desc("n_null"), "column")


def column_profile(df: DataFrame, method: str = "exact", distinct: str = "exact") -> DataFrame:
    """Per column: type, rows, non-null, null rate, distinct count/rate and,
    for numeric columns, mean/std/min/quartiles/max.

    Exact distinct counts of k columns make Spark expand every row k times
    before de-duplicating, so columns are profiled in passes of
    ``COLUMNS_PER_PASS``; on very wide, very large tables ``distinct="approx"``
    uses HyperLogLog++ (algebraic, no expansion, ~1% error)."""
    dtypes = dict(df.dtypes)
    n = F.count(F.lit(1))
    nd = (F.count_distinct if distinct == "exact"
          else (lambda c: F.approx_count_distinct(c, 0.01)))
    parts = []
    for cols in _chunks(df.columns):
        wide = df.agg(n.alias("_n"), *[
            x for i, c in enumerate(cols) for x in (
                F.count(F.col(c)).alias(f"_nn_{i}"),
                nd(F.col(c)).alias(f"_nd_{i}"))])
        pairs = F.array(*[F.struct(
            F.lit(c).alias("column"), F.lit(dtypes[c]).alias("dtype"),
            F.col(f"_nn_{i}").alias("non_null"), F.col(f"_nd_{i}").alias("n_distinct"))
            for i, c in enumerate(cols)])
        parts.append(wide.select("_n", F.explode(pairs).alias("kv"))
                     .select("kv.column", "kv.dtype", F.col("_n").alias("n_rows"),
                             "kv.non_null", "kv.n_distinct"))
    base = parts[0]
    for p in parts[1:]:
        base = base.unionByName(p)
    base = base.select(
        "*", F.try_divide(F.col("n_rows") - F.col("non_null"), F.col("n_rows")).alias("null_rate"),
        F.try_divide(F.col("n_distinct").cast("double"),
                     F.col("non_null").cast("double")).alias("distinct_rate"))
    num = numeric_columns(df)
    if not num:
        return base
    stats = describe(df, num, method=method).drop("count")
    return base.join(stats, "column", "left")


def dtype_counts(df: DataFrame) -> DataFrame:
    """Number of columns per Spark type (metadata of ``df``)."""
    spark = df.sparkSession
    rows = {}
    for _, t in df.dtypes:
        rows[t] = rows.get(t, 0) + 1
    return spark.createDataFrame(sorted(rows.items()), "dtype string, n_columns long")


# -- target analysis ----------------------------------------------------------

def class_comparison(df: DataFrame, value: str, label: str,
                     method: str = "exact") -> DataFrame:
    """mean/median/std of ``value`` per class (0/1) and the relative mean
    difference ``(mean_1 − mean_0) / mean_0`` in one row."""
    vt, integral = _common_type(df, [value])
    y = F.col(label)
    x = F.col(value)
    per = {k: F.when(y == k, x) for k in (0, 1)}
    mom = df.agg(*[e for k in (0, 1) for e in (
        mean_expr(per[k], integral).alias(f"mean_{k}"),
        std_expr(per[k], integral).alias(f"std_{k}"),
        F.count(per[k]).alias(f"n_{k}"))])
    q = quantiles(df.where(y.isin(0, 1)), value, [0.5], [label], ["median"],
                  method=method)
    med = q.agg(*[F.max(F.when(F.col(label) == k, F.col("median"))).alias(f"median_{k}")
                  for k in (0, 1)])
    # two one-row aggregates side by side
    both = mom.withColumn("_k", F.lit(1)).join(
        F.broadcast(med.withColumn("_k", F.lit(1))), "_k").drop("_k")
    return both.select(
        "n_0", "n_1", "mean_0", "mean_1", "median_0", "median_1", "std_0", "std_1",
        F.try_divide(F.col("mean_1") - F.col("mean_0"), F.col("mean_0"))
        .alias("rel_mean_diff"))


def target_rate_by_category(df: DataFrame, cat: str, label: str) -> DataFrame:
    """count, positives, rate and share of rows per category, by rate."""
    g = df.groupBy(cat).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label)).cast("bigint").alias("n_pos"),
        F.try_divide(F.sum(F.col(label)).cast("double"),
                     F.count(F.col(label)).cast("double")).alias("rate"))
    tot = df.agg(F.count(F.lit(1)).alias("_tot"))  # one row
    return (with_one_row(g, tot).select(*g.columns, (F.col("n") * 100.0 / F.col("_tot")).alias("pct_rows"))
            .orderBy(F.desc("rate"), F.asc_nulls_last(cat)))


def target_rate_by_bin(df: DataFrame, value: str, edges: Sequence[float],
                       labels: Sequence[str], label: str) -> DataFrame:
    """Right-closed bins; rows outside every bin are dropped."""
    from ledgerfold.functions.nullsafe import cut_right_closed
    b = df.select(cut_right_closed(value, edges, labels).alias("bin"),
                  cut_right_closed(value, edges, None).alias("bin_ord"),
                  F.col(label).alias("_y"))
    return (b.where(F.col("bin").isNotNull()).groupBy("bin", "bin_ord").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").cast("bigint").alias("n_pos"),
        F.try_divide(F.sum("_y").cast("double"), F.count("_y").cast("double"))
        .alias("rate")).orderBy("bin_ord"))


def category_class_counts(df: DataFrame, cat: str, label: str) -> DataFrame:
    g = df.groupBy(cat, label).agg(F.count(F.lit(1)).alias("n"))
    tot = df.agg(F.count(F.lit(1)).alias("_tot"))  # one row
    return with_one_row(g, tot).select(*g.columns, (F.col("n") * 100.0 / F.col("_tot")).alias("pct_rows"))


# -- shapes -----------------------------------------------------------------

def value_range(df: DataFrame, value: str) -> tuple[float, float]:
    """(min, max) of a column: a one-row aggregate brought to the driver."""
    r = df.agg(F.min(value).cast("double"), F.max(value).cast("double")).first()
    return r[0], r[1]


def histogram(df: DataFrame, value: str, bins: int = 10,
              groups: Sequence[str] = (), density: bool = False,
              lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Equal-width histogram over [min, max] (last bin closed), optionally
    per group with shared edges; ``density`` = n / (N_group · width)."""
    if lo is None or hi is None:
        lo, hi = value_range(df, value)
    if lo is None:
        raise ValueError(f"column {value!r} has no values")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    x = F.col(value).cast("double")
    idx = F.least(F.floor((x - F.lit(lo)) * F.lit(bins / (hi - lo))),
                  F.lit(bins - 1)).cast("int")
    g = (df.where(x.isNotNull()).select(*groups, idx.alias("bin"))
         .groupBy(*groups, "bin").agg(F.count(F.lit(1)).alias("count")))
    # every bin of every group, empty ones with 0
    places = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    grid = (g.select(*groups).distinct().select(*groups, places) if groups
            else df.sparkSession.range(1).select(places))
    g = join_on(grid, g, [*groups, "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    out = g.select(*groups, "bin",
                   (F.lit(lo) + F.col("bin") * F.lit(width)).alias("left"),
                   (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("right"),
                   "count")
    if density:
        from pyspark.sql import Window
        tot = F.sum("count").over(Window.partitionBy(*groups))  # ≤ bins rows each
        out = out.withColumn("density", F.col("count") / (tot * F.lit(width)))
    return out


def box_stats(df: DataFrame, value: str, groups: Sequence[str] = (),
              method: str = "exact") -> DataFrame:
    """Quartiles, IQR, whiskers (furthest values within 1.5·IQR) and the
    number of outliers per group."""
    groups = list(groups)
    q = quantiles(df, value, [0.25, 0.5, 0.75], groups, ["q1", "median", "q3"],
                  method=method)
    q = q.select("*", (F.col("q3") - F.col("q1")).alias("iqr"))
    q = q.select("*", (F.col("q1") - 1.5 * F.col("iqr")).alias("_lo"),
                 (F.col("q3") + 1.5 * F.col("iqr")).alias("_hi"))
    x = F.col(value).cast("double")
    if groups:
        # one row per group, broadcast when provably small (hot groups then
        # cannot skew the join)
        j = join_on(df, q, groups, broadcast_rows=DEFAULT_BROADCAST_ROWS)
    else:
        j = with_one_row(df, q)
    inside = (x >= F.col("_lo")) & (x <= F.col("_hi"))
    a = j.where(x.isNotNull()).groupBy(*groups, "q1", "median", "q3", "iqr").agg(
        F.min(F.when(inside, x)).alias("whisker_low"),
        F.max(F.when(inside, x)).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"), F.count(F.lit(1)).alias("n"))
    return a


def kde_grid(df: DataFrame, value: str, gridsize: int = 200,
             groups: Sequence[str] = (), method: str = "binned",
             bins_per_bandwidth: int = 64) -> DataFrame:
    """Gaussian KDE on ``gridsize`` points over [min, max], Scott bandwidth
    ``h = std · n^(-1/5)``.

    ``binned``: each value is shared between the two nearest of equally spaced
    bins, in proportion to its distance (one pass, one row per bin), and the bins
    are convolved with the kernel as far as it exceeds 1e-16.  With bins
    ``h / bins_per_bandwidth`` wide the density is off by at most
    ``1 / (8 · bins_per_bandwidth² · h · sqrt(2π))``, 3e-5 of a lone point's peak
    by default, however many rows and distinct values there are.

    ``exact``: each distinct value contributes to every grid point (work grows
    with the number of distinct values × grid size, no pairs of rows)."""
    vt, integral = _common_type(df, [value])
    x = F.col(value)
    st = df.agg(F.count(x).alias("n"), std_expr(x, integral).alias("sd"),
                F.min(x).cast("double").alias("lo"),
                F.max(x).cast("double").alias("hi")).first()
    n, sd, lo, hi = st["n"], st["sd"], st["lo"], st["hi"]
    if not n or sd is None or sd == 0:
        raise ValueError("KDE needs at least two distinct values")
    h = sd * n ** (-0.2)
    step = (hi - lo) / (gridsize - 1)
    src = df.where(x.isNotNull())
    norm = 1.0 / (n * h * math.sqrt(2.0 * math.pi))
    if method == "exact":
        places = src.groupBy(*groups, value).agg(F.count(F.lit(1)).cast("double").alias("_c")).withColumn("_x", x.cast("double"))
        grid = F.explode(F.sequence(F.lit(0), F.lit(gridsize - 1))).alias("grid")
    elif method == "binned":
        width = h / bins_per_bandwidth
        place = (x.cast("double") - F.lit(lo)) / F.lit(width)
        share = place - F.floor(place)
        halves = (src.groupBy(*groups, F.floor(place).alias("_b"))
                  .agg(F.sum(1 - share).alias("_l"), F.sum(share).alias("_r")))
        both = F.explode(F.array(F.struct(F.col("_b").alias("b"), F.col("_l").alias("w")), F.struct((F.col("_b") + 1).alias("b"), F.col("_r").alias("w")))).alias("_e")
        places = (halves.select(*groups, both).groupBy(*groups, "_e.b").agg(F.sum("_e.w").alias("_c"))
                  .withColumn("_x", F.lit(lo) + F.col("b") * F.lit(width)))
        # the kernel is below 1e-16 beyond 8.6 bandwidths
        first = F.ceil((F.col("_x") - F.lit(8.6 * h + lo)) / F.lit(step))
        last = F.floor((F.col("_x") + F.lit(8.6 * h - lo)) / F.lit(step))
        low, high = F.greatest(first, F.lit(0)).cast("int"), F.least(last, F.lit(gridsize - 1)).cast("int")
        grid = F.explode(F.when(low <= high, F.sequence(low, high))).alias("grid")
    else:
        raise ValueError("method must be 'binned' or 'exact'")
    e = places.select(*groups, "_c", "_x", grid)
    z = (F.lit(lo) + F.col("grid") * F.lit(step) - F.col("_x")) / F.lit(h)
    k = e.groupBy(*groups, "grid").agg(F.sum(F.col("_c") * F.exp(F.lit(-0.5) * z * z)).alias("_s"))
    # every grid point, also where there is no mass
    points = F.explode(F.sequence(F.lit(0), F.lit(gridsize - 1))).alias("grid")
    every = (places.select(*groups).distinct().select(*groups, points) if groups else df.sparkSession.range(1).select(points))
    return (join_on(every, k, [*groups, "grid"], "left")
            .select(*groups, "grid", (F.lit(lo) + F.col("grid") * F.lit(step)).alias("x"),
                    (F.coalesce("_s", F.lit(0.0)) * F.lit(norm)).alias("density")))


def key_coverage(a: DataFrame, a_key: str, b: DataFrame, b_key: str) -> DataFrame:
    """Distinct keys of ``a``, of ``b``, shared, and coverage of ``a`` by ``b``."""
    ka = a.select(F.col(a_key).alias("k")).where("k IS NOT NULL").distinct()
    kb = b.select(F.col(b_key).alias("k")).where("k IS NOT NULL").distinct()
    j = ka.withColumn("_a", F.lit(1)).join(kb.withColumn("_b", F.lit(1)), "k", "full")
    return j.agg(F.count("_a").alias("n_keys_a"), F.count("_b").alias("n_keys_b"),
                 F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull())
                 .alias("n_shared")).select(
        "*", F.try_divide(F.col("n_shared") * 100.0, F.col("n_keys_a")).alias("pct_a_covered"))
