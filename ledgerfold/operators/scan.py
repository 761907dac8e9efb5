"""Ordered running aggregates without a single-partition window, as one lazy plan.

``Window.orderBy(x)`` with no partition moves every row into one task, and
``Window.partitionBy(k)`` moves a hot key's rows into one task.  Instead the
order column's range is cut into pieces that hold about equally many distinct
values, each ``(partition columns, piece)`` gets its own running aggregate, and
the totals of the earlier pieces -- at most ``#groups * #pieces`` rows -- are
added back.  Exact.

The edges come from a mergeable sketch: values are dealt to cells by their hash,
and each cell keeps the value of smallest hash, so the cells hold a uniform
sample of the distinct values.  Whatever the layout of the data and the order of
merging, the sketch is the same, and with it the edges: they are a scalar
subquery, and a row's piece is a pure expression of its values (a binary search
of as many projections as the number of pieces has bits, inside code
generation).  So the rows are exchanged once, by (group, piece); no job runs
while the plan is built, nothing is checkpointed, and lost tasks are computed
again like those of any other query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_OPS = {"sum": F.sum, "max": F.max, "min": F.min}

#: Cells of the sketch for each piece: the sample size a piece's share rests on.
CELLS_PER_PIECE = 16


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bucket_count(df: DataFrame, lo: int = 64, hi: int = 1 << 20, per_partition: int = 4) -> int:
    """Hash buckets for ranking inside large groups: a power of two near
    ``per_partition ×`` the session's shuffle partition count (which a
    cluster sizes to its data, ~128 MB per partition), within [lo, hi]."""
    n = max(lo, min(hi, shuffle_partitions(df) * per_partition))
    p = 1
    while p < n:
        p <<= 1
    return p


def range_edges(df: DataFrame, value: Column, pieces: int) -> Column:
    """Scalar subquery: at most ``pieces - 1`` ascending edges that cut the
    distinct non-null values of ``value`` into parts of about one size."""
    h = F.xxhash64(value, F.lit(pieces))
    cells = (df.select(value.alias("_v"), h.alias("_h")).where(F.col("_v").isNotNull())
             .groupBy(F.pmod("_h", F.lit(pieces * CELLS_PER_PIECE)).alias("_cell"))
             .agg(F.min_by("_v", "_h").alias("_v")))
    sample = cells.agg(F.array_sort(F.collect_list("_v")).alias("_s"))
    n = F.size("_s")
    edges = F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.lit(pieces - 1)),
        lambda i: F.get("_s", F.floor(i * n / F.lit(pieces)).cast("int"))))
    return sample.select(F.when(n > 0, edges).alias("_edges")).scalar()


def place(df: DataFrame, value: Column, edges: Column, n_edges: int, out: str) -> DataFrame:
    """Adds ``out``: how many of the ascending ``edges`` (an array of at most
    ``n_edges``) are at most ``value``; 0 for null.  Binary search, one
    projection a step."""
    df = df.withColumn(out, F.lit(0))
    step = 1 << max(n_edges.bit_length() - 1, 0)
    while step and n_edges:
        at = F.col(out)
        df = df.withColumn(out, F.when(value >= F.get(edges, at + F.lit(step - 1)), at + F.lit(step)).otherwise(at))
        step >>= 1
    return df


def running(df: DataFrame, order_col: str, value_cols: Sequence[str],
            partition_cols: Sequence[str] = (), op: str = "sum",
            inclusive: bool = True, n_ranges: int | None = None,
            prefix: str = "cum_", tie_cols: Sequence[str] = (),
            n_buckets: int | None = None, total_prefix: str | None = None) -> DataFrame:
    """Add ``<prefix><v>``: running ``op`` of each value column ordered by
    ``order_col`` (then ``tie_cols``) within ``partition_cols``.

    ``inclusive=False`` gives the aggregate of strictly earlier rows (0 for
    sum, null for max/min when there is none).  ``n_ranges``, the number of
    pieces, defaults to four a shuffle partition (``n_buckets`` is an alias).
    ``total_prefix`` also adds ``<total_prefix><v>``: ``op`` over the whole
    group.  Nulls in the order column come first, a null in a partition column
    is a group like any other.
    """
    if op not in _OPS:
        raise ValueError(f"op must be one of {sorted(_OPS)}")
    parts, agg = list(partition_cols), _OPS[op]
    n = max(n_ranges or n_buckets or 4 * shuffle_partitions(df), 1)
    value = F.struct(order_col, *tie_cols) if tie_cols else F.col(order_col)
    b = place(df, value, range_edges(df, value, n), n - 1, "_piece")
    b = b.withColumn("_key", F.struct(*parts, "_piece") if parts else F.col("_piece"))
    w = (Window.partitionBy("_key").orderBy(order_col, *tie_cols)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1))
    local = b.select("*", *[agg(F.col(v)).over(w).alias(f"_loc_{v}") for v in value_cols])
    # at most one row a (group, piece)
    groups = [F.col(f"_key.{c}") for c in parts]
    wb = Window.partitionBy(*groups).orderBy(F.col("_key._piece") if parts else F.col("_key"))
    before, all_ = wb.rowsBetween(Window.unboundedPreceding, -1), wb.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = (b.groupBy("_key").agg(*[agg(F.col(v)).alias(f"_tot_{v}") for v in value_cols])
               .select("_key", *[agg(F.col(f"_tot_{v}")).over(before).alias(f"_off_{v}") for v in value_cols],
                       *([agg(F.col(f"_tot_{v}")).over(all_).alias(f"{total_prefix}{v}") for v in value_cols] if total_prefix else [])))
    # without groups there are at most ``n`` of them
    joined = local.join(offsets if parts else F.broadcast(offsets), "_key", "left")
    outs = []
    for v in value_cols:
        loc, off = F.col(f"_loc_{v}"), F.col(f"_off_{v}")
        if op == "sum":
            val = F.coalesce(loc, F.lit(0)) + F.coalesce(off, F.lit(0))
        else:
            val = (F.greatest if op == "max" else F.least)(loc, off)  # skip nulls
        outs.append(val.alias(f"{prefix}{v}"))
    totals = [F.col(f"{total_prefix}{v}") for v in value_cols] if total_prefix else []
    return joined.select(*[F.col(c) for c in df.columns], *outs, *totals)
