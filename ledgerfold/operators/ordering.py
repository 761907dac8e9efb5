"""Sort/top-k, per-entity top-n, running best, max-normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.operators.scan import bucket_count, running


def top_k(df: DataFrame, by: str, k: int, tie: Sequence[str] = (),
          ascending: bool = False) -> DataFrame:
    """First k rows by ``by`` (ties broken by ``tie``): a TakeOrdered, i.e.
    per-task top-k then one merge of k·tasks rows."""
    o = F.asc_nulls_last(by) if ascending else F.desc_nulls_last(by)
    return df.orderBy(o, *[F.asc(c) for c in tie]).limit(k)


def top_n_per_entity(df: DataFrame, entity: str, value: str, name: str,
                     n: int = 20, tie: Sequence[str] = (),
                     n_buckets: int | None = None) -> DataFrame:
    """Per entity, the n rows of largest |value| (ties by name, then ``tie``).

    Rows are first reduced per (entity, hash bucket) to their own top n, so
    a hot entity is ranked in parallel pieces before the final ranking
    sees at most n × buckets rows of it (buckets sized from the session's
    shuffle partition count).
    """
    if not 1 <= n <= 50:
        raise ValueError("n must be within 1..50")
    a = F.abs(F.col(value))
    order = [a.desc(), F.col(name).asc(), *[F.col(t).asc() for t in tie]]
    nb = n_buckets or bucket_count(df, lo=16)
    b = df.withColumn("_b", F.pmod(F.xxhash64(F.col(name), *[F.col(t) for t in tie]), F.lit(nb)))
    w1 = Window.partitionBy(entity, "_b").orderBy(*order)
    pre = b.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= n)
    w2 = Window.partitionBy(entity).orderBy(*order)
    return (pre.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= n)
            .drop("_b", "_r1"))


def running_best(df: DataFrame, order_col: str, value: str,
                 partition_cols: Sequence[str] = (), maximize: bool = True,
                 out: str = "best_so_far", tie_cols: Sequence[str] = (),
                 n_ranges: int | None = None) -> DataFrame:
    """Best value so far (inclusive) in ``order_col`` order per partition."""
    r = running(df, order_col, [value], partition_cols,
                op="max" if maximize else "min", inclusive=True,
                prefix="_best_", tie_cols=tie_cols, n_ranges=n_ranges)
    return r.withColumnRenamed(f"_best_{value}", out)


def max_normalise(df: DataFrame, col: str, out: str | None = None,
                  eps: float = 1e-9) -> DataFrame:
    """``x / (max(x) + eps)``; the max is a one-row aggregate."""
    out = out or f"{col}_norm"
    m = df.agg(F.max(col).cast("double").alias("_max"))
    return (df.withColumn("_k", F.lit(1))
            .join(F.broadcast(m.withColumn("_k", F.lit(1))), "_k")
            .select(*df.columns, (F.col(col) / (F.col("_max") + F.lit(eps))).alias(out)))
