"""Stratified sampling, splits and folds with key-based randomness.

Row order does not exist in Spark, so "random" is a seeded hash of the row
key: every run, on any cluster layout, picks the same rows.  Ranks inside a
stratum are computed per ``(stratum, hash bucket)`` and shifted by the
counts of earlier buckets, so a stratum holding most rows (the majority
class) is ranked by many tasks, not one.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.operators.joins import join_on
from ledgerfold.operators.scan import bucket_count


def hash_rank(df: DataFrame, key_cols: Sequence[str], strata: Sequence[str] = (),
              seed: int = 42, n_buckets: int | None = None, out: str = "_rank") -> DataFrame:
    """0-based rank of each row inside its stratum, in seeded hash order.

    The order is ``(hash mod B, hash, key)``; B defaults to four buckets per
    shuffle partition (a power of two, at least 64), so a window group stays
    a fraction of a partition however large the majority class is."""
    strata = list(strata)
    n_buckets = n_buckets or bucket_count(df)
    h = F.xxhash64(*[F.col(k) for k in key_cols], F.lit(seed))
    d = df.select("*", h.alias("_h"), F.pmod(h, F.lit(n_buckets)).alias("_hb"))
    w = Window.partitionBy(*strata, "_hb").orderBy("_h", *key_cols)
    local = d.withColumn("_lr", F.row_number().over(w) - 1)
    counts = d.groupBy(*strata, "_hb").agg(F.count(F.lit(1)).alias("_bc"))
    wb = Window.partitionBy(*strata).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*strata, "_hb", F.coalesce(F.sum("_bc").over(wb), F.lit(0)).alias("_off"))
    j = join_on(local, offs, [*strata, "_hb"])
    return j.select(*df.columns, (F.col("_off") + F.col("_lr")).alias(out),
                    F.col("_h").alias("_hash"))


def _dec(x: float) -> Decimal:
    return Decimal(repr(x))


def split_quotas(n, test_ratio: float, val_ratio: float):
    """Per-stratum quotas as column expressions: test = ceil(n·t),
    val = ceil((n − test)·v/(1 − t)), train = the rest (two-step split)."""
    t = _dec(test_ratio)
    v_adj = _dec(val_ratio) / (Decimal(1) - t)
    n_test = F.ceil(n.cast("decimal(20,0)") * F.lit(t)).cast("bigint")
    n_val = F.ceil((n - n_test).cast("decimal(20,0)") * F.lit(v_adj)).cast("bigint")
    return n_test, n_val


def stratified_split(df: DataFrame, key_cols: Sequence[str], label: str,
                     ratios: tuple[float, float, float] = (0.6, 0.2, 0.2),
                     seed: int = 42) -> DataFrame:
    """Adds ``split`` in {train, val, test} with exact per-class quotas."""
    tr, va, te = ratios
    if abs(tr + va + te - 1.0) > 1e-9:
        raise ValueError(f"split ratios {ratios} do not add up to one")
    r = hash_rank(df, key_cols, [label], seed)
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    n_test, n_val = split_quotas(F.col("_n"), te, va)
    sizes = sizes.select(label, "_n", n_test.alias("_nt"), n_val.alias("_nv"))
    # one row per class: joining it by label with a shuffle would send the
    # whole majority class to one task, so it is broadcast (size checked)
    j = join_on(r, sizes, [label], broadcast_rows=100_000)
    rank = F.col("_rank")
    split = (F.when(rank < F.col("_nt"), F.lit("test"))
             .when(rank < F.col("_nt") + F.col("_nv"), F.lit("val"))
             .otherwise(F.lit("train")))
    return j.select(*df.columns, split.alias("split"))


def stratified_kfold(df: DataFrame, key_cols: Sequence[str], label: str,
                     k: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold`` in 0..k-1: round-robin over the hash order per class,
    so each fold gets ⌊n_c/k⌋ or ⌈n_c/k⌉ rows of each class."""
    if k < 2:
        raise ValueError("k must be at least 2")
    r = hash_rank(df, key_cols, [label], seed)
    return r.select(*df.columns, (F.col("_rank") % k).cast("int").alias("fold"))


def stratified_sample(df: DataFrame, key_cols: Sequence[str], label: str | None,
                      n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows: up to n//2 per class, topped up from the rows
    not yet taken (in hash order), trimmed to ``n``.  Without a label: the
    first ``n`` rows in hash order.  This is a sampling operator, so the
    row limit is the feature."""
    if label is None:
        h = F.xxhash64(*[F.col(k) for k in key_cols], F.lit(seed))
        return df.orderBy(h, *key_cols).limit(n)
    r = hash_rank(df, key_cols, [label], seed)
    first = r.where(F.col("_rank") < n // 2)
    rest = r.where(F.col("_rank") >= n // 2)
    n_first = first.count()   # ≤ n//2 × classes rows: a bounded count
    topped = first
    if n_first > n:           # more than two classes
        topped = first.orderBy("_hash", *key_cols).limit(n)
    elif n_first < n:
        topped = first.unionByName(
            rest.orderBy("_hash", *key_cols).limit(n - n_first))
    return topped.select(*df.columns)


def split_summary(split_df: DataFrame, label: str, n_features: int) -> DataFrame:
    """Size, share of rows and positive rate per split, plus feature count."""
    per = split_df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.try_divide(F.sum(label).cast("double"), F.count(label).cast("double"))
        .alias("positive_rate"))
    tot = split_df.agg(F.count(F.lit(1)).alias("_tot"))  # one row, broadcast
    j = per.withColumn("_k", F.lit(1)).join(F.broadcast(tot.withColumn("_k", F.lit(1))), "_k")
    return j.select("split", "n", (F.col("n") / F.col("_tot").cast("double")).alias("ratio"),
                    "positive_rate", F.lit(n_features).alias("n_features"))
