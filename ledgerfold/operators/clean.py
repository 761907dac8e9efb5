"""Cleaning: imputation, capping, sparse-column and null-row removal,
quantile filters.  Column-level facts (means, null rates, quartiles) are
one-row aggregates; rows are never brought to the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.operators.profile import quantiles


def _one_row(df: DataFrame, *exprs):
    return df.agg(*exprs).first()


def conditional_impute(df: DataFrame, col: str, flag: str,
                       zero_when: str = "N", mean_when: str = "Y") -> DataFrame:
    """Step 1: null ``col`` where ``flag == zero_when`` -> 0.
    Step 2: null ``col`` where ``flag == mean_when`` -> mean of the column
    *after* step 1 (zeros included)."""
    x, f = F.col(col), F.col(flag)
    step1 = F.when(x.isNull() & (f == F.lit(zero_when)), F.lit(0)).otherwise(x)
    mean = _one_row(df.select(step1.alias("_x")), F.avg("_x"))[0]
    step2 = F.when(step1.isNull() & (f == F.lit(mean_when)), F.lit(mean)).otherwise(step1)
    return df.select(*[step2.cast("double").alias(col) if c == col else F.col(c)
                       for c in df.columns])


def cap_outliers(df: DataFrame, caps: Mapping[str, float]) -> DataFrame:
    """``x > cap -> cap``; nulls unchanged."""
    return df.select(*[
        (F.when(F.col(c) > F.lit(caps[c]), F.lit(caps[c])).otherwise(F.col(c))
         .alias(c)) if c in caps else F.col(c) for c in df.columns])


def count_above_cap(df: DataFrame, caps: Mapping[str, float]) -> DataFrame:
    """``(column, cap, n_above)`` -- one pass."""
    names = list(caps)
    wide = df.agg(*[F.count_if(F.col(c) > F.lit(caps[c])).alias(f"_n{i}")
                    for i, c in enumerate(names)])
    arr = F.array(*[F.struct(F.lit(c).alias("column"),
                             F.lit(float(caps[c])).alias("cap"),
                             F.col(f"_n{i}").alias("n_above"))
                    for i, c in enumerate(names)])
    return wide.select(F.explode(arr).alias("kv")).select("kv.*")


def sparse_columns(df: DataFrame, max_null_rate: float = 0.59) -> list[str]:
    n = F.count(F.lit(1))
    r = _one_row(df, n.alias("_n"), *[(n - F.count(F.col(c))).alias(f"_z{i}")
                                      for i, c in enumerate(df.columns)])
    total = r["_n"] or 0
    return [c for i, c in enumerate(df.columns)
            if total and r[f"_z{i}"] / total > max_null_rate]


def drop_sparse_columns(df: DataFrame, max_null_rate: float = 0.59) -> DataFrame:
    """Drop columns whose null rate exceeds the threshold."""
    return df.drop(*sparse_columns(df, max_null_rate))


def drop_null_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(how="any", subset=list(cols) if cols else None)


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.fill(0, subset=list(cols))


def iqr_bounds(df: DataFrame, col: str, k: float = 1.5,
               method: str = "exact") -> tuple[float, float]:
    q = quantiles(df, col, [0.25, 0.75], names=["q1", "q3"], method=method).first()
    iqr = q["q3"] - q["q1"]
    return q["q1"] - k * iqr, q["q3"] + k * iqr


def iqr_outliers(df: DataFrame, col: str, k: float = 1.5,
                 method: str = "exact") -> DataFrame:
    """Rows outside [Q1 − k·IQR, Q3 + k·IQR]."""
    lo, hi = iqr_bounds(df, col, k, method)
    x = F.col(col)
    return df.where((x < F.lit(lo)) | (x > F.lit(hi)))


def quantile_trim(df: DataFrame, col: str, q: float = 0.99,
                  method: str = "exact") -> DataFrame:
    """Rows with ``x < quantile(q)`` (nulls dropped)."""
    cut = quantiles(df, col, [q], names=["_q"], method=method).first()["_q"]
    return df.where(F.col(col) < F.lit(cut))
