"""Driver tables (Parquet) and key-ordered row caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events "
          "documents embeddings pages benchmark labels conversations").split()


_READS: dict[tuple[int, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of a driver table (the lazy scan is reused per session,
    so its footer/schema resolution happens once)."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (id(spark), path)
    df = _READS.get(key)
    if df is None or df.sparkSession is not spark:
        df = spark.read.parquet(path)
        _READS[key] = df
    return df


def row_cap(df: DataFrame, n: int | None, key: str) -> DataFrame:
    """First ``n`` rows by ``key`` (debug mode); ``None`` keeps all.

    File order does not exist in Spark, so "first" is defined by the key;
    ``orderBy().limit()`` plans a TakeOrdered (per-task top-n, then merge).
    """
    if n is None:
        return df
    return df.orderBy(F.col(key)).limit(n)
