"""Feature table, manifest, split bundle and client-id list at rest.

Parquet replaces pickle/CSV; the ordered feature manifest is a small JSON
next to the table (order is contractual for scoring); the train/val/test
bundle is one table partitioned by ``split`` so a read of one split prunes
the others at the file level.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_EXCLUDE = ["SK_ID_CURR", "SK_ID_BUREAU", "SK_ID_PREV", "index", "TARGET"]


def write_features(df: DataFrame, path: str, target: str | None = None) -> DataFrame:
    """Write the feature table; return its shape and target counts (one row)."""
    df.write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.parquet(path)
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.lit(len(back.columns)).alias("n_columns")]
    if target:
        aggs += [F.count_if(F.col(target) == 1).alias("n_pos"),
                 F.count_if(F.col(target) == 0).alias("n_neg")]
    return back.agg(*aggs)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"feature table not found: {path}") from e


def manifest(df: DataFrame, exclude: Sequence[str] = DEFAULT_EXCLUDE,
             vocabularies: dict | None = None) -> dict:
    """Ordered feature names (order is contractual for scoring) and,
    optionally, the category vocabularies used to build them, so that
    scoring data is encoded with exactly the training columns."""
    names = [c for c in df.columns if c not in set(exclude)]
    m = {"feature_names": names, "n_features": len(names), "exclude_cols": list(exclude)}
    if vocabularies is not None:
        m["vocabularies"] = vocabularies
    return m


def manifest_frame(df: DataFrame, exclude: Sequence[str] = DEFAULT_EXCLUDE) -> DataFrame:
    """``(ordinal, name, type)`` of the features in manifest order."""
    types = dict(df.dtypes)
    rows = [(i, n, types[n]) for i, n in enumerate(manifest(df, exclude)["feature_names"])]
    return df.sparkSession.createDataFrame(rows, "ordinal int, name string, type string")


def write_manifest(df: DataFrame, path: str, exclude: Sequence[str] = DEFAULT_EXCLUDE,
                   vocabularies: dict | None = None) -> dict:
    m = manifest(df, exclude, vocabularies)
    spark = df.sparkSession
    spark.createDataFrame([(json.dumps(m),)], "json string").coalesce(1) \
        .write.mode("overwrite").text(path)
    return m


def read_manifest(spark: SparkSession, path: str) -> dict:
    try:
        return json.loads(spark.read.text(path).first()[0])
    except AnalysisException as e:
        raise FileNotFoundError(f"manifest not found: {path}") from e


def write_split_bundle(split_df: DataFrame, path: str) -> None:
    split_df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split; the ``split = ...`` predicate prunes partitions."""
    return spark.read.parquet(path).where(F.col("split") == split)


def entity_ids(df: DataFrame, key: str) -> DataFrame:
    """Sorted distinct ids and their total (one extra column)."""
    ids = df.select(F.col(key).alias("client_id")).where("client_id IS NOT NULL").distinct()
    tot = ids.agg(F.count(F.lit(1)).alias("total"))
    return (ids.withColumn("_k", F.lit(1))
            .join(F.broadcast(tot.withColumn("_k", F.lit(1))), "_k").drop("_k")
            .orderBy("client_id"))
