"""Append-only run table (params, metrics, tags as long rows) in Parquet.

Every commit has a folder of its own, which Spark's writer fills under a
temporary name and publishes when the job commits.  Writers share nothing, so
any number can log at once and none is lost; a run that fails half way is never
seen.  A run may be logged in several commits (parameters first, metrics later).
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "run_id string, model string, kind string, name string, value double, text string, ts double"


def log_run(spark: SparkSession, path: str, model: str, params: Mapping | None = None,
            metrics: Mapping | None = None, tags: Mapping | None = None,
            run_id: str | None = None) -> str:
    run_id = run_id or uuid.uuid4().hex
    ts = time.time()
    rows = []
    for kind, items in (("param", params), ("metric", metrics), ("tag", tags)):
        for k, v in (items or {}).items():
            num = float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
            rows.append((run_id, model, kind, str(k), num, None if num is not None else str(v), ts))
    append(spark.createDataFrame(rows, SCHEMA), path)
    return run_id


def append(rows: DataFrame, path: str) -> None:
    """One commit of rows in the log's schema."""
    rows.write.parquet(f"{path.rstrip('/')}/commit={uuid.uuid4().hex}")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{SCHEMA}, commit string").parquet(path).drop("commit")


def tagged(runs: DataFrame, tag: tuple[str, str] | None) -> DataFrame:
    """The rows of runs that carry a tag (all without one)."""
    if tag is None:
        return runs
    own = runs.where((F.col("kind") == "tag") & (F.col("name") == tag[0]) & (F.col("text") == tag[1])).select("run_id").distinct()
    return runs.join(own, "run_id", "left_semi")


def best_runs(runs: DataFrame, ascending: bool = False, tag: tuple[str, str] | None = None) -> DataFrame:
    """Per metric the run with the best value (ties: smallest run id): name,
    run_id, model, value.  An algebraic aggregate over ``(value, run id)``."""
    m = tagged(runs, tag).where((F.col("kind") == "metric") & F.col("value").isNotNull())
    key = F.struct((F.col("value") if ascending else -F.col("value")).alias("v"), "run_id", "model", "value")
    return m.groupBy("name").agg(F.min(key).alias("b")).select("name", "b.run_id", "b.model", "b.value")


def best_run(runs: DataFrame, metric: str, ascending: bool = False,
             tag: tuple[str, str] | None = None) -> DataFrame:
    """The run with the best value of ``metric`` (ties: smallest run id)."""
    best = best_runs(runs.where((F.col("kind") != "metric") | (F.col("name") == metric)), ascending, tag)
    return best.select("run_id", "model", F.col("value").alias(metric))
