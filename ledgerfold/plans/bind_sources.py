"""Bindings: sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerfold.session import checkpoint_dir
from ledgerfold.sources.csv import read_csv, write_csv
from ledgerfold.sources.feature_store import entity_ids as _entity_ids
from ledgerfold.sources.feature_store import manifest_frame
from ledgerfold.sources.tables import row_cap as _row_cap
from ledgerfold.sources.tables import table
from ledgerfold.plans.catalog import register

CUSTOMER_SCHEMA = T.StructType([
    T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
    T.StructField("c_nationkey", T.IntegerType()), T.StructField("c_acctbal", T.DoubleType()),
    T.StructField("c_mktsegment", T.StringType())])


@register("csv_scan_null_tokens", """
SELECT c_custkey, c_name, c_nationkey,
  CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL ELSE c_mktsegment END AS c_mktsegment
FROM customer""")
def csv_scan_null_tokens(spark, sf):
    """customer written as CSV with missing values spelled ``None`` / ``NA``
    (into the shared checkpoint folder), then scanned back with its schema."""
    c = table(spark, sf, "customer")
    text = c.select(
        F.col("c_custkey").cast("string").alias("c_custkey"), "c_name",
        F.col("c_nationkey").cast("string").alias("c_nationkey"),
        F.when(F.col("c_acctbal") < 0, F.lit("None")).otherwise(F.col("c_acctbal").cast("string"))
        .alias("c_acctbal"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit("NA")).otherwise(F.col("c_mktsegment"))
        .alias("c_mktsegment"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/csv/{uuid.uuid4().hex}"
    write_csv(text, path)
    return read_csv(spark, path, CUSTOMER_SCHEMA)


@register("row_cap", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000""")
def row_cap(spark, sf):
    """Debug mode: the first 1000 rows by key (the cap is the operator)."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return _row_cap(o, 1000, "o_orderkey")


@register("entity_ids", """
WITH ids AS (SELECT DISTINCT o_custkey AS client_id FROM orders WHERE o_custkey IS NOT NULL)
SELECT client_id, (SELECT count(*) FROM ids) AS total FROM ids""")
def entity_ids(spark, sf):
    return _entity_ids(table(spark, sf, "orders"), "o_custkey")


@register("feature_manifest")
def feature_manifest(spark, sf):
    from ledgerfold.plans.bind_features import credit_tables
    from ledgerfold.plans.features import full_features
    return manifest_frame(full_features(credit_tables(spark, sf)))
