"""Binding: request-stream scoring (J7) over requests derived from the
documents (every document is requested; labelled ones are requested twice,
so de-duplication is exercised) against the scored labelled items."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerfold.plans.bind_common import SCORED_SQL, scored_labels
from ledgerfold.plans.catalog import register
from ledgerfold.session import checkpoint_dir
from ledgerfold.sources.tables import table
from ledgerfold.streaming.scoring_stream import read_decisions, start_scoring_stream


@register("stream_score_requests", f"""
WITH s AS ({SCORED_SQL})
SELECT d.doc_id AS request_id, d.doc_id AS client_id, s.score AS probability,
  CASE WHEN s.score IS NULL THEN NULL ELSE CAST(s.score >= 0.475 AS INTEGER) END AS prediction,
  0.475::DOUBLE AS threshold,
  CASE WHEN s.score IS NULL THEN NULL WHEN s.score >= 0.475 THEN 'refuse: default risk above threshold'
       ELSE 'grant: default risk below threshold' END AS recommendation,
  CASE WHEN s.score IS NULL THEN 'not found' ELSE 'found' END AS status
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id""")
def stream_score_requests(spark, sf):
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream/{uuid.uuid4().hex}"
    docs = table(spark, sf, "documents").select("doc_id")
    req = docs.select(F.col("doc_id").alias("request_id"), F.col("doc_id").alias("client_id"),
                      F.timestamp_seconds(F.col("doc_id") + F.lit(1_700_000_000)).alias("ts"))
    again = req.join(table(spark, sf, "labels").select(F.col("doc_id").alias("request_id")).hint("merge"),
                     "request_id", "left_semi")
    req.write.mode("overwrite").parquet(f"{base}/requests/part=0")
    again.write.mode("overwrite").parquet(f"{base}/requests/part=1")
    # scored once, not by every micro-batch
    scored_labels(spark, sf).select(F.col("doc_id").alias("client_id"), F.col("score").alias("probability")
                                    ).write.parquet(f"{base}/scored")
    scored = spark.read.schema("client_id long, probability double").parquet(f"{base}/scored")
    q = start_scoring_stream(spark, f"{base}/requests", scored, f"{base}/out", f"{base}/ckpt",
                             max_files_per_trigger=1)
    q.awaitTermination()
    return read_decisions(spark, f"{base}/out")
