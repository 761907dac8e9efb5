"""Scoring a stream of client requests (the serving path as a stream).

Requests ``(request_id, client_id, ts)`` arrive as files, are answered once each,
however late they or their repeats come, and are joined to the static
scored-client table (stream-static left join: unknown clients are reported, not
dropped) and decided at the production threshold.

The stream keeps no state.  Decisions are stored by epoch and by a bucket of the
request id; a micro-batch is compared with the earlier decisions of its ids'
buckets, which the reader prunes to, so what is remembered is the result itself
and grows with nothing else.  Each micro-batch is written to its own epoch folder
with overwrite, so a retried epoch replaces its output instead of duplicating
it.  ``watermark`` is an alternative where repeats come soon: ids are then kept as
state until the watermark passes them, and later requests are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerfold.operators.scoring import GRANT_TEXT, REFUSE_TEXT, THRESHOLD

REQUEST_SCHEMA = "request_id long, client_id long, ts timestamp"


def decisions(requests: DataFrame, scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per request: probability, decision and text, or ``not found``.

    The scored clients grow with the data and every micro-batch joins them, so
    they are shuffled: a broadcast would bring them to the driver each time."""
    s = scored.select(F.col("client_id"), F.col("probability")).hint("merge")
    j = requests.join(s, "client_id", "left")
    p = F.col("probability")
    hit = p.isNotNull()
    return j.select(
        "request_id", "client_id", "probability",
        F.when(hit, (p >= F.lit(threshold)).cast("int")).alias("prediction"),
        F.lit(float(threshold)).alias("threshold"),
        F.when(~hit, F.lit(None)).when(p >= F.lit(threshold), F.lit(REFUSE_TEXT))
        .otherwise(F.lit(GRANT_TEXT)).alias("recommendation"),
        F.when(hit, F.lit("found")).otherwise(F.lit("not found")).alias("status"))


def start_scoring_stream(spark: SparkSession, requests_path: str, scored: DataFrame,
                         out_path: str, checkpoint: str, watermark: str | None = None,
                         threshold: float = THRESHOLD, available_now: bool = True,
                         max_files_per_trigger: int | None = None, buckets: int = 16) -> StreamingQuery:
    """Start the stream; ``buckets`` of request ids divide the decisions."""
    reader = spark.readStream.schema(REQUEST_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    req = reader.parquet(requests_path)
    if watermark:
        req = req.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["request_id"])
    out, bucket = out_path.rstrip("/"), F.pmod(F.xxhash64("request_id"), F.lit(buckets)).cast("int")

    def sink(batch: DataFrame, epoch_id: int) -> None:
        fresh = batch.dropDuplicates(["request_id"]).withColumn("bucket", bucket)
        if epoch_id and not watermark:
            earlier = answered(batch.sparkSession, out).where(F.col("epoch") < epoch_id)
            fresh = fresh.join(earlier.select("bucket", "request_id").hint("merge"), ["bucket", "request_id"], "left_anti")
        result = decisions(fresh, scored, threshold).withColumn("bucket", bucket)
        result.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/epoch={epoch_id}")

    w = req.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


DECISION_SCHEMA = ("request_id long, client_id long, probability double, prediction int, threshold double, "
                   "recommendation string, status string")


def answered(spark: SparkSession, out_path: str) -> DataFrame:
    """All decisions with their epoch and bucket."""
    return spark.read.schema(f"{DECISION_SCHEMA}, epoch long, bucket int").parquet(out_path)


def read_decisions(spark: SparkSession, out_path: str) -> DataFrame:
    return answered(spark, out_path).drop("epoch", "bucket")
