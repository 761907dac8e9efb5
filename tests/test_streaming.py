"""Request stream: de-duplication, unknown ids, idempotent epochs."""

import os
import tempfile

from ledgerfold.plans.bind_common import scored_labels
from ledgerfold.streaming.scoring_stream import decisions, read_decisions, start_scoring_stream
from tests.conftest import SF001


def test_stream_scoring(spark):
    d = tempfile.mkdtemp(prefix="lf-stream-")
    req = spark.createDataFrame([(1, 10, "2024-01-01 00:00:00"), (2, 11, "2024-01-01 00:00:05"),
                                 (3, 99, "2024-01-01 00:00:07")], "request_id long, client_id long, ts string")
    req = req.selectExpr("request_id", "client_id", "cast(ts as timestamp) as ts")
    req.write.parquet(os.path.join(d, "req", "p=0"))
    req.where("request_id = 1").write.parquet(os.path.join(d, "req", "p=1"))   # duplicate
    scored = spark.createDataFrame([(10, 0.9), (11, 0.1)], "client_id long, probability double")
    q = start_scoring_stream(spark, os.path.join(d, "req"), scored, os.path.join(d, "out"),
                             os.path.join(d, "ck"), max_files_per_trigger=1)
    q.awaitTermination()
    out = {r.request_id: r for r in read_decisions(spark, os.path.join(d, "out")).collect()}
    assert set(out) == {1, 2, 3}
    assert out[1].prediction == 1 and out[1].threshold == 0.475 and out[1].recommendation
    assert out[2].prediction == 0
    assert out[3].status == "not found" and out[3].probability is None


def test_no_table_is_broadcast(spark):
    """Scored clients grow with the data: none of them pass through the driver."""
    requests = spark.createDataFrame([(1, 10), (2, 11)], "request_id long, client_id long")
    scored = spark.createDataFrame([(10, 0.9)], "client_id long, probability double")
    for df in (decisions(requests, scored), scored_labels(spark, SF001)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
