"""Null labels and groups, more than two classes, empty input, late requests
and counts beyond bigint products."""

from pyspark.sql import functions as F

from ledgerfold.operators import evaluate, profile, sampling, scan
from ledgerfold.streaming.scoring_stream import read_decisions, start_scoring_stream


def _labelled(spark, n=1000):
    return spark.range(n).withColumn("y", F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 2).cast("int"))


def test_null_labels_stay_in_splits_and_folds(spark):
    df = _labelled(spark)
    assert sampling.stratified_split(df, ["id"], "y").count() == 1000
    folds = sampling.stratified_kfold(df, ["id"], "y").groupBy("fold", "y").count().collect()
    assert sum(r["count"] for r in folds) == 1000 and {r["count"] for r in folds if r.y is None} == {40}


def test_sample_of_three_classes_is_trimmed(spark):
    df = spark.range(900).withColumn("y", (F.col("id") % 3).cast("int"))
    assert sampling.stratified_sample(df, ["id"], "y", 100).count() == 100


def test_running_sum_and_quantiles_of_a_null_group(spark):
    df = _labelled(spark).withColumn("one", F.lit(1))
    r = scan.running(df, "id", ["one"], ["y"], n_ranges=4)
    assert {x.y: x.m for x in r.groupBy("y").agg(F.max("cum_one").alias("m")).collect()} == {None: 200, 0: 400, 1: 400}
    d = {x.y: x.median for x in profile.describe(df, ["id"], ["y"]).collect()}
    assert d[None] == 497.5 and None not in d.values()
    assert {x.y for x in profile.box_stats(df, "id", ["y"]).collect()} == {None, 0, 1}


def test_histogram_has_every_bin(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (10.0,)], "x double")
    assert [r["count"] for r in profile.histogram(df, "x", 10).orderBy("bin").collect()] == [1, 1, 0, 0, 0, 0, 0, 0, 0, 1]


def test_empty_input(spark):
    df = spark.range(10).where("id < 0")
    assert profile.null_rates(df).first().pct_null is None
    assert profile.column_profile(df).first().null_rate is None
    assert profile.key_coverage(df, "id", df, "id").first().pct_a_covered is None


def test_auc_of_very_many_rows(spark, monkeypatch):
    counts = spark.createDataFrame([(0.2, 10 ** 10, 9 * 10 ** 10), (0.8, 9 * 10 ** 10, 10 ** 10)], "score double, pos long, neg long")
    monkeypatch.setattr(evaluate, "score_counts", lambda *a: counts)
    assert abs(evaluate.roc_auc(counts).first().roc_auc - 0.9) < 1e-12


def test_null_scores_cost_nothing(spark):
    df = spark.createDataFrame([(1, None), (1, 0.9), (0, 0.1)], "label int, score double")
    assert {r.fn for r in evaluate.cost_curve(df, thresholds=[0.5]).collect()} == {0}


def test_late_requests_are_answered(spark, tmp_path):
    for i, hour in enumerate((20, 3, 12, 1)):
        (spark.createDataFrame([(hour, 1, f"2024-01-01 {hour:02d}:00:00"), (20, 1, "2024-01-01 20:00:00")], "request_id long, client_id long, ts string")
         .withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/req/p={i}"))
    scored = spark.createDataFrame([(1, 0.9)], "client_id long, probability double")
    start_scoring_stream(spark, f"{tmp_path}/req", scored, f"{tmp_path}/out", f"{tmp_path}/ck", max_files_per_trigger=1).awaitTermination()
    assert sorted(r.request_id for r in read_decisions(spark, f"{tmp_path}/out").collect()) == [1, 3, 12, 20]
