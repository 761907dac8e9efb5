"""Sources and sinks: CSV tokens, encoding, feature store, bundle, run log."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerfold.sources import csv as C
from ledgerfold.sources import feature_store as FS
from ledgerfold.sources import runlog as RL


def test_csv_null_tokens(spark):
    d = tempfile.mkdtemp(prefix="lf-csv-")
    p = os.path.join(d, "a.csv")
    with open(p, "w") as f:
        f.write("id,amt,cat\n1,1.5,XNA\n2,NA,None\n3,,nan\n4,NaN,A\n")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("amt", T.DoubleType()),
                           T.StructField("cat", T.StringType())])
    r = C.read_csv(spark, p, schema).orderBy("id").collect()
    assert [x.amt for x in r] == [1.5, None, None, None]
    assert [x.cat for x in r] == ["XNA", None, None, "A"]    # XNA is a real category


def test_latin1_csv_with_filter(spark):
    d = tempfile.mkdtemp(prefix="lf-enc-")
    p = os.path.join(d, "desc.csv")
    with open(p, "wb") as f:
        f.write("Table,Row,Description\napplication,A,Montant crédit\nbureau,B,Données\n".encode("iso-8859-1"))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("Table", "Row", "Description")])
    r = C.read_csv(spark, p, schema, encoding="ISO-8859-1").where(F.col("Table") == "application").collect()
    assert r[0].Description == "Montant crédit"


def test_feature_store_round_trip(spark):
    d = tempfile.mkdtemp(prefix="lf-fs-")
    df = spark.createDataFrame([(1, 0, 1.0), (2, 1, None)], "SK_ID_CURR long, TARGET int, f double")
    shape = FS.write_features(df, os.path.join(d, "t"), "TARGET").first()
    assert (shape.n_rows, shape.n_columns, shape.n_pos, shape.n_neg) == (2, 3, 1, 1)
    assert FS.read_features(spark, os.path.join(d, "t")).count() == 2
    with pytest.raises(FileNotFoundError):
        FS.read_features(spark, os.path.join(d, "missing"))
    m = FS.write_manifest(df, os.path.join(d, "m"))
    assert FS.read_manifest(spark, os.path.join(d, "m")) == m and m["feature_names"] == ["f"]


def test_split_bundle_prunes_partitions(spark):
    d = tempfile.mkdtemp(prefix="lf-split-")
    df = spark.createDataFrame([(i, ["train", "val", "test"][i % 3]) for i in range(30)], "id long, split string")
    FS.write_split_bundle(df, os.path.join(d, "b"))
    t = FS.read_split(spark, os.path.join(d, "b"), "test")
    assert t.count() == 10
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "split" in plan


def test_run_log_best_run(spark):
    d = tempfile.mkdtemp(prefix="lf-runs-")
    p = os.path.join(d, "runs")
    RL.log_run(spark, p, "rf", {"depth": 5}, {"auc": 0.71}, {"stage": "cv"}, run_id="a")
    RL.log_run(spark, p, "gbt", {"depth": 3}, {"auc": 0.75}, {"stage": "cv"}, run_id="b")
    RL.log_run(spark, p, "gbt", {}, {"auc": 0.80}, {"stage": "test"}, run_id="c")
    runs = RL.read_runs(spark, p)
    assert RL.best_run(runs, "auc").first().run_id == "c"
    assert RL.best_run(runs, "auc", tag=("stage", "cv")).first().run_id == "b"
    assert RL.best_run(runs, "auc", ascending=True).first().run_id == "a"


def test_entity_ids(spark):
    df = spark.createDataFrame([(3,), (1,), (3,), (None,)], "k long")
    r = FS.entity_ids(df, "k").collect()
    assert [x.client_id for x in r] == [1, 3] and r[0].total == 2


def test_prepare_features_validation(spark):
    from ledgerfold.operators.scoring import prepare_features
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0)], "id long, a double, b double, TARGET double")
    out, names = prepare_features(df, ["b", "a"], "id")
    assert out.columns == ["id", "b", "a"]
    with pytest.raises(ValueError, match="12 features missing"):
        prepare_features(df, [f"m{i}" for i in range(12)], "id")
    _, names = prepare_features(df, None, "id", exclude=["TARGET"])
    assert names == ["a", "b"]
