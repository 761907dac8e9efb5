"""Linear learner from statistics, wide correlation, run log, stream without state."""

import os
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerfold.operators import correlation as C
from ledgerfold.operators import linear as L
from ledgerfold.operators import scoring as J
from ledgerfold.sources import runlog as RL
from ledgerfold.streaming.scoring_stream import answered, read_decisions, start_scoring_stream


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    df = pd.DataFrame({"id": np.arange(600), "a": rng.integers(-50, 50, 600), "b": rng.normal(size=600), "c": 7, "fold": rng.integers(0, 4, 600)})
    df["y"] = ((df.a + 20 * df.b + rng.normal(size=600) * 10) > 0).astype(int)
    return spark.createDataFrame(df).repartition(4), df


def _lstsq(df, cols):
    x = np.column_stack([np.ones(len(df)), df[cols]])
    return np.linalg.lstsq(x, df.y.to_numpy(float), rcond=None)[0]


def test_leave_fold_out_equals_refitting(rows):
    sdf, pdf = rows
    models = L.leave_fold_out(sdf, ["a", "b", "c"], "y", "fold")
    assert sorted(models) == [0, 1, 2, 3]
    for f, w in models.items():
        want = _lstsq(pdf[pdf.fold != f], ["a", "b"])
        assert np.allclose(w[:3], want) and w[3] == 0          # a feature that does not vary
    oof = L.out_of_fold_scores(sdf, ["a", "b", "c"], "y", "fold").toPandas()
    for r in oof.sample(20, random_state=1).itertuples():
        w = models[r.fold]
        assert np.isclose(r.score, min(max(w[0] + w[1] * r.a + w[2] * r.b, 0), 1))
    m = L.cross_validate(sdf, ["a", "b"], "y", "fold").toPandas()
    assert len(m) == 4 and (m.roc_auc > 0.9).all() and (m.tn + m.fp + m.fn + m.tp).sum() == 600


def test_statistics_are_exact_and_take_one_pass(spark):
    df = spark.createDataFrame([(10 ** 15 + i, i % 2, i % 3) for i in range(90)], "x long, y int, fold int")
    r = L.statistics(df, ["x"], "y").first()
    assert int(r.c_0_0) == sum((10 ** 15 + i) ** 2 for i in range(90))
    assert L.statistics(df, ["x"], "y", "fold")._jdf.queryExecution().executedPlan().toString().count("Scan") <= 1
    w = L.leave_fold_out(df, ["x"], "y", "fold")
    assert all(abs(v[0] + v[1] * (10 ** 15 + 45) - 0.5) < 0.05 for v in w.values())
    assert L.leave_fold_out(df.where("x < 0"), ["x"], "y", "fold") == {}
    with pytest.raises(ValueError):
        L.leave_fold_out(spark.range(1200).selectExpr("id", "1 as y"), ["id"], "y", "id")


def test_scoring_by_a_stored_model(spark, rows, tmp_path):
    sdf, pdf = rows
    L.save_model(L.fit(sdf, ["a", "b"], "y", l2=0.1), f"{tmp_path}/model")
    model = L.load_model(spark, f"{tmp_path}/model")
    requests = spark.createDataFrame([(1,), (2,), (2,), (9999,)], "id long")
    got = {r.id: r for r in L.score_requests(requests, sdf.withColumn("b", F.when(F.col("id") != 2, F.col("b"))), model, "id").collect()}
    w = {r.feature: r.coefficient for r in model.collect()}
    assert set(got) == {1, 2, 9999} and got[9999].status == "not found" and got[9999].probability is None
    assert np.isclose(got[2].probability, min(max(w["intercept"] + w["a"] * pdf.a[2], 0), 1))       # null counts as 0
    assert got[1].prediction == int(got[1].probability >= 0.475) and got[1].threshold == got[9999].threshold == 0.475
    with pytest.raises(ValueError, match="missing"):
        L.score_requests(requests, sdf.drop("a"), model, "id")
    with pytest.raises(ValueError, match="intercept"):
        L.score_requests(requests, sdf, model.where("feature <> 'intercept'"), "id")


def test_baselines_under_cross_validation(rows):
    sdf, pdf = rows
    m = J.baseline_cross_validation(sdf, "fold", ["prior", "most_frequent", "stratified"], label="y", key="id").toPandas()
    assert len(m) == 12 and (m.groupby("fold")[["tn", "fp", "fn", "tp"]].sum().sum(axis=1) == 3 * pdf.groupby("fold").size()).all()
    with pytest.raises(ValueError):
        J.baseline_cross_validation(sdf, "fold", ["uniform"], label="y")


def test_gram_matrix_matches_pandas(spark):
    rng = np.random.default_rng(1)
    df = pd.DataFrame({f"i{k}": rng.integers(-10 ** (2 * k + 1), 10 ** (2 * k + 1), 500) for k in range(8)})
    df["f"], df["g"], df["const"] = rng.normal(size=500), rng.normal(size=500) + 1e6, 5
    rows = [tuple(None if rng.random() < 0.1 else (int(v) if isinstance(v, (int, np.integer)) or float(v).is_integer() and abs(v) > 3 else float(v)) for v in r) for r in df.itertuples(index=False)]
    schema = ", ".join(f"{c} {'double' if c in 'fg' else 'long'}" for c in df.columns)
    sdf = spark.createDataFrame([tuple(float(v) if v is not None and c in "fg" else v for v, c in zip(r, df.columns)) for r in rows], schema).repartition(3)
    want = pd.DataFrame(rows, columns=df.columns).astype(float).corr()
    got = {(r.a, r.b): r["corr"] for r in C.gram_matrix(sdf, df.columns).collect()}
    assert len(got) == len(df.columns) * (len(df.columns) + 1) // 2
    for (a, b), r in got.items():
        if "const" in (a, b):
            assert r is None
        else:
            assert np.isclose(r, want.loc[a, b], rtol=1e-9, atol=1e-9)


def test_wide_matrix_is_one_scan(spark):
    n = 763
    df = spark.range(200).select(*[((F.col("id") * (k + 7) + k) % (k + 11)).alias(f"c{k}") for k in range(n)])
    out = C.corr_matrix(df, df.columns)
    assert out._jdf.queryExecution().executedPlan().toString().count("Range (0, 200") == 1
    r = out.agg(F.count("*").alias("n"), F.max("corr").alias("m")).first()
    assert r.n == n * (n + 1) // 2 and abs(r.m - 1) < 1e-12


def test_writers_at_once_lose_nothing(spark, tmp_path):
    path = f"{tmp_path}/runs"
    threads = [threading.Thread(target=RL.log_run, args=(spark, path, f"m{i}", {"depth": i}, {"auc": 0.5 + i / 100}, {"stage": "cv" if i % 2 else "test"}, f"r{i}")) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    os.makedirs(f"{path}/commit=halfway/_temporary/0")           # a writer that died
    runs = RL.read_runs(spark, path)
    assert runs.count() == 18 and {r.run_id for r in runs.collect()} == {f"r{i}" for i in range(6)}
    assert RL.best_run(runs, "auc").first().run_id == "r5" and RL.best_run(runs, "auc", ascending=True).first().run_id == "r0"
    assert RL.best_run(runs, "auc", tag=("stage", "test")).first().run_id == "r4"
    assert RL.best_run(runs, "auc", True, ("stage", "cv")).first().run_id == "r1" and RL.best_run(runs, "f1").count() == 0


def test_stream_answers_late_and_repeated_ids_without_state(spark, tmp_path):
    days = [(1, 1, 20), (2, 2, 1), (1, 1, 1), (3, 1, 15), (2, 2, 25), (4, 9, 2), (1, 1, 28)]
    for i, (request, client, day) in enumerate(days):
        (spark.createDataFrame([(request, client, f"2024-01-{day:02d} 00:00:00")], "request_id long, client_id long, ts string")
         .withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/req/p={i}"))
    scored = spark.createDataFrame([(1, 0.9), (2, 0.1)], "client_id long, probability double")
    for _ in range(2):          # the second start finds nothing new
        q = start_scoring_stream(spark, f"{tmp_path}/req", scored, f"{tmp_path}/out", f"{tmp_path}/ck", max_files_per_trigger=1)
        q.awaitTermination()
        assert all(not p["stateOperators"] for p in map(lambda p: p if isinstance(p, dict) else p.__dict__.get("_jprogress") and {"stateOperators": p.stateOperators}, q.recentProgress) if p)
    out = read_decisions(spark, f"{tmp_path}/out").collect()
    assert sorted((r.request_id, r.status) for r in out) == [(1, "found"), (2, "found"), (3, "found"), (4, "not found")]
    assert answered(spark, f"{tmp_path}/out").where("bucket < 0 or bucket > 15").count() == 0
