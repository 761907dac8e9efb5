"""Lazy running scans, thresholds without a cap, moments beyond 38 digits."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerfold.functions.nullsafe import exact_var_samp
from ledgerfold.operators import correlation as C
from ledgerfold.operators import evaluate as V
from ledgerfold.operators import profile as P
from ledgerfold.operators.joins import bounded_broadcast
from ledgerfold.operators.scan import place, range_edges, running


def jobs_of(spark, build):
    """Jobs that run while ``build`` makes its plan."""
    group = f"plan-{random.random()}"
    spark.sparkContext.setJobGroup(group, "plan")
    out = build()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(jobs)


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(2)
    df = pd.DataFrame({"label": (rng.random(3000) < 0.3).astype(int), "score": rng.random(3000).round(3), "fold": rng.integers(0, 3, 3000)})
    return spark.createDataFrame(df).repartition(5), df


@pytest.mark.parametrize("build", [
    lambda d: P.quantiles(d, "score", [0.5]), lambda d: P.quantiles(d, "score", [0.25, 0.5], ["fold"]), lambda d: V.roc_auc(d),
    lambda d: V.average_precision(d), lambda d: V.roc_points(d), lambda d: V.pr_points(d), lambda d: V.cost_curve(d),
    lambda d: running(d, "score", ["label"], ["fold"]), lambda d: C.spearman(d, "score", "label")])
def test_nothing_runs_while_planning(spark, scored, build):
    df, n = jobs_of(spark, lambda: build(scored[0]))
    assert n == 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD[_piece" not in plan and "rangepartitioning" not in plan and "CartesianProduct" not in plan


def test_rows_are_exchanged_once(spark, scored):
    """The scanned rows move by (group, piece); besides that only the sketch
    and the pieces' totals do."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = running(scored[0], "score", ["label"], ["fold"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(_key#") <= 3      # rows, totals, their sums
    assert "SinglePartition" in plan                                        # the sketch's cells


@pytest.mark.parametrize("values", [
    [0] * 50, list(range(200)), [1] * 300 + list(range(20)), [float("nan"), 1.0, -0.0, 0.0, float("inf"), None, float("-inf")] * 3,
    ["b", "", None, "aé", "ab", "a"] * 7, []])
def test_running_sum_any_values(spark, values):
    kind = "string" if "b" in values else "double"
    rows = [(i, float(v) if v is not None and kind == "double" else v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i long, v {kind}").withColumn("one", F.lit(1)).repartition(3)
    got = running(df, "v", ["one"], tie_cols=["i"], n_ranges=8).orderBy(F.asc_nulls_first("v"), "i").collect()
    assert [r.cum_one for r in got] == list(range(1, len(rows) + 1))
    whole = running(df, "v", ["one"], tie_cols=["i"], n_ranges=8, total_prefix="all_").select("all_one").distinct().collect()
    assert [r.all_one for r in whole] == ([len(rows)] if rows else [])


def test_edges_do_not_depend_on_the_layout(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 4999).alias("v"))
    edges = [d.limit(1).select(range_edges(d, F.col("v"), 16).alias("e")).first().e for d in (df.repartition(1), df.repartition(7), df.orderBy("v"))]
    assert edges[0] == edges[1] == edges[2] and edges[0] == sorted(set(edges[0]))
    sizes = place(df, F.col("v"), range_edges(df, F.col("v"), 16), 15, "p").groupBy("p").count().collect()
    assert max(r["count"] for r in sizes) < 3 * 5000 / 16


def test_running_in_a_hot_group_and_null_groups(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": rng.choice([0, 0, 0, 1, 2], 4000), "t": rng.permutation(4000), "v": rng.integers(-9, 9, 4000)})
    df = spark.createDataFrame(pdf).withColumn("g", F.nullif("g", F.lit(2)))
    got = running(df, "t", ["v"], ["g"], n_ranges=16, total_prefix="all_").toPandas().sort_values("t")
    pdf = pdf.sort_values("t")
    assert (got.cum_v.to_numpy() == pdf.groupby("g").v.cumsum().to_numpy()).all()
    assert (got.all_v.to_numpy() == pdf.groupby("g").v.transform("sum").to_numpy()).all()


def test_a_hundred_thousand_thresholds(spark, scored):
    sdf, pdf = scored
    ts = [i / 100_000 for i in range(100_001)]
    got = V.cost_curve(sdf, thresholds=ts).toPandas().sort_values("threshold")
    assert len(got) == len(ts) and (got.threshold.to_numpy() == np.array(ts)).all()
    pos, neg = np.sort(pdf.score[pdf.label == 1]), np.sort(pdf.score[pdf.label == 0])
    assert (got.fn.to_numpy() == np.searchsorted(pos, ts, side="left")).all()
    assert (got.fp.to_numpy() == len(neg) - np.searchsorted(neg, ts, side="left")).all()
    best = V.optimal_threshold(sdf, thresholds=ts, groups=["fold"]).collect()
    assert len(best) == 3


def test_spearman_matches_ranks(spark):
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 30, 800), rng.normal(size=800).round(1)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    want = np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1]
    r = C.spearman(df, "x", "y").first()
    assert r.n == 800 and math.isclose(r.spearman, want, rel_tol=1e-12)
    assert C.spearman(df.where("x < 0"), "x", "y").first().asDict() == {"spearman": None, "n": 0}


def test_spearman_of_very_many_rows(spark):
    # 10^11 rows as counts: the moments pass 38 digits unless ranks are centred
    c = 10 ** 11 // 4
    d = spark.createDataFrame([(0, 0, c), (0, 1, c), (1, 1, c), (2, 2, c)], "x long, y long, _c long")
    want = np.corrcoef([1.5, 1.5, 3, 4], [1, 2.5, 2.5, 4])[0, 1]
    r = C.spearman_of_counts(d, "x", "y").first()
    assert r.n == 10 ** 11 and math.isclose(r.spearman, want, rel_tol=1e-12)


def test_moments_beyond_38_digits(spark):
    values = [10 ** 18 + i * 10 ** 16 for i in range(50)]
    df = spark.createDataFrame([(v, -v // 3) for v in values * 40], "x long, y long")
    r = df.agg(exact_var_samp("x").alias("v"), C.corr_expr(F.col("x"), F.col("y"), True).alias("c")).first()
    assert math.isclose(r.v, float(np.var(np.array(values * 40, dtype=float), ddof=1)), rel_tol=1e-6) and math.isclose(r.c, -1, rel_tol=1e-9)
    big = spark.createDataFrame([(2 ** 62,), (-2 ** 62,), (2 ** 62,)], "x long").agg(exact_var_samp("x").alias("v")).first().v
    assert math.isclose(big, float(np.var(np.array([2.0 ** 62, -2.0 ** 62, 2.0 ** 62]), ddof=1)), rel_tol=1e-12)


def test_broadcast_is_bounded_in_bytes(spark):
    df = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("s"), F.array("id").alias("a"))
    assert "ResolvedHint" in bounded_broadcast(df)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in bounded_broadcast(df, max_bytes=5000)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in bounded_broadcast(df, max_rows=5)._jdf.queryExecution().analyzed().toString()
