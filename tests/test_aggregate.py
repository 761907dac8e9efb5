"""Spec-driven aggregation against a pandas brute force, plus null rules."""

import math

import pandas as pd
from pyspark.sql import functions as F

from ledgerfold.operators.aggregate import grouped_agg


def _frame(spark):
    rows = [(1, 10, 5.5, "O"), (1, 20, None, "F"), (1, None, 1.5, "O"), (2, 7, None, "F"),
            (3, None, None, "F"), (4, 4, 2.0, "O")]
    return spark.createDataFrame(rows, "k int, a long, b double, s string")


def test_spec_matches_pandas(spark):
    df = _frame(spark)
    spec = {"a": ["min", "max", "mean", "sum", "var", "size", "nunique"], "b": ["mean", "sum", "var"]}
    out = {r.k: r for r in grouped_agg(df, "k", spec, prefix="P_").collect()}
    pdf = df.toPandas()
    g = pdf.groupby("k")
    for k, grp in g:
        r = out[k]
        assert r.P_a_MIN == (None if grp.a.isna().all() else grp.a.min())
        assert r.P_a_SUM == grp.a.sum()          # all-null group sums to 0
        assert r.P_b_SUM == grp.b.sum()
        assert r.P_a_SIZE == len(grp)
        assert r.P_a_NUNIQUE == grp.a.nunique()
        for col in ("a", "b"):
            exp_mean, exp_var = grp[col].mean(), grp[col].var()
            got_mean, got_var = r[f"P_{col}_MEAN"], r[f"P_{col}_VAR"]
            assert (got_mean is None) == pd.isna(exp_mean)
            assert got_mean is None or math.isclose(got_mean, exp_mean)
            assert (got_var is None) == pd.isna(exp_var)   # one value -> null
            assert got_var is None or math.isclose(got_var, exp_var)


def test_subset_null_when_no_row_zero_when_all_null(spark):
    df = _frame(spark)
    out = {r.k: r for r in grouped_agg(
        df, "k", {}, subsets={"ACTIVE_": F.col("s") == "O"},
        subset_spec={"a": ["sum", "size", "mean"], "b": ["sum"]}).collect()}
    assert out[2].ACTIVE_a_SUM is None and out[2].ACTIVE_a_SIZE is None   # no active row
    assert out[1].ACTIVE_a_SUM == 10 and out[1].ACTIVE_a_SIZE == 2
    assert out[1].ACTIVE_b_SUM == 7.0
    assert out[4].ACTIVE_a_MEAN == 4.0


def test_nunique_of_any_numbers_without_a_row_per_small_one(spark):
    import re
    rows = [(k, v) for k, vs in {1: [0, 62, 62, 5], 2: [63, -1, 64, 63, 3], 3: [None], 4: [1 << 62, -(1 << 62), None, 0]}.items() for v in vs]
    df = spark.createDataFrame(rows, "k int, a long").repartition(3)
    agg = grouped_agg(df, "k", {"a": ["nunique", "sum"]}, subsets={"POS_": F.col("a") > 0}, subset_spec={"a": ["nunique"]})
    assert {r.k: (r.a_NUNIQUE, r.POS_a_NUNIQUE) for r in agg.collect()} == {1: (3, 2), 2: (4, 3), 3: (0, None), 4: (3, 1)}
    assert agg.schema["a_NUNIQUE"].dataType.simpleString() == "bigint"
    # all partial results would move once per value of a
    plan = grouped_agg(df, "k", {"a": ["nunique", "sum"]})._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(k#\d+, a#\d+", plan)
