"""Null-safety traps (survey §0) on hand-made frames."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerfold.functions import (
    clean_names, clip_lower, cut_right_closed, not_equal_keep_null, rowwise_max, rowwise_mean,
    rowwise_min, rowwise_product, rowwise_std, safe_divide, sentinel_to_null)
from ledgerfold.functions.names import clean_name


def test_filter_keeps_nulls(spark):
    df = spark.createDataFrame([("M",), ("XNA",), (None,), ("F",)], "g string")
    out = sorted((r.g or "") for r in df.where(not_equal_keep_null("g", "XNA")).collect())
    assert out == ["", "F", "M"]


def test_safe_divide_zero_cases(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (6.0, 3.0), (None, 2.0), (-2.0, 0.0)],
                               "n double, d double")
    r = df.select(safe_divide("n", "d").alias("q"), safe_divide("n", "d", fill=-9.0).alias("f")).collect()
    assert [x.q for x in r] == [None, None, 2.0, None, None]
    assert [x.f for x in r] == [-9.0, None, 2.0, None, -9.0]


def test_clip_keeps_null_and_sentinel(spark):
    df = spark.createDataFrame([(-3,), (None,), (5,), (365243,)], "x int")
    r = df.select(clip_lower("x", 0).alias("c"), sentinel_to_null("x", 365243).alias("s")).collect()
    assert [x.c for x in r] == [0, None, 5, 365243]
    assert [x.s for x in r] == [-3, None, 5, None]


def test_cut_right_closed_excludes_lowest_edge(spark):
    df = spark.createDataFrame([(0.0,), (25.0,), (25.5,), (35.0,), (65.0,), (100.5,), (None,)], "y double")
    r = df.select(cut_right_closed("y", [0, 25, 35, 65, 100], ["a", "b", "c", "d"]).alias("b")).collect()
    assert [x.b for x in r] == [None, "a", "b", "b", "c", None, None]


def test_rowwise_stats_skip_nulls(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None), (2.0, 2.0, 2.0), (1.0, None, None)],
                               "a double, b double, c double")
    cols = ["a", "b", "c"]
    r = df.select(rowwise_mean(cols).alias("m"), rowwise_min(cols).alias("lo"), rowwise_max(cols).alias("hi"),
                  rowwise_std(cols).alias("s"), rowwise_product(cols).alias("p")).collect()
    assert r[0].m == 2.0 and r[0].lo == 1.0 and r[0].hi == 3.0 and math.isclose(r[0].s, math.sqrt(2))
    assert r[0].p is None
    assert r[1].m is None and r[1].lo is None and r[1].s is None
    assert r[2].s == 0.0 and r[2].p == 8.0
    assert r[3].s is None  # one value: sample std undefined


def test_clean_names_and_collision(spark):
    assert clean_name("BURO_CREDIT_TYPE_4-NOT SPECIFIED_MEAN") == "BURO_CREDIT_TYPE_4_NOT_SPECIFIED_MEAN"
    assert clean_name("__a  b__") == "a_b"
    df = spark.createDataFrame([(1, 2)], "`a b` int, `a-b` int")
    with pytest.raises(ValueError):
        clean_names(df)


def test_one_hot_share_counts_null_as_zero(spark):
    from ledgerfold.operators.encode import category_share
    df = spark.createDataFrame([(1, "x"), (1, None), (1, "y"), (2, None)], "k int, c string")
    r = {x.k: x for x in df.groupBy("k").agg(*category_share("c", ["x", "y"], True)).collect()}
    assert math.isclose(r[1]["c_x_MEAN"], 1 / 3) and math.isclose(r[1]["c_nan_MEAN"], 1 / 3)
    assert r[2]["c_x_MEAN"] == 0.0 and r[2]["c_nan_MEAN"] == 1.0


def test_factorize_first_appearance(spark):
    from ledgerfold.operators.encode import factorize, factorize_many
    df = spark.createDataFrame([(3, "b"), (1, "a"), (2, None), (4, "b"), (0, "c")], "k int, g string")
    r = dict(factorize(df, "g", "k").select("k", "g").collect())
    assert r == {0: 0, 1: 1, 3: 2, 4: 2, 2: -1}
    r2 = dict(factorize_many(df, ["g"], "k")[0].select("k", "g").collect())
    assert r2 == r
