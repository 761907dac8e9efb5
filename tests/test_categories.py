"""Encodings of any number of categories, wide and long."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerfold.operators import encode as N
from ledgerfold.plans import features as FE


@pytest.fixture(scope="module")
def many(spark):
    rng = np.random.default_rng(8)
    cat = np.where(rng.random(20000) < 0.35, 0, rng.integers(0, 5000, 20000))     # one category holds a third
    df = pd.DataFrame({"id": np.arange(20000), "k": rng.integers(0, 40, 20000), "c": [f"c{v}" if v % 7 else None for v in cat]})
    return spark.createDataFrame(df).repartition(5), df


def _shares(pdf):
    n = pdf.groupby("k").size()
    return {(k, v): m / n[k] for (k, v), m in pdf.dropna().groupby(["k", "c"]).size().items()}


def test_factorize_without_a_bound(many):
    sdf, pdf = many
    codes, _ = pd.factorize(pdf.c)
    got = N.factorize(sdf, "c", "id", "code").toPandas().sort_values("id")
    assert (got.code.to_numpy() == codes).all()
    out, used = N.factorize_many(sdf, ["c"], "id", max_categories=100)
    assert not isinstance(used["c"], dict) and (out.toPandas().sort_values("id").c.to_numpy() == codes).all()
    small, used = N.factorize_many(sdf, ["c"], "id")
    assert isinstance(used["c"], dict) and (small.toPandas().sort_values("id").c.to_numpy() == codes).all()


def test_a_million_categories(spark):
    n = 1_000_000
    df = spark.range(2 * n).select("id", F.concat(F.lit("v"), (F.col("id") * 7919 % n).cast("string")).alias("c"), (F.col("id") % 50).alias("k"))
    codes = N.ordinal_codes(df, "c", "id")
    r = codes.agg(F.count("*").alias("n"), F.min("code").alias("lo"), F.max("code").alias("hi"), F.count_distinct("code").alias("d")).first()
    assert (r.n, r.lo, r.hi, r.d) == (n, 0, n - 1, n)
    # the first million rows are all different, so their ids are their codes
    assert N.coded(df.where(F.col("id") < n), "c", codes, "code").where("code <> id").count() == 0
    s = N.category_share_long(df, ["k"], "c").groupBy("k").agg(F.sum("share").alias("s"), F.sum("n").alias("n"))
    assert all(abs(r.s - 1) < 1e-6 and r.n == 2 * n // 50 for r in s.collect())


def test_vocabularies_and_the_bound(many):
    sdf, pdf = many
    values = sorted(pdf.c.dropna().unique())
    assert N.collect_vocabularies(sdf, ["c"])["c"] == values == N.vocabulary(sdf, "c")
    both = N.small_vocabularies(sdf.withColumn("d", F.col("k").cast("string")), ["c", "d"], 100)
    assert both["c"] is None and both["d"] == sorted(map(str, range(40)))
    with pytest.raises(ValueError):
        N.vocabulary(sdf, "c", 100)


def test_wide_one_hot(many):
    sdf, pdf = many
    out, names = N.one_hot(sdf, ["c"])
    assert len(names) == pdf.c.nunique() + 1
    one = out.where("id = 5").first()
    assert sum(one[n] for n in names) == 1 and one["c_nan" if pdf.c[5] is None else f"c_{pdf.c[5]}"] == 1


def test_one_hot_beyond_the_bound(many):
    sdf, pdf = many
    out, names = N.one_hot(sdf, ["c"], max_categories=100)
    assert names == ["c_CODE"] and out.columns == ["id", "k", "c_CODE"]
    values = {v: i for i, v in enumerate(sorted(pdf.c.dropna().unique()))}
    got = out.toPandas().sort_values("id").c_CODE.tolist()
    assert got == [values.get(v, -1) for v in pdf.c]


def test_sparse_one_hot(many):
    sdf, pdf = many
    places, entries = N.sparse_one_hot(sdf, ["id"], ["c", "k"])
    order = {("c", v): i for i, v in enumerate([*sorted(pdf.c.dropna().unique()), None])}
    order.update({("k", v): len(order) + i for i, v in enumerate(sorted(map(str, pdf.k.unique())))})
    assert {(r["column"], r["value"]): r["index"] for r in places.collect()} == order
    got = entries.groupBy("id").agg(F.sort_array(F.collect_list("index")).alias("i")).toPandas().sort_values("id").i
    assert [list(i) for i in got] == [sorted([order["c", c], order["k", str(k)]]) for c, k in zip(pdf.c, pdf.k, strict=True)]
    assert N.sparse_one_hot(sdf, ["id"], ["c"], nan_as_category=False)[1].count() == pdf.c.notna().sum()


@pytest.mark.parametrize("bound", [10_000, 1000])
def test_pipelines_with_many_categories(spark, many, bound):
    """Shares of 5000 categories: as columns within the bound, as maps beyond."""
    sdf, pdf = many
    pos = sdf.select(F.col("k").alias("SK_ID_CURR"), F.col("id").alias("SK_ID_PREV"), (-F.col("id")).alias("MONTHS_BALANCE"),
                     F.lit(0).alias("SK_DPD"), F.lit(0).alias("SK_DPD_DEF"), F.col("c").alias("NAME_CONTRACT_STATUS"))
    want = _shares(pdf)
    out = FE.pos_features(pos, max_categories=bound)
    for r in out.collect():
        assert r.POS_COUNT == (pdf.k == r.SK_ID_CURR).sum()
        assert abs(r.POS_NAME_CONTRACT_STATUS_nan_MEAN - pdf.c[pdf.k == r.SK_ID_CURR].isna().mean()) < 1e-12
        own = {v: s for (k, v), s in want.items() if k == r.SK_ID_CURR}
        if bound == 1000:
            assert r.POS_NAME_CONTRACT_STATUS_SHARES == own
        else:
            assert all(r[f"POS_NAME_CONTRACT_STATUS_{v}_MEAN"] == own.get(v, 0.0) for v in pdf.c.dropna().unique())


def test_nested_shares_beyond_the_bound(spark):
    bureau = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, 9)], "SK_ID_BUREAU long, SK_ID_CURR long").withColumn("DAYS_CREDIT", F.lit(-1))
    bb = spark.createDataFrame([(1, 0, "a"), (1, -1, "b"), (2, 0, "a"), (3, 0, None), (3, -1, "c")], "SK_ID_BUREAU long, MONTHS_BALANCE int, STATUS string")
    wide = {r.SK_ID_CURR: r for r in FE.bureau_features(bureau, bb).collect()}
    long = {r.SK_ID_CURR: r for r in FE.bureau_features(bureau, bb, max_categories=2).collect()}
    assert long[7].BURO_STATUS_SHARES_MEAN == {"a": 0.75, "b": 0.25} and long[8].BURO_STATUS_SHARES_MEAN == {"c": 0.5}
    assert long[9].BURO_STATUS_SHARES_MEAN is None
    for k, r in long.items():
        assert r.BURO_STATUS_nan_MEAN_MEAN == wide[k].BURO_STATUS_nan_MEAN_MEAN
        assert all(wide[k][f"BURO_STATUS_{v}_MEAN_MEAN"] == s for v, s in (r.BURO_STATUS_SHARES_MEAN or {}).items())
