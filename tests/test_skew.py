"""Hot keys: one key holds a large share of the rows; answers must equal a
brute force, whatever the bucketing."""

import numpy as np
import pandas as pd
import pytest

from ledgerfold.operators import ordering as O
from ledgerfold.operators import scoring as J
from ledgerfold.operators.aggregate import grouped_agg
from ledgerfold.operators.sampling import hash_rank


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(11)
    n = 6000
    ent = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 50, n))   # entity 0: ~40 % of rows
    df = pd.DataFrame({"ent": ent.astype("int64"), "item": np.arange(n, dtype="int64"),
                       "v": rng.integers(-1000, 1000, n).astype("int64")})
    return spark.createDataFrame(df), df


def test_top_n_per_hot_entity(spark, skewed):
    sdf, pdf = skewed
    got = O.top_n_per_entity(sdf, "ent", "v", "item", n=7, n_buckets=32).toPandas()
    pdf = pdf.assign(a=pdf.v.abs()).sort_values(["ent", "a", "item"], ascending=[True, False, True])
    exp = pdf.groupby("ent").head(7)
    assert sorted(zip(got.ent, got.item)) == sorted(zip(exp.ent, exp.item))
    assert got.groupby("ent")["rank"].max().le(7).all()


def test_running_best_hot_entity(spark, skewed):
    sdf, pdf = skewed
    got = O.running_best(sdf, "item", "v", ["ent"], n_ranges=16).toPandas().sort_values("item")
    exp = pdf.sort_values("item").groupby("ent")["v"].cummax()
    assert (got["best_so_far"].to_numpy() == exp.to_numpy()).all()


def test_best_by_and_aggregate_hot_group(spark, skewed):
    sdf, pdf = skewed
    best = {r.ent: (r.item, r.v) for r in J.best_by(sdf, ["ent"], "v", "item").collect()}
    for e, g in pdf.groupby("ent"):
        top = g.sort_values(["v", "item"], ascending=[False, True]).iloc[0]
        assert best[e] == (top["item"], top["v"])
    agg = {r.ent: r for r in grouped_agg(sdf, "ent", {"v": ["sum", "var", "nunique"]}).collect()}
    g0 = pdf[pdf.ent == 0].v
    assert agg[0].v_SUM == g0.sum() and agg[0].v_NUNIQUE == g0.nunique()
    assert np.isclose(agg[0].v_VAR, g0.var())


def test_hash_rank_hot_stratum(spark, skewed):
    sdf, pdf = skewed
    r = hash_rank(sdf, ["item"], ["ent"], n_buckets=8).toPandas()
    for e, g in r.groupby("ent"):
        assert sorted(g._rank) == list(range(len(g)))
