"""Quantiles, describe, histogram, KDE and box statistics vs numpy."""

import math

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ledgerfold.operators import profile as P
from ledgerfold.operators.scan import running


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60),
       st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]))
def test_exact_quantile_matches_numpy(spark, values, p):
    df = spark.createDataFrame([(v,) for v in values], "x long")
    got = P.quantiles(df, "x", [p], names=["q"], n_buckets=4).first()["q"]
    assert math.isclose(got, float(np.quantile(values, p)), rel_tol=1e-12, abs_tol=1e-12)


def test_grouped_quantiles_with_hot_group(spark):
    rng = np.random.default_rng(1)
    hot = rng.integers(0, 1000, 3000)
    cold = rng.integers(0, 1000, 30)
    rows = [(0, int(v)) for v in hot] + [(1, int(v)) for v in cold]
    df = spark.createDataFrame(rows, "g int, x long")
    out = {r.g: r for r in P.quantiles(df, "x", [0.25, 0.5, 0.9], ["g"], n_buckets=16).collect()}
    for g, vals in ((0, hot), (1, cold)):
        for name, p in (("p25", 0.25), ("median", 0.5), ("p9", 0.9)):
            assert math.isclose(out[g][name], float(np.quantile(vals, p)))


def test_running_sum_and_max_match_pandas(spark):
    rng = np.random.default_rng(7)
    rows = [(int(k), i, float(v)) for i, (k, v) in enumerate(zip(rng.choice([0, 0, 0, 1, 2], 500),
                                                                rng.normal(size=500)))]
    df = spark.createDataFrame(rows, "k int, t long, v double")
    s = running(df, "t", ["v"], ["k"], op="sum", n_buckets=8).toPandas().sort_values("t")
    m = running(df, "t", ["v"], ["k"], op="max", inclusive=False, n_buckets=8, prefix="b_").toPandas().sort_values("t")
    pdf = df.toPandas().sort_values("t")
    exp_sum = pdf.groupby("k")["v"].cumsum()
    exp_prev_max = pdf.groupby("k")["v"].transform(lambda x: x.cummax().shift(1))
    assert np.allclose(s["cum_v"].to_numpy(), exp_sum.to_numpy())
    got = m.set_index("t")["b_v"].reindex(pdf["t"]).to_numpy(dtype=float)
    assert np.allclose(np.nan_to_num(got, nan=-99), np.nan_to_num(exp_prev_max.to_numpy(), nan=-99))


def test_histogram_matches_numpy(spark):
    vals = np.random.default_rng(3).normal(size=400)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    h = sorted((r.bin, r["count"]) for r in P.histogram(df, "x", 12).collect())
    counts, _ = np.histogram(vals, bins=12)
    got = [0] * 12
    for b, c in h:
        got[b] = c
    assert got == counts.tolist()


def test_kde_matches_brute_force(spark):
    vals = np.random.default_rng(5).integers(0, 50, 200)
    df = spark.createDataFrame([(int(v),) for v in vals], "x long")
    k = P.kde_grid(df, "x", 50, method="exact").toPandas().sort_values("grid")
    h = vals.std(ddof=1) * len(vals) ** -0.2
    grid = np.linspace(vals.min(), vals.max(), 50)
    exp = np.exp(-0.5 * ((grid[:, None] - vals[None, :]) / h) ** 2).sum(1) / (len(vals) * h * math.sqrt(2 * math.pi))
    assert np.allclose(k["density"].to_numpy(), exp, atol=1e-9)


def test_box_stats_and_describe(spark):
    vals = list(range(1, 21)) + [100]
    df = spark.createDataFrame([(v,) for v in vals], "x long")
    b = P.box_stats(df, "x").first()
    q1, q3 = np.quantile(vals, [0.25, 0.75])
    assert b.q1 == q1 and b.q3 == q3 and b.n_outliers == 1 and b.whisker_high == 20
    d = P.describe(df, ["x"]).first()
    assert d["count"] == 21 and math.isclose(d["std"], float(np.std(vals, ddof=1)))


def test_column_profile_and_null_rates(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "a")], "n int, s string")
    prof = {r.column: r for r in P.column_profile(df).collect()}
    assert prof["n"].non_null == 2 and math.isclose(prof["n"].null_rate, 1 / 3)
    assert prof["s"].n_distinct == 1 and prof["s"].mean is None
    nr = P.null_rates(df).collect()
    assert {r.column: r.n_null for r in nr} == {"n": 1, "s": 1}


def test_approx_paths_close_to_exact(spark):
    from ledgerfold.operators.correlation import corr_matrix
    rng = np.random.default_rng(9)
    x = rng.integers(0, 1000, 5000)
    y = x + rng.integers(0, 300, 5000)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y)], "x long, y long")
    ex = P.quantiles(df, "x", [0.5], names=["m"]).first().m
    ap = P.quantiles(df, "x", [0.5], names=["m"], method="approx").first().m
    assert abs(ex - ap) <= 0.01 * 1000
    prof_e = {r.column: r.n_distinct for r in P.column_profile(df).collect()}
    prof_a = {r.column: r.n_distinct for r in P.column_profile(df, distinct="approx").collect()}
    assert all(abs(prof_e[c] - prof_a[c]) <= 0.05 * prof_e[c] for c in prof_e)
    ce = {(r.a, r.b): r.corr for r in corr_matrix(df, ["x", "y"]).collect()}
    cf = {(r.a, r.b): r.corr for r in corr_matrix(df, ["x", "y"], exact=False).collect()}
    assert all(math.isclose(ce[k], cf[k], rel_tol=1e-9) for k in ce)
    assert math.isclose(ce[("x", "y")], float(np.corrcoef(x, y)[0, 1]), rel_tol=1e-12)


def test_kde_error_bound_and_wide_corr(spark, monkeypatch):
    from ledgerfold.operators import correlation as C
    vals = np.random.default_rng(4).normal(size=3000)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    ex = P.kde_grid(df, "x", 5000, method="exact").toPandas().sort_values("grid")["density"].to_numpy()
    h = vals.std(ddof=1) * len(vals) ** -0.2
    for bins in (16, 64):
        ap = P.kde_grid(df, "x", 5000, bins_per_bandwidth=bins).toPandas().sort_values("grid")["density"].to_numpy()
        assert 0 < np.abs(ex - ap).max() <= 1 / (8 * bins ** 2 * h * math.sqrt(2 * math.pi))
    cols = ["a", "b", "c", "d"]
    m = np.random.default_rng(2).integers(0, 100, (200, 4))
    d = spark.createDataFrame([tuple(int(v) for v in r) for r in m], ", ".join(f"{c} long" for c in cols))
    one = {(r.a, r.b): r.corr for r in C.corr_matrix(d, cols).collect()}
    monkeypatch.setattr(C, "PAIRS_PER_PASS", 3)
    many = {(r.a, r.b): r.corr for r in C.corr_matrix(d, cols).collect()}
    assert one == many and len(one) == 10


def test_profile_chunks_equal_single_pass(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a", 2.0), (2, None, None), (None, "a", 3.0)], "n int, s string, d double")
    one = sorted(tuple(r) for r in P.column_profile(df).collect())
    nr1 = sorted(tuple(r) for r in P.null_rates(df).collect())
    monkeypatch.setattr(P, "COLUMNS_PER_PASS", 1)
    assert sorted(tuple(r) for r in P.column_profile(df).collect()) == one
    assert sorted(tuple(r) for r in P.null_rates(df).collect()) == nr1


def test_running_without_partition_all_ops(spark):
    rng = np.random.default_rng(21)
    vals = rng.normal(size=800)
    vals[rng.integers(0, 800, 40)] = np.nan
    pdf = {"t": np.arange(800), "v": vals}
    df = spark.createDataFrame([(int(t), None if np.isnan(v) else float(v)) for t, v in zip(*pdf.values())],
                               "t long, v double")
    s = np.array(vals)
    for op, inclusive in (("sum", True), ("max", True), ("min", False)):
        got = running(df, "t", ["v"], op=op, inclusive=inclusive, n_ranges=13).toPandas().sort_values("t")
        ser = __import__("pandas").Series(s)
        if op == "sum":
            exp = ser.fillna(0).cumsum()
        elif op == "max":
            exp = ser.cummax().ffill()
        else:
            exp = ser.cummin().ffill().shift(1)
        a = got["cum_v"].to_numpy(dtype=float)
        assert np.allclose(np.nan_to_num(a, nan=-99.0), np.nan_to_num(exp.to_numpy(dtype=float), nan=-99.0)), op
