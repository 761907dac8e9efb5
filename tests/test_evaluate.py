"""Metrics vs brute force: AUC by pairs, AP by definition, sweep by loop."""

import math

import numpy as np
from hypothesis import given, settings, strategies as st

from ledgerfold.operators import evaluate as V


def brute_auc(y, s):
    pos = [a for a, t in zip(s, y) if t == 1]
    neg = [a for a, t in zip(s, y) if t == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def brute_ap(y, s):
    y, s = np.asarray(y), np.asarray(s)
    P = y.sum()
    ap, prev_r = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        pred = s >= t
        tp = (pred & (y == 1)).sum()
        prec = tp / pred.sum()
        rec = tp / P
        ap += (rec - prev_r) * prec
        prev_r = rec
    return ap


scored = st.lists(st.tuples(st.integers(0, 1), st.integers(0, 20)), min_size=4, max_size=60).filter(
    lambda r: 0 < sum(y for y, _ in r) < len(r))


@settings(max_examples=15, deadline=None)
@given(scored)
def test_auc_and_ap_match_brute_force(spark, rows):
    y = [a for a, _ in rows]
    s = [b / 20 for _, b in rows]
    df = spark.createDataFrame(list(zip(y, s)), "label int, score double")
    assert math.isclose(V.roc_auc(df).first().roc_auc, brute_auc(y, s), rel_tol=1e-12)
    assert math.isclose(V.average_precision(df).first().average_precision, brute_ap(y, s), abs_tol=1e-11)


def test_linspace_equals_numpy():
    assert V.linspace_thresholds(100) == np.linspace(0, 1, 100).tolist()


@settings(max_examples=10, deadline=None)
@given(scored)
def test_cost_curve_matches_loop(spark, rows):
    y = np.array([a for a, _ in rows])
    s = np.array([b / 20 for _, b in rows])
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    got = {r.threshold: r.cost for r in V.cost_curve(df).collect()}
    ts = np.linspace(0, 1, 100)
    costs = []
    for t in ts:
        pred = s >= t
        fn = ((~pred) & (y == 1)).sum()
        fp = (pred & (y == 0)).sum()
        costs.append(10.0 * fn + fp)
        assert got[float(t)] == costs[-1]
    best = V.optimal_threshold(df).first()
    assert best.optimal_threshold == float(ts[int(np.argmin(costs))])


def test_confusion_has_four_cells_with_one_class(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.9)], "label int, score double")
    r = V.classification_metrics(df).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (1, 1, 0, 0)
    assert r.precision == 0.0 and r.recall == 0.0 and r.f1 == 0.0 and r.accuracy == 0.5


def test_threshold_is_inclusive(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.49)], "label int, score double")
    r = V.confusion_counts(df, threshold=0.5).first()
    assert r.tp == 1 and r.tn == 1


def test_threshold_comparison_reduction(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.35), (0, 0.1), (0, 0.2), (0, 0.6)], "label int, score double")
    rows = {r.name: r for r in V.threshold_comparison(df).collect()}
    assert rows["optimal"].business_cost <= rows["default"].business_cost
    assert rows["default"].cost_reduction_pct == 0.0


def test_grouped_optimal_threshold_matches_per_group(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), int(y), float(s)) for g, y, s in zip(rng.integers(0, 3, 300), rng.integers(0, 2, 300),
                                                          rng.integers(0, 100, 300) / 100)]
    df = spark.createDataFrame(rows, "fold int, label int, score double")
    got = {r.fold: (r.optimal_threshold, r.optimal_cost)
           for r in V.optimal_threshold(df, groups=["fold"]).collect()}
    for f in range(3):
        one = V.optimal_threshold(df.where(f"fold = {f}")).first()
        assert got[f] == (one.optimal_threshold, one.optimal_cost)
