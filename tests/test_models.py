"""Training, persistence, importance and Tree SHAP invariants."""

import math
import os
import tempfile

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ledgerfold.operators import attribution as A
from ledgerfold.operators import train as TR
from ledgerfold.plans.bind_models import document_features
from tests.conftest import SF01


@pytest.fixture(scope="module")
def data(spark):
    df, feats = document_features(spark, SF01)
    return df.cache(), feats


def test_gbt_shap_additivity_and_reload(spark, data):
    df, feats = data
    m = TR.fit(df, feats, "gbt", "label", maxIter=8, maxDepth=3)
    gbt = m.stages[-1]
    path = tempfile.mkdtemp(prefix="lf-model-")
    nodes = TR.tree_nodes(gbt, spark, os.path.join(path, "gbt"))
    ens = A.trees_from_nodes(nodes.toPandas(), "gbt", TR.tree_weights(gbt))
    prepared = m.transform(df).select("doc_id", "features", "rawPrediction").limit(20).toPandas()
    X = np.vstack([v.toArray() for v in prepared["features"]])
    phi, base = A.explain_rows(ens, X)
    raw = np.array([v[1] for v in prepared["rawPrediction"]])
    assert np.allclose(base + phi.sum(1), 2.0 * raw, atol=1e-6)
    # persistence: same scores after reload
    m.write().overwrite().save(os.path.join(path, "pipe"))
    again = PipelineModel.load(os.path.join(path, "pipe"))
    a = TR.score(m, df, ["doc_id"]).orderBy("doc_id").collect()
    b = TR.score(again, df, ["doc_id"]).orderBy("doc_id").collect()
    assert a == b
    imp = TR.split_gain_importance(nodes, TR.vector_feature_names(feats)).collect()
    assert all(r.total_gain >= 0 and r.split_count >= 1 for r in imp)


def test_rf_shap_probability_scale(spark, data):
    df, feats = data
    m = TR.fit(df, feats, "rf", "label", numTrees=5, maxDepth=3)
    rf = m.stages[-1]
    nodes = TR.tree_nodes(rf, spark, tempfile.mkdtemp(prefix="lf-rf-"))
    ens = A.trees_from_nodes(nodes.toPandas(), "rf", TR.tree_weights(rf))
    p = m.transform(df).select("features", "probability").limit(10).toPandas()
    X = np.vstack([v.toArray() for v in p["features"]])
    phi, base = A.explain_rows(ens, X)
    prob = np.array([v[1] for v in p["probability"]])
    assert np.allclose(base + phi.sum(1), prob, atol=1e-9)


def test_cv_and_search(spark, data):
    from ledgerfold.operators.sampling import stratified_kfold
    df, feats = data
    folds = stratified_kfold(df, ["doc_id"], "label", k=3)
    oof, m = TR.cross_validate(folds, feats, "lr", "fold", ["doc_id"], "label", maxIter=20)
    assert oof.count() == df.count() and m.count() == 3
    s = TR.cv_summary(m).first()
    assert 0.0 <= s.roc_auc_mean <= 1.0 and s.roc_auc_std >= 0.0
    t = TR.random_search(folds, feats, "rf", {"n_estimators": (5, 8), "max_depth": (2, 3)}, n_trials=2)
    rows = t.orderBy("trial").collect()
    assert rows[1].best_auc_so_far == max(rows[0].auc_mean, rows[1].auc_mean)


def test_param_mapping():
    sp, ignored = TR.spark_params("gbt", {"n_estimators": 462, "max_depth": 8, "learning_rate": 0.0235,
                                          "num_leaves": 41, "subsample": 0.855, "reg_alpha": 0.17})
    assert sp == {"maxIter": 462, "maxDepth": 8, "stepSize": 0.0235, "subsamplingRate": 0.855}
    assert set(ignored) == {"num_leaves", "reg_alpha"}


def test_shap_top_n_invariants(spark):
    import __spark_entry__ as E
    out = E.queries()["shap_top_n"](spark, SF01)
    rows = out.collect()
    assert rows and all(r.importance >= 0 and 1 <= r.rank <= 5 for r in rows)
    per = {}
    for r in rows:
        per.setdefault(r.doc_id, []).append(r)
    assert all(len(v) <= 5 for v in per.values())


def test_vectorised_tree_shap_equals_row_by_row(spark, data):
    df, feats = data
    m = TR.fit(df, feats, "gbt", "label", maxIter=6, maxDepth=4)
    gbt = m.stages[-1]
    nodes = TR.tree_nodes(gbt, spark, tempfile.mkdtemp(prefix="lf-vec-"))
    ens = A.collect_ensemble(nodes, "gbt", TR.tree_weights(gbt))
    X = np.vstack([v.toArray() for v in m.transform(df).select("features").limit(40).toPandas()["features"]])
    fast, b1 = A.explain_rows(ens, X, vectorised=True)
    slow, b2 = A.explain_rows(ens, X, vectorised=False)
    assert b1 == b2 and np.allclose(fast, slow, atol=1e-12)


def test_score_clients_end_to_end(spark, data):
    from ledgerfold.operators.scoring import score_clients
    df, feats = data
    m = TR.fit(df, feats, "lr", "label", maxIter=10)
    req = spark.createDataFrame([(int(r.doc_id),) for r in df.select("doc_id").limit(5).collect()]
                                + [(999999999,), (-1,)], "doc_id long")
    out = {r.doc_id: r for r in score_clients(m, df.drop("label"), feats, req, "doc_id").collect()}
    assert out[999999999].status == "not found" and out[-1].status == "not found"
    found = [r for r in out.values() if r.status == "found"]
    assert len(found) == 5
    assert all(0.0 <= r.probability <= 1.0 and r.prediction in (0, 1) and r.threshold == 0.475
               and r.recommendation for r in found)


def test_model_facts_invariants(spark, data):
    from ledgerfold.operators.scoring import THRESHOLD, model_facts
    df, feats = data
    m = TR.fit(df, feats, "gbt", "label", maxIter=3, maxDepth=2)
    r = model_facts(spark, m, feats, THRESHOLD).first()
    assert r.model_type == "GBTClassificationModel" and r.n_features == len(feats)
    assert r.optimal_threshold == 0.475 and len(r.feature_names) == min(10, len(feats))
    assert r.model_loaded is True


def _random_tree(rng, depth, n_features):
    """A tree of the given depth whose paths use features again."""
    left, right, feat, thr, val, cov = ([] for _ in range(6))

    def grow(level, cover):
        j = len(left)
        for column, v in ((left, -1), (right, -1), (feat, int(rng.integers(n_features))), (thr, float(rng.normal())), (val, float(rng.normal())), (cov, cover)):
            column.append(v)
        if level < depth and cover >= 2:
            part = int(rng.integers(1, cover))
            left[j], right[j] = grow(level + 1, part), grow(level + 1, cover - part)
        return j

    grow(0, 5000)
    return A.Tree(*[np.array(c) for c in (left, right, feat)], *[np.array(c, float) for c in (thr, val, cov)])


def test_shap_recursion_does_not_grow_with_rows(monkeypatch):
    """The recursion runs over patterns of passed features, not over rows."""
    rng, plain, seen = np.random.default_rng(5), A._unwound_sum_v, []
    ens = [(0.3, _random_tree(rng, 6, 5)), (1.7, _random_tree(rng, 3, 9))]
    X = rng.normal(size=(4000, 9))
    X[::7, 2] = np.nan
    slow = np.zeros((60, 9))
    for scale, tree in ens:
        for r in range(60):
            A.tree_shap(tree, X[r], slow[r], scale)
    monkeypatch.setattr(A, "_unwound_sum_v", lambda z, *more: seen.append(len(z)) or plain(z, *more))
    rows = []
    for n in (1000, 4000):
        seen.clear()
        phi, _ = A.explain_rows(ens, X[:n])
        rows.append(sum(seen))
        assert np.abs(phi[:60] - slow).max() < 1e-12
    assert rows[0] == rows[1]
