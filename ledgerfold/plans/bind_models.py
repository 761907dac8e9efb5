"""Bindings: training, cross-validation, search, importance, attributions
and model facts (I3-I7, I18, J6, J8) on the labelled documents.

The supervised table is ``documents ⋈ labels`` (target: ``toxic``) with
features computed by Spark string built-ins over the whole text.  These
outputs depend on learners, so they are checked by row counts and by the
pytest suite (invariants, additivity), not by a SQL oracle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions.nullsafe import safe_divide
from ledgerfold.operators import attribution as A
from ledgerfold.operators import sampling as S
from ledgerfold.operators import train as TR
from ledgerfold.operators.encode import one_hot_columns, vocabulary
from ledgerfold.operators.ordering import top_n_per_entity
from ledgerfold.plans.catalog import register
from ledgerfold.session import checkpoint_dir, cut_lineage
from ledgerfold.sources.tables import table

KEY = "doc_id"
LABEL = "label"


def document_features(spark, sf) -> tuple[DataFrame, list[str]]:
    """One row per labelled document: text statistics and one-hot language
    and source; returns (frame, feature names)."""
    d = table(spark, sf, "documents")
    lab = table(spark, sf, "labels").select(KEY, F.col("toxic").alias(LABEL))
    t = F.col("text")
    n_chars = F.length(t)
    base = d.join(lab, KEY).select(
        KEY, LABEL, "lang", "source",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split(F.trim(t), r"\s+")).cast("double").alias("n_words"),
        F.size(F.split(t, "\n")).cast("double").alias("n_lines"),
        safe_divide(F.length(F.regexp_replace(t, "[^A-Z]", "")), n_chars).alias("upper_share"),
        safe_divide(F.length(F.regexp_replace(t, "[^0-9]", "")), n_chars).alias("digit_share"),
        (n_chars - F.length(F.regexp_replace(t, "[!?]", ""))).cast("double").alias("n_marks"),
        safe_divide(F.length(F.regexp_replace(t, r"[^\p{Punct}]", "")), n_chars).alias("punct_share"))
    dummies = []
    for c in ("lang", "source"):
        dummies += one_hot_columns(c, vocabulary(base, c), nan_as_category=False, clean=True)
    out = base.select(KEY, LABEL, *[c for c in base.columns if c not in (KEY, LABEL, "lang", "source")],
                      *[e.cast("double").alias(n) for n, e in dummies])
    feats = [c for c in out.columns if c not in (KEY, LABEL)]
    return out, feats


def _splits(spark, sf):
    """Feature rows with their split, materialised once in the shared
    checkpoint folder (every fit and score below reuses it)."""
    df, feats = document_features(spark, sf)
    return cut_lineage(S.stratified_split(df, [KEY], LABEL, (0.6, 0.2, 0.2), seed=42)), feats


def _train_test(spark, sf):
    s, feats = _splits(spark, sf)
    return s.where(F.col("split") == "train"), s.where(F.col("split") == "test"), feats


# The sizes of the reference's learners.
RF_PARAMS = {"numTrees": 100, "maxDepth": 10, "minInstancesPerNode": 1,
             "featureSubsetStrategy": "sqrt"}
GBT_PARAMS = {"maxIter": 100, "maxDepth": 8, "stepSize": 0.1, "subsamplingRate": 0.9}
LR_PARAMS = {"maxIter": 100, "regParam": 0.01}


def _fit_gbt(train, feats):
    """Boosted trees with balanced class weights."""
    return TR.fit(TR.with_balanced_weights(train, LABEL), feats, "gbt", LABEL, weight_col="weight", **GBT_PARAMS)


@register("rf_scores")
def rf_scores(spark, sf):
    train, test, feats = _train_test(spark, sf)
    train = TR.with_balanced_weights(train, LABEL)
    m = TR.fit(train, feats, "rf", LABEL, weight_col="weight", **RF_PARAMS)
    return TR.score(m, test, [KEY, LABEL])


@register("gbt_scores")
def gbt_scores(spark, sf):
    train, test, feats = _train_test(spark, sf)
    m = _fit_gbt(train, feats)
    return TR.score(m, test, [KEY, LABEL])


@register("lr_scores")
def lr_scores(spark, sf):
    train, test, feats = _train_test(spark, sf)
    m = TR.fit(train, feats, "lr", LABEL, **LR_PARAMS)
    return TR.score(m, test, [KEY, LABEL])


def _cv_frame(spark, sf, k=5):
    s, feats = _splits(spark, sf)
    dev = s.where(F.col("split") != "test").drop("split")
    return S.stratified_kfold(dev, [KEY], LABEL, k=k, seed=42), feats


@register("cv_fold_metrics")
def cv_fold_metrics(spark, sf):
    folds, feats = _cv_frame(spark, sf)
    _, metrics = TR.cross_validate(folds, feats, "lr", "fold", [KEY], LABEL, **LR_PARAMS)
    return metrics


@register("search_trials")
def search_trials(spark, sf):
    folds, feats = _cv_frame(spark, sf, k=3)
    return TR.random_search(folds, feats, "rf", TR.RF_SPACE, n_trials=2, seed=42,
                            fold_col="fold", key=[KEY], label=LABEL)


def _gbt_with_nodes(spark, sf):
    train, test, feats = _train_test(spark, sf)
    m = _fit_gbt(train, feats)
    gbt = m.stages[-1]
    path = f"{checkpoint_dir(spark).rstrip('/')}/models/{uuid.uuid4().hex}"
    nodes = TR.tree_nodes(gbt, spark, path)
    return m, gbt, nodes, test, TR.vector_feature_names(feats)


@register("split_gain_importance")
def split_gain_importance(spark, sf):
    _, _, nodes, _, names = _gbt_with_nodes(spark, sf)
    return TR.split_gain_importance(nodes, names)


@register("shap_top_n")
def shap_top_n(spark, sf):
    m, gbt, nodes, test, names = _gbt_with_nodes(spark, sf)
    # bounded: trees × nodes of depth ≤ maxDepth, checked before collecting
    ens = A.collect_ensemble(nodes, "gbt", TR.tree_weights(gbt))
    prepared = m.transform(test).select(KEY, "features")
    long = A.shap_long(prepared, KEY, "features", ens, names)
    attrs = long.where(F.col("feature") != "__base__")
    return top_n_per_entity(attrs, KEY, "value", "feature", n=5)


@register("model_info")
def model_info(spark, sf):
    train, _, feats = _train_test(spark, sf)
    m = _fit_gbt(train, feats)
    from ledgerfold.operators.scoring import THRESHOLD
    from ledgerfold.operators.scoring import model_facts
    return model_facts(spark, m, feats, THRESHOLD)


@register("holdout_metrics")
def holdout_metrics(spark, sf):
    """Fit on train, choose the cost-optimal threshold on validation, report
    metrics on test at that threshold (and at the production threshold)."""
    s, feats = _splits(spark, sf)
    m = _fit_gbt(s.where(F.col("split") == "train"), feats)
    val = TR.score(m, s.where(F.col("split") == "val"), [KEY, LABEL])
    t = TR.oof_threshold(val, LABEL)
    from ledgerfold.operators.scoring import THRESHOLD
    return TR.holdout_report(m, s.where(F.col("split") == "test"),
                             [("val_optimal", t), ("production", THRESHOLD)], [KEY], LABEL)


@register("baseline_stratified")
def baseline_stratified(spark, sf):
    """Dummy 'stratified' baseline: a seeded hash draw with the positive rate."""
    from ledgerfold.operators.scoring import baseline_metrics
    from ledgerfold.plans.bind_common import scored_labels
    return baseline_metrics(scored_labels(spark, sf), "stratified")
