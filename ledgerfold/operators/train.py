"""Model training, cross-validation, search and importance with Spark ML.

One preparation stage is shared by training and scoring: missing-value
indicators, imputation fitted on the training rows only, and vector
assembly -- stored inside the fitted ``PipelineModel`` so scoring cannot
drift from training (tree learners in Spark reject NaN, so the imputation is
mandatory, not optional).
"""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, RandomForestClassifier)
from pyspark.ml.feature import Imputer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.operators import evaluate as V
from ledgerfold.session import cut_lineage

MODEL_KINDS = ("rf", "gbt", "lr")

# Learner parameter mapping (reference name -> Spark name).
PARAM_MAP = {
    "n_estimators": {"rf": "numTrees", "gbt": "maxIter"},
    "max_depth": {"rf": "maxDepth", "gbt": "maxDepth"},
    "learning_rate": {"gbt": "stepSize"},
    "subsample": {"rf": "subsamplingRate", "gbt": "subsamplingRate"},
    "min_samples_leaf": {"rf": "minInstancesPerNode"},
    "min_child_samples": {"gbt": "minInstancesPerNode"},
    "max_features": {"rf": "featureSubsetStrategy"},
    "max_iter": {"lr": "maxIter"},
    "C": {"lr": "regParam"},
}


def spark_params(kind: str, params: Mapping) -> tuple[dict, list[str]]:
    """Translate reference-style parameters; return (spark params, ignored)."""
    out, ignored = {}, []
    for k, v in params.items():
        target = PARAM_MAP.get(k, {}).get(kind)
        if target is None:
            ignored.append(k)
            continue
        if k == "C":
            v = 1.0 / float(v)  # inverse regularisation strength
        out[target] = v
    return out, ignored


def preparation_stages(features: Sequence[str], strategy: str = "median",
                       indicators: bool = True) -> list:
    """Missing indicators -> imputation -> assembled ``features`` vector."""
    stages = []
    cols = list(features)
    if indicators:
        ind = ", ".join(f"CAST(`{c}` IS NULL AS DOUBLE) AS `{c}__missing`" for c in cols)
        stages.append(SQLTransformer(statement=f"SELECT *, {ind} FROM __THIS__"))
    casted = ", ".join(f"CAST(`{c}` AS DOUBLE) AS `{c}__d`" for c in cols)
    stages.append(SQLTransformer(statement=f"SELECT *, {casted} FROM __THIS__"))
    imputed = [f"{c}__imp" for c in cols]
    stages.append(Imputer(inputCols=[f"{c}__d" for c in cols], outputCols=imputed,
                          strategy=strategy))
    vec_in = imputed + ([f"{c}__missing" for c in cols] if indicators else [])
    stages.append(VectorAssembler(inputCols=vec_in, outputCol="features", handleInvalid="keep"))
    return stages


def vector_feature_names(features: Sequence[str], indicators: bool = True) -> list[str]:
    return list(features) + ([f"{c}__missing" for c in features] if indicators else [])


def estimator(kind: str, label: str = "label", weight_col: str | None = None,
              seed: int = 42, **params):
    common = {"featuresCol": "features", "labelCol": label}
    if weight_col:
        common["weightCol"] = weight_col
    if kind == "rf":
        return RandomForestClassifier(seed=seed, **common, **params)
    if kind == "gbt":
        return GBTClassifier(seed=seed, **common, **params)
    if kind == "lr":
        return LogisticRegression(**common, **params)
    raise ValueError(f"kind must be one of {MODEL_KINDS}")


def fit(train: DataFrame, features: Sequence[str], kind: str, label: str = "label",
        weight_col: str | None = None, seed: int = 42, indicators: bool = True,
        **params) -> PipelineModel:
    stages = preparation_stages(features, indicators=indicators)
    stages.append(estimator(kind, label, weight_col, seed, **params))
    return Pipeline(stages=stages).fit(train)


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns plus ``score`` = probability of class 1."""
    out = model.transform(df)
    return out.select(*keep, vector_to_array("probability")[1].alias("score"))


def with_balanced_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """``n / (2·n_c)`` per row (class counts: a two-row table)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    tot = df.agg(F.count(F.lit(1)).alias("_tot"))  # one row
    w = (c.withColumn("_k", F.lit(1)).join(F.broadcast(tot.withColumn("_k", F.lit(1))), "_k")
         .select(label, (F.col("_tot").cast("double") / (F.col("_nc") * 2.0)).alias(out)))
    return df.join(F.broadcast(w), label, "left")  # one row per class


# -- cross-validation ------------------------------------------------------------

def cross_validate(df: DataFrame, features: Sequence[str], kind: str, fold_col: str = "fold",
                   key: Sequence[str] = ("doc_id",), label: str = "label",
                   threshold: float = V.DEFAULT_THRESHOLD, parallelism: int = 2,
                   seed: int = 42, **params) -> tuple[DataFrame, DataFrame]:
    """k-fold CV: fit on ``fold != k``, score ``fold == k``.

    Returns (out-of-fold scores, per-fold metrics).  The input is
    checkpointed once (lineage cut, reused by every fold); fits run from a
    bounded driver thread pool, each one a distributed Spark job.
    """
    data = cut_lineage(df)
    folds = sorted(r[0] for r in data.select(fold_col).distinct().collect())

    def one(k):
        m = fit(data.where(F.col(fold_col) != k), features, kind, label, seed=seed, **params)
        return score(m, data.where(F.col(fold_col) == k), [*key, label, fold_col])

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        parts = list(pool.map(one, folds))
    oof = parts[0]
    for p in parts[1:]:
        oof = oof.unionByName(p)
    oof = cut_lineage(oof)
    auc = V.roc_auc(oof, label, "score", [fold_col]).select(fold_col, "roc_auc")
    m = V.classification_metrics(oof, label, "score", threshold, [fold_col])
    # each fold's cost-optimal threshold: one grouped sweep over all folds
    opt = V.optimal_threshold(oof, label, "score", groups=[fold_col]).withColumnRenamed(
        "optimal_cost", "optimal_business_cost")
    return oof, m.join(auc, fold_col).join(opt, fold_col)


def cv_summary(fold_metrics: DataFrame, metrics: Sequence[str] = (
        "roc_auc", "accuracy", "precision", "recall", "f1", "business_cost",
        "optimal_threshold", "optimal_business_cost")) -> DataFrame:
    """Mean and population standard deviation of each metric over folds."""
    return fold_metrics.agg(*[e for m in metrics for e in (
        F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))])


# -- random search -----------------------------------------------------------------

def draw(space: Mapping[str, tuple], rng: random.Random) -> dict:
    """One draw: ``(lo, hi)`` ints, ``(lo, hi, 'log')`` log-uniform floats,
    ``(lo, hi, 'float')`` uniform floats, or a list of choices."""
    out = {}
    for k, spec in space.items():
        if isinstance(spec, list):
            out[k] = rng.choice(spec)
        elif len(spec) == 3 and spec[2] == "log":
            out[k] = math.exp(rng.uniform(math.log(spec[0]), math.log(spec[1])))
        elif len(spec) == 3 and spec[2] == "float":
            out[k] = rng.uniform(spec[0], spec[1])
        else:
            out[k] = rng.randint(spec[0], spec[1])
    return out


# Search ranges of the reference (random forest, boosted trees).
RF_SPACE = {"n_estimators": (50, 100), "max_depth": (5, 10), "min_samples_leaf": (1, 10),
            "max_features": ["sqrt", "log2"]}
GBT_SPACE = {"n_estimators": (50, 500), "max_depth": (3, 15), "learning_rate": (0.01, 0.3, "log"),
             "min_child_samples": (10, 100), "subsample": (0.6, 1.0, "float")}


def random_search(df: DataFrame, features: Sequence[str], kind: str, space: Mapping,
                  n_trials: int, seed: int = 42, fold_col: str = "fold",
                  key: Sequence[str] = ("doc_id",), label: str = "label",
                  fixed: Mapping | None = None) -> DataFrame:
    """Seeded random search maximising mean CV AUC; one row per trial with
    the running best (trials are few: the table is built on the driver)."""
    rng = random.Random(seed)
    rows = []
    for t in range(n_trials):
        ref = draw(space, rng)
        sp, ignored = spark_params(kind, {**ref, **(fixed or {})})
        _, m = cross_validate(df, features, kind, fold_col, key, label, seed=seed, **sp)
        s = cv_summary(m, ["roc_auc"]).first()
        rows.append((t, str(sorted(ref.items())), ",".join(ignored), float(s["roc_auc_mean"]),
                     float(s["roc_auc_std"])))
    spark = df.sparkSession
    trials = spark.createDataFrame(
        rows, "trial int, params string, ignored string, auc_mean double, auc_std double")
    from ledgerfold.operators.ordering import running_best
    return running_best(trials, "trial", "auc_mean", out="best_auc_so_far")


# -- importance from the model's own node table -------------------------------------

def tree_nodes(model, spark, path: str) -> DataFrame:
    """Node table of a fitted tree ensemble, read back from its saved form.

    Columns: treeID, id, prediction, impurityStats, rawCount, gain,
    leftChild, rightChild, featureIndex, threshold.
    """
    model.write().overwrite().save(path)
    d = spark.read.parquet(f"{path}/data")
    return d.select("treeID", "nodeData.id", "nodeData.prediction", "nodeData.impurityStats",
                    "nodeData.rawCount", "nodeData.gain", "nodeData.leftChild",
                    "nodeData.rightChild", F.col("nodeData.split.featureIndex").alias("featureIndex"),
                    F.try_element_at(F.col("nodeData.split.leftCategoriesOrThreshold"), F.lit(1)).alias("threshold"))


def tree_weights(model) -> list[float]:
    return list(model.treeWeights)


def split_gain_importance(nodes: DataFrame, feature_names: Sequence[str]) -> DataFrame:
    """Split count and total gain per feature (internal nodes only), ranked
    by gain; feature names come from a bounded broadcast lookup."""
    spark = nodes.sparkSession
    names = spark.createDataFrame(list(enumerate(feature_names)), "featureIndex int, feature string")
    internal = nodes.where(F.col("leftChild") != -1)
    agg = internal.groupBy("featureIndex").agg(F.count(F.lit(1)).alias("split_count"),
                                               F.sum("gain").alias("total_gain"))
    return (agg.join(F.broadcast(names), "featureIndex", "left")
            .select("feature", "featureIndex", "split_count", "total_gain")
            .orderBy(F.desc("total_gain"), "feature"))


def oof_threshold(oof: DataFrame, label: str = "label") -> float:
    return V.optimal_threshold(oof, label, "score").first()["optimal_threshold"]


def holdout_report(model: PipelineModel, test: DataFrame,
                   thresholds: Sequence[tuple[str, float]], key: Sequence[str],
                   label: str = "label") -> DataFrame:
    """Metrics on held-out rows at thresholds chosen elsewhere (CV or
    validation), one row per named threshold, with the holdout ROC AUC."""
    s = score(model, test, [*key, label])
    m = V.metrics_at_thresholds(s, list(thresholds), label, "score")
    auc = V.roc_auc(s, label, "score").select("roc_auc")
    return (m.withColumn("_k", F.lit(1))
            .join(F.broadcast(auc.withColumn("_k", F.lit(1))), "_k").drop("_k"))


