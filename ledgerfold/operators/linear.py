"""A linear learner from sufficient statistics, and scoring by a stored model.

Counts, sums and cross products per fold come from one aggregation.  A model
that leaves a fold out needs the total less that fold's statistics, so k-fold
cross-validation costs one pass over the rows for all folds, and one more to
score them.  Whole numbers are added exactly (decimal), so statistics subtract
without loss; the normal equations are centred before they are solved, on the
driver, in as many unknowns as there are features.

A model is a table (feature, coefficient, fill), ``intercept`` among the
features.  Scoring validates the columns and is one generated expression: the
sum of coefficients times values, nulls replaced by ``fill``, clipped to [0, 1].
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.functions.nullsafe import is_integral
from ledgerfold.operators import evaluate as V
from ledgerfold.operators.scoring import THRESHOLD, decide, prepare_features, request_status

INTERCEPT = "intercept"
MAX_FOLDS = 1000

Statistics = Mapping[str, object]


def statistics(df: DataFrame, features: Sequence[str], label: str, fold: str | None = None) -> DataFrame:
    """One row per fold: ``n``, the sums ``s_i`` and cross products ``c_i_j``
    (i <= j) of the features and, last, the label.  Rows with a null label are
    left out; a null feature counts as 0."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = [*features, label]
    x = [F.coalesce(F.col(c), F.lit(0)).cast("decimal(38,0)" if is_integral(types[c]) else "double") for c in cols]
    aggs = [F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(f"s_{i}") for i, v in enumerate(x)]]
    aggs += [F.sum(x[i] * x[j]).alias(f"c_{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    rows = df.where(F.col(label).isNotNull())
    return rows.groupBy(fold).agg(*aggs) if fold else rows.agg(*aggs)


def _number(v) -> Fraction:
    return Fraction(int(v)) if isinstance(v, Decimal) and v == v.to_integral_value() else Fraction(v or 0)


def _statistics(row, size: int) -> dict[str, Fraction]:
    names = ["n", *[f"s_{i}" for i in range(size)], *[f"c_{i}_{j}" for i in range(size) for j in range(i, size)]]
    return {k: _number(row[k]) for k in names}


def solve(stats: Mapping[str, Fraction], size: int, l2: float = 0.0) -> list[float]:
    """[intercept, coefficients...] of least squares with an optional ridge
    penalty; features that do not vary get 0."""
    n = stats["n"]
    if not n:
        return [0.0] * (size + 1)

    def centred(i, j):
        return float(stats[f"c_{min(i, j)}_{max(i, j)}"] - stats[f"s_{i}"] * stats[f"s_{j}"] / n)

    a = np.array([[centred(i, j) for j in range(size)] for i in range(size)]).reshape(size, size)
    b = np.array([centred(i, size) for i in range(size)])
    scale = np.sqrt(np.diag(a))
    live = scale > 0
    beta = np.zeros(size)
    if live.any():
        inner = a[np.ix_(live, live)] / np.outer(scale[live], scale[live]) + l2 * np.eye(int(live.sum()))
        beta[live] = np.linalg.lstsq(inner, b[live] / scale[live], rcond=None)[0] / scale[live]
    start = float(stats[f"s_{size}"] / n) - sum(w * float(stats[f"s_{i}"] / n) for i, w in enumerate(beta.tolist()))
    return [start, *beta.tolist()]


def linear_score(features: Sequence[str], weights: Sequence[float], fill: Sequence[float] | None = None) -> Column:
    total = F.lit(float(weights[0]))
    for c, w, v in zip(features, weights[1:], fill or [0.0] * len(features), strict=True):
        total = total + F.lit(float(w)) * F.coalesce(F.col(c).cast("double"), F.lit(float(v)))
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def leave_fold_out(df: DataFrame, features: Sequence[str], label: str, fold: str, l2: float = 0.0) -> dict[object, list[float]]:
    """Per fold the model of all other rows, from one pass."""
    size = len(features)
    rows = statistics(df, features, label, fold).limit(MAX_FOLDS + 1).collect()
    if len(rows) > MAX_FOLDS:
        raise ValueError(f"more than {MAX_FOLDS} folds")
    own = {r[fold]: _statistics(r, size + 1) for r in rows}
    total = {k: sum((s[k] for s in own.values()), Fraction(0)) for k in next(iter(own.values()), {})}
    return {f: solve({k: total[k] - s[k] for k in total}, size, l2) for f, s in own.items()}


def out_of_fold_scores(df: DataFrame, features: Sequence[str], label: str, fold: str, l2: float = 0.0) -> DataFrame:
    """``df`` with ``score``: each row by the model that has not seen its fold."""
    score = F.lit(None).cast("double")
    for f, weights in leave_fold_out(df, features, label, fold, l2).items():
        score = F.when(F.col(fold).eqNullSafe(F.lit(f)), linear_score(features, weights)).otherwise(score)
    return df.withColumn("score", score)


def cross_validate(df: DataFrame, features: Sequence[str], label: str, fold: str, threshold: float = V.DEFAULT_THRESHOLD,
                   l2: float = 0.0) -> DataFrame:
    """Per-fold metrics of the out-of-fold scores: confusion counts, accuracy,
    precision, recall, F1, business cost and exact ROC AUC."""
    oof = out_of_fold_scores(df, features, label, fold, l2)
    auc = V.roc_auc(oof, label, "score", [fold]).select(fold, "roc_auc")
    return V.classification_metrics(oof, label, "score", threshold, [fold]).join(auc, fold)


# -- a model as a table ---------------------------------------------------------------

def fit(df: DataFrame, features: Sequence[str], label: str, l2: float = 0.0) -> DataFrame:
    """The model of all rows: (feature, coefficient, fill)."""
    weights = solve(_statistics(statistics(df, features, label).first(), len(features) + 1), len(features), l2)
    rows = [(n, w, 0.0) for n, w in zip([INTERCEPT, *features], weights, strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double, fill double")


def save_model(model: DataFrame, path: str) -> None:
    model.coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("feature string, coefficient double, fill double").parquet(path)


def score_requests(requests: DataFrame, features: DataFrame, model: DataFrame, key: str,
                   threshold: float = THRESHOLD) -> DataFrame:
    """Requested ids decided by a stored model; ids without a feature row are
    reported.  The model has a row per feature column, so it is read whole; a
    column that it names and ``features`` lacks is an error (at most ten names)."""
    rows = {r.feature: r for r in model.collect()}
    if INTERCEPT not in rows:
        raise ValueError("the model has no intercept")
    names = [n for n in rows if n != INTERCEPT]
    known, names = prepare_features(features, names, key)
    score = linear_score(names, [rows[INTERCEPT].coefficient, *[rows[n].coefficient for n in names]], [rows[n].fill for n in names])
    scored = known.select(key, score.alias("probability"))
    found = decide(requests, scored, key, "probability", threshold).withColumn("status", F.lit("found"))
    missing = request_status(requests.select(key).distinct(), known, key).where("status = 'not found'")
    return found.unionByName(missing, allowMissingColumns=True).withColumn("threshold", F.lit(float(threshold)))
