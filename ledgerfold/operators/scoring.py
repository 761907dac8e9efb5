"""Decisions, baselines, class weights and run-log lookups.

Top-1 per group ("best run", "latest version", "winner") uses ``max`` over a
struct ``(value, tie-break, payload)``: an algebraic aggregate that is
partially aggregated map-side, so a metric or key holding a third of all
rows never lands in one task (a ``row_number`` window would).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.operators import evaluate as V

# The production decision threshold and its texts.
THRESHOLD = 0.475
REFUSE_TEXT = "refuse: default risk above threshold"
GRANT_TEXT = "grant: default risk below threshold"


def decide(requests: DataFrame, scored: DataFrame, key: str, prob: str,
           threshold: float = THRESHOLD) -> DataFrame:
    """Requested ids with a score -> probability, 0/1 decision, text.

    A request list is usually small: it is broadcast when its size is proven
    below the bound, otherwise both sides are shuffled by the key."""
    from ledgerfold.operators.joins import bounded_broadcast
    j = bounded_broadcast(requests.select(key).distinct()).join(scored, key, "inner")
    p = F.col(prob)
    return j.select(
        F.col(key), p.alias("probability"), (p >= F.lit(threshold)).cast("int").alias("prediction"),
        F.lit(float(threshold)).alias("threshold"),
        F.when(p >= F.lit(threshold), F.lit(REFUSE_TEXT)).otherwise(F.lit(GRANT_TEXT))
        .alias("recommendation"))


def request_status(requests: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``found`` / ``not found`` for each requested id."""
    k = known.select(key).distinct().withColumn("_hit", F.lit(1))
    j = requests.join(k, key, "left")
    return j.select(key, F.when(F.col("_hit").isNull(), F.lit("not found"))
                    .otherwise(F.lit("found")).alias("status"))


def _with_one_row(df: DataFrame, one: DataFrame) -> DataFrame:
    return (df.withColumn("_k", F.lit(1))
            .join(F.broadcast(one.withColumn("_k", F.lit(1))), "_k").drop("_k"))


def baseline_metrics(df: DataFrame, strategy: str, label: str = "label",
                     seed: int = 42, key: str = "doc_id") -> DataFrame:
    """Dummy classifiers: ``prior`` (constant positive rate), ``most_frequent``
    (constant majority class) or ``stratified`` (hash-uniform draw with the
    positive rate); metrics at 0.5 and ROC AUC."""
    y = F.col(label)
    pri = df.agg((F.sum(y).cast("double") / F.count(F.lit(1))).alias("_prior"),
                 (2 * F.sum(y) > F.count(F.lit(1))).alias("_maj"))
    d = _with_one_row(df, pri)
    if strategy == "prior":
        score = F.col("_prior")
    elif strategy == "most_frequent":
        score = F.when(F.col("_maj"), F.lit(1.0)).otherwise(F.lit(0.0))
    elif strategy == "stratified":
        u = (F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)).cast("double")
             / float(1 << 30))
        score = F.when(u < F.col("_prior"), F.lit(1.0)).otherwise(F.lit(0.0))
    else:
        raise ValueError("strategy must be prior, most_frequent or stratified")
    s = d.select(y.alias("label"), score.alias("score"))
    const = s.agg(F.max("score").alias("constant_score"))
    m = V.classification_metrics(s)
    auc = V.roc_auc(s).select("roc_auc")
    out = _with_one_row(_with_one_row(const, auc), m)
    if strategy == "stratified":
        out = out.drop("constant_score")
    return out


def baseline_cross_validation(df: DataFrame, fold: str, strategies: Sequence[str], label: str = "label",
                              seed: int = 42, key: str = "doc_id") -> DataFrame:
    """Per fold and strategy the metrics of a dummy classifier that knows the
    other folds' positive rate only: the rates of all folds come from one
    aggregate (total less the fold's), the rows are scored in one pass."""
    y = F.col(label)
    own = df.groupBy(fold).agg(F.count(y).alias("_n"), F.sum(y).alias("_pos"))
    rest = _with_one_row(own, own.agg(F.sum("_n").alias("_all"), F.sum("_pos").alias("_all_pos")))
    rate = F.try_divide((F.col("_all_pos") - F.col("_pos")).cast("double"), (F.col("_all") - F.col("_n")).cast("double"))
    rates = rest.select(F.col(fold).alias("_fold"), rate.alias("_rate"), (2 * (F.col("_all_pos") - F.col("_pos")) > F.col("_all") - F.col("_n")).alias("_most"))
    scores = {"prior": F.col("_rate"), "most_frequent": F.when(F.col("_most"), F.lit(1.0)).otherwise(F.lit(0.0)),
              "stratified": F.when(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) < F.col("_rate"), F.lit(1.0)).otherwise(F.lit(0.0))}
    unknown = set(strategies) - set(scores)
    if unknown:
        raise ValueError(f"unknown strategies {sorted(unknown)}; expected {sorted(scores)}")
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), scores[s].alias("score")) for s in strategies])).alias("_s")
    # one row per fold
    rows = df.join(rates, F.col(fold).eqNullSafe(F.col("_fold"))).select(fold, label, each).select(fold, label, "_s.*")
    return V.classification_metrics(rows, label, "score", groups=[fold, "strategy"])


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights ``n / (2·n_c)`` and ``scale_pos_weight = neg/pos``."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    y = F.col(label)
    t = df.agg(F.count(F.lit(1)).alias("_tot"), F.count_if(y == 0).alias("_neg"),
               F.count_if(y == 1).alias("_pos"))  # one row
    return _with_one_row(c, t).select(
        label, "n", (F.col("_tot").cast("double") / (F.col("n") * 2.0)).alias("weight"),
        F.try_divide(F.col("_neg").cast("double"), F.col("_pos").cast("double")).alias("scale_pos_weight"))


def best_by(df: DataFrame, groups: Sequence[str], value: str, id_col: str,
            payload: Sequence[str] = (), maximize: bool = True) -> DataFrame:
    """Per group the row with the best value; ties -> smallest id."""
    v = F.col(value) if maximize else -F.col(value)
    best = F.max(F.struct(v.alias("v"), (-F.col(id_col)).alias("nid"),
                          *[F.col(p) for p in payload], F.col(value).alias("val")))
    a = df.where(F.col(value).isNotNull()).groupBy(*groups).agg(best.alias("_b"))
    return a.select(*groups, (-F.col("_b.nid")).alias(id_col),
                    *[F.col(f"_b.{p}").alias(p) for p in payload], F.col("_b.val").alias(value))


def metric_winner(df: DataFrame, metric: str, model: str, value: str,
                  baseline_model) -> DataFrame:
    """Per metric: model with the highest mean (ties -> smaller model id),
    its mean, the baseline's mean and the improvement in %."""
    means = df.groupBy(metric, model).agg(
        (F.sum(value).cast("double") / F.count(F.lit(1)).cast("double")).alias("mean_c"))
    best = best_by(means, [metric], "mean_c", model)
    base = means.where(F.col(model) == F.lit(baseline_model)).select(
        metric, F.col("mean_c").alias("baseline_c"))
    j = best.join(base, metric, "left")
    return j.select(metric, F.col(model).alias("winner"), F.col("mean_c").alias("best_mean_c"),
                    "baseline_c",
                    F.try_divide((F.col("mean_c") - F.col("baseline_c")) * 100.0,
                                 F.col("baseline_c")).alias("improvement_pct"))


def latest_per_key(df: DataFrame, key: str, order_cols: Sequence[str],
                   rename: Mapping[str, str]) -> DataFrame:
    """Per key the row with the largest ``order_cols`` (lexicographic)."""
    s = F.max(F.struct(*[F.col(c) for c in order_cols],
                       *[F.col(c).alias(f"_p_{c}") for c in rename]))
    a = df.groupBy(key).agg(s.alias("_m"))
    return a.select(key, *[F.col(f"_m._p_{c}").alias(n) for c, n in rename.items()])


def model_facts(spark, model, feature_names: Sequence[str], threshold: float) -> DataFrame:
    """One row: model class, feature count, threshold, first 10 names, loaded."""
    stage = model.stages[-1] if hasattr(model, "stages") else model
    row = (type(stage).__name__, len(feature_names), float(threshold),
           list(feature_names)[:10], True)
    return spark.createDataFrame(
        [row], "model_type string, n_features int, optimal_threshold double, "
               "feature_names array<string>, model_loaded boolean")


def prepare_features(df: DataFrame, feature_names: Sequence[str] | None, key: str,
                     exclude: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Validate and order the scoring columns.

    With a feature list: every name must exist (the error lists at most 10
    missing names) and the frame is reordered to it.  Without one: all
    columns except the key and ``exclude``.
    """
    if feature_names is None:
        skip = {key, *exclude}
        names = [c for c in df.columns if c not in skip]
    else:
        names = list(feature_names)
        missing = [n for n in names if n not in set(df.columns)]
        if missing:
            shown = ", ".join(missing[:10])
            more = f" (+{len(missing) - 10} more)" if len(missing) > 10 else ""
            raise ValueError(f"{len(missing)} features missing: {shown}{more}")
    return df.select(key, *names), names


def score_clients(model, features: DataFrame, feature_names: Sequence[str] | None,
                  requests: DataFrame, key: str, threshold: float = THRESHOLD,
                  exclude: Sequence[str] = ()) -> DataFrame:
    """The serving path as one job: requested ids ⋈ feature rows, features
    validated and ordered (B21), remaining nulls filled with 0 (B22), the
    fitted pipeline applied, probability of class 1 decided at the threshold
    (J4); requested ids without a feature row are reported (J5)."""
    from pyspark.ml.functions import vector_to_array
    feats, names = prepare_features(features, feature_names, key, exclude)
    filled = feats.na.fill(0.0, subset=list(names))
    scored = model.transform(filled).select(
        F.col(key), vector_to_array("probability")[1].alias("probability"))
    found = decide(requests, scored, key, "probability", threshold)
    missing = request_status(requests.select(key).distinct(), feats, key).where(
        F.col("status") == "not found")
    return found.withColumn("status", F.lit("found")).unionByName(
        missing.select(key, F.lit(None).cast("double").alias("probability"),
                       F.lit(None).cast("int").alias("prediction"),
                       F.lit(float(threshold)).alias("threshold"),
                       F.lit(None).cast("string").alias("recommendation"), "status"))
