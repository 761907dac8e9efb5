"""Evaluation of scored rows ``(label 0/1, score)``.

* Confusion counts always give four cells (predicted positive = ``score >=
  threshold``); precision/recall/F1 are 0 when undefined (zero_division=0).
* ROC AUC is exact (Mann-Whitney with ties counted ½), from the counts per
  distinct score and a bucketed running count -- no global window over all
  rows, no 1000-bin approximation.
* The threshold sweep buckets each row once by how many thresholds it
  reaches (≤ len(thresholds)+1 groups), then cumulates over that small
  table: one pass over the data instead of one per threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.operators.scan import place, running

# Fixed values of the reference's evaluation: business cost weights, the
# default decision threshold and the production threshold.
FN_COST = 10.0
FP_COST = 1.0
DEFAULT_THRESHOLD = 0.5
PRODUCTION_THRESHOLD = 0.475


def linspace_thresholds(n: int = 100) -> list[float]:
    """``numpy.linspace(0, 1, n)``: ``i * (1/(n-1))`` with the last point 1.0."""
    step = 1.0 / (n - 1)
    return [i * step for i in range(n - 1)] + [1.0]


def _y(label: str) -> Column:
    return F.col(label)


def confusion_exprs(label: str, score: str, threshold: float) -> list[Column]:
    y, p = _y(label), F.col(score) >= F.lit(float(threshold))
    return [F.count_if((y == 0) & ~p).alias("tn"), F.count_if((y == 0) & p).alias("fp"),
            F.count_if((y == 1) & ~p).alias("fn"), F.count_if((y == 1) & p).alias("tp")]


def confusion_counts(df: DataFrame, label: str = "label", score: str = "score",
                     threshold: float = DEFAULT_THRESHOLD,
                     groups: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*groups).agg(*confusion_exprs(label, score, threshold))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def metric_columns(fn_cost: float = FN_COST, fp_cost: float = FP_COST) -> list[Column]:
    """Metrics from columns tn/fp/fn/tp."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    return [
        _ratio(tp + tn, n).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        (fn.cast("double") * F.lit(fn_cost) + fp.cast("double") * F.lit(fp_cost))
        .alias("business_cost"),
    ]


def classification_metrics(df: DataFrame, label: str = "label", score: str = "score",
                           threshold: float = DEFAULT_THRESHOLD,
                           groups: Sequence[str] = ()) -> DataFrame:
    c = confusion_counts(df, label, score, threshold, groups)
    return c.select(*groups, "tn", "fp", "fn", "tp", *metric_columns())


def business_cost(df: DataFrame, label: str = "label", score: str = "score",
                  threshold: float = DEFAULT_THRESHOLD, fn_cost: float = FN_COST,
                  fp_cost: float = FP_COST) -> DataFrame:
    c = confusion_counts(df, label, score, threshold)
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    cost = F.col("fn").cast("double") * fn_cost + F.col("fp").cast("double") * fp_cost
    return c.select("fn", "fp", cost.alias("business_cost"),
                    (cost / n.cast("double")).alias("cost_per_sample"))


def score_counts(df: DataFrame, label: str, score: str,
                 groups: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score."""
    y = _y(label)
    return df.groupBy(*groups, score).agg(F.count_if(y == 1).alias("pos"),
                                           F.count_if(y == 0).alias("neg"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score",
            groups: Sequence[str] = ()) -> DataFrame:
    """Exact ROC AUC: P(score_pos > score_neg) + ½ P(equal)."""
    groups = list(groups)
    d = score_counts(df, label, score, groups)
    r = running(d, score, ["neg"], groups, inclusive=False, prefix="below_")
    # products of counts pass bigint beyond some billions of rows
    twice = F.col("pos").cast("decimal(18,0)") * (2 * F.col("below_neg") + F.col("neg")).cast("decimal(20,0)")
    a = r.groupBy(*groups).agg(F.sum(twice).alias("_twice"),
                               F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    auc = F.try_divide(F.col("_twice").cast("double"),
                       (2 * F.col("n_pos").cast("decimal(19,0)") * F.col("n_neg").cast("decimal(19,0)")).cast("double"))
    return a.select(*groups, auc.alias("roc_auc"), "n_pos", "n_neg")


def _cumulated(df: DataFrame, label: str, score: str, groups: Sequence[str]):
    """Per distinct score: tp/fp = positives/negatives with score >= s, and
    the group's totals P and N."""
    d = score_counts(df, label, score, groups)
    r = running(d, score, ["pos", "neg"], groups, inclusive=False, prefix="below_", total_prefix="all_")
    return (r.withColumnsRenamed({"all_pos": "P", "all_neg": "N"})
            .select("*", (F.col("P") - F.col("below_pos")).alias("tp"),
                    (F.col("N") - F.col("below_neg")).alias("fp_")))


def average_precision(df: DataFrame, label: str = "label", score: str = "score",
                      groups: Sequence[str] = ()) -> DataFrame:
    """``Σ (R_i − R_{i−1}) · P_i`` over distinct scores (descending), i.e.
    ``Σ_s pos_s · precision(s) / P``.  A sum of fractions: its last bits depend
    on the order of addition."""
    j = _cumulated(df, label, score, groups)
    prec = F.col("tp").cast("double") / (F.col("tp") + F.col("fp_")).cast("double")
    a = j.groupBy(*groups).agg(F.sum(F.col("pos") * prec).alias("_s"),
                               F.max("P").alias("n_pos"))
    ap = F.try_divide(F.col("_s"), F.col("n_pos").cast("double"))
    return a.select(*groups, ap.alias("average_precision"))


def roc_points(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score."""
    j = _cumulated(df, label, score, ())
    return j.select(F.col(score).alias("threshold"),
                    F.try_divide(F.col("fp_").cast("double"), F.col("N").cast("double")).alias("fpr"),
                    F.try_divide(F.col("tp").cast("double"), F.col("P").cast("double")).alias("tpr"))


def pr_points(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, precision, recall) at every distinct score."""
    j = _cumulated(df, label, score, ())
    return j.select(F.col(score).alias("threshold"),
                    (F.col("tp").cast("double") / (F.col("tp") + F.col("fp_")).cast("double"))
                    .alias("precision"),
                    F.try_divide(F.col("tp").cast("double"), F.col("P").cast("double")).alias("recall"))


def _double_array(values: Sequence[float]) -> Column:
    """Array literal of any length (one string literal, not one each)."""
    if not len(values):
        return F.array().cast("array<double>")
    return F.split(F.lit(",".join(map(repr, map(float, values)))), ",").cast("array<double>")


def cost_curve(df: DataFrame, label: str = "label", score: str = "score",
               thresholds: Sequence[float] | None = None, fn_cost: float = FN_COST,
               fp_cost: float = FP_COST, groups: Sequence[str] = ()) -> DataFrame:
    """Cost ``fn_cost·FN + fp_cost·FP`` at each threshold (``score >= t``),
    per group if ``groups`` are given (e.g. CV folds).

    A row's place among the sorted thresholds is found by binary search, so the
    data is aggregated once into ≤ len(thresholds)+1 rows per group, whatever
    their number; each group's grid is generated next to it (no join with a
    grid table) and cumulated over that bounded table.
    """
    ts = [float(t) for t in thresholds] if thresholds is not None else linspace_thresholds()
    if ts != sorted(ts):
        raise ValueError("thresholds must be ascending")
    gs = list(groups) or ["_all"]
    # rows without a score are in no confusion cell, so they cost nothing here either
    src = df.where(F.col(score).isNotNull())
    src = src if groups else src.withColumn("_all", F.lit(0))
    grid_vals, y = _double_array(ts), _y(label)
    k = (place(src, F.col(score).cast("double"), grid_vals, len(ts), "i").groupBy(*gs, "i")
         .agg(F.count_if(y == 1).alias("pos_k"), F.count_if(y == 0).alias("neg_k")))
    empty = F.lit(0).cast("bigint")
    grid = (k.select(*gs).distinct().select(*gs, F.posexplode(grid_vals).alias("i", "threshold"))
            .select(*gs, "i", empty.alias("pos_k"), empty.alias("neg_k"), "threshold"))
    # A row reaching k thresholds is predicted positive at thresholds i < k:
    # FN(i) = positives reaching ≤ i thresholds, FP(i) = negatives reaching > i.
    per_i = (k.withColumn("threshold", F.lit(None).cast("double")).unionByName(grid)
             .groupBy(*gs, "i").agg(F.sum("pos_k").alias("pos_k"), F.sum("neg_k").alias("neg_k"), F.max("threshold").alias("threshold")))
    w_upto = Window.partitionBy(*gs).orderBy("i").rowsBetween(Window.unboundedPreceding,
                                                              Window.currentRow)
    w_all = Window.partitionBy(*gs)
    cum = per_i.select(*gs, "i", "threshold", F.sum("pos_k").over(w_upto).alias("fn"),
                       F.sum("neg_k").over(w_upto).alias("_neg_le"), F.sum("neg_k").over(w_all).alias("N"))
    fp = F.col("N") - F.col("_neg_le")
    cost = F.col("fn").cast("double") * F.lit(fn_cost) + fp.cast("double") * F.lit(fp_cost)
    # the rows beyond the last threshold belong to none
    return cum.where(F.col("i") < len(ts)).select(
        *list(groups), "threshold", F.col("fn").cast("bigint").alias("fn"),
        fp.cast("bigint").alias("fp"), cost.alias("cost"))


def optimal_threshold(df: DataFrame, label: str = "label", score: str = "score",
                      thresholds: Sequence[float] | None = None,
                      groups: Sequence[str] = ()) -> DataFrame:
    """The threshold of least cost (ties -> the lowest threshold), per group:
    ``min(struct(cost, threshold))`` is algebraic, no sort of the curve."""
    c = cost_curve(df, label, score, thresholds, groups=groups)
    best = c.groupBy(*groups).agg(F.min(F.struct("cost", "threshold")).alias("_b"))
    return best.select(*groups, F.col("_b.threshold").alias("optimal_threshold"),
                       F.col("_b.cost").alias("optimal_cost"))


def metrics_at_thresholds(df: DataFrame, thresholds: Sequence[tuple[str, float]],
                          label: str = "label", score: str = "score") -> DataFrame:
    """One row per named threshold with counts, metrics and cost -- one pass."""
    y, s = _y(label), F.col(score)
    aggs = []
    for i, (_, t) in enumerate(thresholds):
        p = s >= F.lit(float(t))
        aggs += [F.count_if((y == 0) & ~p).alias(f"tn{i}"), F.count_if((y == 0) & p).alias(f"fp{i}"),
                 F.count_if((y == 1) & ~p).alias(f"fn{i}"), F.count_if((y == 1) & p).alias(f"tp{i}")]
    wide = df.agg(*aggs)
    arr = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(t)).alias("threshold"),
                             *[F.col(f"{c}{i}").alias(c) for c in ("tn", "fp", "fn", "tp")])
                    for i, (name, t) in enumerate(thresholds)])
    long = wide.select(F.explode(arr).alias("kv")).select("kv.*")
    return long.select("name", "threshold", "tn", "fp", "fn", "tp", *metric_columns())


def threshold_comparison(df: DataFrame, label: str = "label", score: str = "score",
                         default: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Default vs cost-optimal threshold, with the cost reduction in %."""
    opt = optimal_threshold(df, label, score).first()["optimal_threshold"]
    m = metrics_at_thresholds(df, [("default", default), ("optimal", opt)], label, score)
    base = m.where(F.col("name") == "default").select(F.col("business_cost").alias("_base"))
    j = m.withColumn("_k", F.lit(1)).join(F.broadcast(base.withColumn("_k", F.lit(1))), "_k")
    red = F.try_divide((F.col("_base") - F.col("business_cost")) * 100.0, F.col("_base"))
    return j.select(*m.columns, red.alias("cost_reduction_pct"))
