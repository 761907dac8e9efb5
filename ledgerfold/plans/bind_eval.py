"""Bindings: correlation (E), ordering (F), sampling/splits (H), evaluation
(I, non-model) and run-log / decision operators (I17, J3-J5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerfold.functions.nullsafe import cents
from ledgerfold.operators import correlation as C
from ledgerfold.operators import evaluate as V
from ledgerfold.operators import ordering as O
from ledgerfold.operators import sampling as S
from ledgerfold.operators import scoring as J
from ledgerfold.plans.bind_common import SCORED_SQL, scored_labels
from ledgerfold.plans.catalog import register
from ledgerfold.sources.tables import table

# -- E: correlation on integral lineitem measures ------------------------------

_LI_NUM_SQL = """SELECT CAST(l_quantity AS BIGINT) AS qty,
  CAST(round(l_extendedprice * 100.0) AS BIGINT) AS price_c,
  CAST(round(l_discount * 100.0) AS BIGINT) AS disc_pct,
  CAST(round(l_tax * 100.0) AS BIGINT) AS tax_pct, l_linenumber,
  CAST(l_returnflag = 'R' AS INTEGER) AS returned FROM lineitem"""
_NUM = ["qty", "price_c", "disc_pct", "tax_pct", "l_linenumber"]


def _li_num(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_quantity").cast("bigint").alias("qty"),
                     cents("l_extendedprice").alias("price_c"),
                     cents("l_discount").alias("disc_pct"),
                     cents("l_tax").alias("tax_pct"), "l_linenumber",
                     (F.col("l_returnflag") == "R").cast("int").alias("returned"))


def _corr_sql(x, y):
    def m(a, b):
        return (f"count({a}) * sum(CAST({a} AS HUGEINT) * {b}) "
                f"- sum(CAST({a} AS HUGEINT)) * sum(CAST({b} AS HUGEINT))")
    return (f"CASE WHEN count({x}) > 1 THEN CAST({m(x, y)} AS DOUBLE) / "
            f"nullif(sqrt(CAST({m(x, x)} AS DOUBLE)) * sqrt(CAST({m(y, y)} AS DOUBLE)), 0) END")


_CORR_T_SQL = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, {_corr_sql(c, 'returned')} AS corr FROM ({_LI_NUM_SQL})" for c in _NUM)


@register("corr_with_target", _CORR_T_SQL)
def corr_with_target(spark, sf):
    return C.corr_with_target(_li_num(spark, sf), _NUM, "returned")


@register("top_abs_corr", f"""
SELECT feature, corr, abs(corr) AS abs_corr FROM ({_CORR_T_SQL})
ORDER BY abs_corr DESC NULLS LAST, feature LIMIT 3""")
def top_abs_corr(spark, sf):
    return C.top_abs_corr(_li_num(spark, sf), _NUM, "returned", k=3)


_MAT = ["qty", "price_c", "disc_pct", "tax_pct"]


@register("corr_matrix", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {_corr_sql(a, b)} AS corr FROM ({_LI_NUM_SQL})"
    for i, a in enumerate(_MAT) for b in _MAT[i:]))
def corr_matrix(spark, sf):
    return C.corr_matrix(_li_num(spark, sf), _MAT)


@register("spearman", f"""
WITH d AS (SELECT qty, price_c FROM ({_LI_NUM_SQL})),
r AS (SELECT 2 * (rank() OVER (ORDER BY qty) - 1) + count(*) OVER (PARTITION BY qty) + 1 AS rx,
             2 * (rank() OVER (ORDER BY price_c) - 1) + count(*) OVER (PARTITION BY price_c) + 1 AS ry
      FROM d)
SELECT {_corr_sql('rx', 'ry')} AS spearman, count(*) AS n FROM r""")
def spearman(spark, sf):
    return C.spearman(_li_num(spark, sf), "qty", "price_c")


# -- F: ordering ---------------------------------------------------------------

@register("top_k", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def top_k(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return O.top_k(o, "o_totalprice", 10, tie=["o_orderkey"])


@register("top_n_per_entity", """
WITH d AS (SELECT l_orderkey, l_linenumber,
             (CAST(round(l_discount * 100.0) AS BIGINT) - 5) * CAST(l_quantity AS BIGINT) AS value
           FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(value) DESC, l_linenumber, value) AS rank FROM d)
SELECT * FROM r WHERE rank <= 3""")
def top_n_per_entity(spark, sf):
    li = table(spark, sf, "lineitem")
    d = li.select("l_orderkey", "l_linenumber",
                  ((cents("l_discount") - 5) * F.col("l_quantity").cast("bigint")).alias("value"))
    # (order, line number) is not unique in the driver data: value breaks ties
    out = O.top_n_per_entity(d, "l_orderkey", "value", "l_linenumber", n=3, tie=["value"])
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@register("running_best", """
SELECT event_id, user_id, value,
  max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS best_so_far
FROM events""")
def running_best(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "value")
    return O.running_best(e, "event_id", "value", ["user_id"])


@register("max_normalise", """
SELECT p_partkey, p_retailprice, p_retailprice / ((SELECT max(p_retailprice) FROM part) + 1e-9) AS p_retailprice_norm
FROM part""")
def max_normalise(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return O.max_normalise(p, "p_retailprice")


# -- H: sampling and splits on the labelled items --------------------------------

def _labels(spark, sf):
    return table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))


_SAMPLE_N = 200


@register("stratified_sample", f"""
WITH c AS (SELECT toxic AS label, count(*) AS n FROM labels GROUP BY toxic),
a AS (SELECT label, n, least(n, {_SAMPLE_N // 2}) AS a FROM c),
t AS (SELECT {_SAMPLE_N} - sum(a) AS r FROM a)
SELECT label, CAST(a + CASE WHEN n > a THEN least(r, n - a) ELSE 0 END AS BIGINT) AS n FROM a, t""")
def stratified_sample(spark, sf):
    s = S.stratified_sample(_labels(spark, sf), ["doc_id"], "label", _SAMPLE_N, seed=42)
    return s.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


_QUOTA_SQL = """
WITH c AS (SELECT toxic AS label, count(*) AS n FROM labels GROUP BY toxic),
q AS (SELECT label, n, CAST(ceil(n * 0.2) AS BIGINT) AS nt FROM c),
q2 AS (SELECT label, n, nt, CAST(ceil((n - nt) * 0.25) AS BIGINT) AS nv FROM q),
s AS (SELECT label, 'test' AS split, nt AS n, nt * label AS npos FROM q2
      UNION ALL SELECT label, 'val', nv, nv * label FROM q2
      UNION ALL SELECT label, 'train', n - nt - nv, (n - nt - nv) * label FROM q2)"""


@register("stratified_split_counts", _QUOTA_SQL + """
SELECT label, split, n FROM s WHERE n > 0""")
def stratified_split_counts(spark, sf):
    s = S.stratified_split(_labels(spark, sf), ["doc_id"], "label", (0.6, 0.2, 0.2), seed=42)
    return s.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


@register("kfold_counts", """
WITH c AS (SELECT toxic AS label, count(*) AS n FROM labels GROUP BY toxic)
SELECT label, CAST(f.range AS INTEGER) AS fold,
  n // 5 + CASE WHEN f.range < n % 5 THEN 1 ELSE 0 END AS n
FROM c, range(5) f WHERE n // 5 + CASE WHEN f.range < n % 5 THEN 1 ELSE 0 END > 0""")
def kfold_counts(spark, sf):
    f = S.stratified_kfold(_labels(spark, sf), ["doc_id"], "label", k=5, seed=42)
    return f.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


@register("split_summary", _QUOTA_SQL + """,
t AS (SELECT sum(n) AS tot FROM c)
SELECT split, sum(n)::BIGINT AS n, sum(n) / CAST(tot AS DOUBLE) AS ratio,
  CAST(sum(npos) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS positive_rate, 1 AS n_features
FROM s, t GROUP BY split, tot""")
def split_summary(spark, sf):
    s = S.stratified_split(_labels(spark, sf), ["doc_id"], "label", (0.6, 0.2, 0.2), seed=42)
    return S.split_summary(s, "label", n_features=1)


# -- I: evaluation of a fixed score ----------------------------------------------

@register("confusion_counts", f"""
WITH s AS ({SCORED_SQL})
SELECT count(*) FILTER (WHERE label = 0 AND NOT score >= 0.5) AS tn, count(*) FILTER (WHERE label = 0 AND score >= 0.5) AS fp,
       count(*) FILTER (WHERE label = 1 AND NOT score >= 0.5) AS fn, count(*) FILTER (WHERE label = 1 AND score >= 0.5) AS tp FROM s""")
def confusion_counts(spark, sf):
    return V.confusion_counts(scored_labels(spark, sf))


def _metrics_sql(c="c"):
    n = "(tn + fp + fn + tp)"
    def r(a, b):
        return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0.0)"
    return (f"{r('tp + tn', n)} AS accuracy, {r('tp', 'tp + fp')} AS precision, "
            f"{r('tp', 'tp + fn')} AS recall, {r('2 * tp', '2 * tp + fp + fn')} AS f1, "
            f"CAST(fn AS DOUBLE) * 10.0 + CAST(fp AS DOUBLE) * 1.0 AS business_cost")


_CONF_SQL = f"""
WITH s AS ({SCORED_SQL}),
c AS (SELECT count(*) FILTER (WHERE label = 0 AND NOT score >= {{t}}) AS tn, count(*) FILTER (WHERE label = 0 AND score >= {{t}}) AS fp,
             count(*) FILTER (WHERE label = 1 AND NOT score >= {{t}}) AS fn, count(*) FILTER (WHERE label = 1 AND score >= {{t}}) AS tp FROM s)"""


@register("classification_metrics", _CONF_SQL.format(t=0.5) + f"""
SELECT tn, fp, fn, tp, {_metrics_sql()} FROM c""")
def classification_metrics(spark, sf):
    return V.classification_metrics(scored_labels(spark, sf))


@register("business_cost", _CONF_SQL.format(t=0.5) + """
SELECT fn, fp, CAST(fn AS DOUBLE) * 10.0 + CAST(fp AS DOUBLE) * 1.0 AS business_cost,
  (CAST(fn AS DOUBLE) * 10.0 + CAST(fp AS DOUBLE) * 1.0) / CAST(tn + fp + fn + tp AS DOUBLE) AS cost_per_sample
FROM c""")
def business_cost(spark, sf):
    return V.business_cost(scored_labels(spark, sf))


_CUM_SQL = f"""
WITH s AS ({SCORED_SQL}),
d AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM s GROUP BY score),
r AS (SELECT *, coalesce(sum(pos) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bpos,
                coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bneg
      FROM d),
t AS (SELECT sum(pos) AS P, sum(neg) AS N FROM d),
c AS (SELECT r.*, t.P, t.N, t.P - r.bpos AS tp, t.N - r.bneg AS fp FROM r, t)"""


@register("roc_auc", _CUM_SQL + """
SELECT CAST(sum(2 * pos * bneg + pos * neg) AS DOUBLE) / CAST(2 * max(P) * max(N) AS DOUBLE) AS roc_auc,
  sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg FROM c""")
def roc_auc(spark, sf):
    return V.roc_auc(scored_labels(spark, sf))


@register("average_precision", _CUM_SQL + """
SELECT round(sum(pos * (CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE))) / CAST(max(P) AS DOUBLE), 12) AS average_precision FROM c""")
def average_precision(spark, sf):
    ap = V.average_precision(scored_labels(spark, sf))
    return ap.select(F.round("average_precision", 12).alias("average_precision"))


@register("roc_points", _CUM_SQL + """
SELECT score AS threshold, CAST(fp AS DOUBLE) / CAST(N AS DOUBLE) AS fpr, CAST(tp AS DOUBLE) / CAST(P AS DOUBLE) AS tpr FROM c""")
def roc_points(spark, sf):
    return V.roc_points(scored_labels(spark, sf))


@register("pr_points", _CUM_SQL + """
SELECT score AS threshold, CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) AS precision,
  CAST(tp AS DOUBLE) / CAST(P AS DOUBLE) AS recall FROM c""")
def pr_points(spark, sf):
    return V.pr_points(scored_labels(spark, sf))


_CURVE_SQL = f"""
WITH s AS ({SCORED_SQL}),
g AS (SELECT CASE WHEN range = 99 THEN 1.0::DOUBLE ELSE range * (1.0::DOUBLE / 99) END AS threshold FROM range(100)),
k AS (SELECT g.threshold, count(*) FILTER (WHERE s.label = 1 AND s.score < g.threshold) AS fn,
             count(*) FILTER (WHERE s.label = 0 AND s.score >= g.threshold) AS fp
      FROM g, s GROUP BY g.threshold),
cc AS (SELECT threshold, fn, fp, CAST(fn AS DOUBLE) * 10.0 + CAST(fp AS DOUBLE) * 1.0 AS cost FROM k)"""


@register("cost_curve", _CURVE_SQL + "\nSELECT * FROM cc")
def cost_curve(spark, sf):
    return V.cost_curve(scored_labels(spark, sf))


@register("optimal_threshold", _CURVE_SQL + """
SELECT threshold AS optimal_threshold, cost AS optimal_cost FROM cc ORDER BY cost, threshold LIMIT 1""")
def optimal_threshold(spark, sf):
    return V.optimal_threshold(scored_labels(spark, sf))


@register("threshold_comparison", _CURVE_SQL + f""",
o AS (SELECT threshold FROM cc ORDER BY cost, threshold LIMIT 1),
th AS (SELECT 'default' AS name, 0.5::DOUBLE AS threshold UNION ALL SELECT 'optimal', threshold FROM o),
c AS (SELECT th.name, th.threshold,
        count(*) FILTER (WHERE s.label = 0 AND NOT s.score >= th.threshold) AS tn, count(*) FILTER (WHERE s.label = 0 AND s.score >= th.threshold) AS fp,
        count(*) FILTER (WHERE s.label = 1 AND NOT s.score >= th.threshold) AS fn, count(*) FILTER (WHERE s.label = 1 AND s.score >= th.threshold) AS tp
      FROM th, s GROUP BY th.name, th.threshold),
m AS (SELECT name, threshold, tn, fp, fn, tp, {_metrics_sql()} FROM c)
SELECT m.*, (b.business_cost - m.business_cost) * 100.0 / nullif(b.business_cost, 0) AS cost_reduction_pct
FROM m, (SELECT business_cost FROM m WHERE name = 'default') b""")
def threshold_comparison(spark, sf):
    return V.threshold_comparison(scored_labels(spark, sf))


# -- I1/I2: baselines and class weights --------------------------------------------

@register("baseline_prior", f"""
WITH s AS ({SCORED_SQL}), p AS (SELECT CAST(sum(label) AS DOUBLE) / count(*) AS prior FROM s),
c AS (SELECT count(*) FILTER (WHERE label = 0 AND NOT p.prior >= 0.5) AS tn, count(*) FILTER (WHERE label = 0 AND p.prior >= 0.5) AS fp,
             count(*) FILTER (WHERE label = 1 AND NOT p.prior >= 0.5) AS fn, count(*) FILTER (WHERE label = 1 AND p.prior >= 0.5) AS tp
      FROM s, p)
SELECT p.prior AS constant_score, 0.5::DOUBLE AS roc_auc, tn, fp, fn, tp, {_metrics_sql()} FROM c, p""")
def baseline_prior(spark, sf):
    return J.baseline_metrics(scored_labels(spark, sf), "prior")


@register("baseline_most_frequent", f"""
WITH s AS ({SCORED_SQL}), p AS (SELECT CASE WHEN 2 * sum(label) > count(*) THEN 1.0 ELSE 0.0 END::DOUBLE AS prior FROM s),
c AS (SELECT count(*) FILTER (WHERE label = 0 AND NOT p.prior >= 0.5) AS tn, count(*) FILTER (WHERE label = 0 AND p.prior >= 0.5) AS fp,
             count(*) FILTER (WHERE label = 1 AND NOT p.prior >= 0.5) AS fn, count(*) FILTER (WHERE label = 1 AND p.prior >= 0.5) AS tp
      FROM s, p)
SELECT p.prior AS constant_score, 0.5::DOUBLE AS roc_auc, tn, fp, fn, tp, {_metrics_sql()} FROM c, p""")
def baseline_most_frequent(spark, sf):
    return J.baseline_metrics(scored_labels(spark, sf), "most_frequent")


@register("class_weights", """
WITH c AS (SELECT toxic AS label, count(*) AS n FROM labels GROUP BY toxic),
t AS (SELECT sum(n) AS tot, sum(CASE WHEN label = 0 THEN n END) AS neg, sum(CASE WHEN label = 1 THEN n END) AS pos FROM c)
SELECT label, n, CAST(tot AS DOUBLE) / (2.0 * n) AS weight,
  CAST(neg AS DOUBLE) / CAST(pos AS DOUBLE) AS scale_pos_weight FROM c, t""")
def class_weights(spark, sf):
    return J.class_weights(_labels(spark, sf), "label")


# -- I17 / J3: run log as events (run = event, model = user, metric = type) ----------

@register("best_run", """
WITH r AS (SELECT event_type AS metric, event_id AS run_id, user_id AS model, value,
             row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events)
SELECT metric, run_id, model, value FROM r WHERE rn = 1""")
def best_run(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("metric"),
                                          F.col("event_id").alias("run_id"),
                                          F.col("user_id").alias("model"), "value")
    return J.best_by(e, ["metric"], "value", "run_id", ["model"])


@register("metric_winner", """
WITH m AS (SELECT event_type AS metric, user_id AS model,
             CAST(sum(CAST(round(value * 100.0) AS BIGINT)) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS mean_c
           FROM events GROUP BY event_type, user_id),
w AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY mean_c DESC, model) AS rn FROM m),
b AS (SELECT metric, mean_c AS baseline_c FROM m WHERE model = 0)
SELECT w.metric, w.model AS winner, w.mean_c AS best_mean_c, b.baseline_c,
  (w.mean_c - b.baseline_c) * 100.0 / nullif(b.baseline_c, 0) AS improvement_pct
FROM w LEFT JOIN b USING (metric) WHERE rn = 1""")
def metric_winner(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("metric"),
                                          F.col("user_id").alias("model"),
                                          cents("value").alias("v"))
    return J.metric_winner(e, "metric", "model", "v", baseline_model=0)


@register("latest_version", """
WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate,
             row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT o_custkey, o_orderkey AS latest_orderkey, o_orderdate AS latest_date FROM r WHERE rn = 1""")
def latest_version(spark, sf):
    o = table(spark, sf, "orders")
    return J.latest_per_key(o, "o_custkey", ["o_orderdate", "o_orderkey"],
                            {"o_orderkey": "latest_orderkey", "o_orderdate": "latest_date"})


# -- J4/J5: decisions for requested ids ---------------------------------------------

@register("score_decision", f"""
WITH s AS ({SCORED_SQL})
SELECT doc_id AS client_id, score AS probability, CAST(score >= 0.475 AS INTEGER) AS prediction,
  0.475::DOUBLE AS threshold,
  CASE WHEN score >= 0.475 THEN 'refuse: default risk above threshold'
       ELSE 'grant: default risk below threshold' END AS recommendation
FROM s""")
def score_decision(spark, sf):
    s = scored_labels(spark, sf).select(F.col("doc_id").alias("client_id"),
                                        F.col("score").alias("probability"))
    req = table(spark, sf, "labels").select(F.col("doc_id").alias("client_id"))
    return J.decide(req, s, "client_id", "probability")


@register("score_unknown_ids", """
WITH known AS (SELECT DISTINCT user_id FROM events)
SELECT c.c_custkey AS client_id, CASE WHEN k.user_id IS NULL THEN 'not found' ELSE 'found' END AS status
FROM customer c LEFT JOIN known k ON c.c_custkey = k.user_id""")
def score_unknown_ids(spark, sf):
    req = table(spark, sf, "customer").select(F.col("c_custkey").alias("client_id"))
    feats = table(spark, sf, "events").select(F.col("user_id").alias("client_id")).distinct()
    return J.request_status(req, feats, "client_id")
