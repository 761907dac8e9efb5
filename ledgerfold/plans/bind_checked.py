"""Bindings: operators whose results SQL repeats besides those of the other
modules -- sources and stores (A2, A4, A7), derived columns and counts (B10, D5),
wide correlation and binned KDE (E3, D20), baselines and a linear learner under
cross-validation (I1, I5, I6), thresholds chosen elsewhere (I16), score summary by
class (I19), the run log (J1, J2) and scoring by a stored model (J4, J5)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerfold.functions.nullsafe import cents
from ledgerfold.operators import correlation as C
from ledgerfold.operators import evaluate as V
from ledgerfold.operators import linear as L
from ledgerfold.operators import profile as P
from ledgerfold.operators import sampling as S
from ledgerfold.operators import scoring as J
from ledgerfold.operators.aggregate import group_size
from ledgerfold.plans.bind_common import SCORED_SQL, _exact_mean_sql, scored_labels
from ledgerfold.plans.bind_eval import _QUOTA_SQL, _corr_sql, _metrics_sql
from ledgerfold.plans.bind_features import PREVIOUS_SQL, previous_view
from ledgerfold.plans.bind_profile import _describe_sql
from ledgerfold.plans.catalog import register
from ledgerfold.session import checkpoint_dir
from ledgerfold.sources import feature_store as FS
from ledgerfold.sources import runlog as RL
from ledgerfold.sources.csv import read_csv
from ledgerfold.sources.tables import table


def _folder(spark, kind):
    return f"{checkpoint_dir(spark).rstrip('/')}/{kind}/{uuid.uuid4().hex}"


# -- A: sources and stores -----------------------------------------------------------

@register("csv_scan_latin1", """
SELECT p_partkey, 'é' || p_name || 'ß' AS p_name, p_size, CASE WHEN p_size % 3 <> 0 THEN p_retailprice END AS p_retailprice
FROM part WHERE p_brand <> 'Brand#11'""")
def csv_scan_latin1(spark, sf):
    """part as an ISO-8859-1 CSV, scanned with that encoding and filtered."""
    path, p = _folder(spark, "csv"), table(spark, sf, "part")
    text = p.select(F.col("p_partkey").cast("string").alias("p_partkey"), F.concat(F.lit("é"), "p_name", F.lit("ß")).alias("p_name"), "p_brand",
                    F.col("p_size").cast("string").alias("p_size"),
                    F.when(F.col("p_size") % 3 != 0, F.col("p_retailprice").cast("string")).otherwise("n/a").alias("p_retailprice"))
    text.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    schema = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType()), T.StructField("p_brand", T.StringType()),
                           T.StructField("p_size", T.IntegerType()), T.StructField("p_retailprice", T.DoubleType())])
    return read_csv(spark, path, schema, encoding="ISO-8859-1").where(F.col("p_brand") != "Brand#11").drop("p_brand")


@register("feature_table_shape", f"""
SELECT count(*) AS n_rows, 6 AS n_columns, count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg
FROM ({SCORED_SQL})""")
def feature_table_shape(spark, sf):
    return FS.write_features(scored_labels(spark, sf), _folder(spark, "features"), target="label")


@register("split_bundle_read", _QUOTA_SQL + """
SELECT label, split, n FROM s WHERE n > 0 AND split = 'val'""")
def split_bundle_read(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    path = _folder(spark, "bundle")
    FS.write_split_bundle(S.stratified_split(labels, ["doc_id"], "label", (0.6, 0.2, 0.2), seed=42), path)
    return FS.read_split(spark, path, "val").groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


# -- B, D: derived columns and counts -------------------------------------------------

@register("app_credit_perc", f"""
SELECT SK_ID_PREV, CAST(AMT_APPLICATION AS DOUBLE) / nullif(CAST(AMT_CREDIT AS DOUBLE), 0) AS APP_CREDIT_PERC FROM ({PREVIOUS_SQL})""")
def app_credit_perc(spark, sf):
    from ledgerfold.functions.nullsafe import safe_divide
    return previous_view(spark, sf).select("SK_ID_PREV", safe_divide("AMT_APPLICATION", "AMT_CREDIT").alias("APP_CREDIT_PERC"))


@register("group_row_count", "SELECT user_id, count(*) AS POS_COUNT FROM events GROUP BY user_id")
def group_row_count(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(group_size("POS_"))


# -- E, D20: many columns, many values -------------------------------------------------

# 24 whole-number columns, so 300 pairs: more than one aggregate holds
_WIDE = {f"w{i}": (f"CASE WHEN (l_orderkey + l_linenumber) % {i + 5} <> 0 THEN CAST(l_quantity AS BIGINT) * {i} + l_partkey * (l_linenumber % {i + 2}) END") for i in range(24)}
_WIDE_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _WIDE.items()) + " FROM lineitem"


@register("corr_matrix_wide", f"WITH w AS ({_WIDE_SQL}), c AS (SELECT " + ", ".join(
    f"{_corr_sql(f'CASE WHEN {b} IS NOT NULL THEN {a} END', f'CASE WHEN {a} IS NOT NULL THEN {b} END')} AS {a}_{b}"
    for i, a in enumerate(_WIDE) for b in list(_WIDE)[i:]) + " FROM w)\n" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {a}_{b} AS corr FROM c" for i, a in enumerate(_WIDE) for b in list(_WIDE)[i:]))
def corr_matrix_wide(spark, sf):
    return C.corr_matrix(table(spark, sf, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in _WIDE.items()]), list(_WIDE))


@register("kde_binned", """
WITH e AS (SELECT CAST(round(l_extendedprice * 100.0) AS BIGINT) AS v FROM lineitem),
st AS (SELECT count(v) AS n, sqrt(CAST(count(v) * sum(CAST(v AS HUGEINT) * v) - sum(CAST(v AS HUGEINT)) * sum(CAST(v AS HUGEINT)) AS DOUBLE)
         / CAST(count(v) * (count(v) - 1) AS DOUBLE)) AS sd, CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi FROM e),
p AS (SELECT n, sd * pow(n, -0.2) AS h, sd * pow(n, -0.2) / 64 AS w, lo, (hi - lo) / 499 AS step FROM st),
b AS (SELECT CAST(floor((v - lo) / w) AS BIGINT) AS j, (v - lo) / w - floor((v - lo) / w) AS f FROM e, p),
m AS (SELECT j, sum(c) AS c FROM (SELECT j, sum(1 - f) AS c FROM b GROUP BY j UNION ALL SELECT j + 1, sum(f) FROM b GROUP BY j) GROUP BY j),
g AS (SELECT CAST(range AS INTEGER) AS grid FROM range(500))
SELECT g.grid, p.lo + g.grid * p.step AS x,
  round(coalesce(sum(m.c * exp(-0.5 * ((p.lo + g.grid * p.step - p.lo - m.j * p.w) / p.h) * ((p.lo + g.grid * p.step - p.lo - m.j * p.w) / p.h))), 0)
        * (1.0 / (p.n * p.h * sqrt(2.0 * pi()))), 12) AS density
FROM g, m, p GROUP BY g.grid, p.lo, p.step, p.n, p.h""")
def kde_binned(spark, sf):
    k = P.kde_grid(table(spark, sf, "lineitem").select(cents("l_extendedprice").alias("v")), "v", 500)
    return k.withColumn("density", F.round("density", 12))


# -- I: baselines and a linear learner under cross-validation -----------------------------

_FOLDS_SQL = f"SELECT *, CAST(doc_id % 5 AS INTEGER) AS fold FROM ({SCORED_SQL})"


def _folds(spark, sf):
    return scored_labels(spark, sf).withColumn("fold", (F.col("doc_id") % 5).cast("int"))


@register("baseline_cv", f"""
WITH d AS ({_FOLDS_SQL}), f AS (SELECT fold, count(*) AS n, sum(label) AS pos FROM d GROUP BY fold),
t AS (SELECT sum(n) AS n, sum(pos) AS pos FROM f),
m AS (SELECT f.fold, s.strategy, CASE WHEN s.strategy = 'prior' THEN CAST(t.pos - f.pos AS DOUBLE) / CAST(t.n - f.n AS DOUBLE)
        ELSE CASE WHEN 2 * (t.pos - f.pos) > t.n - f.n THEN 1.0 ELSE 0.0 END END AS score FROM f, t, (VALUES ('prior'), ('most_frequent')) s(strategy)),
c AS (SELECT m.fold, m.strategy, count(*) FILTER (WHERE label = 0 AND NOT m.score >= 0.5) AS tn, count(*) FILTER (WHERE label = 0 AND m.score >= 0.5) AS fp,
        count(*) FILTER (WHERE label = 1 AND NOT m.score >= 0.5) AS fn, count(*) FILTER (WHERE label = 1 AND m.score >= 0.5) AS tp
      FROM d JOIN m USING (fold) GROUP BY m.fold, m.strategy)
SELECT fold, strategy, tn, fp, fn, tp, {_metrics_sql()} FROM c""")
def baseline_cv(spark, sf):
    return J.baseline_cross_validation(_folds(spark, sf), "fold", ["prior", "most_frequent"])


_X = ["n_chars", "n_lead"]
_LINEAR_SQL = f"""
WITH d AS (SELECT doc_id, fold, quality, n_chars, CAST(n_chars % 97 AS BIGINT) AS n_lead FROM ({_FOLDS_SQL})),
f AS (SELECT fold, CAST(count(*) AS HUGEINT) AS n, sum(CAST(n_chars AS HUGEINT)) AS s1, sum(CAST(n_lead AS HUGEINT)) AS s2, sum(CAST(quality AS HUGEINT)) AS sy,
        sum(CAST(n_chars AS HUGEINT) * n_chars) AS c11, sum(CAST(n_chars AS HUGEINT) * n_lead) AS c12, sum(CAST(n_lead AS HUGEINT) * n_lead) AS c22,
        sum(CAST(n_chars AS HUGEINT) * quality) AS c1y, sum(CAST(n_lead AS HUGEINT) * quality) AS c2y FROM d GROUP BY ROLLUP (fold)),
t AS (SELECT * FROM f WHERE fold IS NULL),
l AS (SELECT f.fold, {', '.join(f't.{c} - coalesce(f.{c}, 0) AS {c}' for c in ('n', 's1', 's2', 'sy', 'c11', 'c12', 'c22', 'c1y', 'c2y'))} FROM f, t WHERE f.fold IS NOT NULL
      UNION ALL SELECT NULL, n, s1, s2, sy, c11, c12, c22, c1y, c2y FROM t),
a AS (SELECT fold, CAST(n AS DOUBLE) AS n, CAST(s1 AS DOUBLE) AS s1, CAST(s2 AS DOUBLE) AS s2, CAST(sy AS DOUBLE) AS sy,
        CAST(n * c11 - s1 * s1 AS DOUBLE) AS a11, CAST(n * c12 - s1 * s2 AS DOUBLE) AS a12, CAST(n * c22 - s2 * s2 AS DOUBLE) AS a22,
        CAST(n * c1y - s1 * sy AS DOUBLE) AS b1, CAST(n * c2y - s2 * sy AS DOUBLE) AS b2 FROM l),
w AS (SELECT *, (b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12) AS w1, (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) AS w2 FROM a),
m AS (SELECT fold, sy / n - w1 * (s1 / n) - w2 * (s2 / n) AS w0, w1, w2 FROM w)"""


def _linear_rows(spark, sf):
    return _folds(spark, sf).withColumn("n_lead", F.col("n_chars") % 97)


@register("cv_linear_metrics", _LINEAR_SQL + f""",
o AS (SELECT d.fold, d.quality AS label, least(greatest(w0 + w1 * d.n_chars + w2 * d.n_lead, 0.0), 1.0) AS score FROM d JOIN m USING (fold)),
c AS (SELECT fold, count(*) FILTER (WHERE label = 0 AND NOT score >= 0.5) AS tn, count(*) FILTER (WHERE label = 0 AND score >= 0.5) AS fp,
        count(*) FILTER (WHERE label = 1 AND NOT score >= 0.5) AS fn, count(*) FILTER (WHERE label = 1 AND score >= 0.5) AS tp FROM o GROUP BY fold),
g AS (SELECT fold, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM o GROUP BY fold, score),
r AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY fold ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
u AS (SELECT fold, CAST(sum(2 * pos * below + pos * neg) AS DOUBLE) / CAST(2 * sum(pos) * sum(neg) AS DOUBLE) AS roc_auc FROM r GROUP BY fold)
SELECT c.fold, tn, fp, fn, tp, {_metrics_sql()}, u.roc_auc FROM c JOIN u USING (fold)""")
def cv_linear_metrics(spark, sf):
    return L.cross_validate(_linear_rows(spark, sf), _X, "quality", "fold")


@register("score_linear_model", _LINEAR_SQL + """,
s AS (SELECT d.doc_id, round(least(greatest(w0 + w1 * d.n_chars + w2 * d.n_lead, 0.0), 1.0), 9) AS probability FROM d, m WHERE m.fold IS NULL)
SELECT r.doc_id, s.probability, CAST(s.probability >= 0.475 AS INTEGER) AS prediction, 0.475::DOUBLE AS threshold,
  CASE WHEN s.doc_id IS NULL THEN NULL WHEN s.probability >= 0.475 THEN 'refuse: default risk above threshold' ELSE 'grant: default risk below threshold' END AS recommendation,
  CASE WHEN s.doc_id IS NULL THEN 'not found' ELSE 'found' END AS status
FROM documents r LEFT JOIN s USING (doc_id)""")
def score_linear_model(spark, sf):
    """A model fitted on the labelled documents, stored, read back and applied
    to a request for every document."""
    rows, path = _linear_rows(spark, sf), _folder(spark, "models")
    L.save_model(L.fit(rows, _X, "quality"), path)
    out = L.score_requests(table(spark, sf, "documents").select("doc_id"), rows, L.load_model(spark, path), "doc_id")
    return out.withColumn("probability", F.round("probability", 9))


@register("holdout_threshold", f"""
WITH d AS ({_FOLDS_SQL}), v AS (SELECT * FROM d WHERE fold = 3), t AS (SELECT * FROM d WHERE fold = 4),
g AS (SELECT CASE WHEN range = 99 THEN 1.0::DOUBLE ELSE range * (1.0::DOUBLE / 99) END AS threshold FROM range(100)),
k AS (SELECT g.threshold, 10.0 * count(*) FILTER (WHERE v.label = 1 AND v.score < g.threshold) + count(*) FILTER (WHERE v.label = 0 AND v.score >= g.threshold) AS cost
      FROM g, v GROUP BY g.threshold),
th AS (SELECT 'validation' AS name, threshold FROM (SELECT threshold FROM k ORDER BY cost, threshold LIMIT 1) UNION ALL SELECT 'production', 0.475::DOUBLE),
c AS (SELECT th.name, th.threshold, count(*) FILTER (WHERE t.label = 0 AND NOT t.score >= th.threshold) AS tn, count(*) FILTER (WHERE t.label = 0 AND t.score >= th.threshold) AS fp,
        count(*) FILTER (WHERE t.label = 1 AND NOT t.score >= th.threshold) AS fn, count(*) FILTER (WHERE t.label = 1 AND t.score >= th.threshold) AS tp FROM th, t GROUP BY th.name, th.threshold)
SELECT name, threshold, tn, fp, fn, tp, {_metrics_sql()} FROM c""")
def holdout_threshold(spark, sf):
    """The threshold of least cost on one part, metrics at it on another."""
    rows = _folds(spark, sf)
    t = V.optimal_threshold(rows.where("fold = 3")).first()["optimal_threshold"]
    return V.metrics_at_thresholds(rows.where("fold = 4"), [("validation", t), ("production", J.THRESHOLD)])


_MILLI_SQL = f"SELECT label, CAST((n_chars * 37) % 1000 AS BIGINT) AS milli FROM ({SCORED_SQL})"


@register("score_summary_by_class", _describe_sql(_MILLI_SQL, ["milli"], ["label"]))
def score_summary_by_class(spark, sf):
    scored = scored_labels(spark, sf).select("label", ((F.col("n_chars") * 37) % 1000).cast("bigint").alias("milli"))
    return P.describe(scored, ["milli"], ["label"])


# -- J: the run log ----------------------------------------------------------------------

@register("best_run_by_tag", f"""
WITH r AS (SELECT event_type AS name, 'run ' || event_id AS run_id, 'model ' || user_id AS model, value, 'k' || CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 AS tag FROM events),
b AS (SELECT *, row_number() OVER (PARTITION BY name, tag ORDER BY value DESC, run_id) AS first, row_number() OVER (PARTITION BY name, tag ORDER BY value, run_id) AS last FROM r)
SELECT name, 'k1' AS tag, max(run_id) FILTER (WHERE first = 1) AS best_high, max(value) FILTER (WHERE first = 1) AS value_high,
  max(run_id) FILTER (WHERE last = 1) AS best_low, max(value) FILTER (WHERE last = 1) AS value_low FROM b WHERE tag = 'k1' GROUP BY name""")
def best_run_by_tag(spark, sf):
    """Events as a run log written in two commits (tags, then metrics); per
    metric the best run with a tag, highest and lowest first."""
    e, path = table(spark, sf, "events"), _folder(spark, "runs")
    run, model = F.concat(F.lit("run "), F.col("event_id").cast("string")), F.concat(F.lit("model "), F.col("user_id").cast("string"))
    common = [run.alias("run_id"), model.alias("model")]
    tag = F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("int") % 3).cast("string"))
    none, ts = F.lit(None).cast("string"), F.lit(0.0).alias("ts")
    RL.append(e.select(*common, F.lit("tag").alias("kind"), F.lit("k").alias("name"), F.lit(None).cast("double").alias("value"), tag.alias("text"), ts), path)
    RL.append(e.select(*common, F.lit("metric").alias("kind"), F.col("event_type").alias("name"), "value", none.alias("text"), ts), path)
    runs = RL.read_runs(spark, path)
    high, low = (RL.best_runs(runs, tag=("k", "k1"), ascending=asc) for asc in (False, True))
    return (high.select("name", F.lit("k1").alias("tag"), F.col("run_id").alias("best_high"), F.col("value").alias("value_high"))
            .join(low.select("name", F.col("run_id").alias("best_low"), F.col("value").alias("value_low")), "name"))
