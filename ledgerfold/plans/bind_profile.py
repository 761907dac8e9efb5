"""Bindings: grouped aggregation and profiling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerfold.functions.names import clean_name
from ledgerfold.functions.nullsafe import cents
from ledgerfold.operators import profile as P
from ledgerfold.operators.aggregate import grouped_agg
from ledgerfold.operators.encode import category_share, vocabulary
from ledgerfold.plans.bind_common import (
    CREDITS_SQL, SCORED_SQL, _exact_mean_sql, _exact_var_sql, _share_sql, _spec_sql, _sub,
    credits, scored_labels)
from ledgerfold.plans.catalog import register
from ledgerfold.sources.tables import table

# The driver's order priorities, order statuses, languages.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

_SPEC = {"amt": ["min", "max", "mean", "sum", "var"],
         "days": ["min", "max", "mean", "var"],
         "o_orderkey": ["nunique", "size"]}


@register("grouped_agg_spec", f"""
WITH o AS ({CREDITS_SQL})
SELECT o_custkey, {_spec_sql(_SPEC, 'PREV_')} FROM o GROUP BY o_custkey""")
def grouped_agg_spec(spark, sf):
    return grouped_agg(credits(spark, sf), "o_custkey", _SPEC, prefix="PREV_")


@register("category_share", f"""
SELECT o_custkey, {_share_sql('o_orderpriority', PRIORITIES, 'PREV_')}
FROM orders GROUP BY o_custkey""")
def category_share_q(spark, sf):
    o = table(spark, sf, "orders")
    vocab = vocabulary(o, "o_orderpriority")
    exprs = category_share("o_orderpriority", vocab, True, prefix="PREV_")
    out = o.groupBy("o_custkey").agg(*exprs)
    return out.toDF(*[clean_name(c) for c in out.columns])


# two levels: lines -> order (credit) -> customer; means of per-order means
# are rounded to 9 decimals (a sum of fractions depends on addition order).
_FLAGS = ["A", "N", "R"]


def _lines_per_order(spark, sf):
    li = table(spark, sf, "lineitem")
    agg = grouped_agg(li, "l_orderkey", {"l_linenumber": ["min", "max", "size"]},
                      extra=category_share("l_returnflag", vocabulary(li, "l_returnflag"), True))
    return agg


@register("two_level_agg", f"""
WITH bb AS (
  SELECT l_orderkey, min(l_linenumber) AS l_linenumber_MIN, max(l_linenumber) AS l_linenumber_MAX,
    count(*) AS l_linenumber_SIZE,
    {_share_sql('l_returnflag', _FLAGS, '')}
  FROM lineitem GROUP BY l_orderkey),
j AS (SELECT o.o_custkey, bb.* FROM orders o LEFT JOIN bb ON o.o_orderkey = bb.l_orderkey)
SELECT o_custkey,
  min(l_linenumber_MIN) AS BURO_l_linenumber_MIN_MIN,
  max(l_linenumber_MAX) AS BURO_l_linenumber_MAX_MAX,
  {_exact_mean_sql('l_linenumber_SIZE')} AS BURO_l_linenumber_SIZE_MEAN,
  coalesce(sum(l_linenumber_SIZE), 0)::BIGINT AS BURO_l_linenumber_SIZE_SUM,
  {", ".join(f"round(avg(l_returnflag_{v}_MEAN), 9) AS BURO_l_returnflag_{v}_MEAN_MEAN" for v in _FLAGS + ["nan"])}
FROM j GROUP BY o_custkey""")
def two_level_agg(spark, sf):
    bb = _lines_per_order(spark, sf)
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    j = o.join(bb, o.o_orderkey == bb.l_orderkey, "left")
    share_cols = [c for c in bb.columns if c.startswith("l_returnflag_")]
    out = grouped_agg(j, "o_custkey",
                      {"l_linenumber_MIN": ["min"], "l_linenumber_MAX": ["max"],
                       "l_linenumber_SIZE": ["mean", "sum"]},
                      prefix="BURO_",
                      extra=[F.round(F.avg(c), 9).alias(f"BURO_{c}_MEAN") for c in share_cols])
    return out


_SUBSET_SPEC = {"amt": ["max", "mean", "sum", "var"], "days": ["min", "max", "mean"],
                "o_orderkey": ["size"]}
_SUBSETS = [("ACTIVE_", "o_orderstatus = 'O'"), ("CLOSED_", "o_orderstatus = 'F'")]


@register("subset_agg", f"""
WITH o AS ({CREDITS_SQL})
SELECT o_custkey, count(*) AS ALL_COUNT,
  {", ".join(f"{_sub(fn, x, cond)} AS {pre}{x}_{fn.upper()}" for pre, cond in _SUBSETS for x, fns in _SUBSET_SPEC.items() for fn in fns)}
FROM o GROUP BY o_custkey""")
def subset_agg(spark, sf):
    o = credits(spark, sf)
    return grouped_agg(o, "o_custkey", {}, extra=[F.count(F.lit(1)).alias("ALL_COUNT")],
                       subsets={"ACTIVE_": F.col("o_orderstatus") == "O",
                                "CLOSED_": F.col("o_orderstatus") == "F"},
                       subset_spec=_SUBSET_SPEC)


@register("group_nunique", """
SELECT l_orderkey, count(DISTINCT l_suppkey) AS INSTAL_l_suppkey_NUNIQUE, count(*) AS INSTAL_COUNT
FROM lineitem GROUP BY l_orderkey""")
def group_nunique(spark, sf):
    li = table(spark, sf, "lineitem")
    return grouped_agg(li, "l_orderkey", {"l_suppkey": ["nunique"]}, prefix="INSTAL_",
                       extra=[F.count(F.lit(1)).alias("INSTAL_COUNT")])


@register("previous_count", """
SELECT c.c_custkey, count(o.o_orderkey) AS PREVIOUS_APPLICATION_COUNT
FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey""")
def previous_count(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    j = c.join(o, c.c_custkey == o.o_custkey, "left")
    return j.groupBy("c_custkey").agg(F.count("o_orderkey").alias("PREVIOUS_APPLICATION_COUNT"))


@register("value_counts", """
SELECT o_orderstatus, count(*) AS count FROM orders GROUP BY o_orderstatus""")
def value_counts_q(spark, sf):
    return P.value_counts(table(spark, sf, "orders"), "o_orderstatus")


@register("class_balance", """
SELECT count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS n_pos, count(*) FILTER (WHERE toxic = 0) AS n_neg,
  CAST(count(*) FILTER (WHERE toxic = 1) AS DOUBLE) / CAST(count(toxic) AS DOUBLE) AS positive_rate,
  CAST(count(*) FILTER (WHERE toxic = 0) AS DOUBLE) / nullif(CAST(count(*) FILTER (WHERE toxic = 1) AS DOUBLE), 0) AS imbalance_ratio
FROM labels""")
def class_balance_q(spark, sf):
    return P.class_balance(table(spark, sf, "labels"), "toxic")


def _describe_sql(src, cols, groups=()):
    g = ", ".join(groups)
    gsel = f"{g}, " if groups else ""
    parts = []
    for c in cols:
        parts.append(f"""SELECT {gsel}'{c}' AS "column", count({c}) AS count,
  {_exact_mean_sql(c)} AS mean, sqrt({_exact_var_sql(c)}) AS std,
  CAST(min({c}) AS DOUBLE) AS min, quantile_cont({c}, 0.25) AS p25,
  quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS p75, CAST(max({c}) AS DOUBLE) AS max
FROM ({src}) {"GROUP BY " + g if groups else ""}""")
    return "\nUNION ALL\n".join(parts)


@register("describe", _describe_sql(CREDITS_SQL, ["amt", "days"]))
def describe_q(spark, sf):
    return P.describe(credits(spark, sf), ["amt", "days"])


@register("describe_by_class", _describe_sql(CREDITS_SQL, ["amt", "days"], ["o_orderstatus"]))
def describe_by_class(spark, sf):
    return P.describe(credits(spark, sf), ["amt", "days"], groups=["o_orderstatus"])


def _cust_cents(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", "c_name", "c_nationkey",
                    cents("c_acctbal").alias("c_acctbal"), "c_mktsegment")


_CUST_CENTS_SQL = """SELECT c_custkey, c_name, c_nationkey,
  CAST(round(c_acctbal * 100.0) AS BIGINT) AS c_acctbal, c_mktsegment FROM customer"""


def _profile_sql():
    cols = [("c_custkey", "bigint", True), ("c_name", "string", False),
            ("c_nationkey", "int", True), ("c_acctbal", "bigint", True),
            ("c_mktsegment", "string", False)]
    parts = []
    for c, t, num in cols:
        stats = (f"""{_exact_mean_sql(c)} AS mean, sqrt({_exact_var_sql(c)}) AS std,
  CAST(min({c}) AS DOUBLE) AS min, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS median,
  quantile_cont({c}, 0.75) AS p75, CAST(max({c}) AS DOUBLE) AS max""" if num else
                 "NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS p25, "
                 "NULL::DOUBLE AS median, NULL::DOUBLE AS p75, NULL::DOUBLE AS max")
        parts.append(f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) AS n_rows, count({c}) AS non_null,
  count(DISTINCT {c}) AS n_distinct,
  CAST(count(*) - count({c}) AS DOUBLE) / count(*) AS null_rate,
  CAST(count(DISTINCT {c}) AS DOUBLE) / nullif(CAST(count({c}) AS DOUBLE), 0) AS distinct_rate,
  {stats}
FROM ({_CUST_CENTS_SQL})""")
    return "\nUNION ALL\n".join(parts)


@register("column_profile", _profile_sql())
def column_profile_q(spark, sf):
    return P.column_profile(_cust_cents(spark, sf))


@register("null_rates", """
WITH c AS (SELECT c_custkey, c_mktsegment,
  CASE WHEN c_mktsegment <> 'MACHINERY' THEN NULL ELSE c_acctbal END AS sparse_bal,
  CASE WHEN c_nationkey > 20 THEN NULL ELSE c_nationkey END AS nation FROM customer)
SELECT 'c_custkey' AS "column", count(*) - count(c_custkey) AS n_null, (count(*) - count(c_custkey)) * 100.0::DOUBLE / count(*) AS pct_null FROM c
UNION ALL SELECT 'c_mktsegment', count(*) - count(c_mktsegment), (count(*) - count(c_mktsegment)) * 100.0::DOUBLE / count(*) FROM c
UNION ALL SELECT 'sparse_bal', count(*) - count(sparse_bal), (count(*) - count(sparse_bal)) * 100.0::DOUBLE / count(*) FROM c
UNION ALL SELECT 'nation', count(*) - count(nation), (count(*) - count(nation)) * 100.0::DOUBLE / count(*) FROM c""")
def null_rates_q(spark, sf):
    from ledgerfold.plans.bind_cleaning import _cust_sparse
    return P.null_rates(_cust_sparse(spark, sf))


@register("dtype_counts")
def dtype_counts_q(spark, sf):
    return P.dtype_counts(table(spark, sf, "lineitem"))


@register("class_comparison", f"""
WITH s AS ({SCORED_SQL})
SELECT count(CASE WHEN label = 0 THEN n_chars END) AS n_0, count(CASE WHEN label = 1 THEN n_chars END) AS n_1,
  {_exact_mean_sql('CASE WHEN label = 0 THEN n_chars END')} AS mean_0,
  {_exact_mean_sql('CASE WHEN label = 1 THEN n_chars END')} AS mean_1,
  quantile_cont(CASE WHEN label = 0 THEN n_chars END, 0.5) AS median_0,
  quantile_cont(CASE WHEN label = 1 THEN n_chars END, 0.5) AS median_1,
  sqrt({_exact_var_sql('CASE WHEN label = 0 THEN n_chars END')}) AS std_0,
  sqrt({_exact_var_sql('CASE WHEN label = 1 THEN n_chars END')}) AS std_1,
  ({_exact_mean_sql('CASE WHEN label = 1 THEN n_chars END')} - {_exact_mean_sql('CASE WHEN label = 0 THEN n_chars END')})
    / nullif({_exact_mean_sql('CASE WHEN label = 0 THEN n_chars END')}, 0) AS rel_mean_diff
FROM s""")
def class_comparison_q(spark, sf):
    return P.class_comparison(scored_labels(spark, sf), "n_chars", "label")


@register("target_rate_by_category", f"""
WITH s AS ({SCORED_SQL}),
g AS (SELECT lang, count(*) AS n, sum(label)::BIGINT AS n_pos,
        CAST(sum(label) AS DOUBLE) / CAST(count(label) AS DOUBLE) AS rate FROM s GROUP BY lang)
SELECT *, n * 100.0::DOUBLE / sum(n) OVER () AS pct_rows FROM g""")
def target_rate_by_category_q(spark, sf):
    return P.target_rate_by_category(scored_labels(spark, sf), "lang", "label")


_NCHAR_EDGES = [0.0, 500.0, 1000.0, 2000.0, 5000.0, 1000000.0]
_NCHAR_LABELS = ["tiny", "short", "medium", "long", "very long"]


def _bin_sql(x, edges, labels, ordinal=False):
    whens = " ".join(
        f"WHEN {x} > {edges[i]} AND {x} <= {edges[i + 1]} THEN {i if ordinal else repr(labels[i])}"
        for i in range(len(labels)))
    return f"CASE {whens} END"


@register("target_rate_by_bin", f"""
WITH s AS ({SCORED_SQL}),
b AS (SELECT {_bin_sql('n_chars', _NCHAR_EDGES, _NCHAR_LABELS)} AS bin,
             {_bin_sql('n_chars', _NCHAR_EDGES, _NCHAR_LABELS, True)} AS bin_ord, label FROM s)
SELECT bin, bin_ord, count(*) AS n, sum(label)::BIGINT AS n_pos,
  CAST(sum(label) AS DOUBLE) / CAST(count(label) AS DOUBLE) AS rate
FROM b WHERE bin IS NOT NULL GROUP BY bin, bin_ord""")
def target_rate_by_bin_q(spark, sf):
    return P.target_rate_by_bin(scored_labels(spark, sf), "n_chars", _NCHAR_EDGES,
                                _NCHAR_LABELS, "label")


@register("category_class_counts", f"""
WITH s AS ({SCORED_SQL}), g AS (SELECT lang, label, count(*) AS n FROM s GROUP BY lang, label)
SELECT *, n * 100.0::DOUBLE / sum(n) OVER () AS pct_rows FROM g""")
def category_class_counts_q(spark, sf):
    return P.category_class_counts(scored_labels(spark, sf), "lang", "label")


def _hist_sql(src, x, bins, groups=(), density=False):
    g = ", ".join(groups)
    gsel = f"{g}, " if groups else ""
    same = " AND ".join(f"c.{k} IS NOT DISTINCT FROM e.{k}" for k in groups) + " AND " if groups else ""
    keys = "".join(f"e.{k}, " for k in groups)
    dens = (f", coalesce(c.n, 0) / (sum(coalesce(c.n, 0)) OVER ({'PARTITION BY ' + ', '.join('e.' + k for k in groups) if groups else ''}) * ((r.hi - r.lo) / {bins})) AS density"
            if density else "")
    return f"""
WITH d AS ({src}), r AS (SELECT CAST(min({x}) AS DOUBLE) AS lo, CAST(max({x}) AS DOUBLE) AS hi FROM d),
b AS (SELECT {gsel}CAST(least(floor((CAST({x} AS DOUBLE) - r.lo) * ({bins} / (r.hi - r.lo))), {bins - 1}) AS INTEGER) AS bin
      FROM d, r WHERE {x} IS NOT NULL),
c AS (SELECT {gsel}bin, count(*) AS n FROM b GROUP BY {gsel}bin),
e AS (SELECT {gsel}CAST(unnest(range({bins})) AS INTEGER) AS bin FROM (SELECT DISTINCT {g or '1'} FROM b))
SELECT {keys}e.bin, r.lo + e.bin * ((r.hi - r.lo) / {bins}) AS "left", r.lo + (e.bin + 1) * ((r.hi - r.lo) / {bins}) AS "right",
  coalesce(c.n, 0) AS count{dens}
FROM r, e LEFT JOIN c ON {same}c.bin = e.bin"""


@register("histogram", _hist_sql("SELECT o_totalprice FROM orders", "o_totalprice", 10))
def histogram_q(spark, sf):
    return P.histogram(table(spark, sf, "orders"), "o_totalprice", 10)


@register("histogram_by_class", _hist_sql("SELECT o_totalprice, o_orderstatus FROM orders",
                                          "o_totalprice", 20, ["o_orderstatus"], True))
def histogram_by_class_q(spark, sf):
    return P.histogram(table(spark, sf, "orders"), "o_totalprice", 20,
                       groups=["o_orderstatus"], density=True)


@register("box_stats", """
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
             quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type),
j AS (SELECT e.event_type, e.value, q.q1, q.median, q.q3, q.q3 - q.q1 AS iqr,
        q.q1 - 1.5 * (q.q3 - q.q1) AS lo, q.q3 + 1.5 * (q.q3 - q.q1) AS hi
      FROM events e JOIN q USING (event_type) WHERE e.value IS NOT NULL)
SELECT event_type, q1, median, q3, iqr,
  min(CASE WHEN value >= lo AND value <= hi THEN value END) AS whisker_low,
  max(CASE WHEN value >= lo AND value <= hi THEN value END) AS whisker_high,
  count(*) FILTER (WHERE NOT (value >= lo AND value <= hi)) AS n_outliers, count(*) AS n
FROM j GROUP BY event_type, q1, median, q3, iqr""")
def box_stats_q(spark, sf):
    return P.box_stats(table(spark, sf, "events"), "value", ["event_type"])


@register("kde_grid", """
WITH e AS (SELECT CAST(round(value * 100.0) AS BIGINT) AS v FROM events),
st AS (SELECT count(v) AS n, sqrt(""" + _exact_var_sql('v') + """) AS sd,
         CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi FROM e),
p AS (SELECT n, sd * pow(n, -0.2) AS h, lo, hi, (hi - lo) / 199 AS step FROM st),
dv AS (SELECT v, count(*) AS c FROM e GROUP BY v),
g AS (SELECT CAST(range AS INTEGER) AS grid FROM range(200))
SELECT g.grid, p.lo + g.grid * p.step AS x,
  round(sum(dv.c * exp(-0.5 * ((p.lo + g.grid * p.step - v) / p.h) * ((p.lo + g.grid * p.step - v) / p.h)))
        * (1.0 / (p.n * p.h * sqrt(2.0 * pi()))), 10) AS density
FROM g, dv, p GROUP BY g.grid, p.lo, p.step, p.n, p.h""")
def kde_grid_q(spark, sf):
    e = table(spark, sf, "events").select(cents("value").alias("v"))
    return P.kde_grid(e, "v", 200, method="exact").withColumn("density", F.round("density", 10))


@register("key_coverage", """
WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT user_id AS k FROM events)
SELECT (SELECT count(*) FROM a) AS n_keys_a, (SELECT count(*) FROM b) AS n_keys_b,
  (SELECT count(*) FROM a JOIN b USING (k)) AS n_shared,
  (SELECT count(*) FROM a JOIN b USING (k)) * 100.0::DOUBLE / (SELECT count(*) FROM a) AS pct_a_covered""")
def key_coverage_q(spark, sf):
    return P.key_coverage(table(spark, sf, "customer"), "c_custkey",
                          table(spark, sf, "events"), "user_id")


_SCORE_THRESHOLDS = [0.3, 0.475, 0.5, 0.7]


@register("score_distribution", f"""
WITH s AS (SELECT CAST((n_chars * 37) % 1000 AS BIGINT) AS m FROM ({SCORED_SQL}))
SELECT min(m) / 1000.0::DOUBLE AS min_score, max(m) / 1000.0::DOUBLE AS max_score,
  {_exact_mean_sql('m')} / 1000.0 AS mean_score, quantile_cont(m, 0.5) / 1000.0 AS median_score,
  sqrt({_exact_var_sql('m')}) / 1000.0 AS std_score,
  {", ".join(f"count(*) FILTER (WHERE m >= {round(t * 1000)}) AS n_pred_pos_{str(t).replace('.', '_')}" for t in _SCORE_THRESHOLDS)}
FROM s""")
def score_distribution(spark, sf):
    s = scored_labels(spark, sf).select(((F.col("n_chars") * 37) % 1000).alias("m"))
    q = P.quantiles(s, "m", [0.5], names=["median"])
    stats = s.agg(
        (F.min("m") / F.lit(1000.0)).alias("min_score"), (F.max("m") / F.lit(1000.0)).alias("max_score"),
        (P.mean_expr(F.col("m"), True) / 1000.0).alias("mean_score"),
        (P.std_expr(F.col("m"), True) / 1000.0).alias("std_score"),
        *[F.count_if(F.col("m") >= round(t * 1000)).alias(f"n_pred_pos_{str(t).replace('.', '_')}")
          for t in _SCORE_THRESHOLDS])
    j = stats.withColumn("_k", F.lit(1)).join(
        F.broadcast(q.select((F.col("median") / 1000.0).alias("median_score")).withColumn("_k", F.lit(1))), "_k")
    return j.drop("_k")


@register("sentinel_share", """
SELECT count(*) FILTER (WHERE l_quantity = 50.0) AS n_sentinel, count(*) AS n,
  count(*) FILTER (WHERE l_quantity = 50.0) * 100.0::DOUBLE / count(*) AS pct_sentinel FROM lineitem""")
def sentinel_share_q(spark, sf):
    return P.sentinel_share(table(spark, sf, "lineitem"), "l_quantity", 50.0)
