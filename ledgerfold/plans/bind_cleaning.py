"""Bindings: projection, filter, cleaning and encoding operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerfold.functions.names import clean_names
from ledgerfold.functions.nullsafe import (
    cents, clip_lower, cut_right_closed, days_to_years, not_equal_keep_null,
    rowwise_flag_count, rowwise_max, rowwise_mean, rowwise_min, rowwise_product,
    rowwise_std, safe_divide, sentinel_to_null)
from ledgerfold.operators import clean
from ledgerfold.operators.encode import category_share_long, factorize, one_hot, ordinal_codes, sparse_one_hot
from ledgerfold.plans.bind_common import day_offset, day_offset_sql
from ledgerfold.plans.catalog import register
from ledgerfold.sources.tables import table


def _orders_null_prio(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey",
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("prio"))


@register("filter_not_value_keep_null", """
SELECT o_orderkey, o_custkey, prio FROM (
  SELECT o_orderkey, o_custkey, nullif(o_orderpriority, '5-LOW') AS prio FROM orders)
WHERE prio IS DISTINCT FROM '1-URGENT'""")
def filter_not_value_keep_null(spark, sf):
    return _orders_null_prio(spark, sf).where(not_equal_keep_null("prio", "1-URGENT"))


@register("sentinel_to_null", """
SELECT l_orderkey, l_linenumber, nullif(l_quantity, 50.0) AS l_quantity,
       nullif(l_linenumber, 7) AS line_no
FROM lineitem""")
def sentinel_to_null_q(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     sentinel_to_null("l_quantity", 50.0).alias("l_quantity"),
                     sentinel_to_null("l_linenumber", 7).alias("line_no"))


@register("factorize_category", """
WITH o AS (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS prio FROM orders),
f AS (SELECT prio, min(o_orderkey) AS first FROM o WHERE prio IS NOT NULL GROUP BY prio),
c AS (SELECT prio, CAST(row_number() OVER (ORDER BY first, prio) - 1 AS INTEGER) AS code FROM f)
SELECT o.o_orderkey, coalesce(c.code, -1) AS prio FROM o LEFT JOIN c USING (prio)""")
def factorize_category(spark, sf):
    o = _orders_null_prio(spark, sf).select("o_orderkey", "prio")
    return factorize(o, "prio", "o_orderkey").withColumn("prio", F.col("prio").cast("int"))


# as many categories as the lines have parts: 2000 at the smallest checked size, growing with the data
_PART_SQL = "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 17 <> 0 THEN 'part ' || l_partkey END AS part, l_suppkey FROM lineitem"


def _parts(spark, sf):
    part = F.when(F.col("l_partkey") % 17 != 0, F.concat(F.lit("part "), F.col("l_partkey").cast("string")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", part.alias("part"), "l_suppkey")


@register("ordinal_codes", f"""
WITH p AS ({_PART_SQL}), f AS (SELECT part, min(l_orderkey) AS first FROM p WHERE part IS NOT NULL GROUP BY part)
SELECT part AS value, row_number() OVER (ORDER BY first, part) - 1 AS code FROM f""")
def ordinal_codes_q(spark, sf):
    return ordinal_codes(_parts(spark, sf), "part", "l_orderkey")


@register("factorize_many_categories", f"""
WITH p AS ({_PART_SQL}), f AS (SELECT part, min(l_orderkey) AS first FROM p WHERE part IS NOT NULL GROUP BY part),
c AS (SELECT part, row_number() OVER (ORDER BY first, part) - 1 AS code FROM f)
SELECT l_orderkey, l_linenumber, coalesce(code, -1) AS part FROM p LEFT JOIN c USING (part)""")
def factorize_many_categories(spark, sf):
    return factorize(_parts(spark, sf).drop("l_suppkey"), "part", "l_orderkey")


@register("sparse_one_hot", f"""
WITH p AS ({_PART_SQL}),
l AS (SELECT l_orderkey, l_linenumber, 'part' AS "column", part AS value FROM p
      UNION ALL SELECT l_orderkey, l_linenumber, 'l_suppkey', CAST(l_suppkey AS VARCHAR) FROM p),
d AS (SELECT DISTINCT "column", value FROM l),
c AS (SELECT *, row_number() OVER (ORDER BY "column", value NULLS LAST) - 1 AS index FROM d)
SELECT l_orderkey, l_linenumber, index FROM l JOIN c ON l."column" = c."column" AND l.value IS NOT DISTINCT FROM c.value""")
def sparse_one_hot_q(spark, sf):
    return sparse_one_hot(_parts(spark, sf), ["l_orderkey", "l_linenumber"], ["part", "l_suppkey"])[1]


@register("category_share_long", f"""
WITH p AS ({_PART_SQL}), g AS (SELECT l_suppkey, part AS value, count(*) AS n FROM p GROUP BY l_suppkey, part)
SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY l_suppkey) AS share FROM g""")
def category_share_long_q(spark, sf):
    return category_share_long(_parts(spark, sf), ["l_suppkey"], "part")


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register("one_hot", "SELECT c_custkey, " + ", ".join(
    f"CAST(c_mktsegment IS NOT DISTINCT FROM '{v}' AS INTEGER) AS c_mktsegment_{v}"
    for v in _SEGMENTS) + ", CAST(c_mktsegment IS NULL AS INTEGER) AS c_mktsegment_nan FROM customer")
def one_hot_q(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    out, _ = one_hot(c, ["c_mktsegment"], nan_as_category=True)
    return out


@register("clean_names", """
SELECT l_orderkey AS Order_Key, l_linenumber AS line, l_quantity AS qty_units,
       l_returnflag AS flag, l_shipdate AS ship_date_ts
FROM lineitem""")
def clean_names_q(spark, sf):
    li = table(spark, sf, "lineitem")
    messy = li.select(F.col("l_orderkey").alias("Order Key"),
                      F.col("l_linenumber").alias("line#"),
                      F.col("l_quantity").alias("qty (units)"),
                      F.col("l_returnflag").alias("__flag__"),
                      F.col("l_shipdate").alias("ship-date/ts"))
    return clean_names(messy)


@register("safe_divide", """
SELECT l_orderkey, l_linenumber,
       l_tax / nullif(l_discount, 0) + 0.0 AS tax_per_discount,
       CASE WHEN l_discount = 0 AND l_tax <> 0 THEN -1.0
            ELSE l_tax / nullif(l_discount, 0) END + 0.0 AS tax_per_discount_filled
FROM lineitem""")
def safe_divide_q(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     (safe_divide("l_tax", "l_discount") + 0.0).alias("tax_per_discount"),
                     (safe_divide("l_tax", "l_discount", fill=-1.0) + 0.0)
                     .alias("tax_per_discount_filled"))


# application-style ratios on customer ⋈ orders:
#   income := c_acctbal, credit := o_totalprice, annuity := o_totalprice / 12,
#   family size := c_nationkey (0 occurs: division by zero), employed := day offset
@register("ratio_features", f"""
SELECT o.o_orderkey, c.c_custkey,
  {day_offset_sql('o.o_orderdate')} / nullif(CAST(c.c_nationkey AS DOUBLE), 0) + 0.0 AS DAYS_EMPLOYED_PERC,
  c.c_acctbal / nullif(o.o_totalprice, 0) + 0.0 AS INCOME_CREDIT_PERC,
  c.c_acctbal / nullif(CAST(c.c_nationkey AS DOUBLE), 0) + 0.0 AS INCOME_PER_PERSON,
  (o.o_totalprice / 12.0) / nullif(c.c_acctbal, 0) + 0.0 AS ANNUITY_INCOME_PERC,
  (o.o_totalprice / 12.0) / nullif(o.o_totalprice, 0) + 0.0 AS PAYMENT_RATE
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""")
def ratio_features(spark, sf):
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    annuity = F.col("o_totalprice") / 12.0
    return j.select(
        "o_orderkey", "c_custkey",
        (safe_divide(day_offset("o_orderdate"), "c_nationkey") + 0.0).alias("DAYS_EMPLOYED_PERC"),
        (safe_divide("c_acctbal", "o_totalprice") + 0.0).alias("INCOME_CREDIT_PERC"),
        (safe_divide("c_acctbal", "c_nationkey") + 0.0).alias("INCOME_PER_PERSON"),
        (safe_divide(annuity, "c_acctbal") + 0.0).alias("ANNUITY_INCOME_PERC"),
        (safe_divide(annuity, "o_totalprice") + 0.0).alias("PAYMENT_RATE"))


# exploratory ratios on lineitem (credit := extendedprice, income := quantity,
# annuity := tax·price, goods := price·(1-discount), persons := linenumber,
# children := discount·100, age := ship-day offset, employed := linenumber−1)
@register("ratio_features_extended", f"""
SELECT l_orderkey, l_linenumber,
  l_extendedprice / nullif(l_quantity, 0) + 0.0 AS CREDIT_INCOME_RATIO,
  (l_tax * l_extendedprice) / nullif(l_quantity, 0) + 0.0 AS ANNUITY_INCOME_RATIO,
  (l_tax * l_extendedprice) / nullif(l_extendedprice, 0) + 0.0 AS CREDIT_TERM,
  (l_extendedprice * (1 - l_discount)) / nullif(l_extendedprice, 0) + 0.0 AS GOODS_PRICE_RATIO,
  l_quantity / nullif(CAST(l_linenumber AS DOUBLE), 0) + 0.0 AS INCOME_PER_PERSON,
  (l_tax * l_extendedprice) / nullif(CAST(l_linenumber AS DOUBLE), 0) + 0.0 AS ANNUITY_PER_PERSON,
  l_quantity / nullif(l_discount * 100 + 1, 0) + 0.0 AS INCOME_PER_CHILD,
  CAST(l_linenumber - 1 AS DOUBLE) / nullif(CAST({day_offset_sql('l_shipdate')} AS DOUBLE), 0) + 0.0 AS EMPLOYED_TO_AGE_RATIO,
  l_extendedprice / nullif(CAST({day_offset_sql('l_shipdate')} AS DOUBLE), 0) + 0.0 AS CREDIT_TO_AGE_RATIO
FROM lineitem""")
def ratio_features_extended(spark, sf):
    li = table(spark, sf, "lineitem")
    annuity = F.col("l_tax") * F.col("l_extendedprice")
    goods = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    age = day_offset("l_shipdate")
    r = {
        "CREDIT_INCOME_RATIO": safe_divide("l_extendedprice", "l_quantity"),
        "ANNUITY_INCOME_RATIO": safe_divide(annuity, "l_quantity"),
        "CREDIT_TERM": safe_divide(annuity, "l_extendedprice"),
        "GOODS_PRICE_RATIO": safe_divide(goods, "l_extendedprice"),
        "INCOME_PER_PERSON": safe_divide("l_quantity", "l_linenumber"),
        "ANNUITY_PER_PERSON": safe_divide(annuity, "l_linenumber"),
        "INCOME_PER_CHILD": safe_divide("l_quantity", F.col("l_discount") * 100 + 1),
        "EMPLOYED_TO_AGE_RATIO": safe_divide(F.col("l_linenumber") - 1, age),
        "CREDIT_TO_AGE_RATIO": safe_divide("l_extendedprice", age),
    }
    return li.select("l_orderkey", "l_linenumber", *[(v + 0.0).alias(k) for k, v in r.items()])


# instalment facts on lineitem ⋈ orders: due day := order day, paid day :=
# ship day (missing for returned lines), instalment := order total in cents,
# payment := line price in cents
@register("payment_delay", f"""
WITH j AS (
  SELECT l.l_orderkey, l.l_linenumber,
    CASE WHEN l.l_returnflag = 'R' THEN NULL ELSE {day_offset_sql('l.l_shipdate')} END AS paid,
    {day_offset_sql('o.o_orderdate')} AS due,
    CAST(round(o.o_totalprice * 100.0) AS BIGINT) AS inst,
    CAST(round(l.l_extendedprice * 100.0) AS BIGINT) AS pay
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)
SELECT l_orderkey, l_linenumber,
  CAST(pay AS DOUBLE) / nullif(CAST(inst AS DOUBLE), 0) AS PAYMENT_PERC,
  inst - pay AS PAYMENT_DIFF,
  CASE WHEN paid - due < 0 THEN 0 ELSE paid - due END AS DPD,
  CASE WHEN due - paid < 0 THEN 0 ELSE due - paid END AS DBD
FROM j""")
def payment_delay(spark, sf):
    li = table(spark, sf, "lineitem")
    o = table(spark, sf, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey).select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_returnflag") == "R", F.lit(None)).otherwise(day_offset("l_shipdate")).alias("paid"),
        day_offset("o_orderdate").alias("due"),
        cents("o_totalprice").alias("inst"), cents("l_extendedprice").alias("pay"))
    return j.select("l_orderkey", "l_linenumber",
                    safe_divide("pay", "inst").alias("PAYMENT_PERC"),
                    (F.col("inst") - F.col("pay")).alias("PAYMENT_DIFF"),
                    clip_lower(F.col("paid") - F.col("due"), 0).alias("DPD"),
                    clip_lower(F.col("due") - F.col("paid"), 0).alias("DBD"))


def _cust_with_nulls(spark, sf):
    """customer with nulls injected: balance (cents) missing when negative;
    flag N for two segments, Y otherwise."""
    c = table(spark, sf, "customer")
    bal = cents("c_acctbal")
    return c.select("c_custkey",
                    F.when(F.col("c_acctbal") < 0, F.lit(None)).otherwise(bal).alias("bal"),
                    F.when(F.col("c_mktsegment").isin("BUILDING", "FURNITURE"), F.lit("N"))
                    .otherwise(F.lit("Y")).alias("flag"))


_CUST_NULLS_SQL = """
SELECT c_custkey,
  CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(round(c_acctbal * 100.0) AS BIGINT) END AS bal,
  CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'N' ELSE 'Y' END AS flag
FROM customer"""


@register("conditional_impute", f"""
WITH c AS ({_CUST_NULLS_SQL}),
s1 AS (SELECT c_custkey, flag, CASE WHEN bal IS NULL AND flag = 'N' THEN 0 ELSE bal END AS bal FROM c),
m AS (SELECT CAST(sum(bal) AS DOUBLE) / count(bal) AS mu FROM s1)
SELECT c_custkey, CAST(CASE WHEN bal IS NULL AND flag = 'Y' THEN m.mu ELSE bal END AS DOUBLE) AS bal, flag
FROM s1, m""")
def conditional_impute_q(spark, sf):
    return clean.conditional_impute(_cust_with_nulls(spark, sf), "bal", "flag")


_CAPS = {"o_totalprice": 300000.0, "days": 0}


def _orders_days(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", day_offset("o_orderdate").alias("days"))


@register("cap_outliers", f"""
SELECT o_orderkey,
  CASE WHEN o_totalprice > 300000.0 THEN 300000.0 ELSE o_totalprice END AS o_totalprice,
  CASE WHEN days > 0 THEN 0 ELSE days END AS days
FROM (SELECT o_orderkey, o_totalprice, {day_offset_sql('o_orderdate')} AS days FROM orders)""")
def cap_outliers_q(spark, sf):
    return clean.cap_outliers(_orders_days(spark, sf), _CAPS)


@register("count_above_cap", f"""
SELECT 'o_totalprice' AS "column", 300000.0::DOUBLE AS cap, count(*) FILTER (WHERE o_totalprice > 300000.0) AS n_above FROM orders
UNION ALL
SELECT 'days', 0.0::DOUBLE, count(*) FILTER (WHERE {day_offset_sql('o_orderdate')} > 0) FROM orders""")
def count_above_cap_q(spark, sf):
    return clean.count_above_cap(_orders_days(spark, sf), _CAPS)


def _cust_sparse(spark, sf):
    """customer with a mostly-missing column (4 of 5 segments null) and a
    rarely-missing one (nations above 20)."""
    c = table(spark, sf, "customer")
    return c.select(
        "c_custkey", "c_mktsegment",
        F.when(F.col("c_mktsegment") != "MACHINERY", F.lit(None)).otherwise(F.col("c_acctbal")).alias("sparse_bal"),
        F.when(F.col("c_nationkey") > 20, F.lit(None)).otherwise(F.col("c_nationkey")).alias("nation"))


_CUST_SPARSE_SQL = """
SELECT c_custkey, c_mktsegment,
  CASE WHEN c_mktsegment <> 'MACHINERY' THEN NULL ELSE c_acctbal END AS sparse_bal,
  CASE WHEN c_nationkey > 20 THEN NULL ELSE c_nationkey END AS nation
FROM customer"""


@register("drop_sparse_columns", f"SELECT c_custkey, c_mktsegment, nation FROM ({_CUST_SPARSE_SQL})")
def drop_sparse_columns_q(spark, sf):
    return clean.drop_sparse_columns(_cust_sparse(spark, sf), 0.59)


@register("drop_null_rows", f"SELECT * FROM ({_CUST_SPARSE_SQL}) WHERE sparse_bal IS NOT NULL AND nation IS NOT NULL")
def drop_null_rows_q(spark, sf):
    return clean.drop_null_rows(_cust_sparse(spark, sf))


@register("fill_zero", """
SELECT l_orderkey, l_linenumber, coalesce(nullif(l_quantity, 50.0), 0.0) AS qty,
       coalesce(nullif(l_discount, 0.0), 0.0) + 0.0 AS disc
FROM lineitem""")
def fill_zero_q(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.nullif("l_quantity", F.lit(50.0)).alias("qty"),
        F.nullif("l_discount", F.lit(0.0)).alias("disc"))
    out = clean.fill_zero(li, ["qty", "disc"])
    return out.select("l_orderkey", "l_linenumber", "qty", (F.col("disc") + 0.0).alias("disc"))


@register("days_to_years", f"""
SELECT o_orderkey, {day_offset_sql('o_orderdate')} / -365.0 AS years,
       CAST(floor({day_offset_sql('o_orderdate')} / -365.25) AS BIGINT) AS years_floor
FROM orders""")
def days_to_years_q(spark, sf):
    o = table(spark, sf, "orders")
    d = day_offset("o_orderdate")
    return o.select("o_orderkey", days_to_years(d).alias("years"),
                    days_to_years(d, -365.25, floor=True).alias("years_floor"))


_EDGES = [0.0, 50000.0, 100000.0, 200000.0, 300000.0, 600000.0]
_LABELS = ["0-50k", "50-100k", "100-200k", "200-300k", "300-600k"]


def _cut_sql(x, edges, labels):
    whens = " ".join(f"WHEN {x} > {edges[i]} AND {x} <= {edges[i + 1]} THEN '{labels[i]}'"
                     for i in range(len(labels)))
    return f"CASE {whens} END"


@register("cut_right_closed", f"""
SELECT o_orderkey, {_cut_sql('o_totalprice', _EDGES, _LABELS)} AS price_band FROM orders""")
def cut_right_closed_q(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", cut_right_closed("o_totalprice", _EDGES, _LABELS).alias("price_band"))


def _rw_cols_sql():
    return ["l_quantity", "nullif(l_discount, 0.0)", "l_tax"]


def _rw_sql():
    a, b, c = _rw_cols_sql()
    n = " + ".join(f"(CASE WHEN {x} IS NOT NULL THEN 1 ELSE 0 END)" for x in (a, b, c))
    n = f"(0 + {n})"
    s = "(((0.0 + coalesce(CAST({0} AS DOUBLE), 0.0)) + coalesce(CAST({1} AS DOUBLE), 0.0)) + coalesce(CAST({2} AS DOUBLE), 0.0))".format(a, b, c)
    mean = f"({s} / {n})"
    ss = " + ".join(f"coalesce((CAST({x} AS DOUBLE) - {mean}) * (CAST({x} AS DOUBLE) - {mean}), 0.0)" for x in (a, b, c))
    ss = f"(0.0 + {ss})"
    return f"""
SELECT l_orderkey, l_linenumber,
  CASE WHEN {n} > 0 THEN {s} / {n} END + 0.0 AS row_mean,
  least({a}, {b}, {c}) + 0.0 AS row_min,
  greatest({a}, {b}, {c}) + 0.0 AS row_max,
  CASE WHEN {n} > 1 THEN sqrt({ss} / ({n} - 1)) END AS row_std,
  CAST({a} AS DOUBLE) * CAST({b} AS DOUBLE) * CAST({c} AS DOUBLE) + 0.0 AS row_product
FROM lineitem"""


@register("rowwise_stats", _rw_sql())
def rowwise_stats_q(spark, sf):
    li = table(spark, sf, "lineitem")
    cols = [F.col("l_quantity"), F.nullif("l_discount", F.lit(0.0)), F.col("l_tax")]
    return li.select("l_orderkey", "l_linenumber",
                     (rowwise_mean(cols) + 0.0).alias("row_mean"),
                     (rowwise_min(cols) + 0.0).alias("row_min"),
                     (rowwise_max(cols) + 0.0).alias("row_max"),
                     rowwise_std(cols).alias("row_std"),
                     (rowwise_product(cols) + 0.0).alias("row_product"))


@register("rowwise_flag_count", """
SELECT l_orderkey, l_linenumber,
  0 + coalesce(CAST(FLAG_RETURNED AS INTEGER), 0) + coalesce(CAST(FLAG_OPEN AS INTEGER), 0)
    + coalesce(CAST(FLAG_DISCOUNTED AS INTEGER), 0) + coalesce(CAST(FLAG_TAX_FREE AS INTEGER), 0) AS n_flags
FROM (SELECT l_orderkey, l_linenumber,
        CAST(l_returnflag = 'R' AS INTEGER) AS FLAG_RETURNED,
        CAST(l_linestatus = 'O' AS INTEGER) AS FLAG_OPEN,
        CAST(l_discount > 0.05 AS INTEGER) AS FLAG_DISCOUNTED,
        CAST(nullif(l_tax, 0.08) = 0 AS INTEGER) AS FLAG_TAX_FREE
      FROM lineitem)""")
def rowwise_flag_count_q(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        (F.col("l_returnflag") == "R").cast("int").alias("FLAG_RETURNED"),
        (F.col("l_linestatus") == "O").cast("int").alias("FLAG_OPEN"),
        (F.col("l_discount") > 0.05).cast("int").alias("FLAG_DISCOUNTED"),
        (F.nullif("l_tax", F.lit(0.08)) == 0).cast("int").alias("FLAG_TAX_FREE"))
    flags = [c for c in li.columns if c.startswith("FLAG_")]
    return li.select("l_orderkey", "l_linenumber", rowwise_flag_count(flags).alias("n_flags"))


@register("iqr_outliers", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, value FROM events, q
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def iqr_outliers_q(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    return clean.iqr_outliers(e, "value")


@register("quantile_trim", """
WITH q AS (SELECT quantile_cont(value, 0.99) AS q99 FROM events)
SELECT event_id, value FROM events, q WHERE value < q99""")
def quantile_trim_q(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    return clean.quantile_trim(e, "value", 0.99)


@register("filter_project", """
SELECT c_custkey, c_acctbal, c_nationkey FROM customer
WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING' AND c_nationkey BETWEEN 5 AND 20""")
def filter_project(spark, sf):
    c = table(spark, sf, "customer")
    return (c.where((F.col("c_acctbal") > 0) & (F.col("c_mktsegment") == "BUILDING")
                    & F.col("c_nationkey").between(5, 20))
            .select("c_custkey", "c_acctbal", "c_nationkey"))
