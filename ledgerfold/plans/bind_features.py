"""Bindings: feature folding (joins of pre-aggregated children, P1-P8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerfold.functions.names import clean_names
from ledgerfold.operators.aggregate import grouped_agg
from ledgerfold.operators.encode import category_share, vocabulary
from ledgerfold.operators.joins import left_join_child
from ledgerfold.plans.bind_common import (
    CREDITS_SQL, _exact_mean_sql, _exact_var_sql, _share_sql, _sub, credits)
from ledgerfold.plans.catalog import register
from ledgerfold.sources.tables import table

# -- slice 0: customer ⟕ (orders aggregated per customer) --------------------

_PRIORITIES_SQL = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def customer_order_features(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    o = credits(spark, sf)
    prios = vocabulary(o, "o_orderpriority")
    agg = grouped_agg(
        o, "o_custkey",
        {"amt": ["min", "max", "mean", "sum", "var"],
         "days": ["min", "max", "mean"]},
        prefix="ORD_",
        extra=category_share("o_orderpriority", prios, True, prefix="ORD_")
        + [F.count(F.lit(1)).alias("ORD_COUNT")],
        subsets={"CLOSED_": F.col("o_orderstatus") == "F",
                 "ACTIVE_": F.col("o_orderstatus") == "O"},
        subset_spec={"amt": ["max", "mean", "sum"], "days": ["min", "mean"]},
    ).withColumnRenamed("o_custkey", "c_custkey")
    return clean_names(left_join_child(c, agg, "c_custkey"))


def rounded(df, names, digits=9):
    """Means of fractions depend on the order of addition in their last bits;
    the registered results hold them rounded, as the SQL does."""
    chosen = set(names)
    return df.select(*[F.round(c, digits).alias(c) if c in chosen else F.col(c) for c in df.columns])


def rounded_sql(sql, names, digits=9):
    return f"SELECT * REPLACE ({', '.join(f'round({n}, {digits}) AS {n}' for n in names)}) FROM ({sql})"


_SUBSET_SQL = ",\n".join(
    f"{_sub(fn, x, cond)} AS {pre}{x}_{fn.upper()}"
    for pre, cond in [("CLOSED_", "o_orderstatus = 'F'"), ("ACTIVE_", "o_orderstatus = 'O'")]
    for x, fns in [("amt", ["max", "mean", "sum"]), ("days", ["min", "mean"])]
    for fn in fns)

CUSTOMER_ORDER_FEATURES_SQL = f"""
WITH o AS ({CREDITS_SQL}),
agg AS (
  SELECT o_custkey AS c_custkey,
    min(amt) AS ORD_amt_MIN, max(amt) AS ORD_amt_MAX,
    {_exact_mean_sql('amt')} AS ORD_amt_MEAN,
    coalesce(sum(amt), 0)::BIGINT AS ORD_amt_SUM,
    {_exact_var_sql('amt')} AS ORD_amt_VAR,
    min(days) AS ORD_days_MIN, max(days) AS ORD_days_MAX,
    {_exact_mean_sql('days')} AS ORD_days_MEAN,
    {_share_sql('o_orderpriority', _PRIORITIES_SQL, 'ORD_')},
    count(*) AS ORD_COUNT,
    {_SUBSET_SQL}
  FROM o GROUP BY o_custkey)
SELECT c.c_custkey, c.c_mktsegment, agg.* EXCLUDE (c_custkey)
FROM customer c LEFT JOIN agg USING (c_custkey)"""

register("left_join_child_agg", CUSTOMER_ORDER_FEATURES_SQL)(customer_order_features)


# -- P1-P8: the credit-schema pipelines on driver tables -----------------------------
#
# Each driver table is projected into the credit schema the pipelines read
# (column names of the application and child tables); the projections keep
# money in cents and days as integer offsets so every aggregate is exact.

from ledgerfold.functions.nullsafe import cents as _cents  # noqa: E402
from ledgerfold.plans import features as FE  # noqa: E402
from ledgerfold.plans.bind_common import (  # noqa: E402
    _spec_sql, day_offset, day_offset_sql)


def app_view(spark, sf):
    c = table(spark, sf, "customer")
    bal, nat, key, seg = F.col("c_acctbal"), F.col("c_nationkey"), F.col("c_custkey"), F.col("c_mktsegment")
    gender = (F.when((nat == 0) & (bal < 0), F.lit("XNA")).when(bal < 0, F.lit(None))
              .when(nat % 2 == 0, F.lit("F")).otherwise(F.lit("M")))
    return c.select(
        key.alias("SK_ID_CURR"), gender.alias("CODE_GENDER"),
        F.when(bal > 5000, F.lit("Y")).otherwise(F.lit("N")).alias("FLAG_OWN_CAR"),
        F.when(nat < 12, F.lit("Y")).otherwise(F.lit("N")).alias("FLAG_OWN_REALTY"),
        seg.alias("NAME_CONTRACT_TYPE"),
        bal.alias("AMT_INCOME_TOTAL"), (F.abs(bal) * 3.0).alias("AMT_CREDIT"),
        (F.abs(bal) / 12.0).alias("AMT_ANNUITY"), (F.abs(bal) * 2.5).alias("AMT_GOODS_PRICE"),
        nat.cast("double").alias("CNT_FAM_MEMBERS"), (nat % 4).cast("int").alias("CNT_CHILDREN"),
        (-(key % 20000) - 7000).cast("int").alias("DAYS_BIRTH"),
        F.when(seg == "MACHINERY", F.lit(365243)).otherwise(-(key % 5000)).cast("int").alias("DAYS_EMPLOYED"),
        F.when(seg == "AUTOMOBILE", F.lit(None)).otherwise((key % 1000) / 1000.0).alias("EXT_SOURCE_1"),
        ((nat + 1) / 26.0).alias("EXT_SOURCE_2"),
        (((key * 37) % 1000) / 1000.0).alias("EXT_SOURCE_3"),
        (key % 2).cast("int").alias("FLAG_DOCUMENT_2"), (nat % 2).cast("int").alias("FLAG_DOCUMENT_3"),
        F.when(bal > 0, F.lit(1)).otherwise(F.lit(0)).alias("FLAG_DOCUMENT_4"))


APP_SQL = """
SELECT c_custkey AS SK_ID_CURR,
  CASE WHEN c_nationkey = 0 AND c_acctbal < 0 THEN 'XNA' WHEN c_acctbal < 0 THEN NULL
       WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS CODE_GENDER,
  CASE WHEN c_acctbal > 5000 THEN 'Y' ELSE 'N' END AS FLAG_OWN_CAR,
  CASE WHEN c_nationkey < 12 THEN 'Y' ELSE 'N' END AS FLAG_OWN_REALTY,
  c_mktsegment AS NAME_CONTRACT_TYPE,
  c_acctbal AS AMT_INCOME_TOTAL, abs(c_acctbal) * 3.0 AS AMT_CREDIT,
  abs(c_acctbal) / 12.0 AS AMT_ANNUITY, abs(c_acctbal) * 2.5 AS AMT_GOODS_PRICE,
  CAST(c_nationkey AS DOUBLE) AS CNT_FAM_MEMBERS, CAST(c_nationkey % 4 AS INTEGER) AS CNT_CHILDREN,
  CAST(-(c_custkey % 20000) - 7000 AS INTEGER) AS DAYS_BIRTH,
  CAST(CASE WHEN c_mktsegment = 'MACHINERY' THEN 365243 ELSE -(c_custkey % 5000) END AS INTEGER) AS DAYS_EMPLOYED,
  CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN NULL ELSE (c_custkey % 1000) / 1000.0::DOUBLE END AS EXT_SOURCE_1,
  (c_nationkey + 1) / 26.0::DOUBLE AS EXT_SOURCE_2,
  ((c_custkey * 37) % 1000) / 1000.0::DOUBLE AS EXT_SOURCE_3,
  CAST(c_custkey % 2 AS INTEGER) AS FLAG_DOCUMENT_2, CAST(c_nationkey % 2 AS INTEGER) AS FLAG_DOCUMENT_3,
  CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS FLAG_DOCUMENT_4
FROM customer"""

_APP_OUT_KEEP = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "CNT_FAM_MEMBERS",
                 "CNT_CHILDREN", "DAYS_BIRTH", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3",
                 "FLAG_DOCUMENT_2", "FLAG_DOCUMENT_3", "FLAG_DOCUMENT_4"]
_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _code_sql(col):
    return (f"{col}_codes AS (SELECT {col} AS v, CAST(row_number() OVER (ORDER BY min(SK_ID_CURR), {col}) - 1 AS INTEGER) AS code "
            f"FROM f WHERE {col} IS NOT NULL GROUP BY {col})")


def _ratio_sql(n, d):
    return f"CAST({n} AS DOUBLE) / nullif(CAST({d} AS DOUBLE), 0)"


FE_APPLICATION_SQL = f"""
WITH a AS ({APP_SQL}),
f AS (SELECT * FROM a WHERE CODE_GENDER IS DISTINCT FROM 'XNA'),
{_code_sql('CODE_GENDER')}, {_code_sql('FLAG_OWN_CAR')}, {_code_sql('FLAG_OWN_REALTY')},
g AS (SELECT f.* REPLACE (
        coalesce(cg.code, -1) AS CODE_GENDER, coalesce(cc.code, -1) AS FLAG_OWN_CAR,
        coalesce(cr.code, -1) AS FLAG_OWN_REALTY, nullif(f.DAYS_EMPLOYED, 365243) AS DAYS_EMPLOYED)
      FROM f LEFT JOIN CODE_GENDER_codes cg ON f.CODE_GENDER = cg.v
             LEFT JOIN FLAG_OWN_CAR_codes cc ON f.FLAG_OWN_CAR = cc.v
             LEFT JOIN FLAG_OWN_REALTY_codes cr ON f.FLAG_OWN_REALTY = cr.v)
SELECT SK_ID_CURR, CODE_GENDER, FLAG_OWN_CAR, FLAG_OWN_REALTY, {", ".join(_APP_OUT_KEEP)}, DAYS_EMPLOYED,
  {", ".join(f"CAST(NAME_CONTRACT_TYPE IS NOT DISTINCT FROM '{v}' AS INTEGER) AS NAME_CONTRACT_TYPE_{v}" for v in _SEGMENTS)},
  {_ratio_sql('DAYS_EMPLOYED', 'DAYS_BIRTH')} AS DAYS_EMPLOYED_PERC,
  {_ratio_sql('AMT_INCOME_TOTAL', 'AMT_CREDIT')} AS INCOME_CREDIT_PERC,
  {_ratio_sql('AMT_INCOME_TOTAL', 'CNT_FAM_MEMBERS')} AS INCOME_PER_PERSON,
  {_ratio_sql('AMT_ANNUITY', 'AMT_INCOME_TOTAL')} AS ANNUITY_INCOME_PERC,
  {_ratio_sql('AMT_ANNUITY', 'AMT_CREDIT')} AS PAYMENT_RATE
FROM g"""


@register("fe_application", FE_APPLICATION_SQL)
def fe_application(spark, sf):
    return clean_names(FE.application_features(app_view(spark, sf), nan_as_category=False))


# Bureau := orders, bureau_balance := lineitem.  Amounts and day counts that
# the orders lack are whole multiples or remainders of those they have.
def _key_part(key, step, of):
    return (F.col(key) * step % of).cast("int")


def bureau_view(spark, sf):
    o = table(spark, sf, "orders")
    st, pr, amt, d = F.col("o_orderstatus"), F.col("o_orderpriority"), _cents("o_totalprice"), day_offset("o_orderdate")
    none = F.lit(0).cast("bigint")
    return o.select(
        F.col("o_orderkey").alias("SK_ID_BUREAU"), F.col("o_custkey").alias("SK_ID_CURR"),
        F.when(st == "O", "Active").when(st == "F", "Closed").otherwise("Sold").alias("CREDIT_ACTIVE"),
        pr.alias("CREDIT_TYPE"), d.alias("DAYS_CREDIT"), (d + 365).alias("DAYS_CREDIT_ENDDATE"),
        (d + _key_part("o_orderkey", 7, 90)).alias("DAYS_CREDIT_UPDATE"),
        F.when(st == "F", _key_part("o_orderkey", 13, 60)).otherwise(F.lit(0)).alias("CREDIT_DAY_OVERDUE"),
        F.when(pr != "5-LOW", F.col("o_orderkey") * 31 % 100000).alias("AMT_CREDIT_MAX_OVERDUE"),
        amt.alias("AMT_CREDIT_SUM"), F.when(st == "O", amt).otherwise(none).alias("AMT_CREDIT_SUM_DEBT"),
        F.when(st == "F", amt % 1000).otherwise(none).alias("AMT_CREDIT_SUM_OVERDUE"),
        F.when(st != "P", amt * 2).alias("AMT_CREDIT_SUM_LIMIT"),
        F.when(pr != "3-MEDIUM", amt % 50000).alias("AMT_ANNUITY"),
        F.when(st == "P", F.lit(None)).when(pr == "1-URGENT", F.lit(1)).otherwise(F.lit(0))
        .alias("CNT_CREDIT_PROLONG"))


_AMT = "CAST(round(o_totalprice * 100.0) AS BIGINT)"
_DAY = day_offset_sql("o_orderdate")
BUREAU_SQL = f"""
SELECT o_orderkey AS SK_ID_BUREAU, o_custkey AS SK_ID_CURR,
  CASE o_orderstatus WHEN 'O' THEN 'Active' WHEN 'F' THEN 'Closed' ELSE 'Sold' END AS CREDIT_ACTIVE,
  o_orderpriority AS CREDIT_TYPE, {_DAY} AS DAYS_CREDIT, {_DAY} + 365 AS DAYS_CREDIT_ENDDATE,
  {_DAY} + CAST(o_orderkey * 7 % 90 AS INTEGER) AS DAYS_CREDIT_UPDATE,
  CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey * 13 % 60 AS INTEGER) ELSE 0 END AS CREDIT_DAY_OVERDUE,
  CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderkey * 31 % 100000 END AS AMT_CREDIT_MAX_OVERDUE,
  {_AMT} AS AMT_CREDIT_SUM, CASE WHEN o_orderstatus = 'O' THEN {_AMT} ELSE 0 END AS AMT_CREDIT_SUM_DEBT,
  CASE WHEN o_orderstatus = 'F' THEN {_AMT} % 1000 ELSE 0 END AS AMT_CREDIT_SUM_OVERDUE,
  CASE WHEN o_orderstatus <> 'P' THEN {_AMT} * 2 END AS AMT_CREDIT_SUM_LIMIT,
  CASE WHEN o_orderpriority <> '3-MEDIUM' THEN {_AMT} % 50000 END AS AMT_ANNUITY,
  CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS CNT_CREDIT_PROLONG
FROM orders"""


def balance_view(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("SK_ID_BUREAU"),
                     (-F.col("l_linenumber")).alias("MONTHS_BALANCE"),
                     F.col("l_returnflag").alias("STATUS"))


BALANCE_SQL = "SELECT l_orderkey AS SK_ID_BUREAU, -l_linenumber AS MONTHS_BALANCE, l_returnflag AS STATUS FROM lineitem"
_CREDIT_ACTIVE = ["Active", "Closed", "Sold"]
_STATUS = ["A", "N", "R"]


def _subset_sql(spec, subsets, fractions=()):
    return ",\n  ".join(f"{_sub(fn, x, cond, x in fractions)} AS {pre}{x}_{fn.upper()}"
                        for pre, cond in subsets for x, fns in spec.items() for fn in fns)


_BURO_ROUNDED = [f"BURO_STATUS_{v}_MEAN_MEAN" for v in _STATUS + ["nan"]]
FE_BUREAU_SQL = f"""
WITH bb AS (SELECT SK_ID_BUREAU, min(MONTHS_BALANCE) AS MONTHS_BALANCE_MIN, max(MONTHS_BALANCE) AS MONTHS_BALANCE_MAX,
              count(*) AS MONTHS_BALANCE_SIZE, {_share_sql('STATUS', _STATUS, '')}
            FROM ({BALANCE_SQL}) GROUP BY SK_ID_BUREAU),
b AS (SELECT bu.* EXCLUDE (SK_ID_BUREAU), bb.* EXCLUDE (SK_ID_BUREAU)
      FROM ({BUREAU_SQL}) bu LEFT JOIN bb USING (SK_ID_BUREAU))
SELECT SK_ID_CURR, {_spec_sql(FE.BUREAU_SPEC, 'BURO_')},
  {_share_sql('CREDIT_ACTIVE', _CREDIT_ACTIVE, 'BURO_')},
  {_share_sql('CREDIT_TYPE', _PRIORITIES_SQL, 'BURO_')},
  {", ".join(f"round(avg(STATUS_{v}_MEAN), 9) AS BURO_STATUS_{v}_MEAN_MEAN" for v in _STATUS + ["nan"])},
  {_subset_sql(FE.BUREAU_SPEC, [("ACTIVE_", "CREDIT_ACTIVE = 'Active'"), ("CLOSED_", "CREDIT_ACTIVE = 'Closed'")])}
FROM b GROUP BY SK_ID_CURR"""


@register("fe_bureau", FE_BUREAU_SQL)
def fe_bureau(spark, sf):
    return rounded(clean_names(FE.bureau_features(bureau_view(spark, sf), balance_view(spark, sf))), _BURO_ROUNDED)


# Previous applications := orders
def previous_view(spark, sf):
    o = table(spark, sf, "orders")
    st, pr, d = F.col("o_orderstatus"), F.col("o_orderpriority"), day_offset("o_orderdate")
    amt, key = _cents("o_totalprice"), F.col("o_orderkey")
    return o.select(
        key.alias("SK_ID_PREV"), F.col("o_custkey").alias("SK_ID_CURR"),
        F.when(st == "F", "Approved").when(st == "O", "Refused").otherwise("Canceled")
        .alias("NAME_CONTRACT_STATUS"),
        pr.alias("NAME_YIELD_GROUP"),
        _cents(F.col("o_totalprice") / 12.0).alias("AMT_ANNUITY"),
        amt.alias("AMT_APPLICATION"),
        F.round(F.col("o_totalprice") * 90.0).cast("bigint").alias("AMT_CREDIT"),
        F.when(pr != "2-HIGH", amt % 10000).alias("AMT_DOWN_PAYMENT"),
        (amt + 500).alias("AMT_GOODS_PRICE"), _key_part("o_orderkey", 5, 24).alias("HOUR_APPR_PROCESS_START"),
        F.when(st != "P", (key % 100).cast("double") / 100.0).alias("RATE_DOWN_PAYMENT"),
        d.alias("DAYS_DECISION"), F.when(st != "P", _key_part("o_orderkey", 6, 48)).alias("CNT_PAYMENT"),
        F.when(pr == "5-LOW", F.lit(365243)).otherwise(d + 30).alias("DAYS_FIRST_DUE"))


PREVIOUS_SQL = f"""
SELECT o_orderkey AS SK_ID_PREV, o_custkey AS SK_ID_CURR,
  CASE o_orderstatus WHEN 'F' THEN 'Approved' WHEN 'O' THEN 'Refused' ELSE 'Canceled' END AS NAME_CONTRACT_STATUS,
  o_orderpriority AS NAME_YIELD_GROUP,
  CAST(round(o_totalprice / 12.0 * 100.0) AS BIGINT) AS AMT_ANNUITY,
  {_AMT} AS AMT_APPLICATION,
  CAST(round(o_totalprice * 90.0) AS BIGINT) AS AMT_CREDIT,
  CASE WHEN o_orderpriority <> '2-HIGH' THEN {_AMT} % 10000 END AS AMT_DOWN_PAYMENT,
  {_AMT} + 500 AS AMT_GOODS_PRICE, CAST(o_orderkey * 5 % 24 AS INTEGER) AS HOUR_APPR_PROCESS_START,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderkey % 100 AS DOUBLE) / 100.0::DOUBLE END AS RATE_DOWN_PAYMENT,
  {_DAY} AS DAYS_DECISION, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderkey * 6 % 48 AS INTEGER) END AS CNT_PAYMENT,
  CASE WHEN o_orderpriority = '5-LOW' THEN 365243 ELSE {_DAY} + 30 END AS DAYS_FIRST_DUE
FROM orders"""
_PREV_STATUS = ["Approved", "Canceled", "Refused"]
# fractions: their mean and variance are taken in double
_FRACTIONS = {"APP_CREDIT_PERC", "RATE_DOWN_PAYMENT", "PAYMENT_PERC"}


def _fraction_names(spec, prefixes):
    return [f"{p}{c}_{fn.upper()}" for p in prefixes for c, fns in spec.items() if c in _FRACTIONS
            for fn in fns if fn in ("mean", "sum", "var")]


_PREV_ROUNDED = _fraction_names(FE.PREVIOUS_SPEC, ["PREV_", "APPROVED_", "REFUSED_"])
FE_PREVIOUS_SQL = rounded_sql(f"""
WITH p AS (SELECT * REPLACE (nullif(DAYS_FIRST_DUE, 365243) AS DAYS_FIRST_DUE),
             CAST(AMT_APPLICATION AS DOUBLE) / nullif(CAST(AMT_CREDIT AS DOUBLE), 0) AS APP_CREDIT_PERC
           FROM ({PREVIOUS_SQL}))
SELECT SK_ID_CURR, {_spec_sql(FE.PREVIOUS_SPEC, 'PREV_', _FRACTIONS)},
  {_share_sql('NAME_CONTRACT_STATUS', _PREV_STATUS, 'PREV_')},
  {_share_sql('NAME_YIELD_GROUP', _PRIORITIES_SQL, 'PREV_')},
  {_subset_sql(FE.PREVIOUS_SPEC, [("APPROVED_", "NAME_CONTRACT_STATUS = 'Approved'"), ("REFUSED_", "NAME_CONTRACT_STATUS = 'Refused'")], _FRACTIONS)}
FROM p GROUP BY SK_ID_CURR""", _PREV_ROUNDED)


@register("fe_previous", FE_PREVIOUS_SQL)
def fe_previous(spark, sf):
    return rounded(clean_names(FE.previous_features(previous_view(spark, sf))), _PREV_ROUNDED)


# POS and card snapshots := events
_EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def pos_view(spark, sf):
    e = table(spark, sf, "events")
    v = _cents("value")
    return e.select(F.col("user_id").alias("SK_ID_CURR"), F.col("event_id").alias("SK_ID_PREV"),
                    (-F.dayofmonth("ts")).alias("MONTHS_BALANCE"), v.alias("SK_DPD"),
                    F.when(F.col("event_type") == "error", v).otherwise(F.lit(0).cast("bigint")).alias("SK_DPD_DEF"),
                    F.col("event_type").alias("NAME_CONTRACT_STATUS"))


POS_SQL = """
SELECT user_id AS SK_ID_CURR, event_id AS SK_ID_PREV, CAST(-dayofmonth(ts) AS INTEGER) AS MONTHS_BALANCE,
  CAST(round(value * 100.0) AS BIGINT) AS SK_DPD,
  CASE WHEN event_type = 'error' THEN CAST(round(value * 100.0) AS BIGINT) ELSE 0 END AS SK_DPD_DEF,
  event_type AS NAME_CONTRACT_STATUS
FROM events"""

FE_POS_SQL = f"""
SELECT SK_ID_CURR, {_spec_sql(FE.POS_SPEC, 'POS_')},
  {_share_sql('NAME_CONTRACT_STATUS', _EVENT_TYPES, 'POS_')}, count(*) AS POS_COUNT
FROM ({POS_SQL}) GROUP BY SK_ID_CURR"""


@register("fe_pos", FE_POS_SQL)
def fe_pos(spark, sf):
    return clean_names(FE.pos_features(pos_view(spark, sf)))


# the card snapshots' further amounts and counts: shares of the value, remainders
_CARD_AMOUNTS = {"AMT_CREDIT_LIMIT_ACTUAL": (20, 1), "AMT_DRAWINGS_ATM_CURRENT": (1, 3), "AMT_DRAWINGS_CURRENT": (1, 2),
                 "AMT_DRAWINGS_OTHER_CURRENT": (1, 7), "AMT_DRAWINGS_POS_CURRENT": (1, 5), "AMT_INST_MIN_REGULARITY": (1, 20),
                 "AMT_PAYMENT_CURRENT": (1, 4), "AMT_PAYMENT_TOTAL_CURRENT": (3, 4), "AMT_RECEIVABLE_PRINCIPAL": (9, 10),
                 "AMT_RECIVABLE": (19, 20), "AMT_TOTAL_RECEIVABLE": (21, 20)}
_CARD_COUNTS = {"CNT_DRAWINGS_ATM_CURRENT": 4, "CNT_DRAWINGS_OTHER_CURRENT": 3, "CNT_DRAWINGS_POS_CURRENT": 9,
                "CNT_INSTALMENT_MATURE_CUM": 30, "SK_DPD": 11, "SK_DPD_DEF": 2}


def card_view(spark, sf):
    e = table(spark, sf, "events")
    v, k, kind = _cents("value"), F.col("event_id"), F.col("event_type")
    return e.select(F.col("user_id").alias("SK_ID_CURR"), k.alias("SK_ID_PREV"),
                    (-F.dayofmonth("ts")).alias("MONTHS_BALANCE"), v.alias("AMT_BALANCE"),
                    *[F.when(kind != "view" if "DRAWINGS" in c else F.lit(True), F.expr(f"({_CENTS} * {a}) div {b}")).alias(c)
                      for c, (a, b) in _CARD_AMOUNTS.items()],
                    F.get_json_object("props", "$.k").cast("int").alias("CNT_DRAWINGS_CURRENT"),
                    *[F.when(kind != "signup", k % n).alias(c) for c, n in _CARD_COUNTS.items()],
                    kind.alias("NAME_CONTRACT_STATUS"))


_CENTS = "CAST(round(value * 100.0) AS BIGINT)"
CARD_SQL = f"""
SELECT user_id AS SK_ID_CURR, event_id AS SK_ID_PREV, CAST(-dayofmonth(ts) AS INTEGER) AS MONTHS_BALANCE,
  {_CENTS} AS AMT_BALANCE,
  {", ".join(f"CASE WHEN {chr(39) + 'view' + chr(39) + ' <> event_type' if 'DRAWINGS' in c else 'TRUE'} THEN ({_CENTS} * {a}) // {b} END AS {c}" for c, (a, b) in _CARD_AMOUNTS.items())},
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS CNT_DRAWINGS_CURRENT,
  {", ".join(f"CASE WHEN event_type <> 'signup' THEN event_id % {n} END AS {c}" for c, n in _CARD_COUNTS.items())},
  event_type AS NAME_CONTRACT_STATUS
FROM events"""
_CC_SPEC = {c: FE.CREDIT_CARD_FUNCS for c in ["MONTHS_BALANCE", "AMT_BALANCE", *_CARD_AMOUNTS, "CNT_DRAWINGS_CURRENT", *_CARD_COUNTS]}

FE_CREDIT_CARD_SQL = f"""
SELECT SK_ID_CURR, {_spec_sql(_CC_SPEC, 'CC_')},
  {_share_sql('NAME_CONTRACT_STATUS', _EVENT_TYPES, 'CC_')}, count(*) AS CC_COUNT
FROM ({CARD_SQL}) GROUP BY SK_ID_CURR"""


@register("fe_credit_card", FE_CREDIT_CARD_SQL)
def fe_credit_card(spark, sf):
    return clean_names(FE.credit_card_features(card_view(spark, sf)))


# P5: instalments := lineitem ⋈ orders
def installments_view(spark, sf):
    li = table(spark, sf, "lineitem")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        F.col("l_orderkey").alias("SK_ID_PREV"), F.col("o_custkey").alias("SK_ID_CURR"),
        F.col("l_linenumber").alias("NUM_INSTALMENT_VERSION"),
        day_offset("o_orderdate").alias("DAYS_INSTALMENT"),
        F.when(F.col("l_returnflag") == "R", F.lit(None)).otherwise(day_offset("l_shipdate"))
        .alias("DAYS_ENTRY_PAYMENT"),
        _cents("l_extendedprice").alias("AMT_INSTALMENT"),
        _cents(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("AMT_PAYMENT"))


INSTALLMENTS_SQL = f"""
SELECT l.l_orderkey AS SK_ID_PREV, o.o_custkey AS SK_ID_CURR, l.l_linenumber AS NUM_INSTALMENT_VERSION,
  {day_offset_sql('o.o_orderdate')} AS DAYS_INSTALMENT,
  CASE WHEN l.l_returnflag = 'R' THEN NULL ELSE {day_offset_sql('l.l_shipdate')} END AS DAYS_ENTRY_PAYMENT,
  CAST(round(l.l_extendedprice * 100.0) AS BIGINT) AS AMT_INSTALMENT,
  CAST(round(l.l_extendedprice * (1 - l.l_discount) * 100.0) AS BIGINT) AS AMT_PAYMENT
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"""
_INS_ROUNDED = _fraction_names(FE.INSTALLMENTS_SPEC, ["INSTAL_"])

FE_INSTALLMENTS_SQL = rounded_sql(f"""
WITH i AS (SELECT *, CAST(AMT_PAYMENT AS DOUBLE) / nullif(CAST(AMT_INSTALMENT AS DOUBLE), 0) AS PAYMENT_PERC,
             AMT_INSTALMENT - AMT_PAYMENT AS PAYMENT_DIFF,
             CASE WHEN DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT < 0 THEN 0 ELSE DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT END AS DPD,
             CASE WHEN DAYS_INSTALMENT - DAYS_ENTRY_PAYMENT < 0 THEN 0 ELSE DAYS_INSTALMENT - DAYS_ENTRY_PAYMENT END AS DBD
           FROM ({INSTALLMENTS_SQL}))
SELECT SK_ID_CURR, {_spec_sql(FE.INSTALLMENTS_SPEC, 'INSTAL_', _FRACTIONS)}, count(*) AS INSTAL_COUNT
FROM i GROUP BY SK_ID_CURR""", _INS_ROUNDED)


@register("fe_installments", FE_INSTALLMENTS_SQL)
def fe_installments(spark, sf):
    return rounded(clean_names(FE.installments_features(installments_view(spark, sf))), _INS_ROUNDED)


# Everything folded onto the application rows
def credit_tables(spark, sf):
    return {"application": app_view(spark, sf), "bureau": bureau_view(spark, sf),
            "bureau_balance": balance_view(spark, sf), "previous_application": previous_view(spark, sf),
            "POS_CASH_balance": pos_view(spark, sf), "installments_payments": installments_view(spark, sf),
            "credit_card_balance": card_view(spark, sf)}


FE_FULL_SQL = f"""
WITH app AS ({FE_APPLICATION_SQL}), buro AS ({FE_BUREAU_SQL}), prev AS ({FE_PREVIOUS_SQL}),
pos AS ({FE_POS_SQL}), ins AS ({FE_INSTALLMENTS_SQL}), cc AS ({FE_CREDIT_CARD_SQL})
SELECT * FROM app LEFT JOIN buro USING (SK_ID_CURR) LEFT JOIN prev USING (SK_ID_CURR)
  LEFT JOIN pos USING (SK_ID_CURR) LEFT JOIN ins USING (SK_ID_CURR) LEFT JOIN cc USING (SK_ID_CURR)"""


@register("fe_full", FE_FULL_SQL)
def fe_full(spark, sf):
    return rounded(FE.full_features(credit_tables(spark, sf)), [*_BURO_ROUNDED, *_PREV_ROUNDED, *_INS_ROUNDED])


# Exploratory features on the application rows
def _rowwise_sql(cols):
    n = "(0 + " + " + ".join(f"(CASE WHEN {x} IS NOT NULL THEN 1 ELSE 0 END)" for x in cols) + ")"
    s = "0.0"
    for x in cols:
        s = f"({s} + coalesce(CAST({x} AS DOUBLE), 0.0))"
    mean = f"({s} / {n})"
    ss = "0.0"
    for x in cols:
        ss = f"({ss} + coalesce((CAST({x} AS DOUBLE) - {mean}) * (CAST({x} AS DOUBLE) - {mean}), 0.0))"
    prod = " * ".join(f"CAST({x} AS DOUBLE)" for x in cols)
    return {"MEAN": f"CASE WHEN {n} > 0 THEN {s} / {n} END", "MIN": f"least({', '.join(cols)})",
            "MAX": f"greatest({', '.join(cols)})",
            "STD": f"CASE WHEN {n} > 1 THEN sqrt({ss} / ({n} - 1)) END", "PROD": prod}


def _bins_sql(x, edges, labels):
    return "CASE " + " ".join(f"WHEN {x} > {edges[i]} AND {x} <= {edges[i + 1]} THEN '{labels[i]}'"
                              for i in range(len(labels))) + " END"


_EXT = FE.EXT_SOURCES
_RW = _rowwise_sql(_EXT)
FE_EXPLORATORY_SQL = f"""
WITH a AS (SELECT * REPLACE (nullif(DAYS_EMPLOYED, 365243) AS DAYS_EMPLOYED) FROM ({APP_SQL})),
y AS (SELECT *, CAST(DAYS_BIRTH AS DOUBLE) / -365.25 AS AGE_YEARS, CAST(DAYS_EMPLOYED AS DOUBLE) / -365.25 AS EMPLOYED_YEARS FROM a),
r AS (SELECT *, {_ratio_sql('AMT_CREDIT', 'AMT_INCOME_TOTAL')} AS CREDIT_INCOME_RATIO FROM y)
SELECT SK_ID_CURR, AGE_YEARS, EMPLOYED_YEARS, CREDIT_INCOME_RATIO,
  {_ratio_sql('AMT_ANNUITY', 'AMT_INCOME_TOTAL')} AS ANNUITY_INCOME_RATIO,
  {_ratio_sql('AMT_CREDIT', 'AMT_ANNUITY')} AS CREDIT_TERM,
  {_ratio_sql('AMT_GOODS_PRICE', 'AMT_CREDIT')} AS GOODS_PRICE_RATIO,
  {_ratio_sql('AMT_INCOME_TOTAL', 'CNT_FAM_MEMBERS')} AS INCOME_PER_PERSON,
  {_ratio_sql('AMT_ANNUITY', 'CNT_FAM_MEMBERS')} AS ANNUITY_PER_PERSON,
  {_ratio_sql('AMT_INCOME_TOTAL', 'CNT_CHILDREN + 1')} AS INCOME_PER_CHILD,
  {_ratio_sql('EMPLOYED_YEARS', 'AGE_YEARS')} AS EMPLOYED_TO_AGE_RATIO,
  {_ratio_sql('AMT_CREDIT', 'AGE_YEARS')} AS CREDIT_TO_AGE_RATIO,
  {", ".join(f"{v} AS EXT_SOURCE_{k}" for k, v in _RW.items())},
  0 + coalesce(CAST(FLAG_DOCUMENT_2 AS INTEGER), 0) + coalesce(CAST(FLAG_DOCUMENT_3 AS INTEGER), 0)
    + coalesce(CAST(FLAG_DOCUMENT_4 AS INTEGER), 0) AS DOCUMENT_COUNT,
  {_bins_sql('AGE_YEARS', FE.AGE_BINS, FE.AGE_LABELS)} AS AGE_GROUP,
  {_bins_sql('CREDIT_INCOME_RATIO', FE.CREDIT_RATIO_BINS, FE.CREDIT_RATIO_LABELS)} AS CREDIT_RATIO_GROUP,
  {", ".join(f"{_bins_sql(c, FE.EXT_SOURCE_BINS, FE.EXT_SOURCE_LABELS)} AS {c}_GROUP" for c in _EXT)},
  {_bins_sql('EMPLOYED_YEARS', FE.EMPLOYED_BINS, FE.EMPLOYED_LABELS)} AS EMPLOYED_GROUP
FROM r"""


@register("fe_exploratory", FE_EXPLORATORY_SQL)
def fe_exploratory(spark, sf):
    return FE.exploratory_features(app_view(spark, sf))
