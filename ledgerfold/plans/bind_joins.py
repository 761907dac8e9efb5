"""Bindings: joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerfold.operators import joins as JN
from ledgerfold.plans.catalog import register
from ledgerfold.sources.tables import table


@register("left_join_fanout", """
WITH cnt AS (SELECT o_custkey, count(*) AS PREV_count FROM orders GROUP BY o_custkey)
SELECT c.c_custkey, c.c_acctbal, coalesce(cnt.PREV_count, 0) AS PREV_count,
  o.o_orderkey AS PREV_o_orderkey, o.o_custkey AS PREV_o_custkey, o.o_totalprice AS PREV_o_totalprice
FROM customer c LEFT JOIN cnt ON c.c_custkey = cnt.o_custkey
LEFT JOIN orders o ON c.c_custkey = o.o_custkey""")
def left_join_fanout(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return JN.left_join_fanout(c, o, "c_custkey", "o_custkey", "PREV_")


@register("inner_join", """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, p.p_name, p.p_retailprice,
  l.l_extendedprice / nullif(l.l_quantity * p.p_retailprice, 0) AS price_ratio
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""")
def inner_join(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                             "l_quantity", "l_extendedprice")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_retailprice")
    # the dimension is broadcast only below a proven row bound, else shuffled
    j = li.join(JN.bounded_broadcast(p, 5_000_000), "l_partkey", "inner")
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "p_name", "p_retailprice",
                    F.try_divide(F.col("l_extendedprice"), F.col("l_quantity") * F.col("p_retailprice"))
                    .alias("price_ratio"))


@register("anti_join", """
SELECT c_custkey, c_mktsegment FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')""")
def anti_join(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    urgent = (table(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT")
              .select(F.col("o_custkey").alias("c_custkey")))
    return JN.anti_join(c, urgent, "c_custkey")


@register("key_intersection", """
SELECT DISTINCT c.c_custkey AS key FROM customer c WHERE c.c_custkey IN (SELECT user_id FROM events)""")
def key_intersection(spark, sf):
    return JN.key_intersection(table(spark, sf, "customer"), "c_custkey",
                               table(spark, sf, "events"), "user_id")


@register("union_all", """
SELECT o_orderkey, o_custkey, o_orderstatus, 'closed' AS slice FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, 'open' FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, 'other' FROM orders
  WHERE o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O')""")
def union_all(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    st = F.col("o_orderstatus")
    parts = [o.where(st == "F").withColumn("slice", F.lit("closed")),
             o.where(st == "O").withColumn("slice", F.lit("open")),
             o.where(st.isNull() | ~st.isin("F", "O")).withColumn("slice", F.lit("other"))]
    return JN.union_all(parts)
