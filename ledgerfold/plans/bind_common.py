"""Shared pieces of the driver-table bindings.

Role mapping (reference table -> driver table):
  application (client)         -> customer   (c_custkey)
  bureau / previous credits    -> orders     (o_custkey; status F/O/P)
  monthly balance / payments   -> lineitem   (child of an order)
  POS / card snapshots         -> events     (user_id)
  labelled, scored items       -> labels ⋈ documents

Money is carried as integer cents and day facts as integer day offsets, so
aggregates are exact (see ``ledgerfold.functions.nullsafe``) and the Spark
result equals the DuckDB oracle bit for bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.functions.names import clean_name
from ledgerfold.functions.nullsafe import cents
from ledgerfold.sources.tables import table

# The reference date for day offsets and the score formula
# of the labelled items.
EPOCH = "2000-01-01"
EPOCH_SQL = "DATE '2000-01-01'"


def day_offset(col: str):
    """Whole days from EPOCH (negative = before)."""
    return F.datediff(F.to_date(F.col(col)), F.lit(EPOCH).cast("date"))


def day_offset_sql(col: str) -> str:
    return f"CAST(datediff('day', {EPOCH_SQL}, CAST({col} AS DATE)) AS INTEGER)"


def credits(spark: SparkSession, sf: str) -> DataFrame:
    """orders as credits: client key, status, priority, cents, day offset."""
    o = table(spark, sf, "orders")
    return o.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
        cents("o_totalprice").alias("amt"),
        day_offset("o_orderdate").alias("days"))


CREDITS_SQL = f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
       CAST(round(o_totalprice * 100.0) AS BIGINT) AS amt,
       {day_offset_sql('o_orderdate')} AS days
FROM orders"""


def scored_labels(spark: SparkSession, sf: str) -> DataFrame:
    """labels ⋈ documents with a deterministic score in [0, 1).

    Both sides grow together, so none is broadcast through the driver."""
    lab = table(spark, sf, "labels").hint("merge")
    doc = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    return lab.join(doc, "doc_id").select(
        "doc_id", "lang", "n_chars", "quality",
        F.col("toxic").alias("label"),
        (((F.col("n_chars") * 37) % 1000) / F.lit(1000.0)).alias("score"))


SCORED_SQL = """
SELECT l.doc_id, d.lang, d.n_chars, l.quality, l.toxic AS label,
       ((d.n_chars * 37) % 1000) / 1000.0::DOUBLE AS score
FROM labels l JOIN documents d USING (doc_id)"""


# -- SQL text of the exact aggregate forms (oracle side) -----------------------

def _share_sql(col, values, prefix, nan=True):
    items = [(f"{col}_{v}", f"{col} IS NOT DISTINCT FROM '{v}'") for v in values]
    if nan:
        items.append((f"{col}_nan", f"{col} IS NULL"))
    return ",\n".join(
        f"avg(CASE WHEN {p} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS {clean_name(prefix + n + '_MEAN')}"
        for n, p in items)


def _exact_mean_sql(x):
    return f"CAST(sum({x}) AS DOUBLE) / CAST(count({x}) AS DOUBLE)"


def _exact_var_sql(x):
    return (f"CASE WHEN count({x}) > 1 THEN CAST(count({x}) * sum(CAST({x} AS HUGEINT) * {x}) "
            f"- sum(CAST({x} AS HUGEINT)) * sum(CAST({x} AS HUGEINT)) AS DOUBLE) "
            f"/ CAST(count({x}) * (count({x}) - 1) AS DOUBLE) END")


def _mean_sql(x, fraction):
    """Mean of whole numbers from their exact sum; fractions are averaged."""
    return f"avg({x})" if fraction else _exact_mean_sql(x)


def _var_sql(x, fraction):
    return f"var_samp({x})" if fraction else _exact_var_sql(x)


def _sum_sql(x, fraction):
    return f"coalesce(sum({x}), 0)" + ("" if fraction else "::BIGINT")


def _sub(fn, x, cond, fraction=False):
    """SQL of a subset aggregate (null when no row meets cond)."""
    xc = f"CASE WHEN {cond} THEN {x} END"
    has = f"count(*) FILTER (WHERE {cond}) > 0"
    if fn == "sum":
        return f"CASE WHEN {has} THEN {_sum_sql(xc, fraction)} END"
    if fn == "mean":
        return _mean_sql(xc, fraction)
    if fn == "var":
        return _var_sql(xc, fraction)
    if fn == "size":
        return f"CASE WHEN {has} THEN count(*) FILTER (WHERE {cond}) END"
    return f"{fn}({xc})"


def _spec_sql(spec, prefix, fractions=()):
    """SQL of a spec; ``fractions`` are the columns that are not whole numbers."""
    out = []
    for col, fns in spec.items():
        for fn in fns:
            name, fraction = f"{prefix}{col}_{fn.upper()}", col in fractions
            if fn in ("min", "max"):
                e = f"{fn}({col})"
            elif fn == "mean":
                e = _mean_sql(col, fraction)
            elif fn == "var":
                e = _var_sql(col, fraction)
            elif fn == "sum":
                e = _sum_sql(col, fraction)
            elif fn == "nunique":
                e = f"count(DISTINCT {col})"
            elif fn == "size":
                e = "count(*)"
            else:
                e = f"count({col})"
            out.append(f"{e} AS {name}")
    return ",\n  ".join(out)
