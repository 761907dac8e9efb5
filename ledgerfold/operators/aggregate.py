"""Specification-driven grouped aggregation.

A spec maps a column to a list of function names (``min max mean sum var
size nunique count``); output columns are named ``<PREFIX><COL>_<FUNC>``.
All functions are algebraic except ``nunique`` (Spark expands it to a
de-duplicating aggregate, here for values beyond small whole numbers only), so partial aggregation runs map-side before the
shuffle and a hot key costs one partial row per task, not one huge group.

Subsets (e.g. Active/Closed credits) are folded into the *same* group-by
as conditional aggregates instead of re-scanning: a subset aggregate is
null for an entity with no row in the subset, as a left-joined separate
aggregate would be.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions.nullsafe import exact_var_samp, is_integral

FUNCS = ("min", "max", "mean", "sum", "var", "size", "nunique", "count")

Spec = Mapping[str, Sequence[str]]


def _mean(x: Column, integral: bool) -> Column:
    if integral:
        return F.try_divide(F.sum(x).cast("double"), F.count(x).cast("double"))
    return F.avg(x)


def _var(x: Column, integral: bool) -> Column:
    return exact_var_samp(x) if integral else F.var_samp(x)


def _nunique(x: Column, integral: bool) -> Column:
    """Distinct values.  A distinct aggregate shuffles the partial results of all
    functions beside it once per value; whole numbers below 63 are marked in a
    word of bits instead, so only other values make such rows."""
    if not integral:
        return F.count_distinct(x)
    small = x.between(0, 62)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), x.cast("int"))
    marked = F.coalesce(F.bit_count(F.bit_or(F.when(small, bit))), F.lit(0)).cast("bigint")
    return marked + F.count_distinct(F.when(~small, x))


def agg_expr(func: str, x: Column, integral: bool,
             cond: Column | None = None, n_rows: Column | None = None,
             xv: Column | None = None) -> Column:
    """One aggregate; with ``cond`` it only sees rows where cond is true
    and is null when no row qualifies.  ``cond`` must already be null-safe
    (``coalesce(cond, false)``) and ``n_rows`` its ``count_if``; callers
    build both (and ``xv``, the masked column) once, not per function."""
    if func not in FUNCS:
        raise ValueError(f"unknown aggregate {func!r}; expected one of {FUNCS}")
    if xv is None:
        xv = x if cond is None else F.when(cond, x)
    if func == "min":
        return F.min(xv)
    if func == "max":
        return F.max(xv)
    if func == "mean":
        return _mean(xv, integral)
    if func == "var":
        return _var(xv, integral)
    if func == "nunique":
        return _nunique(xv, integral) if cond is None else F.when(n_rows > 0, _nunique(xv, integral))
    if func == "count":
        return F.count(xv) if cond is None else F.when(n_rows > 0, F.count(xv))
    if func == "size":
        return F.count(F.lit(1)) if cond is None else F.when(n_rows > 0, n_rows)
    # sum: 0 for a non-empty group of nulls, null for an empty subset
    s = F.coalesce(F.sum(xv), F.lit(0))
    return s if cond is None else F.when(n_rows > 0, s)


def spec_columns(df: DataFrame, spec: Spec, prefix: str = "",
                 cond: Column | None = None) -> list[Column]:
    types = {f.name: f.dataType for f in df.schema.fields}
    n_rows = None
    if cond is not None:
        cond = F.coalesce(cond, F.lit(False))
        n_rows = F.count_if(cond)
    out = []
    for col, funcs in spec.items():
        if col not in types:
            raise ValueError(f"spec column {col!r} not in frame")
        integral = is_integral(types[col])
        x = F.col(col)
        xv = x if cond is None else F.when(cond, x)
        for fn in funcs:
            out.append(agg_expr(fn, x, integral, cond, n_rows, xv)
                       .alias(f"{prefix}{col}_{fn.upper()}"))
    return out


def grouped_agg(df: DataFrame, keys: str | Sequence[str], spec: Spec,
                prefix: str = "", extra: Sequence[Column] = (),
                subsets: Mapping[str, Column] | None = None,
                subset_spec: Spec | None = None) -> DataFrame:
    """``groupBy(keys).agg(...)`` built from a spec.

    ``subsets`` maps a prefix (e.g. ``"ACTIVE_"``) to a row condition; each
    adds ``subset_spec`` (default: ``spec``) aggregates restricted to it.
    ``extra`` appends further aggregate columns (category shares, counts).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    exprs = spec_columns(df, spec, prefix) + list(extra)
    for sub_prefix, cond in (subsets or {}).items():
        exprs += spec_columns(df, subset_spec or spec, sub_prefix, cond)
    return df.groupBy(*keys).agg(*exprs)


def group_size(prefix: str = "") -> Column:
    return F.count(F.lit(1)).alias(f"{prefix}COUNT")
