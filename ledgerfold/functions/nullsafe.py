"""Null-safe column expressions.

Semantics follow the reference's pandas behaviour, re-expressed with Spark
built-ins so everything stays inside whole-stage codegen:

* a comparison filter keeps rows whose value is missing;
* division by zero gives null (never an exception, never +-inf);
* a sum over a non-empty group of nulls is 0, a group without rows is null;
* clipping keeps nulls;
* right-closed bins ``(a, b]`` exclude the lowest edge.

Integral measures (counts, day offsets, money in minor units) can be
aggregated *exactly*: Σx and Σx² are kept as integers/decimals and divided
once at the end, so the result does not depend on partitioning or merge
order.  Use ``exact_mean``/``exact_var_samp`` for those.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, _INTEGRAL) or (
        isinstance(dtype, T.DecimalType) and dtype.scale == 0)


def not_equal_keep_null(c: Column | str, value) -> Column:
    """``c != value`` that keeps rows where ``c`` is null."""
    return ~_c(c).eqNullSafe(F.lit(value))


def sentinel_to_null(c: Column | str, sentinel) -> Column:
    """Replace a sentinel (e.g. 365243 day offsets) with null."""
    return F.nullif(_c(c), F.lit(sentinel))


def safe_divide(num: Column | str, den: Column | str, fill=None) -> Column:
    """``num / den`` with null for 0/0 and x/0.

    ``fill`` replaces only the +-inf case (x/0 with x != 0), as the
    reference's ``replace([inf, -inf], fill)`` does; 0/0 stays null.
    """
    n, d = _c(num), _c(den)
    q = F.try_divide(n.cast("double"), d.cast("double"))
    if fill is None:
        return q
    return F.when((d == 0) & (n != 0), F.lit(fill)).otherwise(q)


def clip_lower(c: Column | str, lower=0) -> Column:
    """``clip(lower=...)`` that keeps nulls (``greatest`` would not)."""
    x = _c(c)
    return F.when(x < F.lit(lower), F.lit(lower)).otherwise(x)


def sum0(c: Column | str) -> Column:
    """Group sum that is 0 (not null) when every value is null."""
    return F.coalesce(F.sum(_c(c)), F.lit(0))


def cents(c: Column | str, scale: int = 100) -> Column:
    """Money as integer minor units: ``round(x * scale)`` as bigint."""
    return F.round(_c(c) * F.lit(float(scale))).cast("bigint")


def exact_mean(c: Column | str) -> Column:
    """Mean of an integral column: exact Σx, one final division."""
    x = _c(c)
    return F.try_divide(F.sum(x).cast("double"), F.count(x).cast("double"))


def exact_var_samp(c: Column | str) -> Column:
    """Sample variance (ddof=1) of an integral column from exact moments.

    ``(n·Σx² − (Σx)²) / (n·(n−1))`` with the numerator in decimal(38,0);
    null for fewer than two values, like pandas ``var``.  Where a moment
    passes 38 digits, Spark's merged central moments take over.
    """
    x = _c(c).cast("decimal(38,0)")
    cnt = F.count(x)
    sx = F.try_sum(x)
    n = cnt.cast("decimal(38,0)")
    num = F.try_subtract(F.try_multiply(n, F.try_sum(F.try_multiply(x, x))), F.try_multiply(sx, sx))
    den = (n * (n - 1)).cast("double")
    return F.when(cnt > 1, F.coalesce(F.try_divide(num.cast("double"), den), F.var_samp(_c(c).cast("double"))))


def days_to_years(c: Column | str, divisor: float = -365.0,
                  floor: bool = False) -> Column:
    """Day offsets (negative = in the past) to years; optional floor."""
    y = _c(c).cast("double") / F.lit(float(divisor))
    return F.floor(y) if floor else y


def cut_right_closed(c: Column | str, edges: Sequence[float],
                     labels: Sequence[str] | None = None) -> Column:
    """Right-closed bins ``(e[i], e[i+1]]`` like ``pd.cut``.

    Values on or below the first edge, above the last edge, or null fall
    in no bin and give null.  Returns the label (or the bin ordinal when no
    labels are given).
    """
    if len(edges) < 2:
        raise ValueError("need at least two edges")
    if labels is not None and len(labels) != len(edges) - 1:
        raise ValueError("need one label per bin")
    x = _c(c)
    out = None
    for i in range(len(edges) - 1):
        cond = (x > F.lit(edges[i])) & (x <= F.lit(edges[i + 1]))
        val = F.lit(labels[i]) if labels is not None else F.lit(i)
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out


# -- row-wise statistics over a list of columns (nulls skipped) ------------

def _nonnull_count(cols: Sequence[Column]) -> Column:
    return sum((F.when(x.isNotNull(), F.lit(1)).otherwise(F.lit(0))
                for x in cols), F.lit(0))


def _nullsafe_sum(cols: Sequence[Column]) -> Column:
    return sum((F.coalesce(x.cast("double"), F.lit(0.0)) for x in cols),
               F.lit(0.0))


def rowwise_mean(cols: Sequence[Column | str]) -> Column:
    xs = [_c(x) for x in cols]
    n = _nonnull_count(xs)
    return F.when(n > 0, F.try_divide(_nullsafe_sum(xs), n))


def rowwise_min(cols: Sequence[Column | str]) -> Column:
    return F.least(*[_c(x) for x in cols])


def rowwise_max(cols: Sequence[Column | str]) -> Column:
    return F.greatest(*[_c(x) for x in cols])


def rowwise_std(cols: Sequence[Column | str]) -> Column:
    """Sample standard deviation across columns; null for < 2 values."""
    xs = [_c(x) for x in cols]
    n = _nonnull_count(xs)
    mean = F.try_divide(_nullsafe_sum(xs), n)
    ss = sum((F.coalesce((x.cast("double") - mean) * (x.cast("double") - mean),
                         F.lit(0.0)) for x in xs), F.lit(0.0))
    return F.when(n > 1, F.sqrt(F.try_divide(ss, n - 1)))


def rowwise_product(cols: Sequence[Column | str]) -> Column:
    """Product; null as soon as one factor is null."""
    xs = [_c(x).cast("double") for x in cols]
    out = xs[0]
    for x in xs[1:]:
        out = out * x
    return out


def rowwise_flag_count(cols: Sequence[Column | str]) -> Column:
    """Row-wise sum of 0/1 flags, nulls counted as 0."""
    return sum((F.coalesce(_c(x).cast("int"), F.lit(0)) for x in cols),
               F.lit(0))
