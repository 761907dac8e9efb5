"""Categorical encodings: vocabularies, codes, one-hot, category shares.

Two forms, whatever the number of categories:

* wide -- one column per category.  The names are part of the schema, so the
  driver must know them; a vocabulary is collected once, sorted by code point,
  and reused -- at scoring time too -- so the output schema does not depend on
  which rows were read.  ``max_categories`` bounds it per column.
* long -- codes and shares as rows.  Categories are ranked by a distributed
  running count (``ledgerfold.operators.scan``), code tables stay tables, and
  nothing is collected: ``ordinal_codes``, ``factorize``, ``sparse_one_hot`` and
  ``category_share_long`` take any number of categories.

The feature pipelines use the wide form for columns within the bound and the
long form (codes; one map of shares per entity) for the others.  One-hot columns
are never needed for aggregation: ``category_share`` averages the null-safe
equality predicate directly, ``wide_shares`` counts by category and pivots.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions.names import clean_name
from ledgerfold.operators.joins import join_on
from ledgerfold.operators.scan import running
from ledgerfold.session import cut_lineage

#: Categories of a column that become columns of their own, at most.
DEFAULT_MAX_CATEGORIES = 10_000
#: Categories up to which a share is an aggregate expression of its own.
EXPRESSIONS = 64


def vocabulary(df: DataFrame, col: str,
               max_categories: int = DEFAULT_MAX_CATEGORIES) -> list:
    """Sorted distinct non-null values of ``col`` (bounded collect)."""
    rows = (df.select(col).where(F.col(col).isNotNull()).distinct()
            .limit(max_categories + 1).collect())
    if len(rows) > max_categories:
        raise ValueError(
            f"column {col!r} has more than {max_categories} categories: use the long forms, or a larger max_categories")
    return sorted(r[0] for r in rows)


def _stacked(df: DataFrame, cols: Sequence[str], *more: Column) -> DataFrame:
    """Rows (c, v, ...) of every column's non-null values as strings."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols])).alias("p")
    named = [m.alias(f"_m{i}") for i, m in enumerate(more)]
    return df.select(pairs, *named).select("p.c", "p.v", *[f"_m{i}" for i in range(len(more))]).where(F.col("v").isNotNull())


def small_vocabularies(df: DataFrame, cols: Sequence[str],
                       max_categories: int = DEFAULT_MAX_CATEGORIES) -> dict[str, list | None]:
    """Vocabularies of several columns; None for a column with more than
    ``max_categories``.  One job: ``(column, value)`` pairs are stacked,
    de-duplicated and collected under a limit; if some column passes the bound,
    a second job counts per column and a third collects the others."""
    cols = list(cols)
    if not cols:
        return {}
    pairs = _stacked(df, cols).distinct()
    rows = pairs.limit(len(cols) * max_categories + 1).collect()
    out: dict[str, list | None] = {c: [] for c in cols}
    if len(rows) > len(cols) * max_categories:
        counts = {r["c"]: r["n"] for r in pairs.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
        out = {c: None if counts.get(c, 0) > max_categories else [] for c in cols}
        small = [c for c in cols if out[c] is not None]
        rows = _stacked(df, small).distinct().collect() if small else []
    for r in rows:
        out[r["c"]].append(r["v"])
    return {c: None if v is None or len(v) > max_categories else sorted(v) for c, v in out.items()}


def collect_vocabularies(df: DataFrame, cols: Sequence[str],
                         max_categories: int = DEFAULT_MAX_CATEGORIES) -> dict[str, list]:
    """``small_vocabularies`` where every column must be within the bound."""
    out = small_vocabularies(df, cols, max_categories)
    for c, values in out.items():
        if values is None:
            raise ValueError(f"column {c!r} has more than {max_categories} categories: use the long forms, or a larger max_categories")
    return out


# -- codes ------------------------------------------------------------------------

def ordinal_codes(df: DataFrame, col: str, order_key: str, stored: bool = True) -> DataFrame:
    """Code table ``(value, code)``: categories numbered from 0 by their
    smallest ``order_key`` (then by value).  A distributed running count over
    the distinct values; ``stored`` writes it to the shared checkpoint folder,
    so that joins do not compute it again."""
    firsts = (df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value"))
              .agg(F.min(order_key).alias("_first")).withColumn("_one", F.lit(1).cast("bigint")))
    out = (running(firsts, "_first", ["_one"], inclusive=False, tie_cols=["value"], prefix="code")
           .select("value", F.col("code_one").alias("code")))
    return cut_lineage(out) if stored else out


def coded(df: DataFrame, col: str, codes: DataFrame, out_col: str) -> DataFrame:
    """``out_col``: the code of ``col``; -1 for null and for values without one.
    ``df`` may hold a column of any name besides."""
    table = codes.select(F.col("value").alias("_coded_value"), F.col("code").alias("_coded"))
    joined = df.join(table, F.col(col) == F.col("_coded_value"), "left")
    code = F.coalesce(F.col("_coded"), F.lit(-1)).alias(out_col)
    if out_col in df.columns:
        return joined.select(*[code if c == out_col else F.col(c) for c in df.columns])
    return joined.select(*[F.col(c) for c in df.columns], code)


def first_seen_codes(df: DataFrame, cols: Sequence[str], order_key: str,
                     max_categories: int = DEFAULT_MAX_CATEGORIES) -> dict[str, dict | DataFrame]:
    """Per column its codes by first appearance (smallest ``order_key``, then
    value): ``{value: code}`` from one bounded job for all columns, or the code
    table of a column with more than ``max_categories``."""
    cols = list(cols)
    if not cols:
        return {}
    bound = len(cols) * max_categories + 1
    rows = (_stacked(df, cols, F.col(order_key)).groupBy("c", "v").agg(F.min("_m0").alias("first"))
            .limit(bound).collect())
    out: dict[str, dict | DataFrame] = {}
    for c in cols:
        seen = sorted(((r["first"], r["v"]) for r in rows if r["c"] == c))
        out[c] = (ordinal_codes(df.select(F.col(c).cast("string").alias(c), order_key), c, order_key)
                  if len(rows) >= bound or len(seen) > max_categories else {v: i for i, (_, v) in enumerate(seen)})
    return out


def apply_codes(col: str, codes: dict) -> Column:
    """Literal map lookup (no join); unseen values and nulls give -1."""
    if not codes:
        return F.lit(-1)
    m = F.create_map(*[x for v, i in codes.items() for x in (F.lit(v), F.lit(i))])
    return F.coalesce(F.try_element_at(m, F.col(col).cast("string")), F.lit(-1)).cast("int")


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields
            if f.dataType.simpleString() == "string" and f.name not in skip]


def dummy_name(col: str, value) -> str:
    return f"{col}_{value}"


def one_hot_columns(col: str, values: Sequence, nan_as_category: bool,
                    clean: bool = False) -> list[tuple[str, Column]]:
    """``(name, 0/1 int column)`` pairs; null counts as 0 in every dummy."""
    out = []
    for v in values:
        name = dummy_name(col, v)
        out.append((clean_name(name) if clean else name,
                    F.col(col).eqNullSafe(F.lit(v)).cast("int")))
    if nan_as_category:
        name = f"{col}_nan"
        out.append((name, F.col(col).isNull().cast("int")))
    return out


def one_hot(df: DataFrame, cols: Sequence[str] | None = None,
            nan_as_category: bool = True,
            vocabularies: dict[str, Sequence] | None = None,
            max_categories: int = DEFAULT_MAX_CATEGORIES,
            ) -> tuple[DataFrame, list[str]]:
    """One-hot encode string columns in one ``select``.

    Returns the frame (encoded columns replace the originals, appended at
    the end like ``get_dummies``) and the new column names.  A column with more
    than ``max_categories`` values (or whose vocabulary is None) becomes one
    column ``<col>_CODE`` of ordinal codes, by value; ``sparse_one_hot`` gives
    its one-hot form.
    """
    cols = list(cols) if cols is not None else string_columns(df)
    given = dict(vocabularies or {})
    given.update(small_vocabularies(df, [c for c in cols if c not in given], max_categories))
    codes = [c for c in cols if given[c] is None]
    out = df
    for c in codes:
        out = coded(out, c, ordinal_codes(df.select(F.col(c)), c, c), f"{c}_CODE")
    keep = [F.col(c) for c in df.columns if c not in set(cols)]
    new_cols: list[tuple[str, Column]] = []
    for c in cols:
        new_cols += [(f"{c}_CODE", F.col(f"{c}_CODE"))] if c in codes else one_hot_columns(c, given[c], nan_as_category)
    out = out.select(*keep, *[e.alias(n) for n, e in new_cols])
    return out, [n for n, _ in new_cols]


def sparse_one_hot(df: DataFrame, keys: Sequence[str], cols: Sequence[str],
                   nan_as_category: bool = True) -> tuple[DataFrame, DataFrame]:
    """One-hot encoding as coordinates: ``(column, value, index)``, the position
    of every category (by column, then value; null last with
    ``nan_as_category``), and one row ``(keys..., index)`` for every 1 of the
    encoded matrix.  Both are tables, whatever the number of categories."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("_p")
    long = df.select(*keys, pairs).select(*keys, "_p.column", "_p.value")
    if not nan_as_category:
        long = long.where(F.col("value").isNotNull())
    distinct = (long.select("column", "value").distinct()
                .select("column", "value", F.col("value").isNull().alias("_last"), F.lit(1).cast("bigint").alias("_one")))
    places = cut_lineage(running(distinct, "column", ["_one"], inclusive=False, tie_cols=["_last", "value"], prefix="index")
                         .select("column", "value", F.col("index_one").alias("index")))
    return places, join_on(long, places, ["column", "value"]).select(*keys, "index")


def category_share_long(df: DataFrame, keys: Sequence[str], col: str,
                        nan_as_category: bool = True) -> DataFrame:
    """``(keys..., value, n, share)``: how many of a group's rows have each
    category and their share of all its rows, for the categories it has."""
    counts = df.groupBy(*keys, F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    # a group's categories, at most as many rows as it has distinct values
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("_all"))
    out = join_on(counts, sizes, list(keys))
    if not nan_as_category:
        out = out.where(F.col("value").isNotNull())
    return out.select(*keys, "value", "n", (F.col("n").cast("double") / F.col("_all").cast("double")).alias("share"))


def wide_shares(df: DataFrame, key: str, col: str, values: Sequence, prefix: str = "",
                suffix: str = "_MEAN") -> DataFrame:
    """``key`` and one share column per value: categories are counted first and
    pivoted, so a row costs one hash lookup and not one comparison a value."""
    counts = df.groupBy(key, F.col(col).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    # pivot drops rows of other values, so the group's size rides along with each
    sizes = counts.groupBy(key).agg(F.sum("_n").alias("_all"))
    wide = counts.where(F.col("_value").isNotNull()).groupBy(key).pivot("_value", list(values)).agg(F.first("_n"))
    wide = wide.toDF(key, *[f"_v{i}" for i in range(len(values))])
    total = F.col("_all").cast("double")
    return (join_on(sizes, wide, [key], "left")
            .select(key, *[(F.coalesce(F.col(f"_v{i}"), F.lit(0)).cast("double") / total).alias(f"{prefix}{dummy_name(col, v)}{suffix}")
                           for i, v in enumerate(values)]))


def share_maps(df: DataFrame, key: str, col: str, out: str) -> DataFrame:
    """``key`` and a map from each category that its rows have to its share."""
    long = category_share_long(df, [key], col).where(F.col("value").isNotNull())
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("value").cast("string").alias("k"), F.col("share").alias("v")))))
    return long.groupBy(key).agg(entries.alias(out))


def category_share(col: str, values: Sequence, nan_as_category: bool = True,
                   prefix: str = "", suffix: str = "_MEAN",
                   condition: Column | None = None) -> list[Column]:
    """Aggregate expressions: share of rows per category value.

    ``avg(CASE WHEN col <=> v THEN 1.0 ELSE 0.0 END)`` -- the mean of the
    one-hot column over *all* rows, without materialising it.  With a
    ``condition`` only rows meeting it count (null when none does).
    """
    out = []
    c = F.col(col)
    one, zero = F.lit(1.0), F.lit(0.0)
    items = [(dummy_name(col, v), c.eqNullSafe(v)) for v in values]
    if nan_as_category:
        items.append((f"{col}_nan", c.isNull()))
    cond = F.coalesce(condition, F.lit(False)) if condition is not None else None
    for name, pred in items:
        ind = F.when(pred, one).otherwise(zero)
        if cond is not None:
            ind = F.when(cond, ind)
        out.append(F.avg(ind).alias(f"{prefix}{name}{suffix}"))
    return out


def factorize_many(df: DataFrame, cols: Sequence[str], order_key: str,
                   codes: dict[str, dict | DataFrame] | None = None,
                   max_categories: int = DEFAULT_MAX_CATEGORIES) -> tuple[DataFrame, dict]:
    """Factorize several columns in place (codes by first appearance, null ->
    -1); returns the frame and the codes used: a map, or a code table for a
    column with more than ``max_categories`` values."""
    cols = [c for c in cols if c in df.columns]
    codes = dict(codes or {})
    todo = [c for c in cols if c not in codes]
    codes.update(first_seen_codes(df, todo, order_key, max_categories))
    out = df
    for c in cols:
        if isinstance(codes[c], DataFrame):
            out = coded(out.withColumn(c, F.col(c).cast("string")), c, codes[c], c)
    mapped = {c for c in cols if not isinstance(codes[c], DataFrame)}
    return out.select(*[apply_codes(c, codes[c]).alias(c) if c in mapped else F.col(c) for c in df.columns]), codes


def factorize(df: DataFrame, col: str, order_key: str, out_col: str | None = None) -> DataFrame:
    """Integer codes by first appearance; null gets -1.

    "First appearance" is made deterministic with a key: categories are
    ranked by the smallest ``order_key`` at which they occur (then by
    value).  The code table has one row per category, any number of them, and
    is joined (AQE broadcasts it if it is small and splits hot categories).
    """
    return coded(df, col, ordinal_codes(df, col, order_key), out_col or col)
