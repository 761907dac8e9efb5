"""Joins and set operations with explicit size checks for broadcasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_BROADCAST_ROWS = 1_000_000
DEFAULT_BROADCAST_BYTES = 64 << 20


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
                      max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only after proving that ``df`` has at most ``max_rows``
    rows and ``max_bytes`` bytes (strings as long as they are, other columns by
    their width).

    The probe reads at most ``max_rows + 1`` rows (limit is pushed into the
    scan); above a bound the plain frame is returned and AQE chooses.
    """
    wide = [f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct", "variant")]
    size = sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in wide), F.lit(16 * len(df.columns) + 16))
    size = sum((F.coalesce(F.octet_length(F.to_json(F.struct(F.col(c)))), F.lit(0)) for c in nested), size)
    r = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(size.cast("bigint")).alias("b")).first()
    return F.broadcast(df) if r["n"] <= max_rows and (r["b"] or 0) <= max_bytes else df


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
            broadcast_rows: int | None = None) -> DataFrame:
    """Equi-join on ``keys`` in which null matches null (a null label or group
    is a group like any other); the keys appear once, as ``left`` has them.
    ``broadcast_rows``: broadcast ``right`` if it has at most that many rows."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    if broadcast_rows is not None:
        named = bounded_broadcast(named, broadcast_rows)
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(named, on, how).drop(*[f"_right_{k}" for k in keys])


def left_join_child(parent: DataFrame, child: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Left join of a child already reduced to ≤ 1 row per key."""
    return parent.join(child, key, "left")


def left_join_fanout(parent: DataFrame, child: DataFrame, parent_key: str,
                     child_key: str, prefix: str) -> DataFrame:
    """1:N left join; the child's columns get ``prefix`` so that no name
    collides, plus the parent's child count (0 when none)."""
    ren = child.select(*[F.col(c).alias(f"{prefix}{c}") for c in child.columns])
    counts = child.groupBy(child_key).agg(F.count(F.lit(1)).alias(f"{prefix}count"))
    p = parent.join(counts.withColumnRenamed(child_key, parent_key), parent_key, "left")
    p = p.withColumn(f"{prefix}count", F.coalesce(F.col(f"{prefix}count"), F.lit(0)))
    return p.join(ren, p[parent_key] == ren[f"{prefix}{child_key}"], "left")


def anti_join(df: DataFrame, other: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows of ``df`` without a match.  The other side is reduced to its
    distinct keys first (map-side), so a key repeated there many times cannot
    skew the join (AQE can split only the left side of an anti join)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.join(other.select(*keys).distinct(), keys, "left_anti")


def key_intersection(a: DataFrame, a_key: str, b: DataFrame, b_key: str) -> DataFrame:
    """Distinct keys present in both frames."""
    ka = a.select(F.col(a_key).alias("key")).distinct()
    kb = b.select(F.col(b_key).alias("key")).distinct()  # no hot key on the semi side
    return ka.join(kb, "key", "left_semi")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
