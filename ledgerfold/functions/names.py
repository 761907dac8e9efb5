"""Column-name cleaning (metadata only, no data pass)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

_NON_WORD = re.compile(r"[^A-Za-z0-9_]")
_RUNS = re.compile(r"_+")


def clean_name(name: str) -> str:
    """Non-alphanumerics become ``_``, runs are squeezed, ends stripped."""
    return _RUNS.sub("_", _NON_WORD.sub("_", str(name))).strip("_")


def clean_names(df: DataFrame) -> DataFrame:
    """Rename every column with ``clean_name``; raise on a collision.

    Spark resolves names case-insensitively by default, so collisions are
    detected on the lower-cased result too.
    """
    new = [clean_name(c) for c in df.columns]
    seen: dict[str, str] = {}
    for old, nn in zip(df.columns, new):
        key = nn.lower()
        if key in seen:
            raise ValueError(
                f"cleaned column names collide: {seen[key]!r} and {old!r} -> {nn!r}")
        seen[key] = old
    if new == df.columns:
        return df
    return df.toDF(*new)
