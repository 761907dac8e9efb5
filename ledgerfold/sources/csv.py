"""CSV scans with declared schemas and pandas-style missing tokens.

Spark nulls only the empty field; tokens such as ``NA`` or ``None`` stay
strings and even turn a numeric column into a string one on inference.  The
scan therefore reads every field as a string, maps the tokens to null and
casts to the declared type in one projection (no schema inference pass).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The tokens pandas ``read_csv`` treats as missing by default.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
               "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
               "nan", "null"]


def read_csv(spark: SparkSession, path: str, schema: T.StructType,
             null_tokens: Iterable[str] = NULL_TOKENS, encoding: str = "UTF-8",
             sep: str = ",") -> DataFrame:
    """Header CSV -> typed frame; fields equal to a null token become null."""
    as_text = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])
    raw = (spark.read.option("header", True).option("encoding", encoding).option("sep", sep)
           .option("nullValue", None).option("emptyValue", "").schema(as_text).csv(path))
    tokens = list(null_tokens)
    cols = []
    for f in schema.fields:
        c = F.col(f.name)
        cleaned = F.when(c.isNull() | c.isin(tokens), F.lit(None)).otherwise(c)
        cols.append(cleaned.cast(f.dataType).alias(f.name))
    return raw.select(*cols)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
