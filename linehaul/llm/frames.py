"""Small DataFrame helpers of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

#: A word: bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, which is counted; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def id_text(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string"))


def long_id(df: DataFrame, column: str) -> Column:
    """An integer id as long; an id of any other type is an error, as ids are compared by size."""
    kind = df.schema[column].dataType
    if not isinstance(kind, IntegralType | NullType):
        raise TypeError(f"{column} must be an integer, not {kind.simpleString()}")
    return F.col(column).cast("long")
