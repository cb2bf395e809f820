"""Declared schemas of the logical tables and the checks applied at a job's input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIGNALS = ("like", "dislike", "share", "bookmarks")

INTERACTIONS = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("pos", T.LongType()),
        T.StructField("timespent", T.DoubleType()),
        *[T.StructField(name, T.IntegerType()) for name in SIGNALS],
    ]
)
ITEMS = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("source_id", T.LongType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("embeddings", T.ArrayType(T.FloatType())),
    ]
)
USERS = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("gender", T.DoubleType()),
        T.StructField("age", T.DoubleType()),
    ]
)
PAIRS = T.StructType(
    [T.StructField("user_id", T.LongType()), T.StructField("item_id", T.LongType())]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema`` (cast included); missing columns are an error."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def fixed_length(column: Column, length: int, name: str = "array") -> Column:
    """The array itself if it is null or has ``length`` elements; any other length is an error of the job."""
    told = F.concat(F.lit(f"{name} must have {length} elements, not "), F.size(column).cast("string"))
    return F.when(column.isNotNull() & (F.size(column) != length), F.raise_error(told)).otherwise(column)


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df
