"""Feature tables in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _is_nested(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))


def serialize_nested(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    return df.select(*[
        F.to_json(f.name).alias(f.name) if _is_nested(f) else F.col(f.name)
        for f in df.schema.fields
    ])


def write_features(df: DataFrame, path: str, fmt: str = "parquet", sep: str = ";", mode: str = "overwrite") -> None:
    """Write a feature table as Parquet, or as CSV with nested columns as JSON text."""
    if fmt == "parquet":
        df.write.mode(mode).parquet(path)
    elif fmt == "csv":
        serialize_nested(df).write.mode(mode).option("header", True).option("sep", sep).option(
            "escape", '"'
        ).csv(path)
    else:
        raise ValueError("fmt must be parquet or csv")


def read_features(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", sep: str = ";") -> DataFrame:
    """Read back what :func:`write_features` wrote; ``schema`` is that of the feature table."""
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    if fmt != "csv":
        raise ValueError("fmt must be parquet or csv")
    target = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    flat = T.StructType([
        T.StructField(f.name, T.StringType() if _is_nested(f) else f.dataType) for f in target.fields
    ])
    raw = spark.read.schema(flat).option("header", True).option("sep", sep).option("escape", '"').csv(path)
    return raw.select(*[
        F.from_json(f.name, f.dataType).alias(f.name) if _is_nested(f) else F.col(f.name)
        for f in target.fields
    ])
