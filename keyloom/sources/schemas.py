"""JSON Schema files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions import json_values as J
from keyloom.sources.files import list_files, write_row_files

# Version marks in a schema's "$schema" address, in order of precedence.
DRAFT_MARKS = [
    ("2020-12", "2020-12"),
    ("2019-09", "2019-09"),
    ("draft-07", "draft7"),
    ("draft-06", "draft6"),
    ("draft-04", "draft4"),
    ("draft-03", "draft3"),
]
DEFAULT_DRAFT = "draft7"


def read_schemas(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One schema per file; the file name is the dataset.

    Columns: dataset, schema_json, loaded. Files that do not hold JSON stay, with ``loaded`` false
    and no text.
    """
    files = spark.read.text(path, wholetext=True)
    name = F.url_decode(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    return schemas_from(files, name, F.regexp_replace("value", "^﻿", ""))


def schemas_from(df: DataFrame, dataset: Column, schema_json: Column) -> DataFrame:
    """Schemas held in a table."""
    loaded = J.parse(schema_json).isNotNull()
    return df.select(
        dataset.alias("dataset"),
        F.when(loaded, schema_json).alias("schema_json"),
        loaded.alias("loaded"),
    )


def schema_name_from_url(url: Column) -> Column:
    """Last segment of an address, with ``.yaml`` replaced by ``.json``."""
    return F.regexp_replace(F.element_at(F.split(url, "/"), -1), r"\.yaml\z", ".json")


def draft_version(schema_json: Column) -> Column:
    """Draft of a schema, judged by its ``$schema`` address."""
    address = F.coalesce(F.get_json_object(schema_json, "$['$schema']"), F.lit(""))
    version = F.lit(DEFAULT_DRAFT)
    for mark, name in reversed(DRAFT_MARKS):
        version = F.when(F.contains(address, F.lit(mark)), F.lit(name)).otherwise(version)
    return version


def schema_properties(schemas: DataFrame) -> DataFrame:
    """Names of the top-level properties; NULL where the schema declares none as an object."""
    properties = F.try_variant_get(J.parse(F.col("schema_json")), "$.properties", "map<string,variant>")
    return schemas.select("dataset", F.map_keys(properties).alias("properties"))


def write_schemas(schemas: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write schema texts, one folder per dataset."""
    text = schemas.select("dataset", F.col("schema_json").alias("value")).dropna()
    text.write.mode(mode).partitionBy("dataset").text(path)


def dataset_inventory(schemas: DataFrame, files: DataFrame) -> DataFrame:
    """Which schemas have data: ``exist`` is 1 where there is no file, ``empty`` 1 for zero bytes.

    ``files`` has one row per data file: dataset, length (see :func:`data_files`).
    """
    sizes = files.groupBy("dataset").agg(F.sum("length").alias("length"))
    return schemas.select("dataset").distinct().join(sizes, "dataset", "left").select(
        "dataset",
        F.when(F.col("length").isNull(), 1).otherwise(0).alias("exist"),
        F.when(F.col("length") == 0, 1).otherwise(0).alias("empty"),
    )


def write_schema_files(schemas: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write one file per dataset, named like it: what :func:`read_schemas` reads."""
    write_row_files(schemas.select("dataset", "schema_json").dropna(), path, mode)


def data_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder, listed by tasks and not opened: dataset, length.

    The dataset is the partition folder that :func:`documents.write_json_lines` makes, or else the
    file's name. Zero-byte files are listed.
    """
    folder = F.regexp_extract("path", r"(?:^|/)dataset=([^/]*)/", 1)
    name = F.when(folder != "", F.url_decode(folder)).otherwise(F.element_at(F.split("path", "/"), -1))
    return list_files(spark, path).select(name.alias("dataset"), "length")
