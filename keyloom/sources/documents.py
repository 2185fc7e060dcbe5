"""JSON Lines in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions import json_values as J

BAD_RECORD_POLICIES = ("fail", "drop", "quarantine", "count")


def _dataset_from_file() -> Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)


def read_json_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One document per line; the file name is the dataset.

    Columns: dataset, doc_id, json. ``doc_id`` is unique, not dense. A byte order mark at the start
    of a line is removed; blank lines are kept, and count as bad records.
    """
    lines = spark.read.text(path)
    return lines.select(
        F.url_decode(_dataset_from_file()).alias("dataset"),
        F.monotonically_increasing_id().alias("doc_id"),
        F.regexp_replace("value", "^﻿", "").alias("json"),
    )


def read_partitioned_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Documents written by :func:`write_json_lines`: the dataset is the partition folder."""
    return spark.read.schema("value string, dataset string").text(path).select(
        "dataset",
        F.monotonically_increasing_id().alias("doc_id"),
        F.col("value").alias("json"),
    )


def documents_from(df: DataFrame, dataset: Column, doc_id: Column, json: Column) -> DataFrame:
    """Documents held in a table."""
    return df.select(dataset.alias("dataset"), doc_id.alias("doc_id"), json.alias("json"))


def is_bad_record(json: Column) -> Column:
    """True for text that is not JSON."""
    return J.parse(json).isNull()


def bad_record_policy(docs: DataFrame, policy: str = "fail") -> DataFrame:
    """Apply one policy to documents whose text is not JSON.

    ``fail`` raises when such a document is read, ``drop`` leaves them out, ``quarantine`` returns
    only them, and ``count`` returns per dataset the documents and how many are bad.
    """
    bad = is_bad_record(F.col("json"))
    if policy == "fail":
        message = F.concat(F.lit("not JSON: dataset "), "dataset", F.lit(", document "), "doc_id")
        checked = F.when(bad, F.raise_error(message).cast("string")).otherwise(F.col("json"))
        return docs.withColumn("json", checked)
    if policy == "drop":
        return docs.filter(~bad)
    if policy == "quarantine":
        return docs.filter(bad)
    if policy == "count":
        return docs.groupBy("dataset").agg(
            F.count(F.lit(1)).alias("documents"), F.count_if(bad).alias("bad_documents")
        )
    raise ValueError(f"policy must be one of {BAD_RECORD_POLICIES}")


def write_json_lines(docs: DataFrame, path: str, mode: str = "append") -> None:
    """Write documents one per line, one folder per dataset, as the original text.

    ``mode="overwrite"`` replaces what the folder held. Writers keep their partitioning, so one
    large dataset is written by many tasks.
    """
    one_line = F.regexp_replace("json", r"[\r\n]+", " ")
    docs.select("dataset", one_line.alias("value")).write.mode(mode).partitionBy("dataset").text(path)
