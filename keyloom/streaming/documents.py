"""The document pass over files as they arrive.

Counts and type masks merge, so the batch operators run unchanged on a stream: flattening is
row-local and the key statistics are one aggregation. Two ways: kept by Structured Streaming as
state, the whole table written after each batch; or as one delta per batch, added up by readers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from keyloom.operators.flatten import document_items, flatten_json
from keyloom.operators.profile import PATH, key_frequency
from keyloom.session import shared_dir


def stream_json_lines(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Documents of a folder's JSON Lines files, each file read once: (dataset, json)."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    name = F.url_decode(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    return lines.select(name.alias("dataset"), F.col("value").alias("json"))


def stream_key_frequency(docs: DataFrame) -> DataFrame:
    """Running key statistics, root rows included."""
    return key_frequency(flatten_json(document_items(docs), include_root=True))


def write_key_frequency(keys: DataFrame, name: str) -> DataStreamWriter:
    """Writer that replaces a Parquet table of key statistics after every batch."""
    folder = shared_dir(keys.sparkSession)

    def replace(batch, _):
        batch.write.mode("overwrite").parquet(f"{folder}/{name}")

    return (
        keys.writeStream.outputMode("complete")
        .option("checkpointLocation", f"{folder}/{name}-checkpoint")
        .foreachBatch(replace)
    )


def write_key_deltas(docs: DataFrame, name: str) -> DataStreamWriter:
    """Writer that appends the key statistics of each batch of documents: no state, no rewriting.

    A batch is one folder named by its id. A batch that runs again after a failure replaces its own
    folder with the same rows, so nothing counts twice.
    """
    folder = f"{shared_dir(docs.sparkSession)}/{name}"

    def add(batch: DataFrame, batch_id: int) -> None:
        rows = flatten_json(document_items(batch), include_root=True)
        key_frequency(rows).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return docs.writeStream.option("checkpointLocation", f"{folder}-checkpoint").foreachBatch(add)


def read_key_deltas(spark: SparkSession, name: str) -> DataFrame:
    """Key statistics over all batches written so far: what ``key_frequency`` gives for their documents."""
    return merge_key_frequency(spark.read.parquet(f"{shared_dir(spark)}/{name}").drop("batch"))


def merge_key_frequency(keys: DataFrame) -> DataFrame:
    """Add up key statistics of parts of the documents."""
    return keys.groupBy(*PATH, "key").agg(
        F.sum("frequency").alias("frequency"), F.bit_or("type_mask").alias("type_mask")
    )
