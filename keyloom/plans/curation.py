"""Which datasets are usable, and with which schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.operators import schema_rewrite, validate
from keyloom.session import materialize
from keyloom.sources.schemas import write_schema_files

FLAGS = ["exist", "empty", "loaded", "dereferenced", "modified", "validation"]


def curate(docs: DataFrame, schemas: DataFrame, inventory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Curated schemas and the failure flags of every dataset.

    ``schemas`` has dataset, schema_json, loaded; ``inventory`` dataset, exist, empty. A schema is
    dereferenced, closed, and kept closed only if all documents of its dataset satisfy it. Datasets
    that fail an earlier check are not validated.
    """
    present = inventory.filter((F.col("exist") == 0) & (F.col("empty") == 0)).select("dataset")
    usable = schemas.filter("loaded").join(present, "dataset", "left_semi")
    resolved = materialize(schema_rewrite.dereference(usable), "resolved")
    complete = resolved.filter(F.col("dereferenced") == 0)
    closed = materialize(schema_rewrite.close_schema(complete.select("dataset", "schema_json")), "closed")
    invalid = materialize(validate.invalid_count(validate.validate_documents(docs, closed)), "invalid")
    chosen = validate.choose_schema(complete, closed, invalid)

    failed_load = schemas.select("dataset", F.when(F.col("loaded"), 0).otherwise(1).alias("_load_failed"))
    reached = (F.col("exist") == 0) & (F.col("empty") == 0)
    flags = (
        inventory.join(failed_load, "dataset", "left")
        .join(resolved.select("dataset", "dereferenced"), "dataset", "left")
        .join(chosen.select("dataset", "validation"), "dataset", "left")
        .select(
            "dataset",
            "exist",
            "empty",
            F.when(reached, F.coalesce("_load_failed", F.lit(1))).otherwise(0).alias("loaded"),
            F.coalesce("dereferenced", F.lit(0)).alias("dereferenced"),
            F.lit(0).alias("modified"),
            F.coalesce("validation", F.lit(0)).alias("validation"),
        )
    )
    return chosen.select("dataset", "schema_json"), flags


def save_curated(curated: DataFrame, path: str) -> None:
    """Write the schemas that curation kept, one file per dataset, replacing what the folder held."""
    write_schema_files(curated, path, mode="overwrite")
