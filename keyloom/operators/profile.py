"""Key statistics and path profiles.

The document pass ends in one aggregation on (dataset, path, key). Everything a profile needs is
kept as a sum or a bit mask there, so each later step is one more plain aggregation with map-side
combine: no window over a path, no list of keys, and no second pass over the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions import json_values as J
from keyloom.operators.flatten import object_members
from keyloom.operators.joins import BROADCAST_BYTES, measured_bytes, size_checked_join, sized_join
from keyloom.session import materialize

PATH = ["dataset", "parent_path"]


def key_frequency(path_rows: DataFrame) -> DataFrame:
    """Occurrences and type set of each key under each object path, over all documents.

    Columns: dataset, parent_path, key, frequency, type_mask. Array steps are not keys.
    """
    return (
        object_members(path_rows)
        .groupBy(*PATH, "key")
        .agg(
            F.count(F.lit(1)).alias("frequency"),
            F.bit_or(J.type_bit(F.col("json_type"))).alias("type_mask"),
        )
    )


def path_frequency(path_rows: DataFrame) -> DataFrame:
    """Occurrences and type set of every full path (array steps too if they were flattened)."""
    return path_rows.groupBy("dataset", "path").agg(
        F.count(F.lit(1)).alias("frequency"),
        J.types_of_mask(F.bit_or(J.type_bit(F.col("json_type")))).alias("types"),
    )


def with_types(keys: DataFrame) -> DataFrame:
    """Replace the type mask by the sorted array of type names."""
    return keys.withColumn("types", J.types_of_mask(F.col("type_mask"))).drop("type_mask")


def without_root(keys: DataFrame) -> DataFrame:
    """Drop the row that stands for the document itself (see ``include_root``)."""
    return keys.filter(F.size("parent_path") > 0)


def num_docs(keys: DataFrame) -> DataFrame:
    """Documents per dataset, read off the root rows of keys flattened with ``include_root``."""
    return keys.filter(F.size("parent_path") == 0).groupBy("dataset").agg(
        F.sum("frequency").alias("num_docs")
    )


def parent_frequency(keys: DataFrame) -> DataFrame:
    """Child occurrences and distinct child keys per object path."""
    return keys.groupBy(*PATH).agg(
        F.sum("frequency").alias("parent_frequency"), F.count(F.lit(1)).alias("num_nested_keys")
    )


def occurrence(keys: DataFrame) -> DataFrame:
    """Adds ``parent_frequency`` and ``occurrence`` (share of the parent's child occurrences).

    An equi-join with the aggregated totals rather than a window: a path with millions of keys is
    then a skewed join key, which adaptive execution splits, and not one sort in one task.
    """
    totals = parent_frequency(keys).select(*PATH, "parent_frequency")
    share = F.when(F.col("parent_frequency") > 0, F.col("frequency") / F.col("parent_frequency"))
    return keys.join(totals, PATH).withColumn("occurrence", F.coalesce(share, F.lit(0.0)))


def _x_ln_x(x: Column) -> Column:
    return F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0))


def path_profile(keys: DataFrame, docs_per_dataset: DataFrame) -> DataFrame:
    """Features of every object path.

    Columns: dataset, path, parent_frequency, num_nested_keys, datatype_entropy (0 when all keys
    share one type set), type_homogeneity, key_entropy, depth, depth_level.

    With shares s = f/P of a path's P child occurrences and N documents, the key entropy is
    -sum(s/N * ln(s/N)) = -(sum(f ln f)/P - ln P - ln N)/N, so two sums per path are enough.
    """
    f = F.col("frequency").cast("double")
    grouped = without_root(keys).groupBy(*PATH).agg(
        F.sum("frequency").alias("parent_frequency"),
        F.count(F.lit(1)).alias("num_nested_keys"),
        F.sum(_x_ln_x(f)).alias("_f_ln_f"),
        (F.min("type_mask") == F.max("type_mask")).alias("_homogeneous"),
    )
    n = F.col("num_docs").cast("double")
    p = F.col("parent_frequency").cast("double")
    joined = size_checked_join(grouped, docs_per_dataset, ["dataset"])
    return _described(joined).withColumn(
        "key_entropy", -(F.col("_f_ln_f") / p - F.ln(p) - F.ln(n)) / n
    ).drop("_f_ln_f", "_homogeneous")


def jxplain_profile(keys: DataFrame, docs_per_dataset: DataFrame) -> DataFrame:
    """Path features with entropy over raw counts: -sum(f/N * ln(f/N)) for N documents.

    Meant for keys flattened with ``descend_arrays=False``, where no count exceeds N. The datatype
    entropy of this variant is always 0, as in the feature set it reproduces.
    """
    f = F.col("frequency").cast("double")
    grouped = without_root(keys).groupBy(*PATH).agg(
        F.sum("frequency").alias("parent_frequency"),
        F.count(F.lit(1)).alias("num_nested_keys"),
        F.sum(_x_ln_x(f)).alias("_f_ln_f"),
    )
    n = F.col("num_docs").cast("double")
    p = F.col("parent_frequency").cast("double")
    joined = size_checked_join(grouped, docs_per_dataset, ["dataset"])
    return joined.select(
        "dataset",
        F.col("parent_path").alias("path"),
        "parent_frequency",
        "num_nested_keys",
        F.lit(0).alias("datatype_entropy"),
        (-(F.col("_f_ln_f") - p * F.ln(n)) / n).alias("key_entropy"),
        "num_docs",
    )


def _described(grouped: DataFrame) -> DataFrame:
    depth = J.nesting_depth(F.col("path"))
    return (
        grouped.withColumnRenamed("parent_path", "path")
        .withColumn("datatype_entropy", F.when(F.col("_homogeneous"), 0).otherwise(1))
        .withColumn(
            "type_homogeneity",
            F.when(F.col("_homogeneous"), "homogeneous").otherwise("heterogeneous"),
        )
        .withColumn("depth", depth)
        .withColumn("depth_level", J.depth_level(depth))
    )


def distinct_subkeys(
    keys: DataFrame, cap: int | None = None, keys_per_row: int = 10_000, buckets: int = 64
) -> DataFrame:
    """Subkeys per path as sorted arrays: dataset, path, part, distinct_subkeys.

    A path with up to about ``keys_per_row`` keys is one row, part 0; the keys of a larger one are
    spread by hash over numbered parts. With ``cap`` only that many keys per path, first by name,
    are reported, in one part; it is taken within hashed buckets of a path first, so that no task
    ever ranks all keys of one path.
    """
    limit = keys_per_row if cap is None else cap
    keys = materialize(without_root(keys), "subkeys")
    # Only paths with more keys than that are dealt out or ranked; they are few, as each has so many rows.
    large = parent_frequency(keys).filter(F.col("num_nested_keys") > limit)
    place = F.struct(*PATH).alias("_place")  # unlike its fields a struct is never NULL, so paths without a dataset meet too
    large = materialize(large.select(place, "num_nested_keys"), "large-paths")
    fits = measured_bytes(large) <= BROADCAST_BYTES
    named = keys.select(*PATH, "key", place)
    if cap is not None:
        bucket = F.pmod(F.xxhash64("key"), F.lit(buckets))
        in_bucket = Window.partitionBy(*PATH, "_bucket").orderBy("key")
        in_path = Window.partitionBy(*PATH).orderBy("key")
        ranked = (
            sized_join(named, large, ["_place"], "left_semi", fits)
            .withColumn("_bucket", bucket)
            .withColumn("_rank", F.row_number().over(in_bucket))
            .filter(F.col("_rank") <= cap)
            .withColumn("_rank", F.row_number().over(in_path))
            .filter(F.col("_rank") <= cap)
            .select(*PATH, "key")
        )
        rest = sized_join(named, large, ["_place"], "left_anti", fits).select(*PATH, "key")
        named = rest.unionByName(ranked).select(*PATH, "key", F.lit(0).alias("part"))
    else:
        parts = F.ceil(F.col("num_nested_keys") / F.lit(keys_per_row))
        part = F.coalesce(F.pmod(F.xxhash64("key"), parts), F.lit(0)).cast("int")
        named = sized_join(named.dropna(subset=PATH), large, ["_place"], "left", fits).select(*PATH, "key", part.alias("part"))
    return named.groupBy(*PATH, "part").agg(
        F.sort_array(F.collect_list("key")).alias("distinct_subkeys")
    ).withColumnRenamed("parent_path", "path")


def _in_parts(rows: DataFrame, counts: DataFrame, keys_per_row: int) -> DataFrame:
    """Rows of keys with their path's ``counts`` and a part by the key's hash, dealt out by part, so
    that a path with very many keys is collected by many tasks."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("num_nested_keys") / F.lit(keys_per_row)))
    return (
        rows.join(counts, PATH)
        .withColumn("part", F.pmod(F.xxhash64("key"), parts).cast("int"))
        .repartition(*PATH, "part")
    )


def packed_properties(keys: DataFrame, keys_per_row: int = 10_000) -> DataFrame:
    """Keys of a path as ``MAP<key, STRUCT<occurrence, type>>`` in parts of bounded size.

    A path with up to about ``keys_per_row`` keys is one row (part 0). Beyond that its keys are
    spread by hash over as many parts as needed: nothing is dropped and no row is unbounded.
    """
    return (
        _in_parts(without_root(keys), parent_frequency(keys), keys_per_row)
        .groupBy(*PATH, "part")
        .agg(
            F.map_from_entries(
                F.collect_list(
                    F.struct(
                        "key",
                        F.struct(
                            (F.col("frequency") / F.col("parent_frequency")).alias("occurrence"),
                            J.types_of_mask(F.col("type_mask")).alias("type"),
                        ),
                    )
                )
            ).alias("properties")
        )
        .withColumnRenamed("parent_path", "path")
    )
