"""Schemas to schemas: references replaced, open objects closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions import json_values as J
from keyloom.functions import schema_rewrite as R
from keyloom.functions.descend import containers
from keyloom.functions.schema_walk import at, let, ref_pointer, ref_targets
from keyloom.session import prepared


def close_schema(schemas: DataFrame) -> DataFrame:
    """Set ``additionalProperties`` to false wherever an object schema leaves it undeclared.

    Reaches schemas under properties, patternProperties, additionalProperties, items, allOf, anyOf,
    oneOf, if, then and else. Columns besides ``schema_json`` are kept.
    """
    return _rewritten(schemas, close=True).drop("_new")


def dereference(schemas: DataFrame) -> DataFrame:
    """Replace local references by what they name; the root's are merged under its own keywords.

    Adds ``dereferenced``: 1 where references remain because they are remote, missing or recursive.
    """
    flag = F.when(F.col("_new.refs_left") > 0, 1).otherwise(0)
    return _rewritten(schemas, expand_refs=True).withColumn("dereferenced", flag).drop("_new")


def _rewritten(schemas: DataFrame, **how) -> DataFrame:
    keep = [c for c in schemas.columns if c != "schema_json"]
    x = F.col("_x")
    new_text = prepared(("rewrite", *sorted(how)), lambda: R.rewritten(x, **how))
    new = schemas.select(*keep, J.parse(F.col("schema_json")).alias("_x")).select(
        *keep, F.when(x.isNotNull(), new_text).alias("_new")
    )
    return new.select(*keep, F.col("_new.text").alias("schema_json"), "_new")


def resolve_ref(schemas: DataFrame) -> DataFrame:
    """Every local reference of a schema and what it names: (dataset, ref, target_json).

    The text after ``#/`` is split at slashes and followed through objects; ``target_json`` is NULL
    where that leads nowhere.
    """
    x = F.col("x")
    no_path = J.empty("array<string>")
    refs = F.array_distinct(
        F.filter(
            F.transform(containers(x, no_path), lambda c: J.string_value(at(c.x, "$ref"))),
            lambda r: r.isNotNull(),
        )
    )
    found = let(
        ref_targets(x),
        lambda targets: F.transform(
            refs,
            lambda r: F.struct(
                r.alias("ref"),
                F.to_json(F.get(F.filter(targets, lambda t: t.path == ref_pointer(r)), 0).x).alias("target_json"),
            ),
        ),
    )
    parsed = schemas.select("dataset", J.parse(F.col("schema_json")).alias("x"))
    return parsed.select("dataset", F.inline(found))
