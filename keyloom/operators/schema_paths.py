"""Paths and facts read off JSON Schemas.

All functions take ``(dataset, schema_json)`` rows. Paths are arrays of typed steps: ``key`` for a
declared property, ``any`` for an additional one, ``regex`` for a pattern, ``index`` for an array
step and ``wild`` for everything below, so that no property name can be mistaken for a marker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions import json_values as J
from keyloom.functions.descend import descend, nesting_depth
from keyloom.functions.schema_walk import (
    MAX_PATH_LENGTH,
    STATE,
    TOKEN,
    at,
    entries,
    has,
    items,
    single,
    step,
    token,
    type_is,
    walk,
)
from keyloom.operators.schema_nodes import observed_static_paths, with_reference_flag
from keyloom.session import materialize, prepared

# Keywords that hold lists of alternative or combined schemas.
COMBINERS = ["allOf", "anyOf", "oneOf"]

# Schema keywords that are not steps of the data path.
STRIPPED_KEYWORDS = [
    "definitions", "$defs", "properties", "patternProperties", "oneOf", "allOf", "anyOf", "items",
]

PATHS = f"array<array<{TOKEN}>>"


def _index() -> Column:
    return token("index", F.lit("*"))


def _any() -> Column:
    return token("any", F.lit("*"))


def _key(e: Column) -> Column:
    return token("key", e.key)


def _combined(s: Column) -> list[Column]:
    return [F.transform(items(s.x, c), lambda i: step(s, None, i)) for c in COMBINERS]


def closed_children(s: Column) -> Column:
    """Sub-schemas that describe data, each one data step below its schema or at the same place."""
    no = F.lit(False)
    conditional = F.when(
        J.is_object(at(s.x, "if")),
        F.concat(
            F.transform(single(s.x, "then"), lambda v: step(s, None, v)),
            F.transform(single(s.x, "else"), lambda v: step(s, None, v)),
        ),
    ).otherwise(J.empty(f"array<{STATE}>"))
    return F.concat(
        F.transform(single(s.x, "additionalProperties"), lambda v: step(s, _any(), v)),
        F.transform(entries(s.x, "properties"), lambda e: step(s, _key(e), e.value)),
        F.transform(
            entries(s.x, "patternProperties"), lambda e: step(s, token("regex", e.key), e.value)
        ),
        F.transform(F.concat(single(s.x, "items"), items(s.x, "items")), lambda v: step(s, _index(), v)),
        F.transform(items(s.x, "prefixItems"), lambda v: step(s, _index(), v, no)),
        *_combined(s),
        conditional,
    )


def closes_when_undeclared(x: Column) -> Column:
    """True where closing a schema adds ``additionalProperties: false``: it describes an object
    and does not say what happens to further keys."""
    return ~has(x, "additionalProperties") & (
        type_is(x, "object") | has(x, "properties") | has(x, "required")
    )


def _closed_emit(assume_closed: bool):
    def emit(s):
        closed = J.is_false(at(s.x, "additionalProperties"))
        if assume_closed:
            closed = closed | (s.closable & closes_when_undeclared(s.x))
        return F.when(closed, F.array(s.path)).otherwise(J.empty(PATHS))
    return emit


def explicit_children(s: Column) -> Column:
    """Sub-schemas followed by the explicit variant: additional keys stay at their parent's path,
    list-valued ``items`` and ``else`` are not followed, array keywords need ``type: array``."""
    none = J.empty(f"array<{STATE}>")
    array_steps = F.concat(
        F.transform(single(s.x, "items"), lambda v: step(s, _index(), v)),
        F.transform(items(s.x, "prefixItems"), lambda v: step(s, _index(), v)),
    )
    return F.concat(
        F.transform(entries(s.x, "properties"), lambda e: step(s, _key(e), e.value)),
        F.transform(single(s.x, "additionalProperties"), lambda v: step(s, None, v)),
        F.when(type_is(s.x, "array"), array_steps).otherwise(none),
        *_combined(s),
        F.transform(single(s.x, "then"), lambda v: step(s, None, v)),
    )


def _explicit_emit(s: Column) -> Column:
    extra = at(s.x, "additionalProperties")
    wild = F.array(F.array_append(s.path, token("wild", F.lit("*"))))
    return (
        F.when(J.is_false(extra), F.array(s.path))
        .when(J.is_true(extra), wild)
        .when(J.is_object(extra) & J.is_false(at(extra, "additionalProperties")), F.array(s.path))
        .when(J.is_object(extra), wild)
        .otherwise(J.empty(PATHS))
    )


def _parsed(schemas: DataFrame) -> DataFrame:
    """Schemas as VARIANT ``x``, from texts written to the shared folder: what is asked of ``x`` would else be worked out for
    every row that the schemas are derived from, as a filter is moved below a distinct and below a repartition."""
    texts = materialize(schemas.select("dataset", "schema_json"), "schemas")
    return texts.select("dataset", J.parse(F.col("schema_json")).alias("x"))


def _paths(schemas: DataFrame, name: str, children, emit, max_path_length: int) -> DataFrame:
    def plain(path):
        return F.transform(path, lambda t: F.struct(t.kind.alias("kind"), t.token.alias("token")))

    def build():
        return F.transform(walk(F.col("x"), children, emit, max_path_length), plain)

    parsed = _parsed(schemas)
    found = prepared((name, max_path_length), build)
    return parsed.filter(J.is_object(F.col("x"))).select("dataset", F.explode(found).alias("path"))


def static_paths(
    schemas: DataFrame,
    variant: str = "closed",
    assume_closed: bool = False,
    max_path_length: int = MAX_PATH_LENGTH,
    observed: DataFrame | None = None,
) -> DataFrame:
    """Distinct data paths whose keys a schema closes: (dataset, path of typed steps).

    ``closed`` reports schemas with ``additionalProperties`` exactly false. With ``assume_closed``
    schemas that leave it undeclared count as closed too, as after :func:`close_schema`.
    ``explicit`` reports closed paths, and open ones with a final ``wild`` step.

    With ``observed(dataset, path)`` schemas with references are walked as a node table, along the data: their paths are
    those that begin an observed one, however far a recursion goes and however it branches.
    """
    if observed is not None:
        marked = with_reference_flag(schemas)
        plain = static_paths(marked.where("NOT refs").drop("refs"), variant, assume_closed, max_path_length)
        referring = marked.where("refs").drop("refs")
        if referring.isEmpty():
            return plain
        return plain.unionByName(observed_static_paths(referring, observed, variant, assume_closed))
    if variant == "closed":
        name = "assumed closed" if assume_closed else "closed"
        return _paths(
            schemas, name, closed_children, _closed_emit(assume_closed), max_path_length
        ).distinct()
    if variant == "explicit":
        return _paths(schemas, "explicit", explicit_children, _explicit_emit, max_path_length).distinct()
    raise ValueError("variant must be closed or explicit")


def open_paths(schemas: DataFrame, max_path_length: int = MAX_PATH_LENGTH) -> DataFrame:
    """Distinct paths of object schemas that accept undeclared keys, with flag 1."""

    def children(s):
        none = J.empty(f"array<{STATE}>")
        return F.concat(
            F.transform(entries(s.x, "properties"), lambda e: step(s, _key(e), e.value)),
            *_combined(s),
            F.when(
                type_is(s.x, "array"), F.transform(single(s.x, "items"), lambda v: step(s, _index(), v))
            ).otherwise(none),
            F.transform(items(s.x, "prefixItems"), lambda v: step(s, _index(), v)),
            F.transform(single(s.x, "then"), lambda v: step(s, None, v)),
        )

    def emit(s):
        extra = at(s.x, "additionalProperties")
        accepts = (
            extra.isNull() | J.is_true(extra) | J.is_object(extra) | has(s.x, "patternProperties")
        )
        return F.when(type_is(s.x, "object") & accepts, F.array(s.path)).otherwise(
            J.empty(PATHS)
        )

    return _paths(schemas, "open", children, emit, max_path_length).distinct().withColumn("flag", F.lit(1))


def _dynamic_pointers(x: Column) -> Column:
    """Pointer of every object that admits keys it does not name, list steps left out."""
    state = "struct<path:array<string>,x:variant>"

    def children(c):
        none = J.empty(f"array<{state}>")
        members = F.transform(
            F.filter(F.map_entries(J.object_map(c.x)), lambda e: J.has_children(e.value)),
            lambda e: F.struct(F.array_append(c.path, e.key).alias("path"), e.value.alias("x")),
        )
        listed = F.transform(
            F.filter(J.array_items(c.x), J.has_children),
            lambda i: F.struct(c.path.alias("path"), i.alias("x")),
        )
        return F.coalesce(members, listed, none)

    def is_dynamic(c):
        extra = at(c.x, "additionalProperties")
        opens = ~has(c.x, "properties") & extra.isNotNull() & ~J.is_false(extra)
        return J.is_object(c.x) & (has(c.x, "patternProperties") | opens)

    root = F.array(F.struct(J.empty("array<string>").alias("path"), x.alias("x")))
    states = descend(root, children, state, nesting_depth(x) + 1)
    return F.transform(F.filter(states, is_dynamic), lambda c: c.path)


def _pointers_of_x() -> Column:
    return prepared("dynamic pointers", lambda: _dynamic_pointers(F.col("x")))


def dynamic_parents(schemas: DataFrame) -> DataFrame:
    """Raw keyword pointers of objects with patterns or open keys: (dataset, pointer), one row each."""
    return _parsed(schemas).select("dataset", F.explode(_pointers_of_x()).alias("pointer"))


def count_dynamic_keys(schemas: DataFrame) -> DataFrame:
    """How many such objects each schema has, 0 included."""
    return schemas.select("dataset", J.parse(F.col("schema_json")).alias("x")).select(
        "dataset",
        F.coalesce(F.size(_pointers_of_x()), F.lit(0)).alias("dynamic_keys"),
    )


def strip_keywords(pointers: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """Data paths of keyword pointers: ``$`` first, keywords removed, pointers through ``items`` dropped."""
    words = F.array(*[F.lit(k) for k in (keywords or STRIPPED_KEYWORDS)])
    kept = F.filter("pointer", lambda p: ~F.array_contains(words, p))
    return pointers.filter(~F.array_contains("pointer", "items")).select(
        "dataset", F.concat(F.array(F.lit("$")), kept).alias("path")
    )


def has_pattern_properties(schemas: DataFrame) -> DataFrame:
    """Whether any schema inside declares ``patternProperties``. Written to the shared folder, so that a filter on the flag
    reads it instead of walking the schemas again."""

    def children(s):
        return F.concat(
            F.transform(entries(s.x, "properties"), lambda e: step(s, _key(e), e.value)),
            F.transform(single(s.x, "additionalProperties"), lambda v: step(s, _any(), v)),
            F.transform(F.concat(single(s.x, "items"), items(s.x, "items")), lambda v: step(s, _index(), v)),
            F.transform(items(s.x, "prefixItems"), lambda v: step(s, _index(), v)),
            *_combined(s),
            F.transform(single(s.x, "then"), lambda v: step(s, None, v)),
        )

    def emit(s):
        return F.array(has(s.x, "patternProperties"))

    parsed = schemas.select("dataset", J.parse(F.col("schema_json")).alias("x"))
    found = prepared("patterns", lambda: F.exists(walk(F.col("x"), children, emit), lambda p: p))
    flags = parsed.select("dataset", F.coalesce(found, F.lit(False)).alias("has_pattern_properties"))
    return materialize(flags, "pattern-flags")


def dynamic_paths_dotted(schemas: DataFrame) -> DataFrame:
    """Dotted paths of objects described by one pattern alone; ``.*`` stands for its keys.

    Objects with both declared and pattern properties end the search below them.
    """

    def children(s):
        named, patterned = has(s.x, "properties"), has(s.x, "patternProperties")
        none = J.empty(f"array<{STATE}>")
        return (
            F.when(named & patterned, none)
            .when(named, F.transform(entries(s.x, "properties"), lambda e: step(s, _key(e), e.value)))
            .when(
                F.size(entries(s.x, "patternProperties")) == 1,
                F.transform(entries(s.x, "patternProperties"), lambda e: step(s, _any(), e.value)),
            )
            .otherwise(none)
        )

    def emit(s):
        alone = ~has(s.x, "properties") & (F.size(entries(s.x, "patternProperties")) == 1)
        return F.when(alone, F.array(s.path)).otherwise(J.empty(PATHS))

    dotted = F.array_join(
        F.transform(F.slice("path", 2, F.size("path")), lambda t: F.concat(F.lit("."), t.token)), ""
    )
    return _paths(schemas, "dotted", children, emit, MAX_PATH_LENGTH).select("dataset", dotted.alias("dotted_path")).distinct()


def path_text(path: Column) -> Column:
    """Typed steps as plain text steps, for display: regex steps as ``/pattern/``, any as ``<any>``."""
    return F.transform(
        path,
        lambda t: F.when(t.kind == "any", F.lit("<any>"))
        .when(t.kind == "wild", F.lit("<wild>"))
        .when(t.kind == "regex", F.concat(F.lit("<regex>"), t.token))
        .otherwise(t.token),
    )
