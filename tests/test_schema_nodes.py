"""The node table of schemas, walks along the data, and costs that grow with the size of a schema only."""

import json
import time

from pyspark.sql import functions as F

from keyloom.operators import schema_nodes, schema_paths, schema_rewrite
from tests.fixtures import SCHEMAS, by_dataset, schema_rows

CLOSED = {"additionalProperties": False}
TREE = {
    "$ref": "#/d/n", "allOf": [{"$ref": "#/d/x"}],
    "d": {"n": {**CLOSED, "properties": {"l": {"$ref": "#/d/a"}, "r": {"$ref": "#/d/n"}}},
          "a": {"$ref": "#/d/b"}, "b": {"$ref": "#/d/n"}, "x": {"$ref": "#/d/y"}, "y": {"$ref": "#/d/x"}},
}
MIXED = {
    "properties": {
        "list": {"items": [{**CLOSED}, {"properties": {"q": CLOSED}}], "prefixItems": [{"properties": {"p": {"type": "object"}}}]},
        "when": {"if": {}, "then": {"properties": {"t": CLOSED}}, "else": CLOSED},
        "unless": {"then": CLOSED}, "any": {"anyOf": [CLOSED, {"additionalProperties": {"properties": {"z": CLOSED}}}]},
        "re": {"patternProperties": {"^a/b": {"$ref": "#/properties/any"}}}, "items": {"properties": CLOSED},
        "dead": {"$ref": "#/nowhere", **CLOSED}, "odd": {"$ref": 5, **CLOSED},
    },
    "$defs": {"unused": CLOSED},
}
SEEN = {
    "tree": [["$", "l", "r", "l", "l"], ["$", "r", "other"]],
    "mixed": [["$", "list", "*", "q"], ["$", "list", "*", "p"], ["$", "when", "t"], ["$", "unless"], ["$", "any", "k1", "z"],
              ["$", "re", "xa/b", "k", "z"], ["$", "items", "properties"], ["$", "dead"], ["$", "odd"], ["$", "$defs", "unused"]],
}


def text(df):
    return df.select("dataset", F.array_join(schema_paths.path_text(F.col("path")), "/").alias("path"))


def seen_rows(spark, seen):
    rows = [(d, p) for d, paths in seen.items() for p in paths]
    return spark.createDataFrame(rows, "dataset string, path array<string>")


def test_nodes(spark):
    rows = schema_rows(spark, {"a": {"k/1": [1, {"x": None}], "": "t"}, "b": 5}).unionByName(
        spark.createDataFrame([("c", "{")], "dataset string, schema_json string"))
    got = {(r.dataset, tuple(r.ptr), r.kind, r.text) for r in schema_nodes.schema_nodes(rows).collect()}
    assert got == {
        ("a", (), "object", None), ("a", ("kk/1",), "array", None), ("a", ("kk/1", "i0"), "integer", "1"),
        ("a", ("kk/1", "i1"), "object", None), ("a", ("kk/1", "i1", "kx"), "null", None), ("a", ("k",), "string", "t"),
        ("b", (), "integer", "5"),
    }


def test_recursion_goes_as_far_as_the_data(spark):
    found = schema_nodes.observed_static_paths(schema_rows(spark, {"tree": TREE}), seen_rows(spark, SEEN))
    assert by_dataset(text(found), "path") == {"tree": {"$", "$/l", "$/l/r", "$/l/r/l", "$/l/r/l/l", "$/r"}}


def test_walks_agree_on_schemas_without_recursion(spark):
    """Along all prefixes that the other walk reports, both report the same."""
    rows = schema_rows(spark, {**SCHEMAS, "mixed": MIXED})
    for variant, close in (("closed", False), ("closed", True), ("explicit", False)):
        whole = schema_paths.static_paths(rows, variant, close)
        texts = F.transform(F.filter("path", lambda t: t.kind != "wild"), lambda t: F.when(t.kind == "any", "some").when(
            t.kind == "regex", "xa/b").otherwise(t.token))
        along = schema_nodes.observed_static_paths(rows, whole.select("dataset", texts.alias("path")), variant, close)
        assert sorted(map(str, text(along).collect())) == sorted(map(str, text(whole).collect()))


def test_only_schemas_with_references_need_the_data(spark):
    rows = schema_rows(spark, {**SCHEMAS, "tree": TREE, "mixed": MIXED})
    found = by_dataset(text(schema_paths.static_paths(rows, observed=seen_rows(spark, SEEN))), "path")
    assert found["T7"] == {"$", "$/types/<any>", "$/types/<any>/symbol"} and len(found["tree"]) == 6
    assert found["mixed"] == {
        "$/list/*", "$/list/*/q", "$/when/t", "$/when", "$/any", "$/any/<any>/z", "$/re/<regex>^a/b",
        "$/re/<regex>^a/b/<any>/z"}


def big(n):
    leaf = {"type": "object", "properties": {"q": {"type": "object", **CLOSED}}}
    return {"big": {"type": "object", "properties": {f"p{i}": leaf for i in range(n)}}}


def test_costs_grow_with_the_size_of_a_schema(spark):
    """2,000 properties of two levels: the square of the size took 20 s and more."""
    def both(rows):
        closed = schema_rewrite.close_schema(rows).first().schema_json
        return schema_paths.static_paths(rows).count(), len(json.loads(closed)["properties"]), closed.count("false")

    both(schema_rows(spark, big(10)))
    rows = schema_rows(spark, big(2000))
    started = time.perf_counter()
    assert both(rows) == (2000, 2000, 4001)
    assert time.perf_counter() - started < 10
