import json

from pyspark.sql import functions as F

from keyloom.operators import schema_paths, schema_rewrite
from keyloom.sources import schemas as sources
from tests.fixtures import SCHEMAS, by_dataset, schema_rows


def text(df):
    return df.select("dataset", F.array_join(schema_paths.path_text(F.col("path")), "/").alias("path"))


def test_closed_paths(spark):
    found = by_dataset(text(schema_paths.static_paths(schema_rows(spark, SCHEMAS))), "path")
    assert found == {
        "T1": {"$", "$/address", "$/person"},
        "T2": {"$", "$/person"},
        "T3": {"$", "$/person"},
        "T4": {"$", "$/person"},
        "T5": {"$/address", "$/person"},
        "T6": {"$", "$/address", "$/person"},
        "T7": {"$", "$/types/<any>", "$/types/<any>/symbol"},
        "T8": {"$"},
    }


def test_explicit_paths(spark):
    found = by_dataset(text(schema_paths.static_paths(schema_rows(spark, SCHEMAS), "explicit")), "path")
    assert found["T1"] == {"$", "$/address", "$/person"}
    assert found["T2"] == found["T3"] == {"$", "$/address/<wild>", "$/person"}
    assert found["T4"] == {"$", "$/person"}
    assert found["T5"] == {"$/address", "$/person"}
    assert found["T7"] == {"$", "$/types", "$/types/symbol"}
    assert found["T8"] == {"$", "$/types/<wild>"}


def test_open_paths(spark):
    found = by_dataset(text(schema_paths.open_paths(schema_rows(spark, SCHEMAS))), "path")
    assert found == {
        "T2": {"$/address"}, "T3": {"$/address"}, "T4": {"$/address"}, "T5": {"$"},
        "T6": {"$/address"}, "T7": {"$/types"}, "T8": {"$/types"},
    }


def test_dynamic_parents_and_counts(spark):
    rows = schema_rows(spark, SCHEMAS)
    pointers = schema_paths.dynamic_parents(rows).select("dataset", F.array_join("pointer", "/").alias("p"))
    assert by_dataset(pointers, "p") == {
        "T6": {"properties/address"}, "T7": {"properties/types"}, "T8": {"properties/types"}
    }
    counts = {r.dataset: r.dynamic_keys for r in schema_paths.count_dynamic_keys(rows).collect()}
    assert counts == {"T1": 0, "T2": 0, "T3": 0, "T4": 0, "T5": 0, "T6": 1, "T7": 1, "T8": 1}


def test_recursive_reference_ends_at_the_longest_path(spark):
    schema = {"properties": {"a": {"$ref": "#/d/n"}}, "d": {
        "n": {"additionalProperties": False, "properties": {"next": {"$ref": "#/d/n"}}},
        "loop": {"$ref": "#/d/loop"}}, "anyOf": [{"$ref": "#/d/loop"}]}
    rows = schema_rows(spark, {"r": schema})
    found = by_dataset(text(schema_paths.static_paths(rows, max_path_length=4)), "path")
    assert found == {"r": {"$/a", "$/a/next", "$/a/next/next"}}


def test_close_and_dereference(spark):
    closed = {r.dataset: json.loads(r.schema_json)
              for r in schema_rewrite.close_schema(schema_rows(spark, SCHEMAS)).collect()}
    assert closed["T1"] == SCHEMAS["T1"]
    assert closed["T4"]["properties"]["address"]["additionalProperties"] is False
    assert closed["T5"]["additionalProperties"] is False
    assert closed["T8"]["properties"]["types"]["additionalProperties"]["additionalProperties"] is False

    schema = {"$ref": "#/d/base", "title": "own", "properties": {"q": {"$ref": "#/d/leaf"}},
              "d": {"base": {"type": "object", "title": "base", "required": ["q"]},
                    "leaf": {"enum": [1, 1.5, 'a"é', None, True, [], {}]}}}
    remote = {"properties": {"q": {"$ref": "http://host/x"}}}
    rows = {r.dataset: r for r in schema_rewrite.dereference(schema_rows(spark, {"d": schema, "r": remote})).collect()}
    merged = json.loads(rows["d"].schema_json)
    assert merged["title"] == "own" and merged["required"] == ["q"] and merged["type"] == "object"
    assert merged["properties"]["q"] == schema["d"]["leaf"] and "$ref" not in merged
    assert (rows["d"].dereferenced, rows["r"].dereferenced) == (0, 1)


def test_draft_and_name(spark):
    rows = spark.createDataFrame(
        [("{}",), ('{"$schema":"http://json-schema.org/draft-04/schema#"}',),
         ('{"$schema":"https://json-schema.org/draft/2020-12/schema"}',)], "s string")
    assert [r[0] for r in rows.select(sources.draft_version(F.col("s"))).collect()] == ["draft7", "draft4", "2020-12"]
    urls = spark.createDataFrame([("http://h/a/b.yaml",), ("http://h/a/c.json",)], "u string")
    assert [r[0] for r in urls.select(sources.schema_name_from_url(F.col("u"))).collect()] == ["b.json", "c.json"]


def test_schemas_are_walked_once_each_and_not_per_row_they_come_from(spark):
    """A filter on what a walk finds reads the written result; it is not moved to the rows behind a distinct."""
    source = spark.range(50).selectExpr("concat('d', id % 2) AS dataset")
    text = F.when(F.col("dataset") == "d0", '{"patternProperties":{"^x":{}},"additionalProperties":false}').otherwise(
        '{"additionalProperties":false}')
    schemas = source.distinct().withColumn("schema_json", text).repartition(4)
    flags = schema_paths.has_pattern_properties(schemas).filter("has_pattern_properties")
    static = schema_paths.static_paths(schemas, "closed")
    assert [r.dataset for r in flags.collect()] == ["d0"]
    assert sorted(r.dataset for r in static.collect()) == ["d0", "d1"]
    for df in (flags, static):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Range" not in plan
