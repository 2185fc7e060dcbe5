"""Joins, samples, validation, nested schemas, files and streams."""

import json
import pathlib
import uuid

import pytest
from pyspark.sql import functions as F

from keyloom.functions import json_values as J
from keyloom.operators import flatten, joins, metrics, nest, profile, sampling, validate
from keyloom.session import materialize, shared_dir
from keyloom.sources import documents, features, files, schemas
from keyloom.streaming import documents as streaming
from tests.fixtures import document_rows, schema_rows


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_returns_what_the_broadcast_returns(spark, how):
    big = spark.range(500).select((F.col("id") % 7).alias("k"), "id", F.expr("parse_json('1')").alias("v"))
    small = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c")], "k bigint, x string")
    ways = [joins.sized_join(big, small, ["k"], how, fits).drop("v") for fits in (True, False)]
    first, second = (sorted(map(tuple, w.collect()), key=str) for w in ways)
    assert first == second


def test_metrics(spark):
    scored = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 1), (1, 1)], "label int, pred int")
    rows = {r["class"]: r for r in metrics.classification_report(scored).collect()}
    assert rows["1"].f1 == pytest.approx(2 / 3) and rows["0"].f1 == 0.5
    assert rows["weighted"].f1 == pytest.approx(0.6) and rows["weighted"].accuracy == pytest.approx(0.6)


@pytest.mark.parametrize("minority,expected", [(2, 5), (7, 7)])
def test_oversample(spark, minority, expected):
    rows = spark.range(10 + minority).select("id", F.when(F.col("id") < 10, 0).otherwise(1).alias("label"))
    counts = {r.label: r["count"] for r in sampling.oversample(rows, "id").groupBy("label").count().collect()}
    assert counts == {0: 10, 1: expected}


def test_group_split_is_disjoint(spark):
    names = [f"{g}{i}" for g in ("aaaa", "bbbb", "cccc", "dddd", "eeee") for i in range(4)]
    rows = sampling.group_split(spark.createDataFrame([(n,) for n in names], "dataset string")).collect()
    sides = {}
    for r in rows:
        sides.setdefault(r.split, set()).add(r.dataset[:4])
    assert len(rows) == 20 and len(sides["train"]) == 4 and len(sides["test"]) == 1
    assert not sides["train"] & sides["test"]


def test_validation(spark):
    schema = {"type": "object", "required": ["n"], "additionalProperties": False, "propertyNames": {}, "properties": {
        "n": {"type": "integer", "minimum": 2}, "s": {"enum": ["x", 1]},
        "l": {"type": "array", "minItems": 1, "items": {"type": "string", "pattern": "^a"}},
        "o": {"properties": {"q": {}}, "patternProperties": {"^p": {"type": "null"}},
              "additionalProperties": {"type": "boolean"}}}}
    docs = document_rows(spark, [
        {"n": 3, "s": 1.0, "l": ["ab"], "o": {"q": 1, "p1": None, "r": True}},
        {"n": 1, "s": "y", "l": ["b", 3], "o": {"p1": 5, "r": 7}}, {"k": 1}, [], "{", {"n": 2.5, "l": []}, {"n": 2.0}])
    rows = validate.validate_documents(docs, schema_rows(spark, {"g": schema}))
    bad = {(r.doc_id, r.path, r.keyword) for r in rows.filter("status = 'violation'").collect()}
    assert bad == {
        (1, "$/n", "minimum"), (1, "$/s", "enum"), (1, "$/l/*", "pattern"), (1, "$/l/*", "type"),
        (1, "$/o/p1", "type"), (1, "$/o/r", "type"), (2, "$", "required"), (2, "$", "additionalProperties"),
        (3, "$", "type"), (4, "$", "parse"), (5, "$/n", "type"), (5, "$/l", "minItems")}
    counts = validate.invalid_count(rows).first()
    assert (counts.invalid_docs, counts.unchecked_docs) == (5, 6)


def test_nested_schema_text_and_size(spark):
    docs = document_rows(spark, [{"d": {"p1": {"é": 1}, "p2": {"é": "s"}}, "l": [{"k": None}], "z": 1}])
    keys = materialize(profile.key_frequency(flatten.flatten_json(flatten.document_items(docs))), "keys")
    leaf = {"type": ["object"], "properties": {"é": {"type": ["integer"]}}}
    other = {"type": ["object"], "properties": {"é": {"type": ["string"]}}}
    listed = {"type": ["array"], "properties": {"*": {"type": "object", "properties": {"k": {"type": ["null"]}}}}}

    def root(d):
        return {"type": "object", "properties": {"$": {"type": "object", "properties": {
            "d": d, "l": listed, "z": {"type": ["integer"]}}}}}

    dynamic = spark.createDataFrame([("g", ["$", "d"])], "dataset string, path array<string>")
    expected = {
        None: root({"type": ["object"], "properties": {"p1": leaf, "p2": other}}),
        False: root({"type": ["object"], "additionalProperties": {"type": ["object"]}}),
        True: root({"type": ["object"], "properties": {
            "p1": {"additionalProperties": {"type": ["object"]}, "properties": leaf["properties"]},
            "p2": {"additionalProperties": {"type": ["object"]}, "properties": other["properties"]}}}),
    }
    for keep_keys, schema in expected.items():
        nodes = nest.nest_schema(keys) if keep_keys is None else nest.nest_schema(keys, dynamic, keep_keys)
        lines = nest.schema_lines(nodes)
        text = nest.schema_text(lines).first().schema_json
        assert text == json.dumps(schema, indent=2)
        assert nest.schema_kb(lines).first().bytes == len(text.encode())
        assert "\n".join(r.line for r in nest.ordered_lines(lines).collect()) == text


def test_files(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_bytes(b'\xef\xbb\xbf{"x":1}\n{"x":\n')
    (source / "b.json").write_text('{"y":1}\n')
    (source / "c.json").write_text("")
    docs = documents.read_json_lines(spark, str(source))
    counts = {r.dataset: (r.documents, r.bad_documents) for r in documents.bad_record_policy(docs, "count").collect()}
    assert counts == {"a.json": (2, 1), "b.json": (1, 0)}
    assert documents.bad_record_policy(docs, "drop").count() == 2
    with pytest.raises(Exception, match="not JSON"):
        documents.bad_record_policy(docs, "fail").collect()
    listed = spark.createDataFrame([("a.json",), ("c.json",), ("d.json",)], "dataset string")
    flags = schemas.dataset_inventory(listed, schemas.data_files(spark, str(source)))
    assert {r.dataset: (r.exist, r["empty"]) for r in flags.collect()} == {
        "a.json": (0, 0), "c.json": (0, 1), "d.json": (1, 0)}
    read = {r.dataset: r.loaded for r in schemas.read_schemas(spark, str(source)).collect()}
    assert read["b.json"] is True and read["a.json"] is False
    table = spark.createDataFrame(
        [(["$", "a;b"], {"k": 'quote"'}, 1.5)], "path array<string>, m map<string,string>, x double")
    features.write_features(table, str(tmp_path / "csv"), fmt="csv")
    assert features.read_features(spark, str(tmp_path / "csv"), table.schema, fmt="csv").collect() == table.collect()


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text('{"x":{"y":[1]}}\n{"x":2}\n')
    (source / "b.json").write_text('{"x":1}\n')
    keys = streaming.stream_key_frequency(streaming.stream_json_lines(spark, str(source), max_files=1))
    name = f"stream-{uuid.uuid4().hex}"  # a stream goes on where an earlier one of that name ended
    run = streaming.write_key_frequency(keys, name).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = spark.read.parquet(f"{shared_dir(spark)}/{name}").collect()
    batch = flatten.document_items(documents.read_json_lines(spark, str(source)))
    want = profile.key_frequency(flatten.flatten_json(batch, include_root=True)).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_types_of_mask(spark):
    row = spark.range(1).select(J.types_of_mask(F.lit(0b1000101)).alias("t")).first()
    assert row.t == ["array", "integer", "string"]


def test_stream_deltas_count_a_repeated_batch_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text('{"x":{"y":[1]}}\n{"x":2}\n')
    (source / "b.json").write_text('{"x":1}\n{"x":"t","z":{}}\n')
    name = f"deltas-{uuid.uuid4().hex}"
    docs = streaming.stream_json_lines(spark, str(source), max_files=1)
    streaming.write_key_deltas(docs, name).trigger(availableNow=True).start().awaitTermination(120)
    batch = flatten.document_items(documents.read_json_lines(spark, str(source)))
    want = sorted(map(str, profile.key_frequency(flatten.flatten_json(batch, include_root=True)).collect()))
    assert sorted(map(str, streaming.read_key_deltas(spark, name).collect())) == want
    # The last batch was computed but not noted as done: it runs again.
    notes = pathlib.Path(f"{shared_dir(spark)}/{name}-checkpoint/commits")
    for file in [notes / "1", notes / ".1.crc"]:
        file.unlink(missing_ok=True)
    streaming.write_key_deltas(docs, name).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(map(str, streaming.read_key_deltas(spark, name).collect())) == want


def test_listing_and_row_files(spark, tmp_path):
    rows = spark.createDataFrame([("a.json", "{}"), ("b/c.json", ""), (None, "x"), ("é.json", None)], "n string, t string")
    files.write_row_files(rows, f"file:{tmp_path}/out")
    files.write_row_files(rows, f"{tmp_path}/out")
    found = {r.path: r.length for r in files.list_files(spark, f"{tmp_path}/out", 3).collect()}
    assert found == {"a.json": 2, "b%2Fc.json": 0, "é.json": 0}
    (tmp_path / "out" / "dataset=x y.json" / "deep").mkdir(parents=True)
    (tmp_path / "out" / "dataset=x y.json" / "deep" / "part-0").write_text("123")
    sizes = {r.dataset: r.length for r in schemas.data_files(spark, f"{tmp_path}/out").collect()}
    assert sizes["x y.json"] == 3 and sizes["a.json"] == 2
    assert files.list_files(spark, str(tmp_path / "out"), 1).count() == 4
