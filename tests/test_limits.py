"""Inputs beyond the usual: fragments of JSON, deep and self-referring schemas, odd patterns, NULL names, hot keys."""

import json
import re

import pytest
from pyspark.sql import functions as F

from keyloom.functions import json_values as J
from keyloom.functions.segments import engine_pattern
from keyloom.operators import flatten, labels, nest, profile, sampling, schema_paths, schema_rewrite, similarity, text_classifier, validate
from keyloom.session import materialize, release, work_dir
from tests.fixtures import document_rows


def parsed(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    return [r[0] for r in rows.select(J.parse(F.col("t")).isNotNull()).collect()]


def test_only_one_whole_value_is_json(spark):
    bad = ['1,"v":2', '{"a":1},"k":{"b":2}', "1],[2", '{"a":1} more', "", "  ", None, '1,"x"', "1]", '{"a":1}}', '1,"~end":0', "[1"]
    good = ["1", " [1, 2] ", '{"a":"]"}', '"x\\"y"', "null"]
    assert parsed(spark, bad) == [False] * len(bad)
    assert parsed(spark, good) == [True] * len(good)


def deep_schema(levels):
    schema = {"type": "object", "additionalProperties": False, "properties": {}}
    for i in range(levels):
        schema = {"type": "object", "properties": {f"k{i}": schema}}
    return schema


def test_schemas_are_followed_to_their_end(spark):
    rows = spark.createDataFrame([("a", json.dumps(deep_schema(40)))], "dataset string, schema_json string")
    found = schema_paths.static_paths(rows).collect()
    assert [len(r.path) for r in found] == [41]
    document = {"x": 1}
    for i in range(40):
        document = {f"k{i}": document}
    docs = spark.createDataFrame([("a", 1, json.dumps(document))], "dataset string, doc_id long, json string")
    assert [r.keyword for r in validate.validate_documents(docs, rows).collect()] == ["additionalProperties"]


def test_chains_of_references_are_replaced(spark):
    d = {"a": {"$ref": "#/d/b"}, "b": {"$ref": "#/d/c"}, "c": {"$ref": "#/d/e"}, "e": {"type": "string"}}
    schemas = [
        ("chain", {"properties": {"q": {"$ref": "#/d/a"}}, "d": d}),
        ("root", {"$ref": "#/d/a", "title": "t", "d": d}),
        ("lost", {"$ref": "#/d/none", "d": {"x": {"$ref": "#/d/x"}}}),
    ]
    rows = spark.createDataFrame([(n, json.dumps(s)) for n, s in schemas], "dataset string, schema_json string")
    found = {r.dataset: r for r in schema_rewrite.dereference(rows).collect()}
    chain, root = json.loads(found["chain"].schema_json), json.loads(found["root"].schema_json)
    assert chain["properties"] == {"q": {"type": "string"}} and found["chain"].dereferenced == 0
    assert root["type"] == "string" and root["title"] == "t" and "$ref" not in root and found["root"].dereferenced == 0
    assert found["lost"].dereferenced == 1


@pytest.mark.parametrize("pattern, text, hit", [
    ("^[a-z]{,3}$", "abc", True), ("^[a-z]{,3}$", "abcd", False), ("{id}", "{id}", True), (r"[^\W\d_]", "_", False),
    (r"(?P<a_b>x)(?P=a_b)", "xx", True), (r"\Ax\Z", "x", True), ("a|bc", "bc", True), (r"[\]\-&&[]", "&", True), ("(?i)ab", "AB", True),
    (r"\d{2,}?x", "12x", True), (r"[^\s]", " ", False), (r"\u00e9", "é", True),
])
def test_patterns_run_in_the_engine(spark, pattern, text, hit):
    import re

    assert (re.search(pattern, text) is not None) == hit
    row = spark.createDataFrame([(text, engine_pattern(pattern))], "t string, p string")
    assert row.select(F.regexp_like("t", "p")).first()[0] == hit


def test_no_pattern_ends_a_job(spark):
    odd = ["{id}", "^[a-z]{,3}$", "a(", "[a", "(?<=x)y", "*"]
    static = [("d", [("key", "$"), ("regex", p)]) for p in odd] + [("d", [("key", "$"), ("regex", "ok.*")])]
    static = spark.createDataFrame(static, "dataset string, path array<struct<kind:string,token:string>>")
    seen = spark.createDataFrame([("d", ["$", k]) for k in ("{id}", "abc", "a(", "okay", "zzzz")], "dataset string, path array<string>")
    got = {r.path[1]: r.label for r in labels.label_paths(seen, static, "closed").collect()}
    assert got == {"{id}": 0, "abc": 0, "a(": 1, "okay": 0, "zzzz": 1}
    assert {r.pattern for r in labels.invalid_patterns(static).collect()} == {"a(", "[a", "(?<=x)y", "*"}
    plain = spark.createDataFrame([("d", ["$", p]) for p in odd], "dataset string, path array<string>")
    assert {r.path[1]: r.label for r in labels.label_paths(seen, plain, "pattern").collect()}["a("] == 1
    assert ["$", "a("] in [r.path for r in labels.matched_by_segments(seen, plain).collect()]
    schema = {"type": "object", "patternProperties": {"a(": {"type": "string"}}, "additionalProperties": False}
    schemas = spark.createDataFrame([("d", json.dumps(schema))], "dataset string, schema_json string")
    docs = spark.createDataFrame([("d", 1, '{"b":1}')], "dataset string, doc_id long, json string")
    assert {r.status for r in validate.validate_documents(docs, schemas).collect()} == {"unchecked"}


def test_rows_without_a_name_stay_in_a_split(spark):
    rows = spark.createDataFrame([("abcd1", 1), (None, 2), ("", 3), ("wxyz", 4)], "dataset string, v int")
    for split in (sampling.group_split(rows, train_ratio=0.5), sampling.name_split(rows, test_size=0.5)):
        assert sorted(r.v for r in split.collect()) == [1, 2, 3, 4]


def test_schema_text_keeps_all_datasets(spark):
    keys = spark.createDataFrame(
        [(f"d{i}", ["$"], f"k{j:03}", 1, 1 << 2) for i in range(2) for j in range(40 if i else 3)],
        "dataset string, parent_path array<string>, key string, frequency long, type_mask int",
    )
    lines = materialize(nest.schema_lines(nest.nest_schema(keys)), "lines")
    whole = {r.dataset: r.schema_json for r in nest.schema_text(lines).collect()}
    parts = sorted(nest.schema_text(lines, max_bytes=400).collect())
    assert {r.dataset for r in parts} == {"d0", "d1"} and len(parts) > 2
    for name, text in whole.items():
        own = [r for r in parts if r.dataset == name]
        assert [r.part for r in own] == list(range(len(own)))
        assert "\n".join(r.schema_json for r in own) == text


def test_a_hot_path_is_collected_by_many_tasks(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = spark.range(1_000_000).selectExpr(
            "'d' AS dataset", "array('$') AS parent_path", "concat('k', id) AS key", "1L AS frequency", "4 AS type_mask"
        )
        packed = profile.packed_properties(keys)
        assert packed.select(F.sum(F.size("properties"))).first()[0] == 1_000_000
        assert packed.count() == 100
        marks = keys.select("dataset", F.array(F.lit("$")).alias("path")).distinct()
        assert nest.type_union(keys, marks).count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_release_removes_the_tables(spark, tmp_path):
    import os

    materialize(spark.range(3), "x")
    folder = work_dir(spark).removeprefix("file:")
    assert os.path.isdir(folder)
    release(spark)
    assert not os.path.isdir(folder)


def test_many_patterns_of_one_dataset(spark):
    """100,000 pattern paths: literal steps meet by equality, the others in rows of bounded length."""
    number = F.col("id").cast("string")
    last = F.when(F.col("id") % 1000 == 0, F.concat(F.lit("x"), number, F.lit("[ab]+"))).otherwise(F.concat(F.lit("k"), number))
    patterns = spark.range(100_000).select(F.lit("d").alias("dataset"), F.array(F.lit("$"), F.lit("root"), last).alias("path"))
    rows = [("d", ["$", "root", s]) for s in ("k1", "k99999", "k99999z", "x3000ab", "x3000c", "x3001a", "other")]
    observed = spark.createDataFrame([*rows, ("e", ["$", "root", "k1"])], "dataset string, path array<string>")
    full = {r.path[2] for r in labels.matched_by_segments(observed, patterns).collect()}
    assert full == {"k1", "k99999", "x3000ab"}
    marked = {(r.dataset, r.path[2]): r.label for r in labels.label_paths(observed, patterns, "pattern").collect()}
    assert {k for k, v in marked.items() if v} == {("d", s) for s in ("k1", "k99999", "k99999z", "x3000ab")}


@pytest.mark.parametrize("mode", ["fullmatch_or_eq", "prefix"])
def test_text_paths_equal_step_by_step_comparison(spark, mode):
    steps = ["a", "ab", "a.", "(", "", "b+", "A", "a b", "é"]
    names = ["a", "ab", "abc", "(", "", "bb", "A", "a b", "é", "éa", "a."]
    texts = spark.createDataFrame([("d", [x, y]) for x in steps for y in steps], "dataset string, path array<string>")
    observed = spark.createDataFrame([("d", [x, y]) for x in names for y in names], "dataset string, path array<string>")

    def fits(name, step):
        if name == step:
            return True
        try:
            return bool((re.fullmatch if mode == "fullmatch_or_eq" else re.match)(step, name))
        except re.error:
            return False

    want = {(x, y) for x in names for y in names if any(fits(x, p) and fits(y, q) for p in steps for q in steps)}
    if mode == "prefix":
        texts = texts.filter("path[0] != '' AND path[1] != ''")
        want = {(x, y) for x in names for y in names if any(fits(x, p) and fits(y, q) for p in steps for q in steps if p and q)}
    got = {tuple(r.path) for r in labels._matched_texts(observed, texts, mode).collect()}
    assert got == want


def test_ranks_take_more_digits_for_more_rows(spark, monkeypatch):
    rows = spark.range(500).withColumn("h", sampling.seeded_hash(3, F.col("id")))
    want = [r.id for r in rows.orderBy("h", "id").collect()]
    monkeypatch.setattr(sampling, "ROWS_IN_BUCKET", 2)
    ranked = sampling.ranked_by_hash(rows, "h", "id", total="n").collect()
    assert [r.id for r in sorted(ranked, key=lambda r: r["rank"])] == want
    assert {r.n for r in ranked} == {500}


def test_type_codes_tell_every_json_type(spark):
    """One small number per value is carried through the document pass, not a struct with the engine's type name."""
    texts = ['{}', '{"_":1}', '[]', '[1]', '[{"a":[2]},"x",null]', '"x"', 'true', 'null', '1', '-0', '1.0', '1.5', '1e3', '1e400', '9' * 18,
             '9' * 19, '9' * 38, '9' * 39, '0.' + '1' * 37, '12345678901234567890.5']
    rows = spark.createDataFrame([(t,) for t in texts], "json string").withColumn("v", F.parse_json("json"))
    types = J.json_type_of_code(J.type_code(F.col("v")))
    expected = F.when(J.object_map(F.col("v")).isNotNull(), "object").when(J.array_items(F.col("v")).isNotNull(), "array").otherwise(
        J.json_type_name(F.schema_of_variant("v")))
    told = rows.select("json", types.alias("told"), expected.alias("expected"), J.json_type(F.col("v")).alias("named")).collect()
    assert all(r.told == r.expected == r.named and r.told in J.JSON_TYPES for r in told), told
    no_value = spark.range(1).select(J.json_type_of_code(J.type_code(F.try_parse_json(F.lit("{")))))
    assert no_value.first()[0] is None
    docs = spark.createDataFrame([("d", '{"a":[{"b":1},2.5],"c":{}}')], "dataset string, json string")
    plain = flatten.flatten_json(flatten.document_items(docs))
    valued = flatten.flatten_json(flatten.document_items(docs), with_values=True)
    both = ["path", "is_index", "json_type"]
    assert sorted(plain.select(*both).collect()) == sorted(valued.select(*both).collect())
    assert "raw_type" not in plain._jdf.queryExecution().optimizedPlan().toString()


def test_ngrams_of_a_key_are_counted_once(spark):
    keys = spark.createDataFrame([("qty",), ("qty",), ("aaaaaa",), (None,)], "key string")
    vectors = similarity.key_vectors(keys)
    assert "Join" not in vectors._jdf.queryExecution().optimizedPlan().toString()
    found = {r.key: r.coordinates for r in vectors.collect()}
    assert set(found) == {"qty", "aaaaaa"}
    for coordinates in found.values():
        assert sum(c.is_first for c in coordinates) == 1 and abs(sum(c.value**2 for c in coordinates) - 1) < 1e-12


def test_text_features_are_worked_out_once(spark, monkeypatch):
    calls = []
    whole = text_classifier.text_features
    monkeypatch.setattr(text_classifier, "text_features", lambda *a, **k: calls.append(1) or whole(*a, **k))
    property_ = {"occurrence": 0.5, "type": ["string"]}
    schema = lambda i: ({f"k{i}": property_}, 1 + i % 2, 0, 0.1 * (i % 2))
    described = spark.createDataFrame(
        [("d", ["$", f"p{i}"], 0, i % 2, schema(i)) for i in range(30)],
        "dataset string, path array<string>, part int, label int, schema struct<properties:map<string,struct<occurrence:double,"
        "type:array<string>>>,num_nested_keys:int,datatype_entropy:int,semantic_similarity:double>",
    )
    featured = materialize(text_classifier.text_features(described), "featured")
    model, _ = text_classifier.fit_text_classifier(described, featured=featured)
    assert text_classifier.score(model, featured).count() == 30 and len(calls) == 1


def test_values_out_of_reach_are_not_opened(spark):
    deep = '{"a":[{"b":[[1,{"c":{}}]]},2.5],"t":"' + "x" * 40_000 + '"}'
    texts = ['{"a":[{"b":[[1,{"c":{"d":[{"e":[[{"f":[[7]]}]]}]}}]]},2.5],"c":{},"d":[]}', "{}", '[{"a":{"b":null}},{"a":1}]', deep]
    items = flatten.document_items(document_rows(spark, texts))
    for options in ({}, {"with_values": True, "places": True, "include_root": True}):
        whole = flatten.flatten_json(items, **options).collect()
        for reach in (0, 2, 9):
            bounded = flatten.flatten_json(items, reach=reach, **options)
            assert sorted(map(repr, bounded.collect())) == sorted(repr(r) for r in whole if len(r.path) <= reach + 1)
            assert bounded._jdf.queryExecution().optimizedPlan().toString().count("variant_explode") == min(reach, flatten.CHAIN_LEVELS)


def test_what_nobody_reads_of_a_value_is_not_carried(spark):
    docs = document_rows(spark, ['{"a":[{"b":1},2.5],"c":{"d":"x"}}', '{"a":[]}'])
    rows = flatten.flatten_json(flatten.document_items(docs), with_values=True)
    sizes = rows.groupBy("dataset").agg(F.sum("size").alias("size"))
    plan = sizes._jdf.queryExecution().optimizedPlan().toString()
    assert "_size3" in plan and "_scalar3" not in plan and "_members3" not in plan
    assert sizes.first()["size"] == 2 + 1 + 1
