import json

import pytest
from pyspark.sql import functions as F

from keyloom.functions import json_values as J
from keyloom.operators import classify, flatten, labels, matching, profile, schema_paths, similarity, text_classifier
from keyloom.plans import features
from keyloom.session import materialize
from tests.fixtures import document_rows, schema_rows

SCHEMA = {"properties": {"a": {"type": "object", "additionalProperties": False}, "l": {}}}
DOCS = [{"a": {"x": 1, "y": "s"}}, {"a": {"x": 2}, "l": [{"k": 1}, {"k": None}]}, {"zzz": 1}, 5]


def brute_force(value, path=("$",)):
    """Path rows of one document, straight from the definition."""
    pairs = value.items() if isinstance(value, dict) else [("*", v) for v in value]
    for key, below in pairs:
        yield path + (key,)
        if isinstance(below, (dict, list)):
            yield from brute_force(below, path + (key,))


def paths_of(rows):
    return sorted(tuple(r.path) for r in rows.select("path").collect())


def test_golden_profile_and_labels(spark):
    table = features.feature_table(document_rows(spark, DOCS), schema_rows(spark, {"g": SCHEMA}))
    found = {"/".join(r.path): r for r in table.collect()}
    assert set(found) == {"$", "$/a", "$/l/*"}
    for path, total, types, entropy, label in [
        ("$", 3, 1, 0.664831, 1), ("$/a", 3, 1, 0.664831, 0), ("$/l/*", 2, 0, 0.346574, 1)
    ]:
        row = found[path]
        assert (row.parent_frequency, row.datatype_entropy, row.label) == (total, types, label)
        assert round(row.key_entropy, 6) == entropy and row.depth_level == "shallow"
    assert found["$/l/*"].semantic_similarity == 1.0


def test_occurrence_sums_to_one_and_types_are_sorted(spark):
    items = matching.match_properties(
        flatten.document_items(document_rows(spark, DOCS)), schema_rows(spark, {"g": SCHEMA}))
    keys = profile.key_frequency(flatten.flatten_json(items))
    rows = profile.with_types(profile.occurrence(keys)).collect()
    sums = {}
    for r in rows:
        sums[tuple(r.parent_path)] = sums.get(tuple(r.parent_path), 0) + r.occurrence
    assert all(abs(s - 1) < 1e-12 for s in sums.values())
    assert {r.key: r.types for r in rows}["k"] == ["integer", "null"]


def test_jxplain_entropy(spark):
    docs = document_rows(spark, DOCS[:2]).select("dataset", J.parse(F.col("json")).alias("doc"))
    keys = materialize(profile.key_frequency(
        flatten.flatten_json(docs, descend_arrays=False, include_root=True)), "keys")
    rows = profile.jxplain_profile(keys, profile.num_docs(keys)).collect()
    assert {"/".join(r.path): round(r.key_entropy, 6) for r in rows} == {"$": 0.346574, "$/a": 0.346574}


def test_any_depth_and_wide_documents(spark):
    deep = {"v": 1}
    for level in range(30):
        deep = {f"k{level}": [deep, level]} if level % 3 == 0 else {f"k{level}": deep, "n": [[]]}
    wide = {f"id{i}": {"x": [i, {"y": "z" * 20}], "e": {}} for i in range(1500)}
    documents = [deep, wide, {"a": {"b": {}}}, {}]
    assert len(json.dumps(wide)) > flatten.WIDE_CHARS
    items = flatten.document_items(document_rows(spark, documents))
    assert items.filter("wide").count() == 1
    expected = sorted(p for d in documents for p in brute_force(d))
    assert paths_of(flatten.flatten_json(items)) == expected
    with_root = sorted(expected + [("$",)] * len(documents))
    assert paths_of(flatten.flatten_json(items, include_root=True)) == with_root


def test_max_depth_raises_on_deeper_values(spark):
    items = flatten.document_items(document_rows(spark, [{"a": {"b": {"c": 1}}}]))
    assert len(paths_of(flatten.flatten_json(items, max_depth=3))) == 3
    with pytest.raises(Exception, match="nested deeper"):
        flatten.flatten_json(items, max_depth=2).collect()


def test_json_types(spark):
    texts = ["1", "1.0", "1e3", "true", "null", '"a"', "[]", "{}", "12345678901234567890", '"1"', '{"a":1,"a":[]}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    found = [r[0] for r in rows.select(J.json_type(J.parse(F.col("t")))).collect()]
    assert found == ["integer", "number", "number", "boolean", "null", "string", "array", "object",
                     "integer", "string", "object"]
    depth = spark.createDataFrame([(3,), (4,), (6,), (7,)], "d int").select(J.depth_level(F.col("d"))).collect()
    assert [r[0] for r in depth] == ["shallow", "moderate", "moderate", "deep"]


def test_subkey_cap_and_packed_parts_keep_every_key(spark):
    docs = document_rows(spark, [{"m": {f"k{i:04d}": 1 for i in range(1200)}}])
    keys = materialize(profile.key_frequency(flatten.flatten_json(flatten.document_items(docs))), "keys")
    capped = {"/".join(r.path): r.distinct_subkeys for r in profile.distinct_subkeys(keys, cap=1000).collect()}
    assert capped["$/m"] == [f"k{i:04d}" for i in range(1000)]
    named = profile.distinct_subkeys(keys, keys_per_row=500).filter(F.size("path") == 2).collect()
    assert len(named) == 3
    assert sorted(k for p in named for k in p.distinct_subkeys) == [f"k{i:04d}" for i in range(1200)]
    parts = profile.packed_properties(keys, keys_per_row=500).filter(F.size("path") == 2).collect()
    assert len(parts) == 3
    assert sorted(k for p in parts for k in p.properties) == [f"k{i:04d}" for i in range(1200)]


def test_semantic_similarity(spark):
    rows = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("b", [0.0, 1.0])], "g string, vector array<double>")
    found = {r.g: r.semantic_similarity for r in similarity.semantic_similarity(rows, ["g"]).collect()}
    assert found == {"a": 1.0, "b": 0.5}


def test_label_matching_and_precedence(spark):
    observed = spark.createDataFrame(
        [("d", ["$", "ab1"]), ("d", ["$", "abz"]), ("d", ["$", "q", "r"]), ("d", ["$", "a"])],
        "dataset string, path array<string>")
    schema = {"properties": {"q": {"additionalProperties": {"additionalProperties": False}}},
              "patternProperties": {"[a-z]+\\d": {"additionalProperties": False}}}
    static = schema_paths.static_paths(schema_rows(spark, {"d": schema}))
    found = {"/".join(r.path): r.label for r in labels.label_paths(observed, static).collect()}
    assert found == {"$/ab1": 0, "$/abz": 1, "$/q/r": 0, "$/a": 1}

    observed = spark.createDataFrame(
        [("d", ["$", "o"]), ("d", ["$", "o", "p"]), ("d", ["$", "z"])], "dataset string, path array<string>")
    opened = {"properties": {"o": {"type": "object", "additionalProperties": True}}}
    static = schema_paths.static_paths(schema_rows(spark, {"d": opened}), "explicit")
    found = {"/".join(r.path): r.label for r in labels.label_paths(observed, static, "explicit").collect()}
    assert found == {"$/o": 1, "$/o/p": 0, "$/z": 1}


def test_entropy_rule_and_classifier(spark):
    rows = spark.createDataFrame([(1, 1.2), (1, 1.0), (0, 1.2)], "datatype_entropy int, key_entropy double")
    assert [r.pred for r in classify.entropy_rule(rows).collect()] == [1, 0, 0]
    assert [r.pred for r in classify.entropy_rule(rows, datatype=0).collect()] == [0, 0, 1]
    train = spark.createDataFrame([(float(i), int(i > 50)) for i in range(100)], "key_entropy double, label int")
    scored = classify.score(classify.fit_key_classifier(train, ["key_entropy"]), train)
    assert scored.filter("pred = label").count() >= 98


def test_text_classifier(spark):
    """Paths whose keys are numbers or dates are dynamic, those of field names static: parted by the keys' texts alone."""
    names = ["title", "createdAt", "user_name", "size", "height", "email", "status", "total"]

    def properties(i, dynamic, n):
        keys = [f"{2000 + i}-0{k % 9}-{k:03}" if i % 2 else f"{i * 7919 + k}" for k in range(n)]
        return {k: (0.5, ["int"]) for k in (keys if dynamic else [names[(i + j) % 8] for j in range(3)])}

    rows = []
    for i in range(200):
        dynamic = i % 4 < 2
        parts = 2 if i % 10 == 0 and dynamic else 1  # a path in several parts counts once
        for part in range(parts):
            rows.append(("d", ["$", f"p{i}"], part, (properties(i + part, dynamic, 3), "shallow", 0, 3, 0.5), int(dynamic)))
    rows += [("d", ["$", "none"], 0, (None, "shallow", None, None, None), None), ("d", ["$", "empty"], 0, ({}, "shallow", 0, 0, None), 0)]
    schema = ("dataset string, path array<string>, part int, schema struct<properties:map<string,struct<occurrence:double,type:"
              "array<string>>>,depth_level:string,datatype_entropy:int,num_nested_keys:bigint,semantic_similarity:double>, label int")
    described = spark.createDataFrame(rows, schema)
    found = {r.path[1]: r for r in text_classifier.text_features(described, 64).collect()}
    assert len(found) == 202 and found["none"]._buckets == [] and found["empty"].similarity == 0.0
    assert all(len(set(r._buckets)) == len(r._buckets) <= 64 for r in found.values())
    model, held_out = text_classifier.fit_text_classifier(described)
    result = held_out.collect()
    assert 20 <= len(result) <= 65 and all(r.pred == r.label for r in result)
    assert text_classifier.score(model, text_classifier.text_features(described.filter("1 = 0"))).count() == 0


def test_subkeys_ranked_and_dealt_out_as_all_of_them(spark):
    """Paths beyond the limit, paths below it, and a path without a dataset."""
    names = [f"k{i:03d}" for i in range(57)]
    rows = [(d, ["$", p], k, 1, 1) for d in ("a", None) for p, n in (("big", 57), ("small", 2)) for k in names[:n]]
    keys = spark.createDataFrame(rows, "dataset string, parent_path array<string>, key string, frequency long, type_mask int")
    capped = profile.distinct_subkeys(keys, cap=5, buckets=3)
    assert {(r.dataset, r.path[1]): r.distinct_subkeys for r in capped.collect()} == {
        (d, p): names[:n] for d in ("a", None) for p, n in (("big", 5), ("small", 2))
    }
    parts = profile.distinct_subkeys(keys, keys_per_row=10).filter("dataset = 'a'").collect()
    assert sorted(k for r in parts if r.path[1] == "big" for k in r.distinct_subkeys) == names
    assert [r.distinct_subkeys for r in parts if r.path[1] == "small"] == [names[:2]]
    assert len([r for r in parts if r.path[1] == "big"]) == 6


def test_only_keys_of_large_paths_are_ranked(spark):
    """The keys are read from what was written; windows see the paths beyond the cap only, over a broadcast join."""
    keys = spark.range(30).selectExpr(
        "'d' AS dataset", "array('$', CAST(id % 3 AS STRING)) AS parent_path", "CAST(id AS STRING) AS key", "1L AS frequency", "1 AS type_mask")
    capped = profile.distinct_subkeys(keys, cap=20)
    plan = capped._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan and "LeftSemi" in plan and "LeftAnti" in plan
    assert sum(len(r.distinct_subkeys) for r in capped.collect()) == 30


def test_tasks_follow_the_rows_of_a_table(spark, tmp_path, monkeypatch):
    from workload import inputs

    spark.range(1000).selectExpr("id AS o_orderkey", "id AS o_custkey", "'F' AS o_orderstatus", "1.5 AS o_totalprice",
                                 "'1' AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(inputs, "ROWS_PER_TASK", 20)
    docs = inputs.derive(spark, str(tmp_path), inputs.ORDER_DOCS)
    assert docs.rdd.getNumPartitions() == 50 and docs.count() == 1000


def test_a_text_is_parsed_once(spark):
    docs = document_rows(spark, [{"a": 1}]).select(J.parse(F.col("json")).alias("doc"))
    assert docs._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_no_filter_repeats_what_the_document_pass_works_out(spark):
    rows = flatten.flatten_json(flatten.document_items(document_rows(spark, [{"a": {"b": [1]}}])))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter (" in line and "variant" in line]
