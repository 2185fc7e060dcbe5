"""Validation against a plain validator on random schemas and documents, and cases that must not pass silently."""

import json
import random
import re

import pytest

from keyloom.operators import validate
from tests.fixtures import document_rows

KINDS = {str: "string", bool: "boolean", int: "integer", float: "number", type(None): "null", list: "array", dict: "object"}


def equal(a, b):
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a == b
    if type(a) is not type(b):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(map(equal, a, b))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(equal(a[k], b[k]) for k in a)
    return a == b


def valid(v, s, root, beside):
    """Whether value ``v`` satisfies schema ``s``: the keywords of the specification, one after the other."""
    if isinstance(s, bool):
        return s
    if "$ref" in s:
        target = root
        for k in s["$ref"].lstrip("#/").split("/"):
            target = target[k]
        if not valid(v, target, root, beside):
            return False
        if not beside:
            return True
    ok = lambda x, t: valid(x, t, root, beside)
    kind = KINDS[type(v)]
    types = s.get("type", kind)
    types = [types] if isinstance(types, str) else types
    if not (kind in types or (kind == "integer" and "number" in types) or (kind == "number" and v == int(v) and "integer" in types)):
        return False
    if "enum" in s and not any(equal(v, e) for e in s["enum"]) or "const" in s and not equal(v, s["const"]):
        return False
    if kind in ("integer", "number"):
        low, high = s.get("exclusiveMinimum"), s.get("exclusiveMaximum")
        low, high = (s.get("minimum") if low is True else low), (s.get("maximum") if high is True else high)
        if v < s.get("minimum", v) or v > s.get("maximum", v) or (low is not None and v <= low) or (high is not None and v >= high):
            return False
        if "multipleOf" in s and v / s["multipleOf"] != v // s["multipleOf"]:
            return False
    if kind == "string":
        if not s.get("minLength", 0) <= len(v) <= s.get("maxLength", 99) or not re.search(s.get("pattern", ""), v):
            return False
    if kind == "array":
        if not s.get("minItems", 0) <= len(v) <= s.get("maxItems", 99):
            return False
        if s.get("uniqueItems") and any(equal(a, b) for i, a in enumerate(v) for b in v[:i]):
            return False
        heads, rest = s.get("prefixItems", []), s.get("items", True)
        if isinstance(rest, list):
            heads, rest = rest, s.get("additionalItems", True)
        if not all(ok(x, heads[i] if i < len(heads) else rest) for i, x in enumerate(v)):
            return False
    if kind == "object":
        if any(k not in v for k in s.get("required", [])) or not s.get("minProperties", 0) <= len(v) <= s.get("maxProperties", 99):
            return False
        if any(k in v and any(n not in v for n in needed) for k, needed in s.get("dependentRequired", {}).items()):
            return False
        for k, x in v.items():
            own = [t for n, t in s.get("properties", {}).items() if n == k]
            own += [t for p, t in s.get("patternProperties", {}).items() if re.search(p, k)]
            if not all(ok(x, t) for t in own or [s.get("additionalProperties", True)]):
                return False
    if not all(ok(v, t) for t in s.get("allOf", [])) or "anyOf" in s and not any(ok(v, t) for t in s["anyOf"]):
        return False
    if "oneOf" in s and sum(ok(v, t) for t in s["oneOf"]) != 1 or "not" in s and ok(v, s["not"]):
        return False
    return "if" not in s or ok(v, s.get("then" if ok(v, s["if"]) else "else", True))


KEYS = ["a", "b", "c", "*", "1"]


def some_value(rng, depth):
    kind = rng.randrange(7 if depth else 4)
    if kind < 4:
        return rng.choice([0, 1, 2, 2.0, 3.5, -1, True, False, None, "", "a", "ab", "xyz"])
    if kind == 4:
        return [some_value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {k: some_value(rng, depth - 1) for k in rng.sample(KEYS, rng.randrange(4))}


def some_schema(rng, depth):
    if rng.random() < 0.06:
        return rng.random() < 0.5
    deeper = lambda: some_schema(rng, depth - 1)
    plain = {
        "type": lambda: rng.choice(["object", "array", "string", "integer", "number", ["object", "integer"], ["string", "null", "array"]]),
        "enum": lambda: [some_value(rng, 1) for _ in range(6)], "const": lambda: some_value(rng, 1), "minimum": lambda: rng.randrange(3),
        "exclusiveMaximum": lambda: 2, "multipleOf": lambda: rng.choice([2, 0.5]), "minLength": lambda: 1, "pattern": lambda: "^a",
        "minItems": lambda: 1, "maxItems": lambda: 2, "uniqueItems": lambda: True, "required": lambda: [rng.choice(KEYS)],
        "maxProperties": lambda: 2, "dependentRequired": lambda: {"a": ["b"]}, "additionalProperties": lambda: False,
    }
    nested = {
        "properties": lambda: {k: deeper() for k in rng.sample(KEYS, 2)}, "patternProperties": lambda: {"^[ab]": deeper()},
        "additionalProperties": deeper, "items": deeper, "prefixItems": lambda: [deeper(), deeper()],
        "allOf": lambda: [deeper(), deeper()], "anyOf": lambda: [deeper(), deeper()], "oneOf": lambda: [deeper(), deeper(), deeper()],
        "not": deeper, "if": deeper, "then": deeper, "else": deeper,
    }
    out = {k: plain[k]() for k in rng.sample(sorted(plain), rng.choice([0, 1, 1]))}
    if depth:
        out |= {k: nested[k]() for k in rng.sample(sorted(nested), rng.choice([1, 2, 3]))}
    if "if" not in out:
        out.pop("then", None), out.pop("else", None)
    return out


def rows_of(spark, schemas):
    return spark.createDataFrame([(f"d{i}", json.dumps(s)) for i, s in enumerate(schemas)], "dataset string, schema_json string")


def invalid_of(spark, schemas, documents):
    """Documents with a violation, and with something unchecked, for every schema."""
    docs = None
    for i in range(len(schemas)):
        own = document_rows(spark, [json.dumps(d) for d in documents], f"d{i}")
        docs = own if docs is None else docs.unionByName(own)
    bad = {(s, i): set() for s in ("violation", "unchecked") for i in range(len(schemas))}
    for r in validate.validate_documents(docs.coalesce(4), rows_of(spark, schemas)).collect():
        bad[r.status, int(r.dataset[1:])].add(r.doc_id)
    return bad


@pytest.mark.parametrize("seed", [1, 2])
def test_random_schemas(spark, seed):
    rng = random.Random(seed)
    schemas = [some_schema(rng, 3) for _ in range(60)]
    documents = [some_value(rng, 3) for _ in range(40)]
    bad = invalid_of(spark, schemas, documents)
    for i, s in enumerate(schemas):
        want = {n for n, d in enumerate(documents) if not valid(d, s, s, False)}
        assert (bad["violation", i], bad["unchecked", i]) == (want, set()), json.dumps(s)


CASES = [
    ({"properties": {"a": False}}, {"a": 1}, "violation"),
    ({"$ref": "http://host/other.json"}, {}, "unchecked"),
    ({"properties": {"a": {"$ref": "#/nope"}}}, {"a": 1}, "unchecked"),
    ({"$schema": "https://json-schema.org/draft/2020-12/schema", "$ref": "#/$defs/n", "$defs": {"n": {}}, "maximum": 3}, 5, "violation"),
    ({"$schema": "http://json-schema.org/draft-07/schema#", "$ref": "#/$defs/n", "$defs": {"n": {}}, "maximum": 3}, 5, None),
    ({"$schema": "http://json-schema.org/draft-04/schema#", "minimum": 5, "exclusiveMinimum": True}, 5, "violation"),
    ({"additionalProperties": {"type": "string"}}, {"*": 1}, "violation"),
    ({"items": {"type": "string"}}, {"*": 1}, None),
    ({"enum": [{"x": 1}]}, {"y": 2}, "violation"),
    ({"enum": [{"x": 1.0, "y": [1.50, "1.0"]}]}, {"y": [1.5, "1.0"], "x": 1}, None),
    ({"enum": [{"y": "1.0"}]}, {"y": "1"}, "violation"),
    ({"const": [1]}, [2], "violation"),
    ({"uniqueItems": True}, [{"a": 1, "b": 2}, {"b": 2, "a": 1.0}], "violation"),
    ({"items": [{"type": "integer"}], "additionalItems": False}, [1, 2], "violation"),
    ({"prefixItems": [{}, {"type": "string"}], "items": {"type": "null"}}, [1, "x", None, 4], "violation"),
    ({"not": {"propertyNames": {}}}, {"a": 1}, "unchecked"),
    ({"anyOf": [{"propertyNames": {}}, {"type": "object"}]}, {"a": 1}, None),
    ({"anyOf": [{"propertyNames": {}}, {"type": "null"}]}, {"a": 1}, "unchecked"),
    ({"items": {"oneOf": [{"required": ["a"]}, {"required": ["b"]}]}}, [{"a": 1}, {"a": 1, "b": 1}], "violation"),
    ({"items": {"oneOf": [{"required": ["a"]}, {"required": ["b"]}]}}, [{"a": 1}, {"b": 1}], None),
    (False, 1, "violation"),
    (True, 1, None),
]


def test_nothing_passes_silently(spark):
    schemas = [s for s, _, _ in CASES]
    docs = spark.createDataFrame([(f"d{i}", 0, json.dumps(d)) for i, (_, d, _) in enumerate(CASES)], "dataset string, doc_id long, json string")
    got = {int(r.dataset[1:]): r.status for r in validate.validate_documents(docs, rows_of(spark, schemas)).collect()}
    assert {i: got.get(i) for i in range(len(CASES))} == {i: s for i, (_, _, s) in enumerate(CASES)}


def test_recursion_is_followed_as_deep_as_the_data(spark):
    schema = {"$ref": "#/d/n", "d": {"n": {"properties": {"n": {"$ref": "#/d/n"}, "v": {"type": "integer"}}}}}
    deep, wrong = {"v": 1}, {"v": "x"}
    for _ in range(45):
        deep, wrong = {"n": deep}, {"n": wrong}
    bad = invalid_of(spark, [schema], [deep, wrong])
    assert (bad["violation", 0], bad["unchecked", 0]) == ({1}, set())


def test_values_deeper_than_all_constraints_are_not_opened(spark, monkeypatch):
    asked = []
    whole = validate.flatten_json
    monkeypatch.setattr(validate, "flatten_json", lambda *a, **k: asked.append(k.get("reach")) or whole(*a, **k))
    schema = {"properties": {"a": {"items": [{"type": "string"}, {"maximum": 3}], "additionalItems": {"type": "null"}}},
              "patternProperties": {"^x": {"additionalProperties": {"type": "integer"}}}}
    schemas = spark.createDataFrame([("g", json.dumps(schema))], "dataset string, schema_json string")
    documents = [{"a": [{"deep": [[[1]]]}, 4, 5, None], "xy": {"k": {"far": {"away": 1}}, "m": 2}}, {"a": ["s", 3], "y": {"k": "s"}}]
    got = validate.validate_documents(document_rows(spark, documents), schemas)
    assert sorted((r.doc_id, r.path, r.keyword) for r in got.collect()) == [
        (0, "$/a/*", "maximum"), (0, "$/a/*", "type"), (0, "$/a/*", "type"), (0, "$/xy/k", "type"),
    ]
    assert asked == [2]  # steps below the root of the longest constraint
