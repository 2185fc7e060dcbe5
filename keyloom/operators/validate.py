"""Documents against JSON Schema, as a join of document values with schema constraints.

A schema becomes rows of constraints, each with the data path it applies to; a document becomes
rows of values. Both meet by equality on the closed steps of the path, as in labelling, so each
value meets only its own constraints and no document is ever gathered. What stands in a branch of
anyOf, oneOf, not, if, then or else does not count by itself: its violations are added up per branch
and place in the document, innermost branches first, and decide there what the keyword says.

Checked: type, required, additionalProperties false, enum, const, minimum, maximum,
exclusiveMinimum, exclusiveMaximum, multipleOf, minLength, maxLength, pattern, minItems, maxItems,
uniqueItems, minProperties, maxProperties, dependentRequired, through properties, patternProperties,
additionalProperties, items, prefixItems, additionalItems, allOf, anyOf, oneOf, not, if, references and
boolean schemas. Other keywords, and references that lead nowhere, are reported as ``unchecked`` where
a document reaches them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions import json_values as J
from keyloom.functions.descend import ITEM, MEMBER
from keyloom.functions.schema_walk import (
    BRANCH,
    MAX_PATH_LENGTH,
    STATE,
    at,
    entries,
    has,
    items,
    step,
    token,
    walk,
)
from keyloom.functions.segments import engine_patterns, search
from keyloom.operators.flatten import flatten_json
from keyloom.operators.joins import BROADCAST_BYTES, measured_bytes, sized_join
from keyloom.operators.schema_nodes import with_reference_flag
from keyloom.session import materialize, prepared
from keyloom.sources.schemas import draft_version

# Keywords with a number to compare with.
LIMITS = [
    "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength",
    "minItems", "maxItems", "minProperties", "maxProperties",
]
# Keywords whose effect is not checked.
UNCHECKED = [
    "contains", "dependencies", "dependentSchemas", "propertyNames", "unevaluatedProperties", "unevaluatedItems",
]
# The drafts in which keywords beside a reference count.
BESIDE_REFERENCES = ["2020-12", "2019-09"]

# What a schema that is the literal false becomes, so that it can be walked like any other.
NEVER = '{"$never":true}'
COMBINES = "combines:"
OPEN = ["any", "regex"]

CONSTRAINT = (
    "struct<path:array<struct<kind:string,token:string,names:array<string>,patterns:array<string>>>,"
    "keyword:string,names:array<string>,patterns:array<string>,limit:double,"
    f"allowed:array<struct<kind:string,text:string>>,scope:array<{BRANCH}>,own:string>"
)


def _names(x: Column, keyword: str) -> Column:
    return F.transform(entries(x, keyword), lambda e: e.key)


def _schema(v: Column) -> Column:
    """A sub-schema as an object: ``false`` allows nothing; ``true`` and other values are no schemas to follow."""
    return F.when(J.is_false(v), F.parse_json(F.lit(NEVER))).otherwise(v)


def _one(x: Column, keyword: str) -> Column:
    """The keyword's value in an array of one if it is a schema, else an empty array."""
    value = at(x, keyword)
    return F.when(J.is_object(value) | J.is_false(value), F.array(_schema(value))).otherwise(J.empty("array<variant>"))


def _index(low: Column, high: Column | str = "") -> Column:
    """Step to the items from one position to another one."""
    last = F.lit(high) if isinstance(high, str) else high.cast("string")
    return token("index", F.concat(low.cast("string"), F.lit("-"), last))


def _id(s: Column, keyword: str) -> Column:
    """Name of a combining keyword. Equal ones at one place of the data decide alike, so they may share it."""
    return F.concat(F.lit(keyword + ":"), F.md5(F.to_json(s.x)))


def _children(s: Column) -> Column:
    other = token("any", F.lit("*"), _names(s.x, "properties"), _names(s.x, "patternProperties"))
    schema_extra = F.filter(_one(s.x, "additionalProperties"), lambda v: ~has(v, "$never"))

    def branch(keyword, number):
        entry = F.struct(_id(s, keyword).alias("id"), number.alias("branch"), F.size(s.path).alias("depth"))
        return F.array_append(s.scope, entry)

    def listed(keyword):
        return F.transform(
            items(s.x, keyword), lambda v, i: step(s, None, _schema(v), scope=branch(keyword, i))
        )

    def conditional(keyword, number, word):
        return F.transform(_one(s.x, word), lambda v: step(s, None, v, scope=branch(keyword, F.lit(number))))

    tuples = F.size(items(s.x, "prefixItems"))
    listing = F.size(items(s.x, "items"))
    no_states = J.empty(f"array<{STATE}>")
    further = F.when(
        J.is_array(at(s.x, "items")), F.transform(_one(s.x, "additionalItems"), lambda v: step(s, _index(listing), v)).cast(f"array<{STATE}>")
    ).otherwise(no_states)
    choices = F.when(has(s.x, "if"), F.concat(
        conditional("if", 0, "if"), conditional("if", 1, "then"), conditional("if", 2, "else")
    ).cast(f"array<{STATE}>")).otherwise(no_states)
    return F.concat(
        F.transform(entries(s.x, "properties"), lambda e: step(s, token("key", e.key), _schema(e.value))),
        F.transform(entries(s.x, "patternProperties"), lambda e: step(s, token("regex", e.key), _schema(e.value))),
        F.transform(schema_extra, lambda v: step(s, other, v)),
        F.transform(_one(s.x, "items"), lambda v: step(s, _index(tuples), v)),
        F.transform(items(s.x, "prefixItems"), lambda v, i: step(s, _index(i, i), _schema(v))),
        F.transform(items(s.x, "items"), lambda v, i: step(s, _index(i, i), _schema(v))),
        further,
        F.transform(items(s.x, "allOf"), lambda v: step(s, None, _schema(v))),
        listed("anyOf"),
        listed("oneOf"),
        conditional("not", 0, "not"),
        choices,
    )


def _kind(v: Column) -> Column:
    name = J.json_type(v)
    return F.when(name == "integer", "number").otherwise(name)


def _constraints(s: Column) -> Column:
    """What schema ``s`` itself demands, as an array of constraint structs."""
    none = J.empty(f"array<{CONSTRAINT}>")
    no_names = F.lit(None).cast("array<string>")
    no_allowed = F.lit(None).cast("array<struct<kind:string,text:string>>")

    def made(keyword, names=None, patterns=None, limit=None, allowed=None, own=None):
        return F.struct(
            s.path.alias("path"),
            (F.lit(keyword) if isinstance(keyword, str) else keyword).alias("keyword"),
            (no_names if names is None else names).alias("names"),
            (no_names if patterns is None else patterns).alias("patterns"),
            (F.lit(None) if limit is None else limit).cast("double").alias("limit"),
            (no_allowed if allowed is None else allowed).alias("allowed"),
            s.scope.alias("scope"),
            (F.lit(None).cast("string") if own is None else own).alias("own"),
        )

    def one(condition, *args, **more):
        return F.when(condition, F.array(made(*args, **more)).cast(f"array<{CONSTRAINT}>")).otherwise(none)

    def texts(keyword):
        return F.transform(items(s.x, keyword), lambda v: F.try_variant_get(v, "$", "string"))

    def values(listed):
        return F.transform(listed, lambda v: F.struct(
            _kind(v).alias("kind"),
            F.when(_kind(v).isin("object", "array"), J.canonical(v)).otherwise(F.try_variant_get(v, "$", "string")).alias("text"),
        ))

    def combining(keyword):
        return one(F.size(items(s.x, keyword)) > 0, COMBINES + keyword, limit=F.size(items(s.x, keyword)), own=_id(s, keyword))

    one_type = J.string_value(at(s.x, "type"))
    type_names = F.when(one_type.isNotNull(), F.array(one_type)).otherwise(texts("type"))
    pattern = J.string_value(at(s.x, "pattern"))
    parts = [
        one(has(s.x, "$never"), "false"),
        one(has(s.x, "$dead"), "unchecked:$ref"),
        one(F.size(type_names) > 0, "type", names=type_names),
        one(F.size(items(s.x, "required")) > 0, "required", names=texts("required")),
        one(
            J.is_false(at(s.x, "additionalProperties")), "additionalProperties",
            names=_names(s.x, "properties"), patterns=_names(s.x, "patternProperties"),
        ),
        one(J.is_array(at(s.x, "enum")), "enum", allowed=values(items(s.x, "enum"))),
        one(has(s.x, "const"), "const", allowed=values(F.array(at(s.x, "const")))),
        one(pattern.isNotNull(), "pattern", patterns=F.array(pattern)),
        one(J.is_true(at(s.x, "uniqueItems")), "uniqueItems"),
        combining("anyOf"),
        combining("oneOf"),
        one(has(s.x, "not"), COMBINES + "not", own=_id(s, "not")),
        one(has(s.x, "if"), COMBINES + "if", own=_id(s, "if")),
    ]
    # In the oldest drafts the exclusive limits are flags beside the limits.
    def limit_of(k):
        plain = F.when(_kind(at(s.x, k)) == "number", F.try_variant_get(at(s.x, k), "$", "double"))
        other = {"exclusiveMinimum": "minimum", "exclusiveMaximum": "maximum"}.get(k)
        if other is None:
            return plain
        flagged = F.when(_kind(at(s.x, other)) == "number", F.try_variant_get(at(s.x, other), "$", "double"))
        return F.when(J.is_true(at(s.x, k)), flagged).otherwise(plain)

    limits = F.array(*[F.struct(F.lit(k).alias("keyword"), limit_of(k).alias("limit")) for k in LIMITS])
    numeric = F.transform(
        F.filter(limits, lambda k: k.limit.isNotNull()), lambda k: made(k.keyword, limit=k.limit)
    ).cast(f"array<{CONSTRAINT}>")
    needed = F.transform(
        entries(s.x, "dependentRequired"),
        lambda e: made("dependentRequired", names=F.concat(F.array(e.key), F.coalesce(
            F.try_variant_get(e.value, "$", "array<string>"), J.empty("array<string>")))),
    ).cast(f"array<{CONSTRAINT}>")
    skipped = F.transform(
        F.filter(F.array(*[F.when(has(s.x, k), F.lit(k)) for k in UNCHECKED]), lambda k: k.isNotNull()),
        lambda k: made(F.concat(F.lit("unchecked:"), k)),
    ).cast(f"array<{CONSTRAINT}>")
    return F.concat(*parts, numeric, needed, skipped)


def schema_constraints(schemas: DataFrame, max_path_length: int = MAX_PATH_LENGTH) -> DataFrame:
    """One row per constraint: dataset, path, keyword, what it compares with, and the branches it stands in.

    A schema that is the literal false allows nothing. In drafts from 2019-09 on, what stands beside a reference counts.
    """
    x = F.col("x")
    parsed = schemas.select(
        "dataset", draft_version(F.col("schema_json")).isin(*BESIDE_REFERENCES).alias("beside"),
        _schema(J.parse(F.col("schema_json"))).alias("x"),
    )
    found = prepared(
        ("constraints", max_path_length),
        lambda: walk(x, _children, _constraints, max_path_length, F.col("beside"), mark_dead=True),
    )
    rows = parsed.filter(J.is_object(x)).select("dataset", F.inline(found))
    return rows.distinct()


def _runnable(constraints: DataFrame) -> DataFrame:
    """Constraints with patterns the engine can run; those with others become unchecked."""
    steps = F.transform("path", lambda t: F.when(t.kind == "regex", t.token))
    around = F.flatten(F.transform("path", lambda t: F.coalesce(t.patterns, J.empty("array<string>"))))
    written = constraints.withColumn("_steps", engine_patterns(steps)).withColumn("_own", engine_patterns("patterns"))
    written = written.withColumn("_around", engine_patterns(around))
    step_lost = F.exists(
        F.zip_with("path", "_steps", lambda t, p: (t.kind == "regex") & p.isNull()), lambda bad: bad
    )
    lost = step_lost | F.exists("_own", lambda p: p.isNull()) | F.exists("_around", lambda p: p.isNull())
    lost = F.coalesce(lost, F.lit(False))
    before = lambda i: F.size(F.flatten(F.transform(
        F.slice("path", 1, i), lambda t: F.coalesce(t.patterns, J.empty("array<string>"))
    )))
    path = F.transform("path", lambda t, i: F.struct(
        F.when(lost & (t.kind == "regex"), F.lit("any")).otherwise(t.kind).alias("kind"),
        F.coalesce(F.get("_steps", i), t.token).alias("token"),
        t.names.alias("names"),
        F.when(lost | t.patterns.isNull(), J.empty("array<string>")).otherwise(
            F.slice("_around", before(i) + 1, F.size(t.patterns))
        ).alias("patterns"),
    ))
    keyword = F.when(lost & ~F.startswith("keyword", F.lit("unchecked:")) & ~F.startswith("keyword", F.lit(COMBINES)), F.concat(F.lit("unchecked:"), "keyword"))
    return written.withColumn("path", path).withColumn("keyword", F.coalesce(keyword, "keyword")).withColumn(
        "patterns", F.when(~lost, F.col("_own"))
    ).drop("_steps", "_own", "_around")


def _tested_steps() -> Column:
    """Steps of a constraint that are still open when a value meets it, each with its place; limits of positions are read once."""
    ends = lambda t: F.split(t.token, "-")
    placed = F.transform("path", lambda t, i: F.struct(
        i.alias("at"), t.kind.alias("kind"), t.token.alias("token"), t.names.alias("names"), t.patterns.alias("patterns"),
        F.when(t.kind == "index", F.get(ends(t), F.lit(0)).cast("long")).alias("low"),
        F.when((t.kind == "index") & (F.get(ends(t), F.lit(1)) != ""), F.get(ends(t), F.lit(1)).try_cast("long")).alias("high"),
    ))
    return F.filter(placed, lambda t: t.kind.isin(*OPEN, "index"))


def _step_fits(t: Column) -> Column:
    """Whether the value's step at the place of ``t`` is one that ``t`` means."""
    p = F.get("inst", t.at)
    name = F.substring(p, 2, 1 << 30)
    is_member = F.startswith(p, F.lit(MEMBER))
    declared = F.array_contains(t.names, name) | F.exists(t.patterns, lambda r: search(name, r))
    place = name.try_cast("long")
    return (
        F.when(t.kind == "index", (place >= t.low) & (t.high.isNull() | (place <= t.high)))
        .when(t.kind == "any", is_member & ~declared)
        .otherwise(is_member & search(name, t.token))
    )


def _violated() -> Column:
    """Whether the value of a joined row breaks the constraint next to it."""
    kw, names, limit = F.col("keyword"), F.col("names"), F.col("limit")
    kind, size, text = F.col("json_type"), F.col("size"), F.col("scalar")
    number = F.when(kind.isin("integer", "number"), text.try_cast("double"))
    whole = (kind == "number") & (number == F.floor(number))
    type_ok = (
        F.array_contains(names, kind)
        | ((kind == "integer") & F.array_contains(names, "number"))
        | (whole & F.array_contains(names, "integer"))
    )
    members = F.col("members")
    lacks = F.size(F.array_except(names, members)) > 0
    triggered = F.array_contains(members, F.get(names, 0))
    undeclared = F.array_except(members, names)
    extra = F.exists(undeclared, lambda m: ~F.exists("patterns", lambda p: search(m, p)))
    value_kind = F.when(kind == "integer", "number").otherwise(kind)
    listed = F.exists(
        "allowed",
        lambda a: (a.kind == value_kind)
        & F.when(value_kind == "number", a.text.try_cast("double") == number)
        .when(value_kind == "null", F.lit(True))
        .when(value_kind.isin("object", "array"), a.text == F.col("canonical"))
        .otherwise(a.text == text),
    )
    is_text, is_list, is_obj = kind == "string", kind == "array", kind == "object"
    broken = (
        F.when(kw == "type", ~type_ok)
        .when(kw == "false", F.lit(True))
        .when(kw == "parse", kind.isNull())
        .when(kw == "required", is_obj & lacks)
        .when(kw == "dependentRequired", is_obj & triggered & lacks)
        .when(kw == "additionalProperties", is_obj & extra)
        .when(kw.isin("enum", "const"), ~listed)
        .when(kw == "minimum", number < limit)
        .when(kw == "maximum", number > limit)
        .when(kw == "exclusiveMinimum", number <= limit)
        .when(kw == "exclusiveMaximum", number >= limit)
        .when(kw == "multipleOf", (limit > 0) & (number / limit != F.floor(number / limit)))
        .when(kw == "minLength", is_text & (F.length(text) < limit))
        .when(kw == "maxLength", is_text & (F.length(text) > limit))
        .when(kw == "pattern", is_text & ~search(text, F.get("patterns", 0)))
        .when(kw == "minItems", is_list & (size < limit))
        .when(kw == "maxItems", is_list & (size > limit))
        .when(kw == "uniqueItems", is_list & F.col("repeats"))
        .when(kw == "minProperties", is_obj & (size < limit))
        .when(kw == "maxProperties", is_obj & (size > limit))
    )
    return F.when(kind.isNull(), kw == "parse").otherwise(F.coalesce(broken, F.lit(False)))


def validate_documents(docs: DataFrame, schemas: DataFrame, json_col: str = "json") -> DataFrame:
    """Violations of each document: dataset, doc_id, path, keyword, status.

    ``status`` is ``violation``, or ``unchecked`` where a value reaches a keyword that is not
    checked and could decide. Text that is not JSON is one violation with keyword ``parse``. Documents of
    datasets without a schema are not looked at. What a branch of a combining keyword demands is
    reported as that keyword, at the value where it stands.
    """
    marked_schemas = with_reference_flag(schemas.select("dataset", "schema_json"))
    has_schema = marked_schemas.select("dataset").distinct()
    longest = MAX_PATH_LENGTH
    parsed = docs.select("dataset", "doc_id", J.parse(F.col(json_col)).alias("doc"))
    referring = marked_schemas.where("refs").select("dataset")
    if not referring.isEmpty():  # how deep the data is bounds the walk through recursive references
        seen = flatten_json(parsed.join(referring, "dataset", "left_semi").select("dataset", "doc"))
        longest = int(seen.agg(F.max(F.size("path"))).first()[0] or 1)
    root = F.array(token("key", F.lit("$")))
    lines = has_schema.select("dataset", F.inline(F.array(F.struct(
        root.alias("path"), F.lit("parse").alias("keyword"), F.lit(None).cast("array<string>").alias("names"),
        F.lit(None).cast("array<string>").alias("patterns"), F.lit(None).cast("double").alias("limit"),
        F.lit(None).cast("array<struct<kind:string,text:string>>").alias("allowed"),
        J.empty(f"array<{BRANCH}>").alias("scope"), F.lit(None).cast("string").alias("own"),
    ))))
    constraints = _runnable(schema_constraints(marked_schemas.drop("refs"), longest).unionByName(lines)).select(
        "*",
        F.transform("path", lambda t: t.kind.isin(*OPEN)).alias("mask"),
        F.transform("path", lambda t: F.when(t.kind.isin(*OPEN), "").when(t.kind == "index", ITEM).otherwise(
            F.concat(F.lit(MEMBER), t.token))).alias("fixed"),
        # Steps that are plain names have been compared when a value meets the constraint.
        _tested_steps().alias("steps"),
    ).drop("path")
    constraints = materialize(constraints, "constraints")
    fits = measured_bytes(constraints) <= BROADCAST_BYTES
    nested = F.max(F.size("scope") + F.startswith("keyword", F.lit(COMBINES)).cast("int"))
    whole = F.exists("allowed", lambda a: a.kind.isin("object", "array")) | (F.col("keyword") == "uniqueItems")
    steps = F.max(F.size("mask")) - 1  # no value deeper than that meets a constraint
    deepest, comparing, reach = constraints.agg(nested, F.bool_or(F.coalesce(whole, F.lit(False))), steps).first()
    marked, compared = parsed, None
    if comparing:
        marks = constraints.where(whole).select("dataset", F.lit(True).alias("_compared")).distinct()
        marked, compared = sized_join(parsed, marks, ["dataset"], "left", fits), "_compared"
    masks = constraints.select("dataset", "mask", F.size("mask").alias("length"), F.exists("mask", lambda m: m).alias("blanks")).distinct()
    values = flatten_json(marked, include_root=True, with_values=True, places=True, compared=compared, reach=reach or 0)
    if not comparing:
        values = values.withColumn("canonical", F.lit(None).cast("string")).withColumn("repeats", F.lit(None).cast("boolean"))
    values = values.select(
        "dataset", "doc_id", F.col("path").alias("inst"), "json_type", "size", "scalar", "members", "canonical", "repeats",
        F.size("path").alias("length"),
    )
    # The steps without positions are the same for all masks of a value, and most masks blank none.
    closed = F.when(F.exists("inst", lambda p: F.startswith(p, F.lit(ITEM))), F.transform(
        "inst", lambda p: F.when(F.startswith(p, F.lit(ITEM)), F.lit(ITEM)).otherwise(p)
    )).otherwise(F.col("inst"))
    shaped = sized_join(values.withColumn("closed", closed), masks, ["dataset", "length"], "inner", fits).withColumn("fixed", F.when(
        F.col("blanks"), F.zip_with("closed", "mask", lambda p, m: F.when(m, F.lit("")).otherwise(p))
    ).otherwise(F.col("closed"))).drop("closed", "blanks")
    met = sized_join(shaped, constraints, ["dataset", "mask", "fixed"], "inner", fits)
    applies = (F.size("steps") == 0) | F.forall("steps", _step_fits)
    unchecked, combines = F.startswith("keyword", F.lit("unchecked:")), F.startswith("keyword", F.lit(COMBINES))
    holds = F.col("json_type").isNotNull() & (unchecked | combines)
    hits = met.filter(applies).filter(holds | _violated()).select(
        "dataset", "doc_id", "inst", "keyword", "scope", "own", "limit",
        F.when(unchecked, "unchecked").when(~combines, "violation").alias("status"),
    )
    if deepest:
        hits = _decided(materialize(hits, "hits"), deepest)
    shown = F.transform("inst", lambda p: F.when(F.startswith(p, F.lit(ITEM)), "*").otherwise(F.substring(p, 2, 1 << 30)))
    return hits.select(
        "dataset", "doc_id", F.array_join(shown, "/").alias("path"),
        F.regexp_replace("keyword", "^(unchecked|combines):", "").alias("keyword"), "status",
    )


def _decided(hits: DataFrame, deepest: int) -> DataFrame:
    """What remains of ``hits`` when all branches have been decided, innermost first: rows without a scope.

    Per keyword, place and branch one row says whether the branch is broken, or may be. The place is the value at which the
    keyword stands, so each round is one aggregation by (document, keyword, place) and one join.
    """
    key = ["dataset", "doc_id", "own", "place", "outer"]
    facts = hits.where("status IS NOT NULL").select("dataset", "doc_id", "inst", "keyword", "scope", "status")
    standing = hits.where("status IS NULL")
    done = facts.where(F.size("scope") == 0)
    raised = facts.limit(0)
    for depth in range(deepest, 0, -1):
        here = facts.where(F.size("scope") == depth).unionByName(raised.where(F.size("scope") == depth))
        last = F.element_at("scope", -1)
        broken, unsure = F.col("status") == "violation", F.col("status") == "unchecked"
        per_branch = here.select(
            "dataset", "doc_id", last["id"].alias("own"), last["branch"].alias("branch"),
            F.slice("inst", F.lit(1), last["depth"]).alias("place"), F.slice("scope", 1, depth - 1).alias("outer"), "status",
        ).groupBy(*key, "branch").agg(F.bool_or(broken).alias("bad"), F.bool_or(unsure).alias("unsure"))
        per_place = per_branch.groupBy(*key).agg(
            F.count_if("bad").alias("n_bad"), F.count_if(~F.col("bad") & F.col("unsure")).alias("n_unsure"),
            *[F.bool_or((F.col("branch") == i) & F.col("bad")).alias(f"bad{i}") for i in range(3)],
            *[F.bool_or((F.col("branch") == i) & F.col("unsure")).alias(f"unsure{i}") for i in range(3)],
        )
        stand = standing.where(F.size("scope") == depth - 1).select(
            "dataset", "doc_id", "own", F.col("inst").alias("place"), F.col("scope").alias("outer"), "keyword", "limit"
        )
        joined = stand.join(per_place, key, "left").fillna(0, ["n_bad", "n_unsure"]).fillna(
            False, [f"{w}{i}" for w in ("bad", "unsure") for i in range(3)]
        )
        verdict = joined.withColumn("status", _verdict()).where("status IS NOT NULL").select(
            "dataset", "doc_id", F.col("place").alias("inst"), "keyword", F.col("outer").alias("scope"), "status"
        )
        raised = materialize(verdict, "verdicts")
        done = done.unionByName(raised.where(F.size("scope") == 0))
    return done


def _verdict() -> Column:
    """``violation``, ``unchecked`` or NULL (satisfied) of a combining keyword, from its branches."""
    kw, n, bad, unsure = F.col("keyword"), F.col("limit"), F.col("n_bad"), F.col("n_unsure")
    good = n - bad - unsure
    violation, unchecked = F.lit("violation"), F.lit("unchecked")
    any_of = F.when(bad == n, violation).when((good == 0) & (unsure > 0), unchecked)
    one_of = F.when(good > 1, violation).when(unsure > 0, unchecked).when(good != 1, violation)
    not_ = F.when(bad > 0, F.lit(None)).when(unsure > 0, unchecked).otherwise(violation)

    def side(i):
        return F.when(F.col(f"bad{i}"), violation).when(F.col(f"unsure{i}"), unchecked)

    either = F.coalesce(side(1), side(2)).isNotNull()
    if_ = F.when(F.col("bad0"), side(2)).when(F.col("unsure0"), F.when(either, unchecked)).otherwise(side(1))
    return (
        F.when(kw == COMBINES + "anyOf", any_of)
        .when(kw == COMBINES + "oneOf", one_of)
        .when(kw == COMBINES + "not", not_)
        .when(kw == COMBINES + "if", if_)
    )


def invalid_count(violations: DataFrame) -> DataFrame:
    """Documents with a violation, and documents with something unchecked, per dataset."""
    per_doc = violations.groupBy("dataset", "doc_id").agg(
        F.bool_or(F.col("status") == "violation").alias("bad"),
        F.bool_or(F.col("status") == "unchecked").alias("open"),
    )
    return per_doc.groupBy("dataset").agg(
        F.count_if("bad").alias("invalid_docs"), F.count_if("open").alias("unchecked_docs")
    )


def choose_schema(originals: DataFrame, closed: DataFrame, invalid: DataFrame, trust_unchecked: bool = False) -> DataFrame:
    """The closed schema where all documents satisfy it, else the original.

    Adds ``validation``: 1 where documents broke the closed schema. A dataset with unchecked values
    keeps its original schema too, unless ``trust_unchecked``.
    """
    counts = invalid.select("dataset", "invalid_docs", "unchecked_docs")
    joined = (
        originals.select("dataset", F.col("schema_json").alias("_original"))
        .join(closed.select("dataset", F.col("schema_json").alias("_closed")), "dataset")
        .join(counts, "dataset", "left")
    )
    invalid_docs = F.coalesce("invalid_docs", F.lit(0))
    open_docs = F.lit(0) if trust_unchecked else F.coalesce("unchecked_docs", F.lit(0))
    return joined.select(
        "dataset",
        F.when((invalid_docs == 0) & (open_docs == 0), F.col("_closed")).otherwise(F.col("_original")).alias("schema_json"),
        F.when(invalid_docs > 0, 1).otherwise(0).alias("validation"),
    )


def curation_funnel(flags: DataFrame) -> DataFrame:
    """Datasets left after each check: one row per step in order.

    ``flags`` has one row per dataset with 0/1 columns exist, empty, loaded, dereferenced, modified
    and validation. A dataset fails only the first check it meets; ``modified`` is reported apart.
    """
    filled = F.col("empty") == 0
    c = flags.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum("exist").alias("exist"),
        F.sum("empty").alias("empty"),
        F.sum("loaded").alias("loaded"),
        F.sum(F.when(filled, F.col("dereferenced")).otherwise(0)).alias("dereferenced"),
        F.sum("validation").alias("validation"),
        F.sum(F.when(filled, F.col("modified")).otherwise(0)).alias("modified"),
    )
    left = F.col("total")
    rows = [("original", left)]
    for name in ("exist", "empty", "loaded", "dereferenced", "validation"):
        left = left - F.col(name)
        rows.append((name, left))
    rows.append(("modified_failures", F.col("modified")))
    return c.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(n).alias("check"), v.cast("bigint").alias("datasets"))
        for i, (n, v) in enumerate(rows)
    ])))
