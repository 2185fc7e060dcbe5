"""JSON Schemas as a table of nodes, and walks over it by joins.

Every value inside a schema is a row with the pointer that leads to it. A walk keeps a table of states (schema node, data
path) and moves all of them one step at a time by a join with the edges that its rules read off the node table. Given the
paths that documents have, each step keeps only the states whose path begins an observed one, so a recursive schema is
followed exactly as far as the data goes, however it branches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions import json_values as J
from keyloom.functions.descend import ITEM, MEMBER, descend, item_step, member_step, nesting_depth
from keyloom.functions.schema_walk import ref_pointer
from keyloom.session import materialize

POINTED = "struct<ptr:array<string>,x:variant>"
NODE = ["dataset", "ptr"]


@dataclass(frozen=True)
class Rule:
    """Where a keyword leads: to its own value, or to the members or items of its value, and by which step of the path."""

    keyword: str
    below: str  # self, member or item
    step: str | None  # key, regex, any, index, or None where the data path stays
    needs: str | None = None  # a flag of the schema that has the keyword
    closable: bool = True  # whether what lies below is reached when schemas are closed


COMBINED = tuple(Rule(k, "item", None) for k in ("allOf", "anyOf", "oneOf"))
RULES = {
    "closed": (
        Rule("properties", "member", "key"), Rule("patternProperties", "member", "regex"),
        Rule("additionalProperties", "self", "any"), Rule("items", "self", "index"), Rule("items", "item", "index"),
        Rule("prefixItems", "item", "index", closable=False), *COMBINED,
        Rule("then", "self", None, "if_object"), Rule("else", "self", None, "if_object"),
    ),
    "explicit": (
        Rule("properties", "member", "key"), Rule("additionalProperties", "self", None),
        Rule("items", "self", "index", "is_array"), Rule("prefixItems", "item", "index", "is_array"), *COMBINED,
        Rule("then", "self", None),
    ),
}


def schema_nodes(schemas: DataFrame) -> DataFrame:
    """Every value of every schema: (dataset, ptr, kind, text), the root with an empty pointer.

    ``kind`` is the JSON type name and ``text`` a scalar's text. Schemas that are no JSON have no rows. One narrow step;
    the rows of a schema grow with its size.
    """

    def children(s):
        members = F.transform(F.map_entries(J.object_map(s["x"])), lambda e: F.struct(
            F.array_append(s["ptr"], member_step(e["key"])).alias("ptr"), e["value"].alias("x")))
        listed = F.transform(J.array_items(s["x"]), lambda v, i: F.struct(
            F.array_append(s["ptr"], item_step(i)).alias("ptr"), v.alias("x")))
        return F.coalesce(members, listed, J.empty(f"array<{POINTED}>"))

    x = F.col("x")
    root = F.array(F.struct(J.empty("array<string>").alias("ptr"), x.alias("x")))
    found = F.transform(descend(root, children, POINTED, nesting_depth(x) + 1), lambda s: F.struct(
        s["ptr"].alias("ptr"), J.json_type(s["x"]).alias("kind"), F.try_variant_get(s["x"], "$", "string").alias("text")))
    parsed = schemas.select("dataset", J.parse(F.col("schema_json")).alias("x")).where(x.isNotNull())
    rows = parsed.select("dataset", F.inline(found))
    scalar = ~F.col("kind").isin("object", "array")
    return rows.select("dataset", "ptr", "kind", F.when(scalar, F.col("text")).alias("text"))


def with_reference_flag(schemas: DataFrame) -> DataFrame:
    """``schemas`` with ``refs``: whether ``$ref`` is written anywhere in them. Written to the shared folder, as a filter on
    the flag would else be worked out for every row that the schemas are derived from."""
    text = F.to_json(J.parse(F.col("schema_json")))
    return materialize(schemas.withColumn("refs", F.coalesce(F.contains(text, F.lit('"$ref"')), F.lit(False))), "schemas")


def _last(n: int = 1) -> Column:
    return F.get("ptr", F.size("ptr") - n)


def _above(n: int) -> Column:
    return F.slice("ptr", F.lit(1), F.greatest(F.size("ptr") - n, F.lit(0)))


def schema_objects(nodes: DataFrame) -> DataFrame:
    """One row per object with what it declares: flags, the type, where its ``$ref`` points to."""

    def named(keyword: str, *kinds: str) -> Column:
        here = F.col("member") == MEMBER + keyword
        return here & F.col("kind").isin(*kinds) if kinds else here

    def any_of(condition: Column, name: str) -> Column:
        return F.coalesce(F.bool_or(condition), F.lit(False)).alias(name)

    extra, text = "additionalProperties", F.col("text")
    members = nodes.where(F.size("ptr") > 0).select("dataset", _above(1).alias("ptr"), _last().alias("member"), "kind", "text")
    flags = members.groupBy(*NODE).agg(
        any_of(named("$ref"), "has_ref"), F.max(F.when(named("$ref", "string"), text)).alias("ref"),
        any_of(named("type", "string") & (text == "object"), "is_object"), any_of(named("type", "string") & (text == "array"), "is_array"),
        any_of(named("if", "object"), "if_object"), any_of(named("properties"), "has_properties"),
        any_of(named("required"), "has_required"), any_of(named("patternProperties"), "has_patterns"),
        any_of(named(extra), "has_extra"), any_of(named(extra, "boolean") & (text == "false"), "extra_false"),
        any_of(named(extra, "boolean") & (text == "true"), "extra_true"), any_of(named(extra, "object"), "extra_object"),
    )
    names = [c for c in flags.columns if c not in (*NODE, "ref")]
    out = nodes.where(F.col("kind") == "object").select(*NODE).join(flags, NODE, "left")
    return out.select(*NODE, "ref", *[F.coalesce(n, F.lit(False)).alias(n) for n in names])


def resolved(objects: DataFrame) -> DataFrame:
    """(dataset, ptr, target) for every object whose reference ends at one without: chains are followed to their end.

    Pointers are followed through objects. References that lead nowhere, or around in a circle, have no row.
    """
    step = F.transform(ref_pointer(F.col("ref")), member_step)
    named = objects.where("ref IS NOT NULL").select(*NODE, step.alias("target"))
    plain = objects.select("dataset", F.col("ptr").alias("target"), F.col("has_ref").alias("more"))
    links = materialize(named.join(plain, ["dataset", "target"]), "schema-refs")
    # Each round doubles the steps that a chain is followed, so what is longer than all references goes in a circle.
    for _ in range(links.count().bit_length()):
        open_ends = links.where("more")
        if open_ends.isEmpty():
            break
        on = links.select("dataset", F.col("ptr").alias("target"), F.col("target").alias("_next"), F.col("more").alias("_more"))
        longer = open_ends.join(on, ["dataset", "target"]).select(*NODE, F.col("_next").alias("target"), F.col("_more").alias("more"))
        links = materialize(links.where("NOT more").unionByName(longer), "schema-refs")
    return links.where("NOT more").drop("more")


def edges(nodes: DataFrame, objects: DataFrame, targets: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(dataset, ptr, to, kind, token, closable): from every schema to those that its keywords lead to.

    ``kind`` is NULL where the data path stays. Schemas with a reference have no edges of their own; an edge to one leads
    to what it names.
    """
    candidates = []
    for r in rules:
        depth = 1 if r.below == "self" else 2
        here = (_last(depth) == MEMBER + r.keyword) & (F.size("ptr") >= depth)
        if r.below != "self":
            here = here & F.startswith(_last(), F.lit(MEMBER if r.below == "member" else ITEM))
        token = F.substring(_last(), 2, 1 << 30) if r.step in ("key", "regex") else F.lit("*") if r.step else F.lit(None)
        candidates.append(F.when(here, F.struct(
            _above(depth).alias("ptr"), F.lit(r.step).cast("string").alias("kind"), token.cast("string").alias("token"),
            F.lit(r.closable).alias("closable"), F.lit(r.needs).cast("string").alias("needs"))))
    found = nodes.where(F.col("kind") == "object").select(
        "dataset", F.col("ptr").alias("to"), F.explode(F.filter(F.array(*candidates), lambda c: c.isNotNull())).alias("e")
    ).select("dataset", "to", "e.*")
    needed = sorted({r.needs for r in rules if r.needs})
    met = F.col("needs").isNull()
    for n in needed:
        met = met | ((F.col("needs") == n) & F.col(n))
    found = found.join(objects.where("NOT has_ref").select(*NODE, *needed), NODE).where(met).drop("needs", *needed)
    plain = objects.where("NOT has_ref").select("dataset", F.col("ptr").alias("to"), F.col("ptr").alias("target"))
    ends = plain.unionByName(targets.select("dataset", F.col("ptr").alias("to"), "target"))
    return found.join(ends, ["dataset", "to"]).drop("to").withColumnRenamed("target", "to").distinct()


def walked(schemas: DataFrame, observed: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame, DataFrame]:
    """States that a walk reaches along the data: (dataset, ptr, path, closable), and the objects of the schemas.

    ``observed(dataset, path)`` are text paths that begin with ``$``. A state stays if its path begins one of them, open
    steps (any, regex) taken for every key. One round per step; equal states are one row, and a state is not entered again
    without a step of the data path, so circles end.
    """
    nodes = materialize(schema_nodes(schemas), "schema-nodes")
    objects = materialize(schema_objects(nodes), "schema-objects")
    targets = resolved(objects)
    moves = materialize(edges(nodes, objects, targets, rules), "schema-edges")
    own = schemas.select("dataset").distinct()
    begins = F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", F.lit(1), n)))
    prefixes = observed.join(own, "dataset", "left_semi").where(F.size("path") > 0).select("dataset", begins.alias("prefix")).distinct()
    prefixes = materialize(prefixes.withColumn("length", F.size("prefix")), "observed-prefixes")
    start = objects.where(F.size("ptr") == 0)
    at_target = start.where("has_ref").join(targets, NODE).select("dataset", F.col("target").alias("ptr"))
    root = F.array(F.struct(F.lit("key").alias("kind"), F.lit("$").alias("token")))
    level = start.where("NOT has_ref").select(*NODE).unionByName(at_target).select(*NODE, root.alias("path"), F.lit(True).alias("closable"))
    level = states = materialize(level, "schema-states")
    while not level.isEmpty():
        moved = level.withColumnRenamed("closable", "_closable").join(moves, NODE)
        token = F.struct(F.col("kind"), F.col("token"))
        moved = moved.select(
            "dataset", F.col("to").alias("ptr"), F.when(F.col("kind").isNull(), F.col("path")).otherwise(F.array_append("path", token)).alias("path"),
            (F.col("_closable") & F.col("closable")).alias("closable"),
        ).distinct()
        level = materialize(_observed(moved, prefixes).join(states, [*NODE, "path", "closable"], "left_anti"), "schema-states")
        states = states.unionByName(level)
    return states, objects


def _observed(states: DataFrame, prefixes: DataFrame) -> DataFrame:
    """States whose path begins an observed one: both sides with the open steps blanked, met by equality."""
    is_open = lambda t: t["kind"].isin("any", "regex")
    shaped = states.withColumn("mask", F.transform("path", is_open)).withColumn(
        "fixed", F.transform("path", lambda t: F.when(is_open(t), F.lit("")).otherwise(t["token"]))
    )
    masks = shaped.select("dataset", "mask", F.size("mask").alias("length")).distinct()
    blanked = prefixes.join(masks, ["dataset", "length"]).select(
        "dataset", "mask", F.zip_with("prefix", "mask", lambda p, m: F.when(m, F.lit("")).otherwise(p)).alias("fixed")
    ).distinct()
    return shaped.join(blanked, ["dataset", "mask", "fixed"], "left_semi").drop("mask", "fixed")


def observed_static_paths(schemas: DataFrame, observed: DataFrame, variant: str = "closed", assume_closed: bool = False) -> DataFrame:
    """Distinct static paths that begin an observed path: (dataset, path of typed steps).

    As ``schema_paths.static_paths``, but recursive references are followed as far as the paths in ``observed`` go.
    """
    states, objects = walked(schemas, observed, RULES[variant])
    here = states.join(objects, NODE)
    if variant == "closed":
        closed = F.col("extra_false")
        if assume_closed:
            undeclared = ~F.col("has_extra") & (F.col("is_object") | F.col("has_properties") | F.col("has_required"))
            closed = closed | (F.col("closable") & undeclared)
        return here.where(closed).select("dataset", "path").distinct()
    inner = objects.where(_last() == f"{MEMBER}additionalProperties").select(
        "dataset", _above(1).alias("ptr"), F.col("extra_false").alias("inner_false")
    )
    here = here.join(inner, NODE, "left")
    wild = F.array_append("path", F.struct(F.lit("wild").alias("kind"), F.lit("*").alias("token")))
    declared = F.col("extra_false") | F.col("extra_true") | F.col("extra_object")
    as_is = F.col("extra_false") | (F.col("extra_object") & F.coalesce("inner_false", F.lit(False)))
    return here.where(declared).select("dataset", F.when(as_is, F.col("path")).otherwise(wild).alias("path")).distinct()
