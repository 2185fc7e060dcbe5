"""Rewriting a JSON Schema inside its own row: references replaced, open objects closed.

The schema is opened level by level into its nodes, each knowing whether it stands where a schema
stands. The new text is what opens and what closes each node, sorted by the places of the nodes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom.functions import json_values as J
from keyloom.functions.descend import descend, nesting_depth
from keyloom.functions.schema_walk import let, ref_of, ref_targets, type_is

# Where sub-schemas stand, for the purpose of closing them.
MAPS_OF_SCHEMAS = ["properties", "patternProperties"]
SCHEMA_OR_LIST = ["items", "allOf", "anyOf", "oneOf", "if", "then", "else"]
SINGLE_SCHEMA = ["additionalProperties"]

NODE = "struct<key:string,x:variant,place:string,trail:array<string>,pos:array<int>>"
AFTER = (1 << 31) - 1  # the place after all members or items
PAIR = "struct<key:string,value:variant>"


def _place_below(place: Column, key: Column, x: Column) -> Column:
    """What a member or item is: a schema, a map of schemas, a list of schemas, or plain data."""
    is_obj, is_list = J.is_object(x), ~J.is_object(x) & J.is_array(x)
    return (
        F.when(place.isin("map", "list"), F.when(is_obj, "schema").otherwise("data"))
        .when(place != "schema", F.lit("data"))
        .when(key.isin(*MAPS_OF_SCHEMAS) & is_obj, F.lit("map"))
        .when(key.isin(*SCHEMA_OR_LIST, *SINGLE_SCHEMA) & is_obj, F.lit("schema"))
        .when(key.isin(*SCHEMA_OR_LIST) & is_list, F.lit("list"))
        .otherwise("data")
    )


def _nodes(x: Column, expand_refs: bool) -> Column:
    """Every value in the schema, parents before children, siblings side by side."""

    def opened(targets):
        def resolved(value, trail):
            """The value, or what its reference names unless that would repeat itself."""
            if not expand_refs:
                return F.struct(value.alias("x"), trail.alias("trail"))
            name = F.array_join(ref_of(value), "/")
            hop = F.filter(targets, lambda t: t.path == ref_of(value))
            take = name.isNotNull() & ~F.array_contains(trail, name) & (F.size(hop) > 0)
            return F.when(
                take,
                F.struct(F.get(hop, 0).x.alias("x"), F.array_append(trail, name).alias("trail")),
            ).otherwise(F.struct(value.alias("x"), trail.alias("trail")))

        def followed(value, trail):
            """What a chain of references ends at: each target is passed at most once."""
            if not expand_refs:
                return resolved(value, trail)
            start = F.struct(value.alias("x"), trail.alias("trail"))
            chain = F.aggregate(F.sequence(F.lit(1), F.size(targets)), start, lambda at, _: resolved(at.x, at.trail))
            return F.when(ref_of(value).isNull() | (F.size(targets) == 0), start).otherwise(chain)

        def node(key, value, place, trail, pos):
            return let(
                followed(value, trail),
                lambda r: F.struct(
                    key.alias("key"),
                    r.x.alias("x"),
                    _place_below(place, key, r.x).alias("place"),
                    r.trail.alias("trail"),
                    pos.alias("pos"),
                ),
            )

        def members(s):
            own = F.map_entries(J.object_map(s.x))
            if not expand_refs:
                return own
            # Only the root keeps its siblings next to a reference: it wins over the target.
            named = F.get(F.filter(targets, lambda t: t.path == ref_of(s.x)), 0).x
            target = F.when(named.isNotNull(), followed(named, s.trail).x)
            is_root = s.place == "root"
            siblings = F.filter(own, lambda e: e.key != "$ref")
            names = F.transform(siblings, lambda e: e.key)
            borrowed = F.filter(
                F.map_entries(J.object_map(target)), lambda e: ~F.array_contains(names, e.key)
            )
            merged = F.concat(siblings, F.coalesce(borrowed, J.empty(f"array<{PAIR}>")))
            return F.when(is_root & target.isNotNull(), merged).otherwise(own)

        def children(s):
            place = F.when(s.place == "root", "schema").otherwise(s.place)
            unnamed = F.transform(
                J.array_items(s.x),
                lambda i: F.struct(F.lit(None).cast("string").alias("key"), i.alias("value")),
            )
            below = F.coalesce(members(s), unnamed, J.empty(f"array<{PAIR}>"))
            return F.transform(
                below, lambda e, i: node(e.key, e.value, place, s.trail, F.array_append(s.pos, i))
            ).cast(f"array<{NODE}>")

        root = F.struct(
            F.lit(None).cast("string").alias("key"),
            x.alias("x"),
            F.lit("root").alias("place"),
            J.empty("array<string>").alias("trail"),
            J.empty("array<int>").alias("pos"),
        )
        levels = (nesting_depth(x) + 1) * (F.size(targets) + 1)
        described = lambda s: F.struct(
            s.key.alias("key"), s.x.alias("x"), s.place.alias("place"), s.pos.alias("pos"), children(s).alias("kids")
        )
        return F.transform(descend(F.array(root), children, NODE, levels), described)

    if expand_refs:
        return let(ref_targets(x), opened)
    return let(J.empty("array<struct<path:array<string>,x:variant>>"), opened)


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def rewritten(x: Column, expand_refs: bool = False, close: bool = False) -> Column:
    """Struct of the compact ``text`` of schema ``x`` with references replaced and open objects
    closed, and of ``refs_left``: references that are remote, missing or endlessly recursive."""

    def opening(n):
        comma = F.when(F.element_at(n.pos, -1) > 0, ",").otherwise("")
        name = F.when(n.key.isNotNull(), F.concat(quoted(n.key), F.lit(":"))).otherwise("")
        own = F.when(J.is_object(n.x), "{").when(J.is_array(n.x), "[").otherwise(F.to_json(n.x))
        return F.when(F.size(n.pos) == 0, own).otherwise(F.concat(comma, name, own))

    def closing(n):
        end = F.when(J.is_object(n.x), "}").otherwise("]")
        if not close:
            return end
        names = F.transform(n.kids, lambda k: k.key)
        object_like = (
            type_is(n.x, "object") | F.array_contains(names, "properties") | F.array_contains(names, "required")
        )
        added = n.place.isin("schema", "root") & ~F.array_contains(names, "additionalProperties") & object_like
        comma = F.when(F.size(n.kids) > 0, ",").otherwise("")
        return F.when(added, F.concat(comma, F.lit('"additionalProperties":false}'))).otherwise(end)

    def assembled(nodes):
        opened = F.transform(nodes, lambda n: F.struct(n.pos.alias("pos"), opening(n).alias("text")))
        inner = F.filter(nodes, lambda n: J.is_object(n.x) | J.is_array(n.x))
        closed = F.transform(
            inner, lambda n: F.struct(F.array_append(n.pos, F.lit(AFTER)).alias("pos"), closing(n).alias("text"))
        )
        return F.array_join(F.transform(F.sort_array(F.concat(opened, closed)), lambda e: e.text), "")

    def is_ref(n):
        # The root's own reference is gone from its members where its target was found.
        left = (n.place != "root") | F.exists(n.kids, lambda k: k.key == "$ref")
        return left & ref_of(n.x).isNotNull()

    return let(
        _nodes(x, expand_refs),
        lambda nodes: F.struct(
            assembled(nodes).alias("text"), F.size(F.filter(nodes, is_ref)).alias("refs_left")
        ),
    )
