"""Walks over a JSON Schema held as VARIANT, inside its own row.

A walk is a pair of functions: which sub-schemas a schema leads to and by which step of the data
path, and what is reported at a schema. References are followed in place: the targets named
anywhere in a schema are looked up once, and a ``$ref`` then continues at its target without
leaving the row. A schema comes in as one row, so everything reported about it is bounded by it;
only recursive references could go on for ever, and ``max_path_length`` ends those. Schemas that do
not refer back to themselves are followed to their end, however deep.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom.functions import json_values as J
from keyloom.functions.descend import containers, descend, nesting_depth, opener_count

# Longest data path a walk follows through a recursive reference unless told otherwise.
MAX_PATH_LENGTH = 32

TOKEN = "struct<kind:string,token:string,names:array<string>,patterns:array<string>>"
# A branch of a combining keyword: which keyword, which of its schemas, and how long the data path is where it stands.
BRANCH = "struct<id:string,branch:int,depth:int>"
STATE = (
    f"struct<path:array<{TOKEN}>,x:variant,hops:int,closable:boolean,trail:array<string>,recursive:boolean,"
    f"scope:array<{BRANCH}>>"
)
# What stands for a reference that leads nowhere, where a walk asks for it.
DEAD = '{"$dead":true}'

Walk = Callable[[Column], Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for use in several places of ``body``."""
    return F.transform(F.array(value), body)[0]


def at(x: Column, keyword: str) -> Column:
    """Value of a schema keyword; NULL where it is not declared."""
    return F.try_variant_get(x, f"$['{keyword}']", "variant")


def has(x: Column, keyword: str) -> Column:
    return at(x, keyword).isNotNull()


def entries(x: Column, keyword: str) -> Column:
    """Members of an object-valued keyword as (key, value) pairs; empty otherwise."""
    members = F.map_entries(F.try_variant_get(x, f"$['{keyword}']", "map<string,variant>"))
    return F.coalesce(members, J.empty("array<struct<key:string,value:variant>>"))


def items(x: Column, keyword: str) -> Column:
    """Items of an array-valued keyword; empty otherwise."""
    return F.coalesce(
        F.try_variant_get(x, f"$['{keyword}']", "array<variant>"), J.empty("array<variant>")
    )


def single(x: Column, keyword: str) -> Column:
    """The keyword's value in an array of one if it is an object, else an empty array."""
    value = at(x, keyword)
    return F.when(J.is_object(value), F.array(value)).otherwise(J.empty("array<variant>"))


def type_is(x: Column, name: str) -> Column:
    """True where ``type`` is exactly the given name."""
    return F.coalesce(J.string_value(at(x, "type")) == name, F.lit(False))


def token(kind: str, text: Column, names: Column | None = None, patterns: Column | None = None) -> Column:
    """One step of a schema path: kind is key, any, regex, index or wild."""
    missing = F.lit(None).cast("array<string>")
    return F.struct(
        F.lit(kind).alias("kind"),
        text.alias("token"),
        (missing if names is None else names).alias("names"),
        (missing if patterns is None else patterns).alias("patterns"),
    )


def step(
    s: Column, tok: Column | None, x: Column, closable: Column | None = None, scope: Column | None = None
) -> Column:
    """State reached from ``s`` at sub-schema ``x``, one data step further if a token is given."""
    path = s.path if tok is None else F.array_append(s.path, tok)
    return F.struct(
        path.alias("path"),
        x.alias("x"),
        (s.hops if tok is None else F.lit(0)).alias("hops"),
        (s.closable if closable is None else closable).alias("closable"),
        s.trail.alias("trail"),
        s.recursive.alias("recursive"),
        (s.scope if scope is None else scope).alias("scope"),
    )


def ref_pointer(ref: Column) -> Column:
    """Object keys named by a local reference such as ``#/definitions/x``."""
    return F.split(F.regexp_replace(ref, "^[#/]+", ""), "/")


def ref_of(x: Column) -> Column:
    """Pointer of the schema's own ``$ref``; NULL where there is none or it is not text."""
    return ref_pointer(J.string_value(at(x, "$ref")))


def ref_targets(x: Column) -> Column:
    """Every object in the schema that some ``$ref`` in it names, with its pointer."""
    no_path = J.empty("array<string>")
    wanted = F.array_distinct(
        F.filter(F.transform(containers(x, no_path), lambda c: ref_of(c.x)), lambda p: p.isNotNull())
    )
    return let(
        wanted,
        lambda w: F.when(
            F.size(w) > 0,
            F.filter(containers(x, no_path, descend_arrays=False), lambda c: F.array_contains(w, c.path)),
        ).otherwise(J.empty("array<struct<path:array<string>,x:variant>>")),
    )


def walk_states(
    x: Column, children: Walk, max_path_length: int = MAX_PATH_LENGTH, beside: Column | None = None, mark_dead: bool = False
) -> Column:
    """All states a walk reaches in schema ``x``; a schema with ``$ref`` only leads to its target.

    Where ``beside`` is true, what stands beside a ``$ref`` is followed too. With ``mark_dead`` a reference that leads
    nowhere is a state with the schema ``DEAD``.
    """
    root = F.struct(
        F.array(token("key", F.lit("$"))).alias("path"),
        x.alias("x"),
        F.lit(0).alias("hops"),
        F.lit(True).alias("closable"),
        J.empty("array<string>").alias("trail"),
        F.lit(False).alias("recursive"),
        J.empty(f"array<{BRANCH}>").alias("scope"),
    )

    def body(targets):
        def follow(s):
            hop = F.filter(targets, lambda t: t.path == ref_of(s.x))
            name = F.array_join(ref_of(s.x), "/")
            followed = F.transform(hop, lambda t: F.struct(
                s.path.alias("path"),
                t.x.alias("x"),
                (s.hops + 1).alias("hops"),
                s.closable.alias("closable"),
                F.array_union(s.trail, F.array(name)).alias("trail"),
                (s.recursive | F.array_contains(s.trail, name)).alias("recursive"),
                s.scope.alias("scope"),
            ))
            if not mark_dead:
                return followed
            dead = F.array(step(s, None, F.parse_json(F.lit(DEAD))))
            some = F.coalesce(F.size(hop), F.lit(0)) > 0
            return F.when(some, followed.cast(f"array<{STATE}>")).otherwise(dead.cast(f"array<{STATE}>"))

        def next_states(s):
            none = J.empty(f"array<{STATE}>")
            own = children(s)
            if beside is not None:
                reached = follow(s).cast(f"array<{STATE}>")
                found = F.when(has(s.x, "$ref"), F.concat(reached, F.when(beside, own.cast(f"array<{STATE}>")).otherwise(none)))
                found = found.otherwise(own.cast(f"array<{STATE}>"))
            else:
                found = F.when(has(s.x, "$ref"), follow(s)).otherwise(own)
            # A chain of references longer than the number of targets is a loop without data steps.
            kept = F.filter(found, lambda n: J.is_object(n.x)
                            & (~n.recursive | (F.size(n.path) <= max_path_length))
                            & (n.hops <= F.size(targets)))
            return F.coalesce(kept.cast(f"array<{STATE}>"), none)

        # Between two data steps no schema is passed twice; the bound follows the depth, as each round copies the states.
        depth, some = nesting_depth(x) + 1, F.size(targets) + 1
        levels = F.when(F.size(targets) == 0, depth).otherwise(
            F.least(opener_count(x), depth * some) * F.greatest(F.lit(max_path_length), some) + F.size(targets)
        )
        return descend(F.array(root), next_states, STATE, levels)

    return let(ref_targets(x), body)


def walk(
    x: Column, children: Walk, emit: Walk, max_path_length: int = MAX_PATH_LENGTH, beside: Column | None = None,
    mark_dead: bool = False,
) -> Column:
    """Everything ``emit`` reports at the reached states; schemas with ``$ref`` report nothing unless ``beside`` is true."""
    reports = lambda s: ~has(s.x, "$ref") if beside is None else (~has(s.x, "$ref") | beside)
    states = F.filter(walk_states(x, children, max_path_length, beside, mark_dead), reports)
    return F.flatten(F.transform(states, emit))
