"""Level-by-level descent inside one row.

A nested value is opened within its own row: an ``aggregate`` keeps the states seen so far and
replaces the newest level by its children until a level has none. The descent therefore needs no
shuffle, no repeated parse and no depth setting, and a plan contains it as one narrow step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom.functions.json_values import array_items, empty, has_children, is_object, object_map

# Levels tried before the exact bound is worked out; real documents rarely go deeper.
USUAL_LEVELS = 16

CONTAINER = "struct<path:array<string>,x:variant>"


def opener_count(v: Column) -> Column:
    """Brackets in the text of a value: never less than its nesting depth."""
    text = F.to_json(v)
    return (
        F.length(text) * 2
        - F.length(F.replace(text, F.lit("{"), F.lit("")))
        - F.length(F.replace(text, F.lit("["), F.lit("")))
    )


# How a step of a path with places begins: a member's name or an item's position follows.
MEMBER, ITEM = "k", "i"


def member_step(key: Column) -> Column:
    return F.concat(F.lit(MEMBER), key)


def item_step(place: Column) -> Column:
    return F.concat(F.lit(ITEM), place.cast("string"))


def nesting_depth(v: Column) -> Column:
    """How deep containers are nested in a value: 0 for a scalar. One pass over the brackets of its text."""
    bare = F.regexp_replace(F.to_json(v), r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    brackets = F.split(F.regexp_replace(bare, r"[^\[\]{}]+", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def count(acc, c):
        now = acc["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(brackets, start, count, lambda acc: acc["most"])


def descend(
    roots: Column,
    children: Callable[[Column], Column],
    state_type: str,
    levels: Column,
    max_depth: int | None = None,
    usual_levels: int | None = None,
) -> Column:
    """All states reachable from ``roots`` through ``children``, parents before children.

    ``levels`` bounds the number of rounds. With ``usual_levels`` that many rounds are tried first
    and ``levels`` is evaluated only for a value that is deeper. With ``max_depth`` a value that
    goes deeper raises.
    """

    def open_level(acc, _):
        newest = F.slice(acc.seen, acc.opened + 1, F.greatest(F.size(acc.seen) - acc.opened, F.lit(0)))
        grown = F.concat(acc.seen, F.flatten(F.transform(newest, children)))
        return F.when(acc.opened == F.size(acc.seen), acc).otherwise(
            F.struct(grown.alias("seen"), F.size(acc.seen).alias("opened"))
        )

    def finish(acc):
        done = acc.opened == F.size(acc.seen)
        if max_depth is not None:
            opened_all = F.size(F.flatten(F.transform(
                F.slice(acc.seen, acc.opened + 1, F.greatest(F.size(acc.seen) - acc.opened, F.lit(0))),
                children,
            ))) == 0
            message = F.lit(f"a value is nested deeper than max_depth={max_depth}")
            return F.when(done | opened_all, acc.seen).otherwise(
                F.raise_error(message).cast(f"array<{state_type}>")
            )
        rest = F.aggregate(F.sequence(F.lit(1), levels), acc, open_level, lambda a: a.seen)
        return F.when(done, acc.seen).otherwise(rest)

    start = F.struct(roots.cast(f"array<{state_type}>").alias("seen"), F.lit(0).alias("opened"))
    if max_depth is None and usual_levels is None:
        return F.aggregate(F.sequence(F.lit(1), levels), start, open_level, lambda acc: acc.seen)
    rounds = usual_levels if max_depth is None else max_depth
    return F.aggregate(F.array(*[F.lit(i) for i in range(rounds)]), start, open_level, finish)


def containers(
    v: Column,
    root: Column,
    descend_arrays: bool = True,
    max_depth: int | None = None,
    usual_levels: int | None = None,
    places: bool = False,
) -> Column:
    """Every object and non-empty array inside ``v`` with its path, root included.

    Array steps are written ``*``; with ``places`` all steps are written as by :func:`member_step` and
    :func:`item_step`. With ``descend_arrays=False`` arrays are not entered.
    """
    none = empty(f"array<{CONTAINER}>")
    deeper = has_children if descend_arrays else is_object

    def members(c):
        return F.transform(
            F.filter(F.map_entries(object_map(c.x)), lambda e: deeper(e.value)),
            lambda e: F.struct(
                F.array_append(c.path, member_step(e.key) if places else e.key).alias("path"), e.value.alias("x")
            ),
        )

    def items(c):
        if places:
            placed = F.transform(array_items(c.x), lambda v, i: F.struct(
                F.array_append(c.path, item_step(i)).alias("path"), v.alias("x")
            ))
            return F.filter(placed, lambda p: deeper(p.x))
        return F.transform(
            F.filter(array_items(c.x), deeper),
            lambda i: F.struct(F.array_append(c.path, F.lit("*")).alias("path"), i.alias("x")),
        )

    def children(c):
        if not descend_arrays:
            return F.coalesce(members(c), none)
        return F.coalesce(members(c), items(c), none)

    start = F.array(F.struct(root.alias("path"), v.alias("x")))
    levels = nesting_depth(v) + 1 if usual_levels is None else opener_count(v) + 1
    return descend(start, children, CONTAINER, levels, max_depth, usual_levels)
