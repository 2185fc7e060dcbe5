"""Column expressions over JSON values held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# JSON type names in alphabetical order; the position is the bit in a type mask.
JSON_TYPES = ["array", "boolean", "integer", "null", "number", "object", "string"]

# The class names of the host language that the oldest feature set reports.
PYTHON_TYPES = {
    "array": "list",
    "boolean": "bool",
    "integer": "int",
    "null": "NoneType",
    "number": "float",
    "object": "dict",
    "string": "str",
}


def empty(array_type: str) -> Column:
    """Empty array of a given type."""
    return F.array().cast(array_type)


def parse(json: Column) -> Column:
    """JSON text as VARIANT; NULL where the text is not one JSON value.

    The engine's parser stops after the first value and would accept ``{"a":1} more``. The text is
    therefore parsed as the first item of an array whose second is the digest of the text. Only a
    text that is exactly one value leaves the digest in second place: text that closes the array
    hides it, further items push it back, and no text can contain its own digest.
    """
    digest = F.md5(json)
    wrapped = F.try_parse_json(F.concat(F.lit("["), json, F.lit(',"'), digest, F.lit('"]')))
    # The parsed text is the one value of an array, so that it is worked out once for both of its items.
    items = F.array(F.try_variant_get(wrapped, "$", "array<variant>"))
    complete = F.filter(items, lambda i: F.try_variant_get(F.get(i, 1), "$", "string") == digest)
    return F.get(F.get(complete, 0), 0)


def object_map(v: Column) -> Column:
    """Members of an object as ``MAP<STRING, VARIANT>``; NULL for other values."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def array_items(v: Column) -> Column:
    """Items of an array as ``ARRAY<VARIANT>``; NULL for other values."""
    return F.try_variant_get(v, "$", "array<variant>")


def member_names(v: Column) -> Column:
    """Names of an object's members; NULL for other values. The cast reads one (absent) member of each value."""
    return F.map_keys(F.try_variant_get(v, "$", "map<string,struct<_:variant>>"))


def item_count(v: Column) -> Column:
    """Items of an array; NULL for other values. The cast is that of :func:`is_array`."""
    return F.size(F.try_variant_get(v, "$", "array<struct<_:variant>>"))


def is_object(v: Column) -> Column:
    """True for objects. The cast reads one (absent) member only, so it stays cheap on big objects."""
    return F.try_variant_get(v, "$", "struct<_:variant>").isNotNull()


def is_array(v: Column) -> Column:
    """True for arrays. As above the cast reads one (absent) member per item; as VARIANT every item would be built anew."""
    return F.try_variant_get(v, "$", "array<struct<_:variant>>").isNotNull()


def has_children(v: Column) -> Column:
    """True for objects and for arrays with at least one item."""
    return is_object(v) | F.try_variant_get(v, "$[0]", "variant").isNotNull()


def is_false(v: Column) -> Column:
    """True only for the JSON literal ``false`` (the text "false" does not count)."""
    return F.coalesce(scalar_type(v) == "BOOLEAN", F.lit(False)) & ~F.coalesce(
        F.try_variant_get(v, "$", "boolean"), F.lit(True)
    )


def is_true(v: Column) -> Column:
    """True only for the JSON literal ``true``."""
    return F.coalesce(scalar_type(v) == "BOOLEAN", F.lit(False)) & F.coalesce(
        F.try_variant_get(v, "$", "boolean"), F.lit(False)
    )


def string_value(v: Column) -> Column:
    """Text of a JSON string; NULL for every other value."""
    return F.when(scalar_type(v) == "STRING", F.try_variant_get(v, "$", "string"))


def scalar_type(v: Column) -> Column:
    """Engine type name of a scalar, OBJECT or ARRAY for containers.

    Containers are recognised first because describing one walks all of its content.
    """
    return (
        F.when(is_object(v), F.lit("OBJECT"))
        .when(is_array(v), F.lit("ARRAY"))
        .otherwise(F.schema_of_variant(v))
    )


def json_type_name(raw: Column) -> Column:
    """JSON type name for an engine type name from :func:`scalar_type`.

    Whole numbers beyond 64 bit arrive as ``DECIMAL(p,0)`` with p of 19 or more; decimals with
    fewer digits and no scale were written with a fraction (``1.0``) and are numbers.
    """
    whole = F.startswith(raw, F.lit("DECIMAL(")) & F.endswith(raw, F.lit(",0)")) & (F.length(raw) == len("DECIMAL(19,0)"))
    return (
        F.when(raw == "OBJECT", F.lit("object"))
        .when(raw == "ARRAY", F.lit("array"))
        .when(raw == "STRING", F.lit("string"))
        .when(raw == "BIGINT", F.lit("integer"))
        .when(raw == "BOOLEAN", F.lit("boolean"))
        .when(raw == "VOID", F.lit("null"))
        .when(whole & (F.substring(raw, 9, 2) >= "19"), F.lit("integer"))
        .when(raw.isNotNull(), F.lit("number"))
    )


# Type codes of containers; a scalar's is its place among the names below, from 1, and 0 for all other numbers.
OBJECT_CODE, ARRAY_CODE = -1, -2
_SCALARS = ["STRING", "BIGINT", "BOOLEAN", "VOID", *[f"DECIMAL({digits},0)" for digits in range(19, 39)]]


def type_code(v: Column) -> Column:
    """JSON type of a VARIANT as a small number, which costs less to carry than the name of :func:`scalar_type`."""
    place = F.array_position(F.array(*[F.lit(name) for name in _SCALARS]), F.schema_of_variant(v)).cast("int")
    return F.when(is_object(v), OBJECT_CODE).when(is_array(v), ARRAY_CODE).otherwise(place)


def json_type_of_code(code: Column) -> Column:
    """JSON type name for a code from :func:`type_code`."""
    return (
        F.when(code == OBJECT_CODE, F.lit("object"))
        .when(code == ARRAY_CODE, F.lit("array"))
        .when(code == 0, F.lit("number"))
        .when(code == 1, F.lit("string"))
        .when(code == 3, F.lit("boolean"))
        .when(code == 4, F.lit("null"))
        .when(code.isNotNull(), F.lit("integer"))
    )


def json_type(v: Column) -> Column:
    """JSON type name of a VARIANT: one of ``JSON_TYPES``."""
    return json_type_name(scalar_type(v))


def python_type(type_name: Column) -> Column:
    """Host-language class name for a JSON type name."""
    pairs = [F.lit(x) for pair in PYTHON_TYPES.items() for x in pair]
    return F.element_at(F.create_map(*pairs), type_name)


def type_bit(type_name: Column) -> Column:
    """Bit of a JSON type name, so that a set of types is one integer and ``bit_or`` its union."""
    bit = F.lit(0)
    for position, name in reversed(list(enumerate(JSON_TYPES))):
        bit = F.when(type_name == name, F.lit(1 << position)).otherwise(bit)
    return bit


def types_of_mask(mask: Column) -> Column:
    """Sorted type names of a type mask."""
    named = F.array(
        *[F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(JSON_TYPES)]
    )
    return F.filter(named, lambda x: x.isNotNull())


def canonical(v: Column) -> Column:
    """Text that is the same for equal values: members by name, ``1.0`` and ``1.50`` as ``1`` and ``1.5``.

    A VARIANT keeps members by name already. Strings are passed over as a whole.
    """
    zeros = r'("(?:[^"\\]++|\\.)*+")|\.0+(?=[,\]}]|$)|(\.\d*?[1-9])0+(?=[,\]}]|$)'
    return F.regexp_replace(F.to_json(v), zeros, "$1$2")


def container_size(v: Column) -> Column:
    """Number of members or items; 0 for scalars."""
    return F.when(is_object(v), F.size(object_map(v))).otherwise(F.coalesce(F.size(array_items(v)), F.lit(0)))


def nesting_depth(path: Column) -> Column:
    """Steps below the root of a path that starts with the root token."""
    return F.size(path) - 1


def depth_level(depth: Column) -> Column:
    """Depth class: up to 3 shallow, up to 6 moderate, else deep."""
    return F.when(depth <= 3, "shallow").when(depth <= 6, "moderate").otherwise("deep")
