"""Documents to path rows.

A document is opened by a chain of ``variant_explode_outer`` steps, one per level, inside one
narrow stage: a row per leaf, carrying the path to it. Inner nodes are not emitted separately on
the way; each is reported by the first leaf below it, which the positions along the path tell.

A VARIANT taken out of a document brings the document's whole key dictionary along, which the chain
would copy for every child. Documents with much text, and whatever lies deeper than the chain, are
therefore opened in place (see ``functions.descend``), where children share the dictionary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions import json_values as J
from keyloom.functions.descend import containers, item_step, member_step
from keyloom.session import prepared

# Levels opened by the chain; deeper values and documents with more text are opened in place.
CHAIN_LEVELS = 8
WIDE_CHARS = 32 * 1024
ROOT = "$"


def document_items(docs: DataFrame, json_col: str = "json") -> DataFrame:
    """Object documents as VARIANT rows; each object in a top-level array is its own document.

    Scalars, other array items and unparsable text yield no row. Adds ``item`` (position within
    a top-level array, else 0), ``doc``, and ``wide`` (the text is long), and drops the text.
    """
    parsed = docs.withColumn("_v", J.parse(F.col(json_col))).withColumn(
        "wide", F.length(json_col) > WIDE_CHARS
    ).drop(json_col)
    v = F.col("_v")
    candidates = F.when(J.is_object(v), F.array(v)).otherwise(
        F.filter(J.array_items(v), J.is_object)
    )
    keep = [c for c in parsed.columns if c != "_v"]
    return parsed.select(*keep, F.posexplode(candidates).alias("item", "doc"))


def root_keys(doc: str = "doc"):
    """Names of the members of an object document."""
    return F.map_keys(J.object_map(F.col(doc)))


def _described(is_index: Column, x: Column, with_values: bool, compared: Column | None = None) -> Column:
    """What is reported about one member or item: a type code and ``is_index`` in one number, or with more fields a struct.

    The engine's type name is mapped to a JSON type only when rows are emitted: here it would be evaluated once per case.
    """
    if not with_values and compared is None:
        return J.type_code(x) * 2 + is_index.cast("int")
    return F.struct(*_fields(is_index, x, J.scalar_type(x), J.member_names(x), J.item_count(x), with_values, compared))


def _fields(
    is_index: Column, x: Column, raw_type: Column, members: Column, items: Column, with_values: bool, compared: Column | None
) -> list[Column]:
    """Fields of :func:`_described`, given the engine's type name, the names of an object's members and the length of an array."""
    fields = [raw_type.alias("raw_type"), is_index.alias("is_index")]
    if with_values:
        fields += [
            F.coalesce(F.when(members.isNotNull(), F.size(members)), items, F.lit(0)).alias("size"),
            F.when(members.isNull() & (F.coalesce(items, F.lit(0)) == 0), F.try_variant_get(x, "$", "string")).alias("scalar"),
            members.alias("members"),
        ]
    if compared is not None:
        items = F.transform(J.array_items(x), J.canonical)
        fields += [
            F.when(compared, J.canonical(x)).alias("canonical"),
            F.when(compared, F.size(items) != F.size(F.array_distinct(items))).alias("repeats"),
        ]
    return fields


def _field_names(with_values: bool, compared: bool) -> list[str]:
    if not with_values and not compared:
        return ["info"]
    return ["raw_type", "is_index"] + ["size", "scalar", "members"] * with_values + ["canonical", "repeats"] * compared


def _info_type(with_values: bool, compared: bool = False) -> str:
    if not with_values and not compared:
        return "int"
    values = ",size:int,scalar:string,members:array<string>" if with_values else ""
    values += ",canonical:string,repeats:boolean" if compared else ""
    return f"struct<raw_type:string,is_index:boolean{values}>"


def _told(fields: dict[str, Column]) -> tuple[Column, Column]:
    """is_index and json_type of what :func:`_described` tells."""
    if "info" in fields:
        return fields["info"].bitwiseAND(1) == 1, J.json_type_of_code(F.shiftright(fields["info"], 1))
    return fields["is_index"], J.json_type_name(fields["raw_type"])


def _opened_in_place(
    x: Column, path: Column, descend_arrays: bool, with_values: bool, places: bool, compared: Column | None
) -> Column:
    """Everything below container ``x`` at ``path``, as one array of (parent_path, key, info)."""

    def entries(c):
        members = F.map_entries(J.object_map(c.x))
        unnamed = F.transform(
            J.array_items(c.x),
            lambda i: F.struct(F.lit(None).cast("string").alias("key"), i.alias("value")),
        )

        def told(e, i):
            named = F.coalesce(member_step(e.key), item_step(i)) if places else F.coalesce(e.key, F.lit("*"))
            return F.struct(
                c.path.alias("parent_path"),
                named.alias("key"),
                _described(e.key.isNull(), e.value, with_values, compared).alias("info"),
            )

        return F.transform(F.coalesce(members, unnamed) if descend_arrays else members, told)

    inside = F.transform(containers(x, path, descend_arrays, places=places), entries)
    return F.flatten(F.filter(inside, lambda e: e.isNotNull()))


def flatten_json(
    docs: DataFrame,
    doc: str = "doc",
    descend_arrays: bool = True,
    include_root: bool = False,
    with_values: bool = False,
    max_depth: int | None = None,
    places: bool = False,
    compared: str | None = None,
    reach: int | None = None,
) -> DataFrame:
    """One row per object member and array item at every depth.

    ``doc`` is a VARIANT column; the other columns are carried, except ``wide``, which marks
    documents to open in place. Result columns: ``path`` (starts with ``$``, array steps are ``*``),
    ``parent_path``, ``key``, ``is_index``, ``json_type``, and with ``with_values`` also ``size``
    (members or items), ``scalar`` (text of scalar values) and ``members`` (key names of objects).
    ``include_root`` adds a row for the document itself, with key ``$`` and an empty parent path.
    With ``max_depth`` a document that goes deeper raises. With ``places`` the steps of paths are written as by
    ``descend.member_step`` and ``descend.item_step``, so that every value has a path of its own. ``compared`` names a
    boolean column: where it is true, ``canonical`` (text that is the same for equal values) and ``repeats`` (of an
    array: some items are equal) are reported too. With ``reach`` only values up to that many steps below the root are reported
    and nothing deeper is opened, for callers that have no use for it.
    """
    keep = [c for c in docs.columns if c not in (doc, "wide")]
    wide = F.col("wide") if "wide" in docs.columns and max_depth is None else F.lit(False)
    mark = None if compared is None else F.col(compared)

    plain = not with_values and compared is None
    entered = ["OBJECT", "ARRAY"] if descend_arrays else ["OBJECT"]
    entered_codes = [J.OBJECT_CODE, J.ARRAY_CODE] if descend_arrays else [J.OBJECT_CODE]

    names = _field_names(with_values, compared is not None)

    def opened(value, level):
        """The value if the next level enters it."""
        if plain:
            return F.when(F.shiftright(F.col(f"_info{level}"), 1).isin(*entered_codes), value)
        return F.when(F.col(f"_raw_type{level}").isin(*entered), value)

    def described(rows, is_index, value, reached, level):
        """``rows`` and what they tell about ``value``, a column each, so that what nobody reads is not carried."""
        if plain:
            fields = [_described(is_index, value, with_values, mark)]
        else:  # what is read several times is worked out once, in a step of its own
            rows = rows.select("*", J.scalar_type(value).alias("_raw"), J.member_names(value).alias("_names"), J.item_count(value).alias("_items"))
            fields = _fields(is_index, value, F.col("_raw"), F.col("_names"), F.col("_items"), with_values, mark)
        return rows, [F.when(reached, f).alias(f"_{n}{level}") for n, f in zip(names, fields)]

    # A column per level for steps and descriptions: an array of them would be copied item by item at each level.
    rows, told = described(docs, F.lit(False), F.col(doc), F.lit(True), 0)
    rows = rows.select(
        *keep,
        (member_step(F.lit(ROOT)) if places else F.lit(ROOT)).alias("_step0"),
        *told,
        F.lit(0).alias("_from"),
        F.lit(0).alias("_leaf"),
        F.when(wide, F.col(doc)).alias("_whole"),
        F.when(~F.coalesce(wide, F.lit(False)), F.col(doc)).alias("_value"),
    )
    # The root needs the same gate as every other value.
    rows = rows.withColumn("_value", opened(F.col("_value"), 0))
    levels = (CHAIN_LEVELS if max_depth is None else max_depth) + 1
    if reach is not None and reach < levels:  # what lies below the chain is out of reach
        levels = reach + 1
        rows = rows.withColumn("_value", F.when(F.lit(reach > 0), F.col("_value")))
    for level in range(1, levels):
        above = [*keep, *[f"_{c}{i}" for i in range(level) for c in ("step", *names)]]
        children = rows.lateralJoin(
            rows.sparkSession.tvf.variant_explode_outer(F.col("_value").outer()).toDF("_pos", "_key", "_child")
        ).select(*above, "_from", "_leaf", "_whole", "_pos", "_key", "_child")
        reached, child = F.col("_pos").isNotNull(), F.col("_child")
        step = F.coalesce(member_step(F.col("_key")), item_step(F.col("_pos"))) if places else F.coalesce("_key", F.lit("*"))
        children, told = described(children, F.col("_key").isNull(), child, reached, level)
        rows = children.select(
            *above,
            F.when(reached, step).alias(f"_step{level}"),
            *told,
            F.when(F.col("_pos") > 0, F.lit(level)).otherwise(F.col("_from")).alias("_from"),
            F.when(reached, F.lit(level)).otherwise(F.col("_leaf")).alias("_leaf"),
            "_whole",
            F.when(reached, child).alias("_value"),
        )
        rows = rows.withColumn("_value", F.when(F.lit(level != reach), opened(F.col("_value"), level)))
    rows = rows.select(
        *keep,
        F.slice(F.array(*[f"_step{i}" for i in range(levels)]), F.lit(1), F.col("_leaf") + 1).alias("_path"),
        *[F.array(*[F.col(f"_{n}{i}") for i in range(levels)]).alias(f"_{n}") for n in names],
        "_from", "_leaf", "_whole", "_value",
    )
    found = _emitted(rows, keep, include_root, with_values, descend_arrays, max_depth, places, compared)
    return found if reach is None else found.filter(F.size("path") <= reach + 1)


def _emitted(rows, keep, include_root, with_values, descend_arrays, max_depth, places, compared) -> DataFrame:
    """Path rows of the leaves: nodes ``_from`` to the leaf itself, then what is below the leaf."""
    leaf = F.col("_leaf")
    if max_depth is not None:
        message = F.lit(f"a value is nested deeper than max_depth={max_depth}")
        deeper = J.has_children(F.col("_value"))
        failed = F.raise_error(message).cast("array<string>")
        rows = rows.withColumn("_path", F.when(deeper, failed).otherwise(F.col("_path")))
        below = F.lit(None).cast(
            f"array<struct<parent_path:array<string>,key:string,info:{_info_type(with_values, compared is not None)}>>"
        )
    else:
        below = prepared(
            ("below", descend_arrays, with_values, places, compared),
            lambda: F.when(
                F.coalesce("_whole", "_value").isNotNull(),
                _opened_in_place(
                    F.coalesce("_whole", "_value"), F.col("_path"), descend_arrays, with_values, places,
                    None if compared is None else F.col(compared),
                ),
            ),
        )
    first = F.col("_from") if include_root else F.greatest("_from", F.lit(1))
    last = leaf + F.greatest(F.coalesce(F.size("_below"), F.lit(0)), F.lit(0))
    names = [f"_{n}" for n in _field_names(with_values, compared is not None)]
    leaves = rows.select(*keep, "_path", *names, "_from", "_leaf", below.alias("_below"))
    # A condition inside the explode: a filter would be moved below the column it reads and work that out once more.
    numbered = leaves.select(
        *keep, "_path", *names, "_leaf", "_below", F.explode(F.when(first <= last, F.sequence(first, last))).alias("_n")
    )
    deep = F.col("_n") > leaf
    found = F.get("_below", F.col("_n") - leaf - 1)
    nodes = numbered.select(
        *keep,
        F.when(deep, found.parent_path).otherwise(F.slice("_path", 1, F.col("_n"))).alias("parent_path"),
        F.when(deep, found.key).otherwise(F.get("_path", F.col("_n"))).alias("key"),
        *[F.when(deep, found.info if n == "_info" else found.info[n[1:]]).otherwise(F.get(n, F.col("_n"))).alias(n) for n in names],
    )
    extra = ["size", "scalar", "members"] if with_values else []
    extra += ["canonical", "repeats"] if compared is not None else []
    is_index, json_type = _told({n[1:]: F.col(n) for n in names})
    return nodes.select(
        *keep,
        F.array_append("parent_path", F.col("key")).alias("path"),
        "parent_path",
        "key",
        is_index.alias("is_index"),
        json_type.alias("json_type"),
        *[F.col(f"_{c}").alias(c) for c in extra],
    )


def object_members(path_rows: DataFrame) -> DataFrame:
    """Path rows whose last step is an object key, not an array step."""
    return path_rows.filter(~F.col("is_index"))
