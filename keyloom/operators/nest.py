"""Path profiles back to one JSON Schema per dataset, with dynamic keys abstracted on request.

A nested schema is kept as rows, one per schema node, because a dataset with dynamic keys can have
more nodes than any row or task should hold. Its size and its text are derived from these rows: a
node contributes lines of indented JSON whose order is known from its path, so writing a schema is
a distributed sort, and measuring it a sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions import json_values as J
from keyloom.operators.joins import size_checked_join
from keyloom.operators.profile import without_root
from keyloom.session import materialize

NODE = ["dataset", "path"]


def _prefixes(path: Column, shortest: int = 1) -> Column:
    return F.transform(F.sequence(F.lit(shortest), F.size(path)), lambda n: F.slice(path, 1, n))


def strip_profile(properties: Column) -> Column:
    """Properties of a packed profile with only their types left."""
    return F.transform_values(properties, lambda _, p: p.type)


def schema_nodes(keys: DataFrame) -> DataFrame:
    """Nodes of the nested schema: (dataset, path, types, additional).

    Observed keys carry their sorted type names. Levels on the way that were not observed as keys
    (the root ``$`` and array steps) have ``types`` NULL and read ``"type": "object"``; an empty
    array stands for no type at all. ``additional`` is NULL until dynamic keys are abstracted.
    """
    observed = without_root(keys).select(
        "dataset", F.array_append("parent_path", F.col("key")).alias("path"), "type_mask"
    )
    levels = (
        without_root(keys)
        .select("dataset", "parent_path").distinct()
        .select("dataset", F.explode(_prefixes(F.col("parent_path"))).alias("path"))
        .withColumn("type_mask", F.lit(None).cast("int"))
    )
    return observed.unionByName(levels).groupBy(*NODE).agg(F.bit_or("type_mask").alias("type_mask")).select(
        *NODE,
        F.when(F.col("type_mask").isNotNull(), J.types_of_mask(F.col("type_mask"))).alias("types"),
        F.lit(None).cast("array<string>").alias("additional"),
    )


def below_dynamic(paths: DataFrame, dynamic: DataFrame) -> DataFrame:
    """Left join of paths with the dynamic paths that are exactly their parent: adds
    ``parent_is_dynamic``."""
    marks = dynamic.select("dataset", F.col("path").alias("_parent")).distinct().withColumn("_hit", F.lit(True))
    parent = F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))
    return (
        paths.withColumn("_parent", parent)
        .join(marks, ["dataset", "_parent"], "left")
        .withColumn("parent_is_dynamic", F.coalesce("_hit", F.lit(False)))
        .drop("_hit", "_parent")
    )


def _inside_dynamic(nodes: DataFrame, dynamic: DataFrame) -> DataFrame:
    """Distinct paths of nodes strictly below some dynamic path."""
    above = F.transform(
        F.filter(F.sequence(F.lit(0), F.size("path") - 1), lambda n: n > 0),
        lambda n: F.slice("path", 1, n),
    )
    marks = dynamic.select("dataset", F.col("path").alias("prefix")).distinct()
    marks = materialize(marks, "dynamic-marks")
    below = nodes.select(*NODE, F.explode(above).alias("prefix"))
    return size_checked_join(below, marks, ["dataset", "prefix"], "left_semi").select(*NODE).distinct()


def type_union(keys: DataFrame, dynamic: DataFrame) -> DataFrame:
    """Sorted union of the types found under each dynamic path: (dataset, path, additional)."""
    marks = dynamic.select("dataset", "path").distinct()
    unions = keys.groupBy("dataset", F.col("parent_path").alias("path")).agg(F.bit_or("type_mask").alias("_mask"))
    return unions.join(marks, NODE, "left_semi").select(*NODE, J.types_of_mask(F.col("_mask")).alias("additional"))


def nest_schema(keys: DataFrame, dynamic: DataFrame | None = None, keep_keys: bool = False) -> DataFrame:
    """Nodes of the nested schema, with the keys of ``dynamic`` paths abstracted if given.

    By default a dynamic path keeps no keys: it gets ``additionalProperties`` with the union of
    their types, and everything below it goes. With ``keep_keys`` each key that has keys of its own
    stays and gets ``additionalProperties`` instead of a type; its type union is taken from
    children named like the key itself ("object" where there is none), and what is below stays.
    """
    nodes = schema_nodes(keys)
    if dynamic is None:
        return nodes
    if not keep_keys:
        gone = _inside_dynamic(nodes, dynamic)
        return (
            nodes.drop("additional")
            .join(gone, NODE, "left_anti")
            .join(type_union(keys, dynamic), NODE, "left")
            .select(*NODE, "types", "additional")
        )
    objects = without_root(keys).select("dataset", F.col("parent_path").alias("path")).distinct()
    kept = below_dynamic(objects, dynamic).filter("parent_is_dynamic").select(*NODE)
    namesakes = without_root(keys).filter(F.col("key") == F.element_at("parent_path", -1)).select(
        "dataset", F.col("parent_path").alias("path"), F.col("type_mask").alias("namesake")
    )
    object_bit = J.type_bit(F.lit("object"))
    unions = (
        kept.join(namesakes, NODE, "left")
        .withColumn("mask", F.coalesce("namesake", object_bit))
        .groupBy("dataset", F.slice("path", 1, F.size("path") - 1).alias("_parent"))
        .agg(J.types_of_mask(F.bit_or("mask")).alias("additional"))
    )
    abstracted = kept.withColumn("_parent", F.slice("path", 1, F.size("path") - 1)).join(
        unions, ["dataset", "_parent"]
    ).select(*NODE, "additional")
    types = F.when(F.col("additional").isNotNull(), J.empty("array<string>")).otherwise(F.col("types"))
    return nodes.drop("additional").join(abstracted, NODE, "left").select(
        *NODE, types.alias("types"), "additional"
    )


def ascii_json(text: Column) -> Column:
    """A text as a JSON string in which characters beyond ASCII are written as escapes."""
    def unit(n):
        return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))

    def escaped(c):
        point = F.ascii(c)
        astral = point - 0x10000
        return (
            F.when(point < 128, c)
            .when(point < 0x10000, unit(point))
            .otherwise(
                F.concat(
                    unit(F.shiftright(astral, 10) + 0xD800),
                    unit(astral.bitwiseAND(F.lit(0x3FF)) + 0xDC00),
                )
            )
        )

    plain = F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)
    spelled = F.array_join(F.transform(F.split(plain, ""), escaped), "")
    return F.when(F.regexp_like(plain, F.lit(r"\A[\x00-\x7f]*\z")), plain).otherwise(spelled)


def _type_lines(label: str, types: Column, level: Column, last: Column) -> Column:
    """Lines of a list of type names under a label."""
    names = F.transform(
        types,
        lambda t, i: F.concat(
            _indent(level + 1), F.lit('"'), t, F.lit('"'), F.when(i < F.size(types) - 1, ",").otherwise("")
        ),
    )
    return F.concat(
        F.array(F.concat(_indent(level), F.lit(f'"{label}": ['))),
        names,
        F.array(F.concat(_indent(level), F.lit("]"), F.when(last, "").otherwise(","))),
    )


def _indent(level: Column) -> Column:
    return F.repeat(F.lit("  "), level)


def schema_lines(nodes: DataFrame) -> DataFrame:
    """The nested schemas as lines of JSON indented by two: (dataset, position, number, line).

    Ordered by dataset, position and number the lines of a dataset are its document, keys sorted.
    """
    parent = F.slice("path", 1, F.size("path") - 1)
    name = F.element_at("path", -1)
    placed = nodes.select(*NODE, "types", "additional", parent.alias("parent"), name.alias("name"))
    families = placed.groupBy("dataset", F.col("parent").alias("path")).agg(F.max("name").alias("last_child"))
    with_children = placed.join(families.withColumnRenamed("last_child", "_own_last"), NODE, "left")
    with_place = with_children.join(
        families.select("dataset", F.col("path").alias("parent"), F.col("last_child").alias("_last_sibling")),
        ["dataset", "parent"],
        "left",
    )
    level = F.size("path") * 2
    has_children = F.col("_own_last").isNotNull()
    comma = F.when(F.col("name") == F.col("_last_sibling"), "").otherwise(",")
    none = J.empty("array<string>")
    extra = F.col("additional")
    ends_here = ~has_children & extra.isNull()
    type_part = (
        F.when(F.size("types") == 0, none)
        .when(F.col("types").isNotNull(), _type_lines("type", F.col("types"), level + 1, ends_here))
        .otherwise(F.array(F.concat(
            _indent(level + 1), F.lit('"type": "object"'), F.when(ends_here, "").otherwise(",")
        )))
    )
    extra_part = F.when(
        extra.isNotNull(),
        F.concat(
            F.array(F.concat(_indent(level + 1), F.lit('"additionalProperties": {'))),
            _type_lines("type", extra, level + 2, F.lit(True)),
            F.array(F.concat(_indent(level + 1), F.lit("}"), F.when(has_children, ",").otherwise(""))),
        ),
    ).otherwise(none)
    opening = F.concat(
        F.array(F.concat(_indent(level), ascii_json(F.col("name")), F.lit(": {"))),
        type_part,
        extra_part,
        F.when(has_children, F.array(F.concat(_indent(level + 1), F.lit('"properties": {')))).otherwise(none),
    )
    closing = F.concat(
        F.when(has_children, F.array(F.concat(_indent(level + 1), F.lit("}")))).otherwise(none),
        F.array(F.concat(_indent(level), F.lit("}"), comma)),
    )
    here = F.transform("path", lambda p: F.concat(F.lit("k"), p))
    blocks = F.array(
        F.struct(here.alias("position"), opening.alias("lines")),
        F.struct(F.array_append(here, F.lit("z")).alias("position"), closing.alias("lines")),
    )
    body = with_place.select("dataset", F.inline(blocks)).select(
        "dataset", "position", F.posexplode("lines").alias("number", "line")
    )
    frame = nodes.select("dataset").distinct().select(
        "dataset",
        F.inline(F.array(
            F.struct(J.empty("array<string>").alias("position"),
                     F.array(F.lit("{"), F.lit('  "type": "object",'), F.lit('  "properties": {')).alias("lines")),
            F.struct(F.array(F.lit("z")).alias("position"), F.array(F.lit("  }"), F.lit("}")).alias("lines")),
        )),
    ).select("dataset", "position", F.posexplode("lines").alias("number", "line"))
    return body.unionByName(frame)


def ordered_lines(lines: DataFrame) -> DataFrame:
    """Lines in document order, for writing."""
    return lines.orderBy("dataset", "position", "number").select("dataset", "line")


def write_schema_lines(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write each dataset's schema document to its own folder, as parts in order."""
    ordered_lines(lines).withColumnRenamed("line", "value").write.mode(mode).partitionBy("dataset").text(path)


def schema_kb(lines: DataFrame) -> DataFrame:
    """Size of each schema document: dataset, bytes, kb (1024 bytes, two decimals)."""
    size = (F.sum(F.octet_length("line").cast("bigint") + 1) - 1).alias("bytes")
    return lines.groupBy("dataset").agg(size).withColumn("kb", F.round(F.col("bytes") / 1024, 2))


def schema_text(lines: DataFrame, max_bytes: int = 16 * 1024 * 1024) -> DataFrame:
    """Schema documents as text: (dataset, part, schema_json).

    A document up to ``max_bytes`` is one row, part 0. A larger one comes in numbered parts of
    about that size, cut between lines; put together by line feeds they are the document.
    """
    sizes = materialize(schema_kb(lines).select("dataset", "bytes"), "schema-sizes")
    large = sizes.filter(F.col("bytes") > max_bytes)
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "number", "line"))), lambda p: p.line), "\n"
    ).alias("schema_json")
    small = lines.join(large, "dataset", "left_anti").groupBy("dataset").agg(joined)
    whole = small.select("dataset", F.lit(0).alias("part"), "schema_json")
    total = large.agg(F.sum("bytes")).first()[0]
    if not total:
        return whole
    ranges = -(-int(total) // max_bytes)
    dealt = lines.join(large.select("dataset"), "dataset", "left_semi").repartitionByRange(
        ranges, "dataset", "position", "number"
    )
    dealt = materialize(dealt.withColumn("_range", F.spark_partition_id()), "schema-ranges")
    parts = dealt.groupBy("dataset", "_range").agg(joined)
    in_order = F.row_number().over(Window.partitionBy("dataset").orderBy("_range")) - 1
    return whole.unionByName(parts.select("dataset", in_order.alias("part"), "schema_json"))


def schema_sizes(original: DataFrame, abstracted: DataFrame) -> DataFrame:
    """Sizes of both forms per dataset and the share saved: dataset, original_kb, abstracted_kb,
    reduction."""
    a = schema_kb(original).select("dataset", F.col("kb").alias("original_kb"))
    b = schema_kb(abstracted).select("dataset", F.col("kb").alias("abstracted_kb"))
    saved = (F.col("original_kb") - F.col("abstracted_kb")) / F.col("original_kb")
    return a.join(b, "dataset").withColumn(
        "reduction", F.when(F.col("original_kb") > 0, saved).otherwise(F.lit(0.0))
    )


def reduction_summary(sizes: DataFrame) -> DataFrame:
    """Averages over datasets: sizes to two decimals, reduction to four; 0 where there is none."""
    return sizes.agg(
        F.coalesce(F.round(F.avg("original_kb"), 2), F.lit(0.0)).alias("original_kb"),
        F.coalesce(F.round(F.avg("abstracted_kb"), 2), F.lit(0.0)).alias("abstracted_kb"),
        F.coalesce(F.round(F.avg("reduction"), 4), F.lit(0.0)).alias("average_reduction"),
    )
