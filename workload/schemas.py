"""Facts read off schemas."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import matching, schema_paths, schema_rewrite
from keyloom.sources import schemas as sources
from keyloom.session import materialize
from workload import inputs as I
from workload.registry import query

# Expected results walk the schemas with one recursive query. A node is a JSON value together with
# what it stands for: S a schema, P properties, R patternProperties, A a list of schemas, X other.
_WALK = """
resolved AS (SELECT dataset, schema_json::JSON AS root FROM schemas),
w(dataset, root, st, path, closable, j) AS (
  SELECT dataset, root, 'S', '$', true, root FROM resolved
  UNION ALL
  SELECT dataset, root, st, path, closable,
         CASE WHEN st = 'S' AND json_type(v) = 'OBJECT' AND json_type(v, '$."$ref"') = 'VARCHAR'
              THEN json_extract(root, '/' || ltrim(v ->> '$."$ref"', '#/')) ELSE v END
  FROM (
    SELECT w.dataset, w.root, e.value AS v, w.closable AND e.key IS DISTINCT FROM 'prefixItems' AS closable,
      CASE
        WHEN w.st = 'S' AND json_type(w.j) = 'OBJECT' THEN CASE
          WHEN e.key = 'properties' AND json_type(e.value) = 'OBJECT' THEN 'P'
          WHEN e.key = 'patternProperties' AND json_type(e.value) = 'OBJECT' AND {patterns} THEN 'R'
          WHEN e.key = 'additionalProperties' AND json_type(e.value) = 'OBJECT' THEN 'S'
          WHEN e.key = 'items' AND json_type(e.value) = 'OBJECT' AND {arrays} THEN 'S'
          WHEN e.key = 'items' AND json_type(e.value) = 'ARRAY' AND {item_lists} THEN 'A'
          WHEN e.key = 'prefixItems' AND json_type(e.value) = 'ARRAY' AND {arrays} THEN 'A'
          WHEN e.key IN ('allOf', 'anyOf', 'oneOf') AND json_type(e.value) = 'ARRAY' THEN 'A'
          WHEN e.key = 'then' AND json_type(e.value) = 'OBJECT' AND {then} THEN 'S'
          WHEN e.key = 'else' AND json_type(e.value) = 'OBJECT' AND {otherwise} THEN 'S'
          ELSE 'X' END
        WHEN w.st IN ('P', 'R', 'A') AND json_type(e.value) = 'OBJECT' THEN 'S'
        ELSE 'X' END AS st,
      CASE
        WHEN w.st = 'P' THEN w.path || '/' || e.key
        WHEN w.st = 'R' THEN w.path || '/<regex>' || e.key
        WHEN w.st = 'S' AND e.key = 'additionalProperties' THEN w.path || '{additional}'
        WHEN w.st = 'S' AND e.key IN ('items', 'prefixItems') THEN w.path || '/*'
        ELSE w.path END AS path
    FROM w, json_each(w.j) AS e WHERE json_type(w.j) IN ('OBJECT', 'ARRAY')
  ) AS step WHERE st <> 'X'),
s AS (SELECT dataset, path, closable, j FROM w WHERE st = 'S' AND json_type(j) = 'OBJECT')
"""
_CLOSED = dict(
    patterns="true", arrays="true", item_lists="true", additional="/<any>",
    then="json_type(w.j, '$.if') = 'OBJECT'", otherwise="json_type(w.j, '$.if') = 'OBJECT'",
)
_IS_ARRAY = "coalesce(w.j ->> '$.type', '') = 'array'"
_EXPLICIT = dict(
    patterns="false", arrays=_IS_ARRAY, item_lists="false", additional="", then="true", otherwise="false"
)
_OPEN = dict(_EXPLICIT)


def _walk_sql(rules: dict, select: str, schemas: str = I.PART_SCHEMAS) -> str:
    text = _WALK
    for name, value in rules.items():
        text = text.replace("{" + name + "}", value)
    return f"WITH RECURSIVE schemas AS ({schemas}), {text} {select}"


def _paths(df):
    return df.select("dataset", F.array_join(schema_paths.path_text(F.col("path")), "/").alias("path"))


@query(
    "static_paths_closed",
    _walk_sql(_CLOSED, "SELECT DISTINCT dataset, path FROM s WHERE (j -> '$.additionalProperties')::VARCHAR = 'false'"),
)
def static_paths_closed(spark, sf):
    return _paths(schema_paths.static_paths(I.derive(spark, sf, I.PART_SCHEMAS), "closed"))


@query(
    "static_paths_after_closing",
    _walk_sql(_CLOSED, """
    SELECT DISTINCT dataset, path FROM s WHERE (j -> '$.additionalProperties')::VARCHAR = 'false'
      OR (closable AND NOT json_exists(j, '$.additionalProperties')
          AND (j ->> '$.type' = 'object' OR json_exists(j, '$.properties') OR json_exists(j, '$.required')))"""),
)
def static_paths_after_closing(spark, sf):
    return _paths(schema_paths.static_paths(I.derive(spark, sf, I.PART_SCHEMAS), "closed", assume_closed=True))


@query(
    "close_schema_static_paths",
    _walk_sql(_CLOSED, """
    SELECT DISTINCT dataset, path FROM s WHERE (j -> '$.additionalProperties')::VARCHAR = 'false'
      OR (closable AND NOT json_exists(j, '$.additionalProperties')
          AND (j ->> '$.type' = 'object' OR json_exists(j, '$.properties') OR json_exists(j, '$.required')))"""),
)
def close_schema_static_paths(spark, sf):
    """Closing the dereferenced schemas, then reading their closed paths."""
    resolved = materialize(schema_rewrite.dereference(I.derive(spark, sf, I.PART_SCHEMAS)), "resolved")
    closed = materialize(schema_rewrite.close_schema(resolved), "closed")
    return _paths(schema_paths.static_paths(closed, "closed"))


@query(
    "static_paths_explicit",
    _walk_sql(_EXPLICIT, """
    SELECT DISTINCT dataset, CASE
        WHEN ap = 'false' OR (kind = 'OBJECT' AND inner_ap = 'false') THEN path ELSE path || '/<wild>' END AS path
    FROM (SELECT dataset, path, (j -> '$.additionalProperties')::VARCHAR AS ap, json_type(j, '$.additionalProperties') AS kind,
                 (j -> '$.additionalProperties.additionalProperties')::VARCHAR AS inner_ap FROM s) AS x
    WHERE ap IN ('false', 'true') OR kind = 'OBJECT'"""),
)
def static_paths_explicit(spark, sf):
    return _paths(schema_paths.static_paths(I.derive(spark, sf, I.PART_SCHEMAS), "explicit"))


@query(
    "open_paths",
    _walk_sql(dict(_OPEN), """
    SELECT DISTINCT dataset, path, 1 AS flag FROM s
    WHERE j ->> '$.type' = 'object' AND NOT contains(path, '<additional>')
      AND (NOT json_exists(j, '$.additionalProperties') OR (j -> '$.additionalProperties')::VARCHAR = 'true'
           OR json_type(j, '$.additionalProperties') = 'OBJECT' OR json_exists(j, '$.patternProperties'))
    """).replace("THEN w.path || ''", "THEN w.path || '<additional>'").replace(
        "'prefixItems' AND json_type(e.value) = 'ARRAY' AND " + _IS_ARRAY, "'prefixItems' AND json_type(e.value) = 'ARRAY'"),
)
def open_paths(spark, sf):
    found = schema_paths.open_paths(I.derive(spark, sf, I.PART_SCHEMAS))
    return _paths(found).withColumn("flag", F.lit(1))


_POINTERS = """
w(dataset, pointer, j) AS (
  SELECT dataset, '', schema_json::JSON FROM schemas
  UNION ALL
  SELECT w.dataset, CASE WHEN json_type(w.j) = 'ARRAY' THEN w.pointer ELSE w.pointer || '/' || e.key END, e.value
  FROM w, json_each(w.j) AS e WHERE json_type(w.j) IN ('OBJECT', 'ARRAY')),
dynamic AS (
  SELECT dataset, pointer FROM w WHERE json_type(j) = 'OBJECT' AND (json_exists(j, '$.patternProperties')
    OR (NOT json_exists(j, '$.properties') AND json_exists(j, '$.additionalProperties')
        AND (j -> '$.additionalProperties')::VARCHAR <> 'false')))
"""


@query(
    "dynamic_parents",
    f"WITH RECURSIVE schemas AS ({I.PART_SCHEMAS}), {_POINTERS} SELECT dataset, pointer FROM dynamic",
)
def dynamic_parents(spark, sf):
    found = schema_paths.dynamic_parents(I.derive(spark, sf, I.PART_SCHEMAS))
    steps = F.transform("pointer", lambda p: F.concat(F.lit("/"), p))
    return found.select("dataset", F.array_join(steps, "").alias("pointer"))


@query(
    "count_dynamic_keys",
    f"""WITH RECURSIVE schemas AS ({I.PART_SCHEMAS}), {_POINTERS}
    SELECT s.dataset, count(d.pointer) AS dynamic_keys FROM schemas AS s LEFT JOIN dynamic AS d USING (dataset) GROUP BY 1""",
)
def count_dynamic_keys(spark, sf):
    return schema_paths.count_dynamic_keys(I.derive(spark, sf, I.PART_SCHEMAS))


@query(
    "strip_keywords",
    f"""WITH RECURSIVE schemas AS ({I.PART_SCHEMAS}), {_POINTERS}
    SELECT dataset, array_to_string(list_concat(['$'], list_filter(string_split(pointer, '/')[2:],
      lambda p: p NOT IN ('definitions', '$defs', 'properties', 'patternProperties', 'oneOf', 'allOf', 'anyOf', 'items'))), '/') AS path
    FROM dynamic WHERE NOT list_contains(string_split(pointer, '/'), 'items')""",
)
def strip_keywords(spark, sf):
    found = schema_paths.strip_keywords(schema_paths.dynamic_parents(I.derive(spark, sf, I.PART_SCHEMAS)))
    return found.select("dataset", F.array_join("path", "/").alias("path"))


_PATTERNED = _walk_sql(
    dict(_CLOSED, then="true", otherwise="false"),
    "SELECT dataset, bool_or(json_exists(j, '$.patternProperties')) AS has_pattern_properties FROM s GROUP BY 1",
)


@query("has_pattern_properties", _PATTERNED)
def has_pattern_properties(spark, sf):
    return schema_paths.has_pattern_properties(I.derive(spark, sf, I.PART_SCHEMAS))


@query(
    "skip_patterned_datasets",
    f"SELECT dataset FROM ({_PATTERNED}) AS p WHERE NOT has_pattern_properties",
)
def skip_patterned_datasets(spark, sf):
    schemas = I.derive(spark, sf, I.PART_SCHEMAS)
    patterned = schema_paths.has_pattern_properties(schemas).filter("has_pattern_properties")
    return matching.skip_datasets(schemas, patterned).select("dataset")


@query(
    "dynamic_paths_dotted",
    f"""WITH RECURSIVE schemas AS ({I.PART_SCHEMAS}),
    w(dataset, path, j) AS (
      SELECT dataset, '', schema_json::JSON FROM schemas
      UNION ALL
      SELECT w.dataset, CASE WHEN json_exists(w.j, '$.properties') THEN w.path || '.' || e.key ELSE w.path || '.*' END, e.value
      FROM w, json_each(CASE WHEN json_exists(w.j, '$.properties') AND json_exists(w.j, '$.patternProperties') THEN '[]'::JSON
                WHEN json_exists(w.j, '$.properties') THEN w.j -> '$.properties'
                WHEN len(json_keys(w.j, '$.patternProperties')) = 1 THEN w.j -> '$.patternProperties' ELSE '[]'::JSON END) AS e
      WHERE json_type(w.j) = 'OBJECT')
    SELECT DISTINCT dataset, path AS dotted_path FROM w
    WHERE json_type(j) = 'OBJECT' AND NOT json_exists(j, '$.properties') AND len(json_keys(j, '$.patternProperties')) = 1""",
)
def dynamic_paths_dotted(spark, sf):
    return schema_paths.dynamic_paths_dotted(I.derive(spark, sf, I.PART_SCHEMAS))


@query(
    "draft_version",
    f"""SELECT dataset, CASE WHEN contains(u, '2020-12') THEN '2020-12' WHEN contains(u, '2019-09') THEN '2019-09'
        WHEN contains(u, 'draft-07') THEN 'draft7' WHEN contains(u, 'draft-06') THEN 'draft6'
        WHEN contains(u, 'draft-04') THEN 'draft4' WHEN contains(u, 'draft-03') THEN 'draft3' ELSE 'draft7' END AS draft
    FROM (SELECT dataset, coalesce(schema_json ->> '$."$schema"', '') AS u FROM ({I.PART_SCHEMAS}) AS s) AS x""",
)
def draft_version(spark, sf):
    return I.derive(spark, sf, I.PART_SCHEMAS).select(
        "dataset", sources.draft_version(F.col("schema_json")).alias("draft")
    )


@query(
    "schema_properties",
    f"""SELECT dataset, array_to_string(list_sort(json_keys(schema_json, '$.properties')), ',') AS properties
    FROM ({I.PART_SCHEMAS}) AS s""",
)
def schema_properties(spark, sf):
    found = sources.schema_properties(I.derive(spark, sf, I.PART_SCHEMAS))
    return found.select("dataset", F.array_join(F.array_sort("properties"), ",").alias("properties"))


@query(
    "resolve_ref",
    f"""SELECT dataset, ref, json_type(target) AS target_type, coalesce(len(json_keys(target)), 0) AS target_keys FROM (
      SELECT dataset, ref, json_extract(root, '/' || ltrim(ref, '#/')) AS target FROM (
        SELECT dataset, root, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(root::VARCHAR, '"\\$ref":"([^"]*)"', 1), lambda r: r), lambda r: r <> ''))) AS ref
        FROM (SELECT dataset, schema_json::JSON AS root FROM ({I.PART_SCHEMAS}) AS s) AS x) AS y) AS z""",
)
def resolve_ref(spark, sf):
    found = schema_rewrite.resolve_ref(I.derive(spark, sf, I.PART_SCHEMAS))
    is_found = F.col("target_json").isNotNull()
    return found.select(
        "dataset", "ref", F.when(is_found, "OBJECT").alias("target_type"),
        F.coalesce(F.size(F.json_object_keys("target_json")), F.lit(0)).cast("bigint").alias("target_keys"),
    )


@query(
    "dereference",
    f"""SELECT dataset, CASE WHEN contains(schema_json, '#/definitions/missing') THEN 1 ELSE 0 END AS dereferenced,
        CASE WHEN contains(schema_json, '#/definitions/d"') THEN 1 ELSE 0 END AS replaced,
        CASE WHEN contains(schema_json, '#/definitions/missing') THEN 1 ELSE 0 END AS refs_left
    FROM ({I.PART_SCHEMAS}) AS s""",
)
def dereference(spark, sf):
    before = I.derive(spark, sf, I.PART_SCHEMAS)
    with_old = before.withColumn("old", F.col("schema_json"))
    after = schema_rewrite.dereference(with_old)
    refs = F.regexp_count("schema_json", F.lit('"[$]ref"'))
    return after.select(
        "dataset", "dereferenced",
        (F.regexp_count("old", F.lit('"[$]ref"')) - refs).alias("replaced"), refs.alias("refs_left"),
    )
