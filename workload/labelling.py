"""Labels for observed paths, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import flatten as flat
from keyloom.operators import labels, metrics, profile, sampling, schema_paths
from keyloom.plans import features
from keyloom.session import materialize
from workload import inputs as I
from workload.registry import path_column, query
from workload.schemas import _CLOSED, _EXPLICIT, _POINTERS, _WALK

_DOCS_AND_WALK = "schemas AS (" + I.LINE_SCHEMAS + ")"


def _walk(rules: dict) -> str:
    text = _WALK
    for name, value in rules.items():
        text = text.replace("{" + name + "}", value)
    return text


def observed_lines(spark, sf):
    items = flat.document_items(I.derive(spark, sf, I.LINE_DOCS))
    keys = profile.key_frequency(flat.flatten_json(items))
    return materialize(profile.parent_frequency(keys).withColumnRenamed("parent_path", "path"), "observed")


_OBSERVED = """
observed AS (SELECT DISTINCT dataset, path[:-2] AS path FROM nodes WHERE NOT is_index AND len(path) > 1)
"""

_STEP_FITS = """
list_bool_and(list_transform(list_zip(o.path, string_split(p.path, '/')), lambda z:
  CASE WHEN z[2] = '<any>' THEN true
       WHEN starts_with(z[2], '<regex>') THEN regexp_full_match(z[1], substr(z[2], 8))
       ELSE z[1] = z[2] END))
"""


@query(
    "label_paths_closed",
    I.with_docs(I.LINE_DOCS, I.ITEMS_SQL, I.NODES_SQL, _OBSERVED, _DOCS_AND_WALK, _walk(_CLOSED), """
    static AS (SELECT DISTINCT dataset, path FROM s WHERE (j -> '$.additionalProperties')::VARCHAR = 'false')""",
    select=f"""
    SELECT o.dataset, array_to_string(o.path, '/') AS path,
           CASE WHEN EXISTS (SELECT 1 FROM static AS p WHERE p.dataset = o.dataset
             AND len(string_split(p.path, '/')) = len(o.path) AND {_STEP_FITS}) THEN 0 ELSE 1 END AS label
    FROM observed AS o"""),
)
def label_paths_closed(spark, sf):
    static = schema_paths.static_paths(I.derive(spark, sf, I.LINE_SCHEMAS), "closed")
    return labels.label_paths(observed_lines(spark, sf), static, "closed").select("dataset", path_column(), "label")


@query(
    "recursive_static_paths_lines",
    I.with_docs(I.LINE_DOCS, I.ITEMS_SQL, I.NODES_SQL, _OBSERVED, select="""
    SELECT dataset, array_to_string(path, '/') AS path FROM observed
    WHERE len(list_filter(path[2:], lambda p: p NOT IN ('deep', 'a', 'b'))) = 0"""),
)
def recursive_static_paths_lines(spark, sf):
    """A recursive schema, walked as far as the documents go."""
    schemas = I.derive(spark, sf, I.RECURSIVE_SCHEMAS)
    static = schema_paths.static_paths(schemas, "closed", observed=observed_lines(spark, sf))
    return static.select("dataset", F.array_join(schema_paths.path_text(F.col("path")), "/").alias("path"))


@query(
    "label_paths_explicit",
    I.with_docs(I.LINE_DOCS, I.ITEMS_SQL, I.NODES_SQL, _OBSERVED, _DOCS_AND_WALK, _walk(_EXPLICIT), """
    static AS (
      SELECT DISTINCT dataset, path, NOT (ap = 'false' OR (kind = 'OBJECT' AND inner_ap = 'false')) AS wild
      FROM (SELECT dataset, path, (j -> '$.additionalProperties')::VARCHAR AS ap, json_type(j, '$.additionalProperties') AS kind,
                   (j -> '$.additionalProperties.additionalProperties')::VARCHAR AS inner_ap FROM s) AS x
      WHERE ap IN ('false', 'true') OR kind = 'OBJECT')""",
    select="""
    SELECT dataset, path, CASE WHEN opened THEN 1 WHEN closed THEN 0 ELSE 1 END AS label FROM (
      SELECT o.dataset, array_to_string(o.path, '/') AS path,
        EXISTS (SELECT 1 FROM static AS p WHERE p.dataset = o.dataset AND p.wild AND p.path = array_to_string(o.path, '/')) AS opened,
        EXISTS (SELECT 1 FROM static AS p WHERE p.dataset = o.dataset AND (
          (NOT p.wild AND p.path = array_to_string(o.path, '/'))
          OR (p.wild AND starts_with(array_to_string(o.path, '/'), p.path || '/')))) AS closed
      FROM observed AS o) AS x"""),
)
def label_paths_explicit(spark, sf):
    static = schema_paths.static_paths(I.derive(spark, sf, I.LINE_SCHEMAS), "explicit")
    return labels.label_paths(observed_lines(spark, sf), static, "explicit").select("dataset", path_column(), "label")


_STRIPPED = """
dynamic_paths AS (
  SELECT dataset, list_concat(['$'], list_filter(string_split(pointer, '/')[2:],
    lambda p: p NOT IN ('definitions', '$defs', 'properties', 'patternProperties', 'oneOf', 'allOf', 'anyOf', 'items'))) AS path
  FROM dynamic WHERE NOT list_contains(string_split(pointer, '/'), 'items'))
"""


@query(
    "label_paths_pattern",
    I.with_docs(I.LINE_DOCS, I.ITEMS_SQL, I.NODES_SQL, _OBSERVED, _DOCS_AND_WALK, _POINTERS, _STRIPPED, select="""
    SELECT o.dataset, array_to_string(o.path, '/') AS path,
      CASE WHEN EXISTS (SELECT 1 FROM dynamic_paths AS p WHERE p.dataset = o.dataset AND len(p.path) = len(o.path)
        AND list_bool_and(list_transform(list_zip(o.path, p.path), lambda z: z[1] = z[2] OR regexp_matches(z[1], concat('^(?:', z[2], ')')))))
      THEN 1 ELSE 0 END AS label
    FROM observed AS o"""),
)
def label_paths_pattern(spark, sf):
    dynamic = schema_paths.strip_keywords(schema_paths.dynamic_parents(I.derive(spark, sf, I.LINE_SCHEMAS)))
    return labels.label_paths(observed_lines(spark, sf), dynamic, "pattern").select("dataset", path_column(), "label")


@query(
    "segment_match_full",
    I.with_docs(I.LINE_DOCS, I.ITEMS_SQL, I.NODES_SQL, _OBSERVED, """
    patterns AS (SELECT DISTINCT concat('line-', l_returnflag, '.json') AS dataset, ['$', 'part[s+', concat('p', l_linenumber, '.*')] AS path FROM lineitem
                 UNION ALL SELECT DISTINCT concat('line-', l_returnflag, '.json'), ['$', 'part.', concat('p', l_linenumber, '.*')] FROM lineitem)""",
    select="""
    SELECT o.dataset, array_to_string(o.path, '/') AS path FROM observed AS o
    SEMI JOIN (SELECT DISTINCT dataset, path[3] AS last FROM patterns WHERE path[2] = 'part.') AS p
      ON p.dataset = o.dataset AND len(o.path) = 3 AND o.path[1] = '$' AND regexp_full_match(o.path[2], 'part.')
      AND regexp_full_match(o.path[3], p.last)"""),
)
def segment_match_full(spark, sf):
    """Patterns from the line numbers, with a step that is no regular expression on half of them."""
    lines = I.table(spark, sf, "lineitem").select(
        F.concat(F.lit("line-"), "l_returnflag", F.lit(".json")).alias("dataset"),
        F.concat(F.lit("p"), "l_linenumber", F.lit(".*")).alias("last"),
    ).distinct()
    second = F.explode(F.array(F.lit("part[s+"), F.lit("part."))).alias("second")
    patterns = lines.select("dataset", "last", second).select(
        "dataset", F.array(F.lit("$"), F.col("second"), F.col("last")).alias("path")
    )
    found = labels.matched_by_segments(observed_lines(spark, sf), patterns)
    return found.select("dataset", path_column())


@query(
    "feature_table_lines",
    I.with_docs(I.LINE_DOCS, I.ITEMS_SQL, I.NODES_SQL, I.KEYS_SQL, I.PROFILE_SQL, _DOCS_AND_WALK, _walk(_CLOSED), """
    static AS (SELECT DISTINCT dataset, path FROM s WHERE (j -> '$.additionalProperties')::VARCHAR = 'false')""",
    select=f"""
    SELECT o.dataset, array_to_string(o.path, '/') AS path, o.parent_frequency, o.num_nested_keys, o.datatype_entropy,
           round(o.key_entropy, 10) AS key_entropy,
           CASE WHEN EXISTS (SELECT 1 FROM static AS p WHERE p.dataset = o.dataset
             AND len(string_split(p.path, '/')) = len(o.path) AND {_STEP_FITS}) THEN 0 ELSE 1 END AS label
    FROM (SELECT * REPLACE (string_split(path, '/') AS path) FROM profile) AS o"""),
)
def feature_table_lines(spark, sf):
    table = features.feature_table(I.derive(spark, sf, I.LINE_DOCS), I.derive(spark, sf, I.LINE_SCHEMAS))
    return table.select(
        "dataset", path_column(), "parent_frequency", "num_nested_keys", "datatype_entropy",
        F.round("key_entropy", 10).alias("key_entropy"), "label",
    )


@query(
    "explicit_table_events",
    I.with_docs(I.EVENT_DOCS, I.ITEMS_SQL, "schemas AS (" + I.EVENT_SCHEMAS + ")", """
    props AS (SELECT dataset, json_keys(schema_json, '$.properties') AS names FROM schemas),
    kept AS (SELECT i.dataset, i.doc FROM items AS i JOIN props AS p USING (dataset) WHERE len(list_intersect(json_keys(i.doc), p.names)) > 0)""",
    I.NODES_SQL.replace("FROM items", "FROM kept"), """
    subkeys AS (SELECT DISTINCT dataset, array_to_string(path[:-2], '/') AS path, path[-1] AS key FROM nodes WHERE NOT is_index AND len(path) > 1)""",
    select="""
    SELECT dataset, path, array_to_string(list(key ORDER BY key), ',') AS subkeys,
           CASE WHEN path = '$/by' THEN 0 ELSE 1 END AS label
    FROM subkeys GROUP BY 1, 2"""),
)
def explicit_table_events(spark, sf):
    table = features.explicit_table(I.derive(spark, sf, I.EVENT_DOCS), I.derive(spark, sf, I.EVENT_SCHEMAS))
    return table.select("dataset", path_column(), F.array_join("distinct_subkeys", ",").alias("subkeys"), "label")


@query(
    "jxplain_table_events",
    I.with_docs(I.EVENT_DOCS, "parsed AS (SELECT dataset, json::JSON AS j FROM docs WHERE json_valid(json) AND dataset <> 'event-click.json')", """
    nodes(dataset, path, j) AS (
      SELECT dataset, ['$'], j FROM parsed
      UNION ALL
      SELECT n.dataset, list_append(n.path, e.key), e.value FROM nodes AS n, json_each(n.j) AS e
      WHERE json_type(n.j) = 'OBJECT')""", """
    counts AS (SELECT dataset, array_to_string(path[:-2], '/') AS path, path[-1] AS key, count(*) AS f
               FROM nodes WHERE len(path) > 1 GROUP BY 1, 2, 3),
    n AS (SELECT dataset, count(*) AS n FROM parsed GROUP BY 1)""", select="""
    SELECT dataset, path, array_to_string(list(key ORDER BY key), ',') AS subkeys,
           round(-sum((f / n) * ln(f / n)), 8) + 0.0 AS key_entropy, CASE WHEN path = '$/by' THEN 1 ELSE 0 END AS label
    FROM counts JOIN n USING (dataset) GROUP BY 1, 2"""),
)
def jxplain_table_events(spark, sf):
    table = features.jxplain_table(I.derive(spark, sf, I.EVENT_DOCS), I.derive(spark, sf, I.EVENT_SCHEMAS))
    return table.select(
        "dataset", path_column(), F.array_join("distinct_subkeys", ",").alias("subkeys"),
        (F.round("key_entropy", 8) + 0.0).alias("key_entropy"), "label",
    )


@query(
    "dataset_summary_lines",
    I.with_docs(I.LINE_DOCS, I.ITEMS_SQL, I.NODES_SQL, _OBSERVED, _DOCS_AND_WALK, _walk(_CLOSED), """
    static AS (SELECT DISTINCT dataset, path FROM s WHERE (j -> '$.additionalProperties')::VARCHAR = 'false')""",
    select=f"""
    SELECT o.dataset, count(*) AS total_paths, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM static AS p WHERE p.dataset = o.dataset
             AND len(string_split(p.path, '/')) = len(o.path) AND {_STEP_FITS})) AS static_paths
    FROM observed AS o GROUP BY 1"""),
)
def dataset_summary_lines(spark, sf):
    static = schema_paths.static_paths(I.derive(spark, sf, I.LINE_SCHEMAS), "closed")
    return metrics.dataset_summary(labels.label_paths(observed_lines(spark, sf), static, "closed"))


def _split_sql(table: str, name: str, group: str, ratio: float) -> str:
    return f"""
    WITH groups AS (SELECT DISTINCT {group} AS g FROM {table}),
    ranked AS (SELECT g, row_number() OVER (ORDER BY md5(concat('101|', g)), g) AS r, count(*) OVER () AS n FROM groups)
    SELECT {name}, CASE WHEN r <= floor({ratio} * n) THEN 'train' ELSE 'test' END AS split
    FROM {table} JOIN ranked ON {group} = g"""


@query("group_split_parts", _split_sql("part", "p_partkey", "substr(p_name, 1, 4)", 0.8))
def group_split_parts(spark, sf):
    parts = I.table(spark, sf, "part").select("p_partkey", "p_name")
    return sampling.group_split(parts, "p_name", 0.8, 101).select("p_partkey", "split")


@query("name_split_customers", _split_sql("customer", "c_custkey", "c_name", 1 - 0.2))
def name_split_customers(spark, sf):
    customers = I.table(spark, sf, "customer").select("c_custkey", "c_name")
    return sampling.name_split(customers, "c_name", 0.2, 101).select("c_custkey", "split")


@query(
    "oversample_labels",
    """
    WITH sizes AS (SELECT toxic AS label, count(*) AS n FROM labels GROUP BY 1),
    plan AS (SELECT min(n) AS small, (floor(max(n) * 0.5) - min(n))::BIGINT AS extra, arg_min(label, n) AS minority FROM sizes),
    ranked AS (SELECT doc_id, toxic, row_number() OVER (ORDER BY md5(concat('101|', doc_id)), doc_id) AS r
               FROM labels WHERE toxic = (SELECT minority FROM plan)),
    draws AS (SELECT 1 + ('0x' || substr(md5(concat('101|', d)), 1, 15))::BIGINT % (SELECT small FROM plan) AS r
              FROM (SELECT unnest(range(1, greatest((SELECT extra FROM plan), 0) + 1)) AS d) AS x)
    SELECT doc_id, toxic, 0 AS copy FROM labels
    UNION ALL
    SELECT doc_id, toxic, row_number() OVER (PARTITION BY doc_id) AS copy FROM ranked JOIN draws USING (r)
    """,
)
def oversample_labels(spark, sf):
    rows = I.table(spark, sf, "labels").select("doc_id", "toxic")
    return sampling.oversample(rows, "doc_id", label="toxic", ratio=0.5, seed=101)


@query(
    "train_and_test_parts",
    """
    WITH rows AS (SELECT concat(p_name, '-', p_partkey, '.json') AS dataset, concat('["$","', p_type, '"]') AS path,
                         CASE WHEN p_size > 45 THEN 1 ELSE 0 END AS label FROM part),
    groups AS (SELECT DISTINCT substr(dataset, 1, 4) AS g FROM rows),
    ranked AS (SELECT g, row_number() OVER (ORDER BY md5(concat('101|', g)), g) AS r, count(*) OVER () AS n FROM groups),
    sided AS (SELECT dataset, path, label, r <= floor(0.8 * n) AS trains FROM rows JOIN ranked ON substr(dataset, 1, 4) = g),
    sizes AS (SELECT label, count(*) AS n FROM sided WHERE trains GROUP BY 1),
    plan AS (SELECT min(n) AS small, (floor(max(n) * 0.5) - min(n))::BIGINT AS extra, arg_min(label, n) AS minority FROM sizes),
    minority AS (SELECT dataset, path, label, row_number() OVER (ORDER BY md5(concat('101|', dataset, '|', path)), concat(dataset, '|', path)) AS r
                 FROM sided WHERE trains AND label = (SELECT minority FROM plan)),
    draws AS (SELECT 1 + ('0x' || substr(md5(concat('101|', d)), 1, 15))::BIGINT % (SELECT small FROM plan) AS r
              FROM (SELECT unnest(range(1, greatest((SELECT extra FROM plan), 0) + 1)) AS d) AS x)
    SELECT CASE WHEN trains THEN 'train' ELSE 'test' END AS side, dataset, path, label, 0 AS copy FROM sided
    UNION ALL
    SELECT 'train', dataset, path, label, row_number() OVER (PARTITION BY dataset, path) FROM minority JOIN draws USING (r)
    """,
)
def train_and_test_parts(spark, sf):
    rows = I.table(spark, sf, "part").select(
        F.concat("p_name", F.lit("-"), F.col("p_partkey").cast("string"), F.lit(".json")).alias("dataset"),
        F.array(F.lit("$"), F.col("p_type")).alias("path"),
        F.when(F.col("p_size") > 45, 1).otherwise(0).alias("label"),
    )
    train, test = features.train_and_test(rows, 0.8, 101)
    sides = train.withColumn("side", F.lit("train")).unionByName(
        test.withColumn("copy", F.lit(0).cast("bigint")).withColumn("side", F.lit("test"))
    )
    return sides.select("side", "dataset", F.to_json("path").alias("path"), "label", "copy")


@query(
    "seeded_shuffle_documents",
    """SELECT doc_id, row_number() OVER (ORDER BY md5(concat('7|', doc_id)), doc_id) - 1 AS position FROM documents""",
)
def seeded_shuffle_documents(spark, sf):
    ids = I.table(spark, sf, "documents").select("doc_id")
    return sampling.seeded_shuffle(ids, "doc_id", seed=7, position="position")


@query("ordered_output_orders", I.with_docs(I.ORDER_DOCS, I.ITEMS_SQL, I.NODES_SQL, _OBSERVED, select="""
    SELECT dataset, array_to_string(path, '/') AS path FROM observed ORDER BY 1, 2"""))
def ordered_output_orders(spark, sf):
    keys = profile.key_frequency(flat.flatten_json(flat.document_items(I.derive(spark, sf, I.ORDER_DOCS))))
    paths = keys.select("dataset", F.col("parent_path").alias("path")).distinct()
    return sampling.ordered_output(paths).select("dataset", path_column())
