"""Sources, flattening, types and document filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.functions import json_values as J
from keyloom.operators import flatten as flat
from keyloom.operators import matching
from keyloom.sources import documents as sources
from keyloom.sources import schemas as schema_sources
from workload import inputs as I
from workload.registry import path_column, query



@query(
    "flatten_line_paths",
    I.with_docs(I.LINE_DOCS, I.ITEMS_SQL, I.NODES_SQL, select=f"""
    SELECT dataset, array_to_string(path, '/') AS path, is_index, {I.TYPE_SQL} AS json_type, count(*) AS n
    FROM nodes WHERE len(path) > 1 GROUP BY 1, 2, 3, 4"""),
)
def flatten_line_paths(spark, sf):
    rows = flat.flatten_json(flat.document_items(I.derive(spark, sf, I.LINE_DOCS)))
    return rows.groupBy("dataset", path_column(), "is_index", "json_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "flatten_line_paths_bounded",
    I.with_docs(I.LINE_DOCS, I.ITEMS_SQL, I.NODES_SQL, select="""
    SELECT dataset, len(path) - 1 AS depth, count(*) AS n FROM nodes WHERE len(path) > 1 GROUP BY 1, 2"""),
)
def flatten_line_paths_bounded(spark, sf):
    items = flat.document_items(I.derive(spark, sf, I.LINE_DOCS))
    rows = flat.flatten_json(items, max_depth=7)
    return rows.groupBy("dataset", J.nesting_depth(F.col("path")).alias("depth")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "flatten_events_objects_only",
    I.with_docs(I.EVENT_DOCS, "parsed AS (SELECT dataset, json::JSON AS j FROM docs WHERE json_valid(json))", """
    nodes(dataset, path, j) AS (
      SELECT dataset, ['$'], j FROM parsed
      UNION ALL
      SELECT n.dataset, list_append(n.path, e.key), e.value FROM nodes AS n, json_each(n.j) AS e
      WHERE json_type(n.j) = 'OBJECT')""", select=f"""
    SELECT dataset, array_to_string(path, '/') AS path, {I.TYPE_SQL} AS json_type, count(*) AS n
    FROM nodes GROUP BY 1, 2, 3"""),
)
def flatten_events_objects_only(spark, sf):
    docs = I.derive(spark, sf, I.EVENT_DOCS)
    parsed = docs.select("dataset", J.parse(F.col("json")).alias("doc")).filter(F.col("doc").isNotNull())
    rows = flat.flatten_json(parsed, descend_arrays=False, include_root=True)
    return rows.groupBy("dataset", path_column(), "json_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "container_sizes_lines",
    I.with_docs(I.LINE_DOCS, I.ITEMS_SQL, I.NODES_SQL, select="""
    SELECT dataset, array_to_string(path, '/') AS path,
           sum(CASE json_type(j) WHEN 'OBJECT' THEN len(json_keys(j)) WHEN 'ARRAY' THEN json_array_length(j) ELSE 0 END)::BIGINT AS total_size
    FROM nodes WHERE len(path) > 1 GROUP BY 1, 2"""),
)
def container_sizes_lines(spark, sf):
    items = flat.document_items(I.derive(spark, sf, I.LINE_DOCS))
    rows = flat.flatten_json(items, with_values=True)
    return rows.groupBy("dataset", path_column()).agg(F.sum("size").alias("total_size"))


@query(
    "value_types_orders",
    I.with_docs(I.ORDER_DOCS, I.ITEMS_SQL, I.NODES_SQL, select="""
    SELECT t AS json_type, CASE t WHEN 'object' THEN 'dict' WHEN 'array' THEN 'list' WHEN 'string' THEN 'str'
             WHEN 'boolean' THEN 'bool' WHEN 'null' THEN 'NoneType' WHEN 'number' THEN 'float' ELSE 'int' END AS python_type,
           count(*) AS n
    FROM (SELECT """ + I.TYPE_SQL + """ AS t FROM nodes WHERE len(path) > 1) AS x GROUP BY 1, 2"""),
)
def value_types_orders(spark, sf):
    rows = flat.flatten_json(flat.document_items(I.derive(spark, sf, I.ORDER_DOCS)))
    return rows.groupBy("json_type").agg(F.count(F.lit(1)).alias("n")).select(
        "json_type", J.python_type(F.col("json_type")).alias("python_type"), "n"
    )


@query(
    "depth_levels_lines",
    I.with_docs(I.LINE_DOCS, I.ITEMS_SQL, I.NODES_SQL, select="""
    SELECT dataset, CASE WHEN d <= 3 THEN 'shallow' WHEN d <= 6 THEN 'moderate' ELSE 'deep' END AS depth_level,
           count(*) AS n, max(d) AS deepest
    FROM (SELECT dataset, len(path) - 1 AS d FROM nodes WHERE len(path) > 1) AS x GROUP BY 1, 2"""),
)
def depth_levels_lines(spark, sf):
    rows = flat.flatten_json(flat.document_items(I.derive(spark, sf, I.LINE_DOCS)))
    depth = J.nesting_depth(F.col("path"))
    return rows.groupBy("dataset", J.depth_level(depth).alias("depth_level")).agg(
        F.count(F.lit(1)).alias("n"), F.max(depth).alias("deepest")
    )


@query(
    "key_split_orders",
    I.with_docs(I.ORDER_DOCS, I.ITEMS_SQL, I.NODES_SQL, select="""
    SELECT array_to_string(path[:-2], '/') AS parent_path, path[-1] AS key, count(*) AS n
    FROM nodes WHERE len(path) > 1 AND NOT is_index GROUP BY 1, 2"""),
)
def key_split_orders(spark, sf):
    rows = flat.flatten_json(flat.document_items(I.derive(spark, sf, I.ORDER_DOCS)))
    return flat.object_members(rows).groupBy(
        F.array_join("parent_path", "/").alias("parent_path"), "key"
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "document_items_events",
    I.with_docs(I.EVENT_DOCS, I.ITEMS_SQL, select="""
    SELECT dataset, doc_id, array_to_string(list_sort(json_keys(doc)), ',') AS keys, count(*) AS n
    FROM items GROUP BY 1, 2, 3"""),
)
def document_items_events(spark, sf):
    items = flat.document_items(I.derive(spark, sf, I.EVENT_DOCS))
    keys = F.array_join(F.array_sort(flat.root_keys()), ",")
    return items.groupBy("dataset", "doc_id", keys.alias("keys")).agg(F.count(F.lit(1)).alias("n"))


_MATCH_SQL = """
props AS (SELECT dataset, json_keys(schema_json, '$.properties') AS names FROM schemas),
matched AS (
  SELECT i.dataset, i.doc_id, i.doc, coalesce(len(list_intersect(json_keys(i.doc), p.names)) > 0, false) AS matches
  FROM items AS i LEFT JOIN props AS p USING (dataset))
"""


@query(
    "match_properties_events",
    I.with_docs(I.EVENT_DOCS, f"schemas AS ({I.EVENT_SCHEMAS})", I.ITEMS_SQL, _MATCH_SQL, select="""
    SELECT dataset, doc_id, count(*) AS n FROM matched WHERE matches GROUP BY 1, 2"""),
)
def match_properties_events(spark, sf):
    items = flat.document_items(I.derive(spark, sf, I.EVENT_DOCS))
    kept = matching.match_properties(items, I.derive(spark, sf, I.EVENT_SCHEMAS))
    return kept.groupBy("dataset", "doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "match_ratio_events",
    I.with_docs(I.EVENT_DOCS, f"schemas AS ({I.EVENT_SCHEMAS})", I.ITEMS_SQL, _MATCH_SQL, select="""
    SELECT dataset, count(*) AS documents, count(*) FILTER (WHERE matches) AS matching,
           round((count(*) FILTER (WHERE matches)) / count(*), 6) AS ratio
    FROM matched GROUP BY ROLLUP (dataset)"""),
)
def match_ratio_events(spark, sf):
    items = flat.document_items(I.derive(spark, sf, I.EVENT_DOCS))
    ratios = matching.match_ratio(items, I.derive(spark, sf, I.EVENT_SCHEMAS))
    return ratios.withColumn("ratio", F.round("ratio", 6))


@query(
    "keep_listed_datasets_orders",
    I.with_docs(I.ORDER_DOCS, select="""
    SELECT dataset, count(*) AS documents FROM docs
    WHERE dataset IN (SELECT concat('orders-', o_orderstatus, '.json') FROM orders GROUP BY o_orderstatus HAVING avg(o_totalprice) > 0 AND o_orderstatus <> 'P')
    GROUP BY 1"""),
)
def keep_listed_datasets_orders(spark, sf):
    orders = I.table(spark, sf, "orders")
    listed = orders.groupBy("o_orderstatus").agg(F.avg("o_totalprice").alias("a")).filter(
        (F.col("a") > 0) & (F.col("o_orderstatus") != "P")
    ).select(F.concat(F.lit("orders-"), "o_orderstatus", F.lit(".json")).alias("dataset"))
    kept = matching.keep_datasets(I.derive(spark, sf, I.ORDER_DOCS), listed)
    return kept.groupBy("dataset").agg(F.count(F.lit(1)).alias("documents"))


@query(
    "bad_record_counts_events",
    I.with_docs(I.EVENT_DOCS, select="""
    SELECT dataset, count(*) AS documents, count(*) FILTER (WHERE NOT json_valid(json)) AS bad_documents
    FROM docs GROUP BY 1"""),
)
def bad_record_counts_events(spark, sf):
    return sources.bad_record_policy(I.derive(spark, sf, I.EVENT_DOCS), "count")


@query(
    "bad_record_quarantine_events",
    I.with_docs(I.EVENT_DOCS, select="SELECT dataset, doc_id, json FROM docs WHERE NOT json_valid(json)"),
)
def bad_record_quarantine_events(spark, sf):
    return sources.bad_record_policy(I.derive(spark, sf, I.EVENT_DOCS), "quarantine")


@query(
    "bad_record_drop_events",
    I.with_docs(I.EVENT_DOCS, select="SELECT dataset, doc_id, json FROM docs WHERE json_valid(json)"),
)
def bad_record_drop_events(spark, sf):
    return sources.bad_record_policy(I.derive(spark, sf, I.EVENT_DOCS), "drop")


@query(
    "bad_record_fail_orders",
    I.with_docs(I.ORDER_DOCS, select="SELECT dataset, count(*) AS documents, sum(length(json))::BIGINT AS chars FROM docs GROUP BY 1"),
)
def bad_record_fail_orders(spark, sf):
    checked = sources.bad_record_policy(I.derive(spark, sf, I.ORDER_DOCS), "fail")
    return checked.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.length("json")).alias("chars")
    )


@query(
    "schema_name_from_url_pages",
    """SELECT page_id, regexp_replace(split_part(url, '/', -1), '\\.yaml$', '.json') AS schema_name,
              regexp_replace(split_part(concat(url, '.yaml'), '/', -1), '\\.yaml$', '.json') AS converted_name FROM pages""",
)
def schema_name_from_url_pages(spark, sf):
    pages = I.table(spark, sf, "pages")
    return pages.select(
        "page_id",
        schema_sources.schema_name_from_url(F.col("url")).alias("schema_name"),
        schema_sources.schema_name_from_url(F.concat("url", F.lit(".yaml"))).alias("converted_name"),
    )
