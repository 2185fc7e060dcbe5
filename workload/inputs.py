"""Documents and schemas derived from the given tables.

Each input is one SELECT that Spark and DuckDB both understand, so that the expected results start
from the same documents. Every row is built from one table row: no group of rows is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LINE_DOCS = """
SELECT concat('line-', l_returnflag, '.json') AS dataset,
       l_orderkey * 8 + l_linenumber AS doc_id,
       concat('{"order":{"key":', l_orderkey, ',"line":', l_linenumber,
              '},"parts":{"p', l_partkey, '":{"qty":', l_quantity, ',"price":', l_extendedprice,
              '}},"flags":[{"name":"ret","v":"', l_returnflag, '"},{"name":"st","v":"', l_linestatus,
              '","n":', CASE WHEN l_linenumber % 2 = 0 THEN 'null' ELSE '1' END,
              '}],"code":', CASE WHEN l_linenumber % 3 = 0 THEN '7' WHEN l_linenumber % 3 = 1 THEN '"x"' ELSE 'true' END,
              ',"deep":{"a":{"b":{"c":[[', l_linenumber, ',{"d":', l_discount, '}]]}}}}') AS json
FROM lineitem
"""

EVENT_DOCS = """
SELECT concat('event-', event_type, '.json') AS dataset,
       event_id AS doc_id,
       CASE WHEN event_id % 23 = 0 THEN '{"id":'
            WHEN event_id % 17 = 0 THEN concat('', event_id)
            WHEN event_id % 10 = 0
            THEN concat('[{"id":', event_id, ',"by":{"u', user_id, '":', props, '}},{"other":1},', user_id, ']')
            ELSE concat('{"id":', event_id, ',"by":{"u', user_id, '":', props, '},"value":', value, '}')
       END AS json
FROM events
"""

ORDER_DOCS = """
SELECT concat('orders-', o_orderstatus, '.json') AS dataset,
       o_orderkey AS doc_id,
       concat('{"customer":{"id":', o_custkey, '},"totals":{"', o_orderpriority, '":', o_totalprice,
              '},"status":"', o_orderstatus, '"',
              CASE WHEN o_orderkey % 4 = 0 THEN ',"extra":[]' WHEN o_orderkey % 4 = 1 THEN ',"extra":{}' ELSE '' END,
              '}') AS json
FROM orders
"""

LINE_SCHEMAS = """
SELECT dataset,
       '{"$schema":"http://json-schema.org/draft-07/schema#","type":"object","properties":{"order":{"type":"object","properties":{"key":{"type":"integer"},"line":{"type":"integer","maximum":5}},"required":["key","line"],"additionalProperties":false},"parts":{"type":"object","patternProperties":{"p[0-9]*[02468]":{"type":"object","properties":{"qty":{"type":"number"}},"additionalProperties":false}}},"flags":{"type":"array","minItems":2,"items":{"type":"object","properties":{"name":{"enum":["ret","st"]},"v":{"type":"string"},"n":{"type":"integer"}},"required":["name","v"],"additionalProperties":false}},"code":{"type":["integer","string"]},"deep":{"additionalProperties":{"additionalProperties":false,"properties":{"b":{}}}}}}' AS schema_json
FROM (SELECT DISTINCT concat('line-', l_returnflag, '.json') AS dataset FROM lineitem) AS d
"""

EVENT_SCHEMAS = """
SELECT dataset,
       CASE WHEN dataset = 'event-click.json' THEN '{"type":"object"}'
            ELSE '{"type":"object","properties":{"id":{"type":"integer"},"by":{"type":"object","additionalProperties":{"type":"object","properties":{"k":{"type":"integer"}},"additionalProperties":false}}}}'
       END AS schema_json
FROM (SELECT DISTINCT concat('event-', event_type, '.json') AS dataset FROM events) AS d
"""

# Exactly one of two descriptions of an event, and no bare number.
CHOICE_SCHEMAS = """
SELECT dataset, '{"oneOf":[{"type":"object","required":["value"],"properties":{"value":{"maximum":50}}},{"type":"object","required":["id"],"properties":{"id":{"multipleOf":2}}}],"not":{"type":"integer"}}' AS schema_json
FROM (SELECT DISTINCT concat('event-', event_type, '.json') AS dataset FROM events) AS d
"""

# Objects inside objects without end, below three names.
RECURSIVE_SCHEMAS = """
SELECT dataset, '{"$ref":"#/definitions/n","definitions":{"n":{"properties":{"deep":{"$ref":"#/definitions/n"},"a":{"$ref":"#/definitions/m"},"b":{"$ref":"#/definitions/n"}},"additionalProperties":false},"m":{"$ref":"#/definitions/n"}}}' AS schema_json
FROM (SELECT DISTINCT concat('line-', l_returnflag, '.json') AS dataset FROM lineitem) AS d
"""

# One schema per part: eight shapes that together use every keyword the extractors look at.
PART_SCHEMAS = """
SELECT concat(p_brand, '-', p_partkey, '.json') AS dataset,
       concat('{"$schema":"', CASE p_partkey % 4 WHEN 0 THEN 'http://json-schema.org/draft-04/schema#'
                                   WHEN 1 THEN 'https://json-schema.org/draft/2020-12/schema'
                                   WHEN 2 THEN 'http://json-schema.org/draft-06/schema#' ELSE 'local' END,
              '","type":"object","properties":{"', p_brand, '":', CASE p_partkey % 8
         WHEN 0 THEN concat('{"type":"object","properties":{"', p_type, '":{"type":"string"}},"additionalProperties":false}},"additionalProperties":false}')
         WHEN 1 THEN concat('{"type":"object","properties":{"', p_type, '":{"type":"object","required":["x"]}},"additionalProperties":true}}}')
         WHEN 2 THEN concat('{"type":"object","additionalProperties":{"type":"object","properties":{"', p_type, '":{"properties":{}}},"additionalProperties":false}}},"additionalProperties":false}')
         WHEN 3 THEN concat('{"type":"object","patternProperties":{"^', p_type, '":{"additionalProperties":false}}}},"anyOf":[{"properties":{"alt":{"type":"object","additionalProperties":false}}},{"required":["alt"]}]}')
         WHEN 4 THEN concat('{"type":"array","items":{"type":"object","properties":{"', p_type, '":{"type":"object"}},"additionalProperties":false},"prefixItems":[{"type":"object","additionalProperties":false}]}},"if":{"required":["z"]},"then":{"properties":{"z":{"additionalProperties":false}}},"else":{"additionalProperties":false}}')
         WHEN 5 THEN concat('{"items":[{"additionalProperties":false},{"properties":{"', p_type, '":{"additionalProperties":false}}}]}},"then":{"properties":{"t":{"type":"object","additionalProperties":false}}}}')
         WHEN 6 THEN concat('{"$ref":"#/definitions/d','","additionalProperties":false}},"definitions":{"d":{"type":"object","properties":{"', p_type, '":{"type":"object","additionalProperties":false}},"additionalProperties":false}}}')
         ELSE concat('{"type":"object","additionalProperties":{"type":"object","properties":{"', p_type, '":{"type":"string"}}}}},"allOf":[{"$ref":"#/definitions/missing"}],"not":{"additionalProperties":false}}')
       END) AS schema_json
FROM part
"""

# Table rows that one task makes documents of.
ROWS_PER_TASK = 100_000

_TABLES = {
    LINE_DOCS: "lineitem",
    EVENT_DOCS: "events",
    ORDER_DOCS: "orders",
    LINE_SCHEMAS: "lineitem",
    EVENT_SCHEMAS: "events",
    PART_SCHEMAS: "part",
    CHOICE_SCHEMAS: "events",
    RECURSIVE_SCHEMAS: "lineitem",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, select: str) -> DataFrame:
    """Run one of the SELECTs above on its table.

    A test table is one row group, which only one task can read, so its rows are dealt out first, to as many tasks as
    their number asks for: no task grows with the table.
    """
    name = _TABLES[select]
    source = table(spark, sf_dir, name)
    tasks = max(spark.sparkContext.defaultParallelism, -(-source.count() // ROWS_PER_TASK))
    text = select.replace("{", "{{").replace("}", "}}").replace(f"FROM {name}", "FROM {source}")
    return spark.sql(text, source=source.repartition(tasks))


# Shared pieces of the expected results (DuckDB). A node is one member or item of a document.
ITEMS_SQL = """
parsed AS (SELECT dataset, doc_id, CASE WHEN json_valid(json) THEN json::JSON END AS j FROM docs),
items AS (
  SELECT dataset, doc_id, j AS doc FROM parsed WHERE json_type(j) = 'OBJECT'
  UNION ALL
  SELECT dataset, doc_id, e.value AS doc FROM (SELECT * FROM parsed WHERE json_type(j) = 'ARRAY') AS p, json_each(p.j) AS e
  WHERE json_type(e.value) = 'OBJECT')
"""

NODES_SQL = """
nodes(dataset, path, is_index, j) AS (
  SELECT dataset, ['$'], false, doc FROM items
  UNION ALL
  SELECT n.dataset, list_append(n.path, CASE WHEN json_type(n.j) = 'ARRAY' THEN '*' ELSE e.key END),
         json_type(n.j) = 'ARRAY', e.value
  FROM nodes AS n, json_each(n.j) AS e
  WHERE json_type(n.j) IN ('ARRAY', 'OBJECT'))
"""

TYPE_SQL = """CASE json_type(j) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string'
  WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'DOUBLE' THEN 'number' ELSE 'integer' END"""

KEYS_SQL = f"""
keys AS (
  SELECT dataset, array_to_string(path[:-2], '/') AS path, path[-1] AS key, len(path) - 2 AS depth,
         count(*) AS frequency, array_to_string(list_sort(list(DISTINCT {TYPE_SQL})), ',') AS types
  FROM nodes WHERE NOT is_index AND len(path) > 1 GROUP BY 1, 2, 3, 4),
num_docs AS (SELECT dataset, count(*) AS num_docs FROM items GROUP BY 1)
"""

PROFILE_SQL = """
profile AS (
  SELECT k.dataset, k.path, max(k.depth) AS depth, sum(k.frequency)::BIGINT AS parent_frequency,
         count(*) AS num_nested_keys,
         CASE WHEN count(DISTINCT k.types) = 1 THEN 0 ELSE 1 END AS datatype_entropy,
         -sum((k.frequency / t.total / n.num_docs) * ln(k.frequency / t.total / n.num_docs)) AS key_entropy
  FROM keys AS k
  JOIN (SELECT dataset, path, sum(frequency)::DOUBLE AS total FROM keys GROUP BY 1, 2) AS t USING (dataset, path)
  JOIN num_docs AS n USING (dataset)
  GROUP BY 1, 2)
"""


def with_docs(docs: str, *parts: str, select: str) -> str:
    """Assemble an expected-result query from the shared pieces."""
    ctes = ",".join([f"docs AS ({docs})", *parts])
    return f"WITH RECURSIVE {ctes} {select}"
