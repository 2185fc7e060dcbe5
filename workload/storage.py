"""Round trips through files, on data derived from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from keyloom.operators import flatten as flat
from keyloom.operators import profile
from keyloom.session import shared_dir
from keyloom.sources import documents, features, schemas
from keyloom.sources.files import write_row_files
from keyloom.streaming import documents as streaming
from workload import inputs as I
from workload.registry import path_column, query


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "json_lines_round_trip_orders",
    I.with_docs(I.ORDER_DOCS, select="SELECT dataset, count(*) AS documents, sum(length(json))::BIGINT AS chars, min(json) AS first FROM docs GROUP BY 1"),
)
def json_lines_round_trip_orders(spark, sf):
    folder = _folder(spark, "json-lines")
    documents.write_json_lines(I.derive(spark, sf, I.ORDER_DOCS), folder)
    back = documents.read_partitioned_json_lines(spark, folder)
    return back.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.length("json")).alias("chars"), F.min("json").alias("first")
    )


@query(
    "json_lines_overwrite_events",
    I.with_docs(I.EVENT_DOCS, select="SELECT dataset, count(*) AS documents FROM docs GROUP BY 1"),
)
def json_lines_overwrite_events(spark, sf):
    """Written twice, kept once; read as plain files, where the file's folder is the dataset."""
    folder = _folder(spark, "json-lines")
    docs = I.derive(spark, sf, I.EVENT_DOCS)
    documents.write_json_lines(docs, folder)
    documents.write_json_lines(docs, folder, mode="overwrite")
    return documents.read_partitioned_json_lines(spark, folder).groupBy("dataset").agg(
        F.count(F.lit(1)).alias("documents")
    )


@query(
    "read_json_lines_events",
    I.with_docs(I.EVENT_DOCS, select="SELECT count(*) AS documents, sum(length(json))::BIGINT AS chars, count(*) FILTER (WHERE NOT json_valid(json)) AS bad_documents FROM docs"),
)
def read_json_lines_events(spark, sf):
    folder = _folder(spark, "json-lines")
    documents.write_json_lines(I.derive(spark, sf, I.EVENT_DOCS), folder)
    back = documents.read_json_lines(spark, f"{folder}/*/*")
    return back.agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.length("json")).alias("chars"),
        F.count_if(documents.is_bad_record(F.col("json"))).alias("bad_documents"),
    )


@query(
    "schemas_round_trip_lines",
    f"SELECT dataset, json_keys(schema_json)[1] IS NOT NULL AS loaded, length(schema_json) AS chars FROM ({I.LINE_SCHEMAS}) AS s",
)
def schemas_round_trip_lines(spark, sf):
    folder = _folder(spark, "schemas")
    schemas.write_schemas(I.derive(spark, sf, I.LINE_SCHEMAS), folder)
    back = spark.read.schema("value string, dataset string").text(folder)
    return schemas.schemas_from(back, F.col("dataset"), F.col("value")).select(
        "dataset", "loaded", F.length("schema_json").alias("chars")
    )


@query(
    "dataset_inventory_orders",
    """SELECT concat(r_name, '.json') AS dataset, 1 AS exist, 0 AS empty FROM region
       UNION ALL SELECT concat(n_name, '.json'), 0, 1 FROM nation
       UNION ALL SELECT DISTINCT concat('orders-', o_orderstatus, '.json'), 0, 0 FROM orders""",
)
def dataset_inventory_orders(spark, sf):
    folder = _folder(spark, "json-lines")
    docs = I.derive(spark, sf, I.ORDER_DOCS)
    documents.write_json_lines(docs, folder)
    empty = I.table(spark, sf, "nation").select(F.concat("n_name", F.lit(".json")).alias("dataset"), F.lit("").alias("text"))
    write_row_files(empty, f"{folder}/empty")
    files = schemas.data_files(spark, folder)
    names = I.table(spark, sf, "region").select(F.concat("r_name", F.lit(".json")).alias("dataset")).union(empty.select("dataset"))
    return schemas.dataset_inventory(names.union(docs.select("dataset").distinct()), files)


@query(
    "features_csv_round_trip_orders",
    I.with_docs(I.ORDER_DOCS, I.ITEMS_SQL, I.NODES_SQL, I.KEYS_SQL, select="""
    SELECT dataset, path, array_to_string(list(key ORDER BY key), ',') AS subkeys FROM keys GROUP BY 1, 2"""),
)
def features_csv_round_trip_orders(spark, sf):
    keys = profile.key_frequency(flat.flatten_json(flat.document_items(I.derive(spark, sf, I.ORDER_DOCS))))
    table = profile.distinct_subkeys(keys)
    folder = _folder(spark, "features")
    features.write_features(table, folder, fmt="csv")
    back = features.read_features(spark, folder, table.schema, fmt="csv")
    return back.select("dataset", path_column(), F.array_join("distinct_subkeys", ",").alias("subkeys"))


@query(
    "features_parquet_round_trip_orders",
    I.with_docs(I.ORDER_DOCS, I.ITEMS_SQL, I.NODES_SQL, I.KEYS_SQL, select="""
    SELECT dataset, path, array_to_string(list(key ORDER BY key), ',') AS subkeys FROM keys GROUP BY 1, 2"""),
)
def features_parquet_round_trip_orders(spark, sf):
    keys = profile.key_frequency(flat.flatten_json(flat.document_items(I.derive(spark, sf, I.ORDER_DOCS))))
    table = profile.distinct_subkeys(keys)
    folder = _folder(spark, "features")
    features.write_features(table, folder)
    back = features.read_features(spark, folder, table.schema)
    return back.select("dataset", path_column(), F.array_join("distinct_subkeys", ",").alias("subkeys"))


@query(
    "byte_order_marks_orders",
    I.with_docs(I.ORDER_DOCS, select="""
    SELECT count(*) AS documents, sum(length(json))::BIGINT AS chars, 0 AS bad_documents,
           count(*) FILTER (WHERE json LIKE '{"customer"%') AS clean FROM docs"""),
)
def byte_order_marks_orders(spark, sf):
    """Every third document was written with a byte order mark."""
    folder = _folder(spark, "marked")
    mark = F.when(F.col("doc_id") % 3 == 0, "\ufeff").otherwise("")
    I.derive(spark, sf, I.ORDER_DOCS).select(F.concat(mark, "json").alias("value")).write.text(folder)
    back = documents.read_json_lines(spark, folder)
    return back.agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.length("json")).alias("chars"),
        F.count_if(documents.is_bad_record(F.col("json"))).alias("bad_documents"),
        F.count_if(F.startswith("json", F.lit('{"customer"'))).alias("clean"),
    )


@query(
    "read_schema_files_events",
    f"""SELECT dataset, true AS loaded, schema_json FROM ({I.EVENT_SCHEMAS}) AS s
        UNION ALL SELECT concat('broken-', n_name, '.json'), false, NULL FROM nation""",
)
def read_schema_files_events(spark, sf):
    """One file per schema, and files that hold no JSON."""
    folder = _folder(spark, "schema-files")
    broken = I.table(spark, sf, "nation").select(
        F.concat(F.lit("broken-"), "n_name", F.lit(".json")).alias("dataset"), F.lit('{"type":').alias("schema_json")
    )
    schemas.write_schema_files(I.derive(spark, sf, I.EVENT_SCHEMAS).unionByName(broken), folder)
    return schemas.read_schemas(spark, folder).select("dataset", "loaded", "schema_json")


@query(
    "streamed_key_deltas_orders",
    I.with_docs(I.ORDER_DOCS, I.ITEMS_SQL, I.NODES_SQL, I.KEYS_SQL, select="""
    SELECT path, key, sum(frequency)::BIGINT AS frequency,
           array_to_string(list_sort(list_distinct(flatten(list(string_split(types, ','))))), ',') AS types
    FROM keys GROUP BY 1, 2"""),
)
def streamed_key_deltas_orders(spark, sf):
    """Written as files, read as a stream, one delta per batch."""
    folder, name = _folder(spark, "stream"), f"deltas-{uuid.uuid4().hex}"
    I.derive(spark, sf, I.ORDER_DOCS).select(F.col("json").alias("value")).write.text(folder)
    docs = streaming.stream_json_lines(spark, folder, max_files=3).withColumn("dataset", F.lit("orders"))
    streaming.write_key_deltas(docs, name).trigger(availableNow=True).start().awaitTermination()
    keys = profile.with_types(profile.without_root(streaming.read_key_deltas(spark, name)))
    return keys.select(
        F.array_join("parent_path", "/").alias("path"), "key", "frequency", F.array_join("types", ",").alias("types")
    )
