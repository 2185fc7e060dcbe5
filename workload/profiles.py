"""Key statistics, path profiles and the entropy rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.functions import json_values as J
from keyloom.operators import classify, profile, similarity
from keyloom.operators import flatten as flat
from keyloom.plans import features
from keyloom.session import materialize
from workload import inputs as I
from workload.registry import path_column, query



def keys_of(spark, sf, docs, **options):
    """Key statistics, root rows included, written once for the steps that follow."""
    items = flat.document_items(I.derive(spark, sf, docs))
    return materialize(profile.key_frequency(flat.flatten_json(items, include_root=True, **options)), "keys")


def lazy_keys(spark, sf, docs):
    return profile.key_frequency(flat.flatten_json(flat.document_items(I.derive(spark, sf, docs))))


@query(
    "key_frequency_lines",
    I.with_docs(I.LINE_DOCS, I.ITEMS_SQL, I.NODES_SQL, I.KEYS_SQL, select="""
    SELECT dataset, path, key, frequency, types FROM keys"""),
)
def key_frequency_lines(spark, sf):
    keys = profile.with_types(lazy_keys(spark, sf, I.LINE_DOCS))
    return keys.select(
        "dataset", F.array_join("parent_path", "/").alias("path"), "key", "frequency",
        F.array_join("types", ",").alias("types"),
    )


@query(
    "path_frequency_events",
    I.with_docs(I.EVENT_DOCS, I.ITEMS_SQL, I.NODES_SQL, select=f"""
    SELECT dataset, array_to_string(path, '/') AS path, count(*) AS frequency,
           array_to_string(list_sort(list(DISTINCT {I.TYPE_SQL})), ',') AS types
    FROM nodes WHERE len(path) > 1 GROUP BY 1, 2"""),
)
def path_frequency_events(spark, sf):
    rows = flat.flatten_json(flat.document_items(I.derive(spark, sf, I.EVENT_DOCS)))
    return profile.path_frequency(rows).select("dataset", path_column(), "frequency", F.array_join("types", ",").alias("types"))


@query(
    "occurrence_events",
    I.with_docs(I.EVENT_DOCS, I.ITEMS_SQL, I.NODES_SQL, I.KEYS_SQL, select="""
    SELECT dataset, path, key, frequency, sum(frequency) OVER (PARTITION BY dataset, path)::BIGINT AS parent_frequency,
           round(frequency / sum(frequency) OVER (PARTITION BY dataset, path), 9) AS occurrence
    FROM keys"""),
)
def occurrence_events(spark, sf):
    shares = profile.occurrence(materialize(lazy_keys(spark, sf, I.EVENT_DOCS), "keys"))
    return shares.select(
        "dataset", F.array_join("parent_path", "/").alias("path"), "key", "frequency",
        "parent_frequency", F.round("occurrence", 9).alias("occurrence"),
    )


@query(
    "num_docs_events",
    I.with_docs(I.EVENT_DOCS, I.ITEMS_SQL, select="SELECT dataset, count(*) AS num_docs FROM items GROUP BY 1"),
)
def num_docs_events(spark, sf):
    items = flat.document_items(I.derive(spark, sf, I.EVENT_DOCS))
    return profile.num_docs(profile.key_frequency(flat.flatten_json(items, include_root=True)))


def _path_profile(docs):
    def run(spark, sf):
        keys = keys_of(spark, sf, docs)
        rows = classify.entropy_rule(profile.path_profile(keys, profile.num_docs(keys)), threshold=0.0005)
        return rows.select(
            "dataset", path_column(), "depth", "depth_level", "parent_frequency", "num_nested_keys",
            "datatype_entropy", "type_homogeneity", F.round("key_entropy", 10).alias("key_entropy"), "pred",
        )
    return run


def _path_profile_sql(docs):
    return I.with_docs(docs, I.ITEMS_SQL, I.NODES_SQL, I.KEYS_SQL, I.PROFILE_SQL, select="""
    SELECT dataset, path, depth::INT AS depth,
           CASE WHEN depth <= 3 THEN 'shallow' WHEN depth <= 6 THEN 'moderate' ELSE 'deep' END AS depth_level,
           parent_frequency, num_nested_keys, datatype_entropy,
           CASE WHEN datatype_entropy = 0 THEN 'homogeneous' ELSE 'heterogeneous' END AS type_homogeneity,
           round(key_entropy, 10) AS key_entropy,
           CASE WHEN datatype_entropy = 1 AND key_entropy > 0.0005 THEN 1 ELSE 0 END AS pred
    FROM profile""")


for _name, _docs in (("lines", I.LINE_DOCS), ("events", I.EVENT_DOCS), ("orders", I.ORDER_DOCS)):
    query(f"path_profile_{_name}", _path_profile_sql(_docs))(_path_profile(_docs))


@query(
    "jxplain_profile_orders",
    I.with_docs(I.ORDER_DOCS, "parsed AS (SELECT dataset, json::JSON AS j FROM docs)", """
    nodes(dataset, path, j) AS (
      SELECT dataset, ['$'], j FROM parsed
      UNION ALL
      SELECT n.dataset, list_append(n.path, e.key), e.value FROM nodes AS n, json_each(n.j) AS e
      WHERE json_type(n.j) = 'OBJECT')""", """
    counts AS (SELECT dataset, array_to_string(path[:-2], '/') AS path, path[-1] AS key, count(*) AS f
               FROM nodes WHERE len(path) > 1 GROUP BY 1, 2, 3),
    n AS (SELECT dataset, count(*) AS n FROM parsed GROUP BY 1)""", select="""
    SELECT dataset, path, count(*) AS num_nested_keys, round(-sum((f / n) * ln(f / n)), 6) + 0.0 AS key_entropy,
           0 AS datatype_entropy, CASE WHEN -sum((f / n) * ln(f / n)) > 1 THEN 1 ELSE 0 END AS pred
    FROM counts JOIN n USING (dataset) GROUP BY 1, 2"""),
)
def jxplain_profile_orders(spark, sf):
    docs = I.derive(spark, sf, I.ORDER_DOCS).select("dataset", J.parse(F.col("json")).alias("doc"))
    rows = flat.flatten_json(docs, descend_arrays=False, include_root=True)
    keys = materialize(profile.key_frequency(rows), "keys")
    profiles = profile.jxplain_profile(keys, profile.num_docs(keys))
    return classify.entropy_rule(profiles, datatype=0).select(
        "dataset", path_column(), "num_nested_keys", (F.round("key_entropy", 6) + 0.0).alias("key_entropy"),
        "datatype_entropy", "pred",
    )


@query(
    "distinct_subkeys_lines",
    I.with_docs(I.LINE_DOCS, I.ITEMS_SQL, I.NODES_SQL, I.KEYS_SQL, select="""
    SELECT dataset, path, count(*) AS kept, array_to_string(list(key ORDER BY key), ',') AS subkeys
    FROM (SELECT *, row_number() OVER (PARTITION BY dataset, path ORDER BY key) AS r FROM keys) AS x
    WHERE r <= 1000 GROUP BY 1, 2"""),
)
def distinct_subkeys_lines(spark, sf):
    rows = profile.distinct_subkeys(lazy_keys(spark, sf, I.LINE_DOCS), cap=1000)
    return rows.select(
        "dataset", path_column(), F.size("distinct_subkeys").cast("bigint").alias("kept"),
        F.array_join("distinct_subkeys", ",").alias("subkeys"),
    )


@query(
    "all_subkeys_lines",
    I.with_docs(I.LINE_DOCS, I.ITEMS_SQL, I.NODES_SQL, I.KEYS_SQL, select="""
    SELECT dataset, path, count(*) AS keys, md5(array_to_string(list(key ORDER BY key), ',')) AS digest
    FROM keys GROUP BY 1, 2"""),
)
def all_subkeys_lines(spark, sf):
    """Parts of 100 keys, put together again."""
    parts = profile.distinct_subkeys(keys_of(spark, sf, I.LINE_DOCS), keys_per_row=100)
    names = F.sort_array(F.flatten(F.collect_list("distinct_subkeys"))).alias("names")
    return parts.groupBy("dataset", path_column()).agg(names).select(
        "dataset", "path", F.size("names").cast("bigint").alias("keys"), F.md5(F.array_join("names", ",")).alias("digest")
    )


@query(
    "packed_properties_orders",
    I.with_docs(I.ORDER_DOCS, I.ITEMS_SQL, I.NODES_SQL, I.KEYS_SQL, select="""
    SELECT dataset, path, 0 AS part, array_to_string(list(concat(key, ':', types) ORDER BY key), ';') AS properties,
           round(sum(frequency / total), 6) AS total_occurrence
    FROM keys JOIN (SELECT dataset, path, sum(frequency) AS total FROM keys GROUP BY 1, 2) AS t USING (dataset, path)
    GROUP BY 1, 2"""),
)
def packed_properties_orders(spark, sf):
    packed = profile.packed_properties(materialize(lazy_keys(spark, sf, I.ORDER_DOCS), "keys"))
    entries = F.array_sort(F.map_entries("properties"))
    text = F.transform(entries, lambda e: F.concat(e.key, F.lit(":"), F.array_join(e.value["type"], ",")))
    total = F.aggregate(F.map_values("properties"), F.lit(0.0), lambda a, v: a + v.occurrence)
    return packed.select(
        "dataset", path_column(), "part", F.array_join(text, ";").alias("properties"),
        F.round(total, 6).alias("total_occurrence"),
    )


@query(
    "semantic_similarity_embeddings",
    """
    WITH coords AS (
      SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    norms AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM coords GROUP BY 1),
    sums AS (SELECT label, i, sum(x / norm) AS s FROM coords JOIN norms USING (vec_id) GROUP BY 1, 2),
    sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
    SELECT label, n AS num_keys, CASE WHEN n < 2 THEN 1.0 ELSE round(sum(s * s) / (n * n), 9) END AS semantic_similarity
    FROM sums JOIN sizes USING (label) GROUP BY label, n
    """,
)
def semantic_similarity_embeddings(spark, sf):
    vectors = I.table(spark, sf, "embeddings").select("label", F.col("embedding").alias("vector"))
    sims = similarity.semantic_similarity(vectors, ["label"])
    return sims.select("label", "num_keys", F.round("semantic_similarity", 9).alias("semantic_similarity"))


_KEY_VECTORS = """
    grams AS (
      SELECT key, ('0x' || substr(md5(substr(t, i::INT, 3)), 1, 2))::BIGINT AS dim
      FROM (SELECT key, t, unnest(range(1, greatest(length(t) - 1, 2))) AS i
            FROM (SELECT DISTINCT key, concat('^', lower(key), '$') AS t FROM keys) AS x) AS y),
    counts AS (SELECT key, dim, count(*)::DOUBLE AS c FROM grams GROUP BY 1, 2),
    norms AS (SELECT key, sqrt(sum(c * c)) AS norm FROM counts GROUP BY 1),
    sums AS (SELECT dataset, path, dim, sum(c / norm) AS s FROM keys JOIN counts USING (key) JOIN norms USING (key) GROUP BY 1, 2, 3),
    sizes AS (SELECT dataset, path, count(*) AS n FROM keys GROUP BY 1, 2)"""


@query(
    "key_similarity_orders",
    I.with_docs(I.ORDER_DOCS, I.ITEMS_SQL, I.NODES_SQL, I.KEYS_SQL, _KEY_VECTORS, select="""
    SELECT dataset, path, n AS num_keys, CASE WHEN n < 2 THEN 1.0 ELSE round(sum(s * s) / (n * n), 9) END AS semantic_similarity
    FROM sums JOIN sizes USING (dataset, path) GROUP BY dataset, path, n"""),
)
def key_similarity_orders(spark, sf):
    keys = materialize(lazy_keys(spark, sf, I.ORDER_DOCS), "keys")
    sims = similarity.key_similarity(keys)
    return sims.select("dataset", path_column(), "num_keys", F.round("semantic_similarity", 9).alias("semantic_similarity"))


@query(
    "feature_schema_orders",
    I.with_docs(I.ORDER_DOCS, I.ITEMS_SQL, I.NODES_SQL, I.KEYS_SQL, I.PROFILE_SQL, _KEY_VECTORS, """
    alike AS (SELECT dataset, path, CASE WHEN n < 2 THEN 1.0 ELSE sum(s * s) / (n * n) END AS similarity
              FROM sums JOIN sizes USING (dataset, path) GROUP BY dataset, path, n),
    props AS (SELECT dataset, path, array_to_string(list(concat(key, ':', types) ORDER BY key), ';') AS properties,
                     round(sum(frequency / total), 6) AS total_occurrence
              FROM keys JOIN (SELECT dataset, path, sum(frequency) AS total FROM keys GROUP BY 1, 2) AS t USING (dataset, path)
              GROUP BY 1, 2)""", select="""
    SELECT dataset, path, 0 AS part, properties, total_occurrence,
           CASE WHEN depth <= 3 THEN 'shallow' WHEN depth <= 6 THEN 'moderate' ELSE 'deep' END AS depth_level,
           datatype_entropy, num_nested_keys, round(similarity, 9) AS semantic_similarity
    FROM profile JOIN alike USING (dataset, path) JOIN props USING (dataset, path)"""),
)
def feature_schema_orders(spark, sf):
    keys = keys_of(spark, sf, I.ORDER_DOCS)
    similar = similarity.key_similarity(keys).select("dataset", "path", "semantic_similarity")
    profiles = profile.path_profile(keys, profile.num_docs(keys)).join(similar, ["dataset", "path"])
    entries = F.array_sort(F.map_entries("schema.properties"))
    text = F.transform(entries, lambda e: F.concat(e.key, F.lit(":"), F.array_join(e.value["type"], ",")))
    total = F.aggregate(F.map_values("schema.properties"), F.lit(0.0), lambda a, v: a + v.occurrence)
    return features.with_schema(profiles, keys).select(
        "dataset", path_column(), "part", F.array_join(text, ";").alias("properties"), F.round(total, 6).alias("total_occurrence"),
        "schema.depth_level", "schema.datatype_entropy", "schema.num_nested_keys",
        F.round("schema.semantic_similarity", 9).alias("semantic_similarity"),
    )


@query(
    "embed_keys_embeddings",
    """
    WITH coords AS (
      SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    norms AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM coords GROUP BY 1),
    sums AS (SELECT label, i, sum(x / norm) AS s FROM coords JOIN norms USING (vec_id) GROUP BY 1, 2),
    sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
    SELECT concat('label-', label) AS dataset, '$' AS path, n AS num_keys,
           CASE WHEN n < 2 THEN 1.0 ELSE round(sum(s * s) / (n * n), 9) END AS semantic_similarity
    FROM sums JOIN sizes USING (label) GROUP BY label, n
    """,
)
def embed_keys_embeddings(spark, sf):
    """Vector ids stand for keys; the encoder looks their vectors up in the row."""
    rows = I.table(spark, sf, "embeddings").select(
        F.concat(F.lit("label-"), "label").alias("dataset"), F.array(F.lit("$")).alias("parent_path"),
        F.to_json(F.struct("vec_id", F.col("embedding").cast("array<double>").alias("v"))).alias("key"),
    )
    encoder = F.from_json(F.get_json_object("key", "$.v"), "array<double>")
    sims = similarity.key_similarity(rows, similarity.embed_keys(rows, encoder))
    return sims.select("dataset", path_column(), "num_keys", F.round("semantic_similarity", 9).alias("semantic_similarity"))
