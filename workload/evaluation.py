"""Metrics, classification, validation, curation and nested schemas."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from keyloom.operators import classify, metrics, nest, profile, similarity, text_classifier, validate
from keyloom.operators import flatten as flat
from keyloom.plans import curation, evaluation, features
from keyloom.session import materialize, shared_dir
from keyloom.sources.schemas import dataset_inventory, read_schemas
from workload import inputs as I
from workload.profiles import keys_of
from workload.registry import path_column, query


def scored_labels(spark, sf):
    """Quality as truth, toxicity as prediction."""
    return I.table(spark, sf, "labels").select(
        "doc_id", F.col("quality").alias("label"), F.col("toxic").alias("pred")
    )


_CONFUSION = """
WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fp,
                  count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fn, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS tn FROM labels),
m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0) AS r1,
             coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
             coalesce(tn / nullif(tn + fn, 0), 0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0) AS r0,
             coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) AS f0,
             (tp + tn) / (tp + tn + fp + fn) AS acc, tp + tn + fp + fn AS total FROM c)
"""


def _rounded(df):
    return df.select(*[
        F.round(f.name, 9).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
        for f in df.schema.fields
    ])


@query("binary_metrics_labels", _CONFUSION + """
    SELECT round(acc, 9) AS accuracy, round(p1, 9) AS dynamic_precision, round(r1, 9) AS dynamic_recall, round(f1, 9) AS dynamic_f1,
           round(p0, 9) AS static_precision, round(r0, 9) AS static_recall, round(f0, 9) AS static_f1 FROM m""")
def binary_metrics_labels(spark, sf):
    return _rounded(metrics.binary_metrics(scored_labels(spark, sf)))


@query("classification_report_labels", _CONFUSION + """
    SELECT '0' AS class, round(p0, 9) AS precision, round(r0, 9) AS recall, round(f0, 9) AS f1, tn + fp AS support, round(acc, 9) AS accuracy FROM m
    UNION ALL SELECT '1', round(p1, 9), round(r1, 9), round(f1, 9), tp + fn, round(acc, 9) FROM m
    UNION ALL SELECT 'weighted', round((p1 * (tp + fn) + p0 * (tn + fp)) / total, 9), round((r1 * (tp + fn) + r0 * (tn + fp)) / total, 9),
                     round((f1 * (tp + fn) + f0 * (tn + fp)) / total, 9), total, round(acc, 9) FROM m""")
def classification_report_labels(spark, sf):
    return _rounded(metrics.classification_report(scored_labels(spark, sf)))


@query("positive_class_metrics_labels", _CONFUSION + """
    SELECT round(p1, 9) AS precision, round(r1, 9) AS recall, round(f1, 9) AS f1, tp + fn AS support FROM m""")
def positive_class_metrics_labels(spark, sf):
    return _rounded(metrics.positive_class_metrics(scored_labels(spark, sf)))


@query("class_accuracy_labels", """
    SELECT quality AS class, round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 9) AS accuracy, count(*) AS support
    FROM labels GROUP BY 1""")
def class_accuracy_labels(spark, sf):
    return _rounded(metrics.class_accuracy(scored_labels(spark, sf)))


@query("log_loss_events", """
    WITH p AS (SELECT CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS label, 1 / (1 + exp(-value / 50)) AS prob FROM events)
    SELECT round(avg(-ln(CASE WHEN label = 1 THEN prob ELSE 1 - prob END)), 9) AS log_loss FROM p""")
def log_loss_events(spark, sf):
    scored = I.table(spark, sf, "events").select(
        F.when(F.col("event_type") == "click", 1).otherwise(0).alias("label"),
        (1 / (1 + F.exp(-F.col("value") / 50))).alias("prob"),
    )
    return _rounded(metrics.log_loss(scored))


@query("argmax_embeddings", """
    SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS pred FROM embeddings""")
def argmax_embeddings(spark, sf):
    return I.table(spark, sf, "embeddings").select("vec_id", classify.argmax(F.col("embedding")).alias("pred"))


def labelled_profiles(spark, sf, docs=I.LINE_DOCS):
    """Keys and their profiles; an object whose keys come from data (parts, totals, by) is dynamic."""
    keys = keys_of(spark, sf, docs)
    profiles = profile.path_profile(keys, profile.num_docs(keys))
    dynamic = F.element_at("path", -1).isin("parts", "totals", "by")
    return keys, profiles.withColumn("label", dynamic.cast("int"))


_LABELLED = """
labelled AS (SELECT *, CASE WHEN string_split(path, '/')[-1] IN ('parts', 'totals', 'by') THEN 1 ELSE 0 END AS label,
                    CASE WHEN datatype_entropy = 0 AND key_entropy > 0.0005 THEN 1 ELSE 0 END AS pred FROM profile)
"""


@query(
    "true_dynamic_paths_lines",
    I.with_docs(I.LINE_DOCS, I.ITEMS_SQL, I.NODES_SQL, I.KEYS_SQL, I.PROFILE_SQL, _LABELLED, select="""
    SELECT dataset, path FROM labelled WHERE pred = 1 AND label = 1"""),
)
def true_dynamic_paths_lines(spark, sf):
    _, profiles = labelled_profiles(spark, sf)
    scored = classify.entropy_rule(profiles, datatype=0, threshold=0.0005)
    return classify.true_dynamic_paths(scored).select("dataset", path_column())


@query(
    "entropy_report_lines",
    I.with_docs(I.LINE_DOCS, I.ITEMS_SQL, I.NODES_SQL, I.KEYS_SQL, I.PROFILE_SQL, _LABELLED, """
    c AS (SELECT count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
                 count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn FROM labelled)""",
    select="""
    SELECT '1' AS class, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall,
           round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1, tp + fn AS support, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy FROM c"""),
)
def entropy_report_lines(spark, sf):
    _, profiles = labelled_profiles(spark, sf)
    report = evaluation.entropy_report(profiles, datatype=0, threshold=0.0005)
    return _rounded(report.filter(F.col("class") == "1"))


@query("key_classifier_lines")
def key_classifier_lines(spark, sf):
    _, profiles = labelled_profiles(spark, sf)
    profiles = materialize(profiles, "profiles")
    model = classify.fit_key_classifier(profiles)
    return metrics.binary_metrics(classify.score(model, profiles))


@query("key_text_classifier_lines")
def key_text_classifier_lines(spark, sf):
    keys, profiles = labelled_profiles(spark, sf)
    similar = similarity.key_similarity(keys).select("dataset", "path", "semantic_similarity")
    described = materialize(features.with_schema(profiles.join(similar, ["dataset", "path"], "left"), keys), "described")
    featured = materialize(text_classifier.text_features(described), "featured")
    model, _ = text_classifier.fit_text_classifier(described, featured=featured)
    return text_classifier.score(model, featured).select(
        "dataset", path_column(), "pred", F.round("prob", 6).alias("prob"))


# What each line document violates, stated on its columns instead of its JSON: see LINE_SCHEMAS.
_VIOLATIONS = """
violations AS (
  SELECT concat('line-', l_returnflag, '.json') AS dataset, l_orderkey * 8 + l_linenumber AS doc_id, v.*
  FROM lineitem, LATERAL (
    SELECT '$/order/line' AS path, 'maximum' AS keyword WHERE l_linenumber > 5
    UNION ALL SELECT '$/flags/*/n', 'type' WHERE l_linenumber % 2 = 0
    UNION ALL SELECT concat('$/parts/p', l_partkey), 'additionalProperties' WHERE regexp_matches(concat('p', l_partkey), 'p[0-9]*[02468]')
    UNION ALL SELECT '$/code', 'type' WHERE l_linenumber % 3 = 2) AS v)
"""


@query(
    "validate_documents_lines",
    f"WITH {_VIOLATIONS} SELECT dataset, doc_id, path, keyword, 'violation' AS status FROM violations",
)
def validate_documents_lines(spark, sf):
    docs, schemas = I.derive(spark, sf, I.LINE_DOCS), I.derive(spark, sf, I.LINE_SCHEMAS)
    return validate.validate_documents(docs, schemas)


@query(
    "invalid_count_lines",
    f"""WITH {_VIOLATIONS} SELECT dataset, count(DISTINCT doc_id) AS invalid_docs, 0 AS unchecked_docs FROM violations GROUP BY 1""",
)
def invalid_count_lines(spark, sf):
    docs, schemas = I.derive(spark, sf, I.LINE_DOCS), I.derive(spark, sf, I.LINE_SCHEMAS)
    return validate.invalid_count(validate.validate_documents(docs, schemas))


@query("validate_choices_events", """
    WITH d AS (SELECT concat('event-', event_type, '.json') AS dataset, event_id AS doc_id, value,
                      CASE WHEN event_id % 23 = 0 THEN 'none' WHEN event_id % 17 = 0 THEN 'number' WHEN event_id % 10 = 0 THEN 'list' ELSE 'object' END AS form
               FROM events),
    broken AS (SELECT *, 'parse' AS keyword FROM d WHERE form = 'none'
               UNION ALL SELECT *, 'not' FROM d WHERE form = 'number'
               UNION ALL SELECT *, 'oneOf' FROM d WHERE form IN ('number', 'list') OR (form = 'object' AND (value <= 50) = (doc_id % 2 = 0)))
    SELECT dataset, doc_id, '$' AS path, keyword, 'violation' AS status FROM broken""")
def validate_choices_events(spark, sf):
    """Branches of combining keywords, decided per document."""
    return validate.validate_documents(I.derive(spark, sf, I.EVENT_DOCS), I.derive(spark, sf, I.CHOICE_SCHEMAS))


def _curated(spark, sf):
    """Event schemas plus one schema per region that has no documents, and one that is not JSON."""
    docs = I.derive(spark, sf, I.EVENT_DOCS)
    events = I.derive(spark, sf, I.EVENT_SCHEMAS).select(
        "dataset",
        F.when(F.col("dataset") == "event-error.json", "{").otherwise(F.col("schema_json")).alias("schema_json"),
    )
    regions = I.table(spark, sf, "region").select(
        F.concat("r_name", F.lit(".json")).alias("dataset"), F.lit('{"type":"object"}').alias("schema_json")
    )
    loaded = F.try_parse_json("schema_json").isNotNull().alias("loaded")
    schemas = events.unionByName(regions).select("dataset", "schema_json", loaded)
    sizes = docs.groupBy("dataset").agg(F.sum(F.octet_length("json").cast("bigint") + 1).alias("length"))
    return curation.curate(docs, schemas, dataset_inventory(schemas, sizes))


_CURATED = """
WITH names AS (SELECT DISTINCT concat('event-', event_type, '.json') AS dataset FROM events),
flags AS (
  SELECT dataset, 0 AS exist, CASE WHEN dataset = 'event-error.json' THEN 1 ELSE 0 END AS loaded,
         CASE WHEN dataset = 'event-error.json' THEN 0 ELSE 1 END AS validation FROM names
  UNION ALL SELECT concat(r_name, '.json'), 1, 0, 0 FROM region)
"""


@query("curation_flags_events", _CURATED + """
    SELECT dataset, exist, 0 AS empty, loaded, 0 AS dereferenced, 0 AS modified, validation FROM flags""")
def curation_flags_events(spark, sf):
    return _curated(spark, sf)[1]


@query("curation_funnel_events", _CURATED + """
    , t AS (SELECT count(*) AS n, sum(exist) AS e, sum(loaded) AS l, sum(validation) AS v FROM flags)
    SELECT 0 AS step, 'original' AS check, n AS datasets FROM t UNION ALL SELECT 1, 'exist', n - e FROM t
    UNION ALL SELECT 2, 'empty', n - e FROM t UNION ALL SELECT 3, 'loaded', n - e - l FROM t
    UNION ALL SELECT 4, 'dereferenced', n - e - l FROM t UNION ALL SELECT 5, 'validation', n - e - l - v FROM t
    UNION ALL SELECT 6, 'modified_failures', 0 FROM t""")
def curation_funnel_events(spark, sf):
    return validate.curation_funnel(_curated(spark, sf)[1])


@query("saved_schemas_events", """
    SELECT DISTINCT concat('event-', event_type, '.json') AS dataset, true AS loaded, 'object' AS kind FROM events WHERE event_type <> 'error'""")
def saved_schemas_events(spark, sf):
    """Curated schemas, written one file each and read again."""
    folder = f"{shared_dir(spark)}/curated-{uuid.uuid4().hex}"
    curation.save_curated(_curated(spark, sf)[0], folder)
    back = read_schemas(spark, folder)
    return back.select("dataset", "loaded", F.get_json_object("schema_json", "$.type").alias("kind"))


@query("choose_schema_events", """
    SELECT DISTINCT concat('event-', event_type, '.json') AS dataset, false AS is_closed FROM events WHERE event_type <> 'error'""")
def choose_schema_events(spark, sf):
    chosen = _curated(spark, sf)[0]
    closed = F.get_json_object("schema_json", "$.additionalProperties") == "false"
    return chosen.select("dataset", F.coalesce(closed, F.lit(False)).alias("is_closed"))


@query(
    "schema_nodes_orders",
    I.with_docs(I.ORDER_DOCS, I.ITEMS_SQL, I.NODES_SQL, select=f"""
    SELECT dataset, array_to_string(path, '/') AS path,
           CASE WHEN len(path) > 1 THEN array_to_string(list_sort(list(DISTINCT {I.TYPE_SQL})), ',') END AS types
    FROM nodes GROUP BY dataset, path"""),
)
def schema_nodes_orders(spark, sf):
    keys = profile.key_frequency(flat.flatten_json(flat.document_items(I.derive(spark, sf, I.ORDER_DOCS))))
    return nest.schema_nodes(keys).select("dataset", path_column(), F.array_join("types", ",").alias("types"))


_NESTED = """
types AS (
  SELECT dataset, array_to_string(path, '/') AS path, len(path) AS len, path[-1] AS name,
         list_sort(list(DISTINCT """ + I.TYPE_SQL + """)) AS types FROM nodes GROUP BY dataset, nodes.path),
lines AS (
  SELECT t.dataset, t.path, t.len, t.name, t.types,
         EXISTS (SELECT 1 FROM types AS c WHERE c.dataset = t.dataset AND c.len = t.len + 1 AND starts_with(c.path, t.path || '/')) AS inner_node
  FROM types AS t)
"""

# Bytes of indented JSON by counting: every line is its indentation, its text and a line end, plus
# one comma between the parts of an object and between list items.
_SIZE = """
SELECT dataset, (45 + sum(
    4 * len + length(name) + 2 + 3 + 1
    + CASE WHEN len = 1 THEN 4 * len + 2 + length('"type": "object"') + 1
           ELSE (4 * len + 2 + length('"type": [') + 1) + (4 * len + 2 + 1 + 1) + (len(types) - 1)
                + list_sum(list_transform(types, lambda t: 4 * len + 4 + length(t) + 2 + 1)) END
    + CASE WHEN inner_node THEN 1 + (4 * len + 2 + length('"properties": {') + 1) + (4 * len + 2 + 1 + 1) ELSE 0 END
    + 4 * len + 1 + 1)
  + count(*) - 1 - count(*) FILTER (WHERE inner_node))::BIGINT AS bytes
FROM lines GROUP BY 1
"""


@query(
    "nested_schema_bytes_orders",
    I.with_docs(I.ORDER_DOCS, I.ITEMS_SQL, I.NODES_SQL, _NESTED, select=_SIZE),
)
def nested_schema_bytes_orders(spark, sf):
    keys = keys_of(spark, sf, I.ORDER_DOCS)
    return nest.schema_kb(nest.schema_lines(nest.nest_schema(keys))).select("dataset", "bytes")


def _dynamic(profiles):
    return profiles.filter(F.col("label") == 1).select("dataset", "path")


@query(
    "abstracted_nodes_lines",
    I.with_docs(I.LINE_DOCS, I.ITEMS_SQL, I.NODES_SQL, select=f"""
    SELECT dataset, array_to_string(path, '/') AS path,
           CASE WHEN len(path) > 1 AND NOT is_index THEN array_to_string(list_sort(list(DISTINCT {I.TYPE_SQL})), ',') END AS types,
           CASE WHEN array_to_string(path, '/') = '$/parts' THEN 'object' END AS additional
    FROM nodes WHERE NOT (len(path) > 2 AND path[2] = 'parts') GROUP BY dataset, path, is_index"""),
)
def abstracted_nodes_lines(spark, sf):
    keys, profiles = labelled_profiles(spark, sf)
    nodes = nest.nest_schema(keys, _dynamic(profiles))
    return nodes.select(
        "dataset", path_column(), F.array_join("types", ",").alias("types"), F.array_join("additional", ",").alias("additional")
    )


@query(
    "abstracted_nodes_keep_keys_lines",
    I.with_docs(I.LINE_DOCS, I.ITEMS_SQL, I.NODES_SQL, select=f"""
    SELECT dataset, array_to_string(path, '/') AS path,
           CASE WHEN len(path) = 3 AND path[2] = 'parts' THEN '' WHEN len(path) > 1 AND NOT is_index THEN array_to_string(list_sort(list(DISTINCT {I.TYPE_SQL})), ',') END AS types,
           CASE WHEN len(path) = 3 AND path[2] = 'parts' THEN 'object' END AS additional
    FROM nodes GROUP BY dataset, path, is_index"""),
)
def abstracted_nodes_keep_keys_lines(spark, sf):
    keys, profiles = labelled_profiles(spark, sf)
    nodes = nest.nest_schema(keys, _dynamic(profiles), keep_keys=True)
    return nodes.select(
        "dataset", path_column(), F.array_join("types", ",").alias("types"), F.array_join("additional", ",").alias("additional")
    )


@query(
    "type_union_events",
    I.with_docs(I.EVENT_DOCS, I.ITEMS_SQL, I.NODES_SQL, I.KEYS_SQL, select="""
    SELECT dataset, path, array_to_string(list_sort(list_distinct(flatten(list(string_split(types, ','))))), ',') AS additional
    FROM keys WHERE path = '$/by' GROUP BY 1, 2"""),
)
def type_union_events(spark, sf):
    keys, profiles = labelled_profiles(spark, sf, I.EVENT_DOCS)
    unions = nest.type_union(keys, _dynamic(profiles))
    return unions.select("dataset", path_column(), F.array_join("additional", ",").alias("additional"))


@query(
    "parent_is_dynamic_orders",
    I.with_docs(I.ORDER_DOCS, I.ITEMS_SQL, I.NODES_SQL, select="""
    SELECT DISTINCT dataset, array_to_string(path, '/') AS path, array_to_string(path[:-2], '/') = '$/totals' AS parent_is_dynamic
    FROM nodes"""),
)
def parent_is_dynamic_orders(spark, sf):
    keys, profiles = labelled_profiles(spark, sf, I.ORDER_DOCS)
    nodes = nest.schema_nodes(keys).select("dataset", "path")
    return nest.below_dynamic(nodes, _dynamic(profiles)).select("dataset", path_column(), "parent_is_dynamic")


# The same count for documents whose node $/parts is abstracted where the rule finds it: what lies
# below it goes, and it gains a list of types.
_ABSTRACTED = """
dynamic AS (SELECT dataset, path FROM labelled WHERE pred = 1 AND label = 1),
kept AS (SELECT l.dataset, l.path, l.len, l.name, l.types, l.inner_node AND d.path IS NULL AS inner_node, d.path IS NOT NULL AS abstracted
         FROM lines AS l LEFT JOIN dynamic AS d ON d.dataset = l.dataset AND d.path = l.path
         WHERE NOT EXISTS (SELECT 1 FROM dynamic AS a WHERE a.dataset = l.dataset AND starts_with(l.path, a.path || '/'))),
before AS ({before}),
after AS ({after}),
sizes AS (SELECT round(b.bytes / 1024, 2) AS original_kb, round(a.bytes / 1024, 2) AS abstracted_kb
          FROM before AS b JOIN after AS a USING (dataset))
"""
_ITEM_SIZE = _SIZE.replace("CASE WHEN len = 1", "CASE WHEN len = 1 OR name = '*'")  # a list's items have no list of types
_AFTER = _ITEM_SIZE.replace("FROM lines", "FROM kept").replace(
    "+ 4 * len + 1 + 1)",
    """+ CASE WHEN abstracted THEN 1 + (4 * len + 2 + length('"additionalProperties": {') + 1)
         + (4 * len + 4 + length('"type": [') + 1) + (4 * len + 6 + length('"object"') + 1) + (4 * len + 4 + 1 + 1)
         + (4 * len + 2 + 1 + 1) ELSE 0 END
    + 4 * len + 1 + 1)""",
)


@query(
    "reduction_summary_lines",
    I.with_docs(I.LINE_DOCS, I.ITEMS_SQL, I.NODES_SQL, I.KEYS_SQL, I.PROFILE_SQL, _LABELLED, _NESTED,
                _ABSTRACTED.replace("{before}", _ITEM_SIZE).replace("{after}", _AFTER), select="""
    SELECT round(avg(original_kb), 2) AS original_kb, round(avg(abstracted_kb), 2) AS abstracted_kb,
           round(avg((original_kb - abstracted_kb) / original_kb), 4) AS average_reduction FROM sizes"""),
)
def reduction_summary_lines(spark, sf):
    keys, profiles = labelled_profiles(spark, sf)
    scored = classify.entropy_rule(profiles, datatype=0, threshold=0.0005)
    sizes = evaluation.abstraction_report(keys, scored)
    return nest.reduction_summary(sizes)


@query("schema_text_events")
def schema_text_events(spark, sf):
    keys, profiles = labelled_profiles(spark, sf, I.EVENT_DOCS)
    lines = nest.schema_lines(nest.nest_schema(keys, _dynamic(profiles)))
    return nest.schema_text(lines)


@query(
    "serialized_properties_orders",
    I.with_docs(I.ORDER_DOCS, I.ITEMS_SQL, I.NODES_SQL, I.KEYS_SQL, select="""
    SELECT dataset, path, concat('{', array_to_string(list(concat('"', key, '":["', replace(types, ',', '","'), '"]') ORDER BY key), ','), '}') AS schema
    FROM keys GROUP BY 1, 2"""),
)
def serialized_properties_orders(spark, sf):
    packed = profile.packed_properties(keys_of(spark, sf, I.ORDER_DOCS))
    ordered = F.map_from_entries(F.array_sort(F.map_entries("properties")))
    return packed.select("dataset", path_column(), F.to_json(nest.strip_profile(ordered)).alias("schema"))
