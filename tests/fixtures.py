"""Schemas T1-T8 of FIXTURES.md and small helpers."""

import json

STRING = {"type": "string"}


def closed(**properties):
    return {"type": "object", "properties": properties, "additionalProperties": False}


def address(**more):
    return {"type": "object", "properties": {"street": STRING}, **more}


ADDRESS, PERSON = closed(street=STRING), closed(name=STRING)
OPEN_ROOT = closed(address=ADDRESS, person=PERSON)
del OPEN_ROOT["additionalProperties"]

SCHEMAS = {
    "T1": closed(address=ADDRESS, person=PERSON),
    "T2": closed(address=address(additionalProperties=True), person=PERSON),
    "T3": closed(address=address(additionalProperties=STRING), person=PERSON),
    "T4": closed(address=address(), person=PERSON),
    "T5": OPEN_ROOT,
    "T6": closed(
        address={"type": "object", "patternProperties": {"^x": STRING}, "additionalProperties": False},
        person=PERSON,
    ),
    "T7": closed(types={"type": "object", "additionalProperties": closed(
        symbol={"type": "object", "additionalProperties": False})}),
    "T8": closed(types={"type": "object", "additionalProperties": {
        "type": "object", "properties": {"symbol": STRING}}}),
}


def schema_rows(spark, schemas):
    return spark.createDataFrame(
        [(name, json.dumps(body)) for name, body in schemas.items()], "dataset string, schema_json string"
    )


def document_rows(spark, documents, dataset="g"):
    rows = [(dataset, i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)]
    return spark.createDataFrame(rows, "dataset string, doc_id bigint, json string")


def by_dataset(df, column):
    found = {}
    for row in df.collect():
        found.setdefault(row["dataset"], set()).add(row[column])
    return found
