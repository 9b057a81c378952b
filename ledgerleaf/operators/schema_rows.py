"""JSON Schemas as data: a column of schemas, checked for being well formed by Draft 2020-12.

The shapes of the keywords are a schema themselves, one that refers to itself wherever a keyword holds schemas. So the
distinct schemas of a table are validated against it as any payload is: each nested schema becomes a row of the
frontier, and rounds are as many as the deepest schema has levels.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions.regex import RegexError, java_regex
from ledgerleaf.operators.jsonschema import SchemaPlan, kind, member
from ledgerleaf.operators.recursion import frontier, row_errors
from ledgerleaf.operators.schema_graph import HOLD_LIST, HOLD_MEMBERS, HOLD_SCHEMA, TYPES
from ledgerleaf.sources.scratch import new_folder


def keyword_shapes() -> dict:
    """The schema of schemas."""
    string, flag, count, number = {"type": "string"}, {"type": "boolean"}, {"type": "integer", "minimum": 0}, {"type": "number"}
    names = {"type": "array", "items": string, "uniqueItems": True}
    one_type = {"enum": list(TYPES)}
    anchor = {"type": "string", "pattern": r"^[A-Za-z_][-A-Za-z0-9._]*\Z"}
    shapes = {
        **{w: {"$ref": "#"} for w in HOLD_SCHEMA},
        **{w: {"type": "array", "minItems": 1, "items": {"$ref": "#"}} for w in HOLD_LIST},
        **{w: {"type": "object", "additionalProperties": {"$ref": "#"}} for w in HOLD_MEMBERS},
        **dict.fromkeys(("minLength", "maxLength", "minItems", "maxItems", "minContains", "maxContains", "minProperties", "maxProperties"), count),
        **dict.fromkeys(("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"), number),
        **dict.fromkeys(("uniqueItems", "deprecated", "readOnly", "writeOnly"), flag),
        **dict.fromkeys(("pattern", "$ref", "$dynamicRef", "$schema", "$comment", "title", "description", "format", "contentEncoding", "contentMediaType"), string),
        **dict.fromkeys(("$anchor", "$dynamicAnchor"), anchor),
        **dict.fromkeys(("enum", "examples"), {"type": "array"}),
        "$id": {"type": "string", "pattern": r"^[^#]*#?\Z"},
        "type": {"anyOf": [one_type, {"type": "array", "minItems": 1, "uniqueItems": True, "items": one_type}]},
        "multipleOf": {"type": "number", "exclusiveMinimum": 0},
        "required": names,
        "dependentRequired": {"type": "object", "additionalProperties": names},
    }
    return {"type": ["object", "boolean"], "properties": shapes}


def _no_patterns(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of distinct texts those that are no regular expressions."""
    for batch in batches:
        bad = []
        for pattern in batch.column(0).to_pylist():
            try:
                java_regex(pattern)
            except RegexError:
                bad.append(pattern)
        yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], ["pattern"])


def malformed_schemas(schemas: DataFrame, column: str = "schema") -> DataFrame:
    """The distinct texts of ``column`` that are no well-formed schemas, as ``column``; null texts are left out."""
    folder = new_folder(schemas.sparkSession, "schemas")
    schemas.select(column).where(F.col(column).isNotNull()).distinct().withColumn("row", F.monotonically_increasing_id()).write.parquet(folder)
    distinct = schemas.sparkSession.read.parquet(folder)
    parsed = distinct.select("row", F.try_parse_json(column).alias("value"))
    plan = SchemaPlan(keyword_shapes(), depth=1)
    levels, n = frontier(parsed.where("value is not null"), plan)
    wrong = row_errors(schemas.sparkSession, plan, levels, n).select("row")

    value = F.col("value")
    string: Column = F.when(kind(member(value, "pattern")) == "string", F.try_variant_get(value, "$.pattern", "string"))
    by_pattern = F.when(kind(member(value, "patternProperties")) == "object", F.map_keys(member(value, "patternProperties").cast("map<string,variant>")))
    given = F.array_compact(F.concat(F.array(string), F.coalesce(by_pattern, F.array().cast("array<string>"))))
    asked = schemas.sparkSession.read.parquet(levels).select("row", F.explode(given).alias("pattern")).distinct()
    bad = asked.select("pattern").distinct().mapInArrow(_no_patterns, "pattern string")
    wrong = wrong.unionAll(asked.join(bad, "pattern").select("row")).unionAll(parsed.where("value is null").select("row")).distinct()
    return distinct.join(wrong, "row").select(column)
