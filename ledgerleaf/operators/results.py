"""Structured results: classifying backend outputs, validating them, joining them to documents, envelopes, requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions import canonical, text
from ledgerleaf.functions.nested import exploded
from ledgerleaf.operators import documents as D
from ledgerleaf.operators.jsonschema import SchemaRequest, is_text_identifier, kind, with_json_errors
from ledgerleaf.operators.schema_rows import malformed_schemas

#: How each style of backend is called, and the request limits.
BACKENDS = {"openai": "openai_responses_v1", "groq": "groq_chat_completions_v1"}
MAX_REQUEST_BYTES, MAX_MODEL, MAX_DOCUMENT_NAME = 1_048_576, 200, 256
SCHEMA_MEMBERS = ("name", "version", "schema")
REQUEST_MEMBERS = ("schemaVersion", "rawDocument", "schemaRequest", "provider", "model", "documentName")


def classify_backend_output(output: Column, style: str, status: Column | None = None, n_choices: Column | None = None, has_message: Column | None = None) -> Column:
    """Why a backend's output can't be used, or null: anything but a JSON object of a finished response fails."""
    reason = F.when(F.lit(False), "")
    if style == "openai" and status is not None:
        reason = reason.when(~status.eqNullSafe(F.lit("completed")), "not_completed")
    if style == "groq" and n_choices is not None:
        reason = reason.when(F.coalesce(n_choices, F.lit(0)) <= 0, "no_choices")
    if style == "groq" and has_message is not None:
        reason = reason.when(~F.coalesce(has_message, F.lit(False)), "no_message")
    value = F.try_parse_json(output)
    return reason.when(text.is_blank(output), "blank_output").when(value.isNull(), "invalid_json").when(kind(value) != "object", "not_an_object")


def check_backend_result(confidence: Column) -> Column:
    """Reason if a confidence is given and lies outside 0 to 1."""
    return F.when(confidence.isNotNull() & ~F.coalesce(confidence.between(0, 1), F.lit(False)), "confidence_out_of_range")


def backend_name(style: str, model: Column) -> tuple[Column, Column]:
    """(name, reason): the style's name and the model, which is a required identifier."""
    value, reason = text.identifier(model, "model")
    return F.concat(F.lit(BACKENDS[style] + ":"), value), reason


def structured_result(document_type: Column, data: Column, backend: Column, errors: Column, confidence: Column) -> Column:
    """The result of one document: the raw data unchanged, the schema check, and its verdict."""
    good = F.size(errors) == 0
    message = F.when(good, "The data fits the schema.").otherwise("The data does not fit the schema.")
    check = F.struct(F.when(good, "passed").otherwise("failed").alias("status"), message.alias("message"), F.create_map(F.lit("errors"), F.to_json(errors)).alias("details"))
    status = F.when(good, "valid").otherwise("invalid")
    validation = F.struct(status.alias("status"), F.create_map(F.lit("json_schema"), check).alias("checks"), F.when(good, 1.0).otherwise(0.0).alias("confidence"))
    return F.struct(F.concat(F.lit("schema_driven_text_v1:"), backend).alias("engine"), document_type.alias("document_type"), data.alias("data"), confidence.cast("double").alias("confidence"), status.alias("validation_status"), validation.alias("validation"))


def extract_with_results(docs: DataFrame, outputs: DataFrame, request: SchemaRequest, style: str = "openai") -> DataFrame:
    """Documents joined to backend outputs (document_id, backend, output_text, status, confidence).

    Every document gets a row: ``failure`` says why there is no result (a missing output is one too), ``result`` is
    the structured result otherwise, valid or not.
    """
    joined = docs.join(outputs.withColumn("_answered", F.lit(True)), "document_id", "left")
    failure = (
        F.when(F.col("_answered").isNull(), "missing_output")
        .when(~is_text_identifier(F.col("backend")), "backend_name_not_normal")
        .otherwise(F.coalesce(classify_backend_output(F.col("output_text"), style, status=F.col("status")), check_backend_result(F.col("confidence"))))
    )
    joined = with_json_errors(joined.withColumn("failure", failure), F.when(F.col("failure").isNull(), F.col("output_text")), request, "_errors")
    result = F.when(F.col("failure").isNull(), structured_result(F.col("document_type"), F.col("output_text"), F.col("backend"), F.col("_errors"), F.col("confidence")))
    return joined.withColumn("result", result).withColumnRenamed("_errors", "schema_errors").drop("_answered", "backend", "output_text", "status", "confidence")


def normalized_struct() -> Column:
    """A normalised document's columns as a struct with its members in key order."""
    times = {t: canonical.canonical_datetime(F.col("source")[t]) for t in D.TIMES}
    source = F.struct(F.col("source.provider").alias("provider"), times["published_at"].alias("published_at"), times["retrieved_at"].alias("retrieved_at"), F.col("source.source_document_id").alias("source_document_id"), times["source_timestamp"].alias("source_timestamp"), F.col("source.source_uri").alias("source_uri"))
    people = F.transform("participants", lambda p: F.struct(*(p[k].alias(k) for k in ("display_name", "organization", "participant_id", "role"))))
    said = F.transform("segments", lambda s: F.struct(*(s[k].alias(k) for k in ("participant_id", "segment_id", "sequence", "text"))))
    return F.struct("document_id", "document_type", "fingerprint", people.alias("participants"), said.alias("segments"), source.alias("source"), "title")


def model_input(df: DataFrame) -> DataFrame:
    """document_id and the canonical JSON of the complete normalised document."""
    return df.select("document_id", canonical.canonical_json(normalized_struct()).alias("model_input"))


def response_envelope(df: DataFrame) -> DataFrame:
    """document_id and the JSON response of every document with a result: its data and its errors as JSON, unchanged."""
    whole = {"ignoreNullFields": "false"}
    r = F.col("result")
    inner = lambda c: F.regexp_replace(F.to_json(c, whole), r"^\{|\}$", "")
    check = r["validation"]["checks"]["json_schema"]
    checked = F.concat(F.lit("{"), inner(F.struct(check["status"].alias("status"), check["message"].alias("message"))), F.lit(',"details":{"errors":'), check["details"]["errors"], F.lit("}}"))
    validation = F.concat(F.lit('{"status":'), F.concat(F.lit('"'), r["validation"]["status"], F.lit('"')), F.lit(',"checks":{"json_schema":'), checked, F.lit('},"confidence":'), r["validation"]["confidence"].cast("string"), F.lit("}"))
    result = F.concat(F.lit("{"), inner(F.struct(r["engine"].alias("engine"), r["document_type"].alias("document_type"))), F.lit(',"data":'), r["data"], F.lit(","), inner(F.struct(r["confidence"].alias("confidence"), r["validation_status"].alias("validation_status"))), F.lit(',"validation":'), validation, F.lit("}"))
    body = F.concat(F.lit('{"schemaVersion":1,"normalizedDocument":'), canonical.canonical_json(normalized_struct()), F.lit(',"structuredResult":'), result, F.lit("}"))
    return df.where(r.isNotNull()).select("document_id", body.alias("response"))


def check_evidence_ids(docs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Rows of ``evidence`` (document_id, segment_id, ...) that name no segment of their document."""
    return check_evidence_rows(exploded(docs, "segments.segment_id", "_at", "segment_id", "document_id"), evidence)


def check_evidence_rows(segments: DataFrame, evidence: DataFrame) -> DataFrame:
    """The flat form of ``check_evidence_ids``: ``segments`` (document_id, segment_id), one row each."""
    return evidence.join(segments.select("document_id", "segment_id"), ["document_id", "segment_id"], "left_anti")


def triage_requests(requests: DataFrame, body: str = "body") -> DataFrame:
    """Add ``outcome`` to rows of JSON request bodies: too_large, invalid_request or accepted.

    The JSON Schemas inside the bodies are checked as a whole, each distinct one once.
    """
    v = F.try_parse_json(F.col(body))
    got = lambda k: F.try_variant_get(v, f"$.{k}", "variant")
    string = lambda k: F.when(kind(got(k)) == "string", F.try_variant_get(v, f"$.{k}", "string"))
    raw = F.to_json(got("rawDocument"))
    parsed = F.from_json(raw, D.RAW_SCHEMA)
    unknown = F.size(F.array_except(F.map_keys(v.cast("map<string,variant>")), F.array(*map(F.lit, REQUEST_MEMBERS)))) > 0
    schema_root = F.try_variant_get(v, "$.schemaRequest.schema.type", "string")
    version = F.try_variant_get(v, "$.schemaRequest.version", "variant")
    asked = F.when(kind(got("schemaRequest")) == "object", F.map_keys(got("schemaRequest").cast("map<string,variant>")))
    strange = F.coalesce(F.size(F.array_except(asked, F.array(*map(F.lit, SCHEMA_MEMBERS)))) > 0, F.lit(True))
    ok = (
        (kind(v) == "object")
        & ~unknown
        & (F.try_variant_get(v, "$.schemaVersion", "double") == 1)
        & string("provider").isin(*BACKENDS)
        & ~text.is_blank(string("model"))
        & (F.length(string("model")) <= MAX_MODEL)
        & (F.coalesce(kind(got("documentName")), F.lit("null")).isin("string", "null"))
        & (F.coalesce(F.length(string("documentName")), F.lit(0)) <= MAX_DOCUMENT_NAME)
        & (kind(got("rawDocument")) == "object")
        & (F.size(D.unknown_fields(raw)) == 0)
        & ~strange
        & (schema_root == "object")
        & (kind(version) == "integer")
        & (F.try_variant_get(version, "$", "double") > 0)
        & ~text.is_blank(F.try_variant_get(v, "$.schemaRequest.name", "string"))
    )
    schema = F.to_json(F.try_variant_get(v, "$.schemaRequest.schema", "variant"))
    checked = requests.withColumn("_ok", F.coalesce(ok, F.lit(False))).withColumn("_raw", parsed).withColumn("_schema", F.when(F.col("_ok"), schema))
    malformed = malformed_schemas(checked, "_schema").select(F.col("_schema").alias("_bad_schema"))
    checked = checked.join(malformed, F.col("_schema") == F.col("_bad_schema"), "left").withColumn("_ok", F.col("_ok") & F.col("_bad_schema").isNull())
    outer = [c for c in requests.columns if c not in D.NAMES]
    checked = D.normalize_documents(checked.select(*outer, "_ok", *(F.col("_raw")[c].alias(c) for c in D.NAMES)))
    outcome = F.when(F.octet_length(F.col(body)) > MAX_REQUEST_BYTES, "too_large").when(F.col("_ok") & (F.size("errors") == 0), "accepted").otherwise("invalid_request")
    return checked.select(*outer, outcome.alias("outcome"))


def outcome_of(df: DataFrame) -> DataFrame:
    """document_id, outcome (0 good, 2 invalid against the schema, 1 failed) and the failure's type, without any text."""
    status = F.col("result.validation_status")
    return df.select("document_id", F.when(F.col("failure").isNotNull(), 1).when(status == "valid", 0).otherwise(2).alias("outcome"), F.col("failure").alias("error_type"))
