"""JSON Schema, backend outputs, registry and requests."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerleaf.operators import jsonschema as J
from ledgerleaf.operators import registry as G
from ledgerleaf.operators import results as X
from ledgerleaf.operators.engines import EngineRegistry
from ledgerleaf.streaming.registration import register_results_stream

SCHEMA = {"type": "object", "additionalProperties": False, "required": ["category", "score"], "properties": {"category": {"type": "string"}, "score": {"type": "number"}}}


def errors(spark, schema, *payloads):
    request = J.schema_request("s", 1, schema)
    texts = [p if isinstance(p, str) else json.dumps(p) for p in payloads]
    got = J.validate_json(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, t string"), "t", request).orderBy("n").collect()
    assert [r.t for r in got] == texts
    return [None if r.schema_errors is None else [(e.path, e.schema_path, e.validator) for e in r.schema_errors] for r in got]


def test_basic_errors(spark):
    got = errors(spark, SCHEMA, {"category": "a", "score": 1}, {"category": 7, "extra": True}, {"category": "a", "score": "0.75"}, "nope", "[]", {"category": "a", "score": None})
    assert got[0] == []
    assert got[1] == [("$", "#/additionalProperties", "additionalProperties"), ("$", "#/required", "required"), ('$["category"]', "#/properties/category/type", "type")]
    assert got[2] == [('$["score"]', "#/properties/score/type", "type")]
    assert got[3] is None and got[4] == [("$", "#/type", "type")]
    assert got[5] == [('$["score"]', "#/properties/score/type", "type")]


@pytest.mark.parametrize(
    ("sub", "good", "bad", "where", "validator"),
    [
        ({"type": "integer"}, 7.0, "7", '$["x"]', "type"),
        ({"enum": [1, "a", None]}, 1.0, "b", '$["x"]', "enum"),
        ({"const": {"a": [1]}}, {"a": [1]}, {"a": [2]}, '$["x"]', "const"),
        ({"minimum": 2, "exclusiveMaximum": 5}, 2, 5, '$["x"]', "exclusiveMaximum"),
        ({"multipleOf": 0.5}, 1.5, 1.2, '$["x"]', "multipleOf"),
        ({"minLength": 2, "maxLength": 3}, "äö", "abcd", '$["x"]', "maxLength"),
        ({"pattern": "^a"}, "ab", "ba", '$["x"]', "pattern"),
        ({"items": {"type": "object", "required": ["id"]}}, [{"id": 1}], [{"id": 1}, {}], '$["x"][1]', "required"),
        ({"prefixItems": [{"type": "string"}], "items": False}, ["a"], ["a", 1], '$["x"][1]', "false schema"),
        ({"minItems": 1, "uniqueItems": True}, [1, 2], [1, 1], '$["x"]', "uniqueItems"),
        ({"contains": {"type": "string"}}, [1, "a"], [1], '$["x"]', "contains"),
        ({"minProperties": 1}, {"a": 1}, {}, '$["x"]', "minProperties"),
        ({"propertyNames": {"maxLength": 1}}, {"a": 1}, {"ab": 1}, '$["x"]', "maxLength"),
        ({"patternProperties": {"^n": {"type": "number"}}}, {"n": 1, "s": "a"}, {"n1": "a"}, '$["x"]["n1"]', "type"),
        ({"additionalProperties": {"type": "number"}}, {"n": 1}, {"n": "a"}, '$["x"]["n"]', "type"),
        ({"dependentRequired": {"a": ["b"]}}, {"b": 1}, {"a": 1}, '$["x"]', "dependentRequired"),
        ({"allOf": [{"type": "string"}, {"minLength": 2}]}, "ab", "a", '$["x"]', "minLength"),
        ({"anyOf": [{"type": "string"}, {"type": "null"}]}, None, 1, '$["x"]', "anyOf"),
        ({"oneOf": [{"type": "number"}, {"minimum": 3}]}, 1, 4, '$["x"]', "oneOf"),
        ({"not": {"type": "string"}}, 1, "a", '$["x"]', "not"),
        ({"if": {"type": "string"}, "then": {"minLength": 2}, "else": {"minimum": 3}}, "ab", 2, '$["x"]', "minimum"),
        ({"$ref": "#/$defs/p"}, 1, 0, '$["x"]', "minimum"),
    ],
)
def test_keywords(spark, sub, good, bad, where, validator):
    schema = {"type": "object", "properties": {"x": sub}, "$defs": {"p": {"minimum": 1}}}
    fine, wrong, absent = errors(spark, schema, {"x": good}, {"x": bad}, {})
    assert fine == [] and absent == []
    assert [(p, v) for p, _, v in wrong] == [(where, validator)]


def test_requests_fail_before_any_work():
    for bad in ({"type": 123}, {"type": "array"}, {"type": "object", "$ref": "#"}, {"type": "object", "properties": {"a": {"$ref": "other"}}}, {"type": "object", "properties": {"a": {"$ref": "#nowhere"}}}, {"type": "object", "properties": {"a": {"type": "text"}}}):
        with pytest.raises(J.SchemaRequestError):
            J.schema_request("s", 1, bad)
    for name, version in ((" ", 1), ("a\nb", 1), ("a", 0), ("a", True), ("a", "1")):
        with pytest.raises(J.SchemaRequestError):
            J.schema_request(name, version, {"type": "object"})
    with pytest.raises(J.SchemaRequestError):
        J.schema_request("s", 1, {"type": "object"}, more=1)
    assert J.schema_path(("a/b", "c~d")) == "#/a~1b/c~0d"


def test_backend_outputs_fail_closed(spark):
    cases = {"": "blank_output", "   ": "blank_output", "not-json": "invalid_json", "[1,2,3]": "not_an_object", '"text"': "not_an_object", "null": "not_an_object", '{"a":1}': None, None: "blank_output"}
    df = spark.createDataFrame([(c,) for c in cases], "o string")
    assert [r.r for r in df.select(X.classify_backend_output(F.col("o"), "openai").alias("r")).collect()] == list(cases.values())
    status = spark.createDataFrame([("{}", s) for s in ("completed", "failed", "incomplete", None)], "o string, s string")
    assert [r.r for r in status.select(X.classify_backend_output(F.col("o"), "openai", status=F.col("s")).alias("r")).collect()] == [None, *["not_completed"] * 3]
    confidence = spark.createDataFrame([(c,) for c in (None, 0.0, 1.0, -0.01, 1.01)], "c double")
    assert [r.r for r in confidence.select(X.check_backend_result(F.col("c")).alias("r")).collect()] == [None] * 3 + ["confidence_out_of_range"] * 2
    name, reason = X.backend_name("groq", F.col("m"))
    got = spark.createDataFrame([(" m ",), (" ",), ("a\nb",)], "m string").select(name.alias("n"), reason.alias("r")).collect()
    assert got[0].n == "groq_chat_completions_v1:m" and [r.r for r in got] == [None, "model_blank", "model_multiline"]


def test_results_join(spark):
    docs = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "t")], "document_id string, document_type string")
    outputs = spark.createDataFrame([("a", "m", '{"category":"x","score":1.50}', "completed", 0.5), ("b", "m", '{"category":1}', "completed", None)], "document_id string, backend string, output_text string, status string, confidence double")
    a, b, c = X.extract_with_results(docs, outputs, J.schema_request("s", 1, SCHEMA)).orderBy("document_id").collect()
    assert a.result.data == '{"category":"x","score":1.50}' and a.result.validation_status == "valid" and a.result.validation.confidence == 1.0 and a.result.confidence == 0.5
    assert a.result.engine == "schema_driven_text_v1:m" and b.result.validation_status == "invalid" and len(b.schema_errors) == 2
    assert c.result is None and c.failure == "missing_output"
    outcomes = X.outcome_of(X.extract_with_results(docs, outputs, J.schema_request("s", 1, SCHEMA))).orderBy("document_id").collect()
    assert [(o.outcome, o.error_type) for o in outcomes] == [(0, None), (2, None), (1, "missing_output")]


def test_payload_rules(spark):
    good = {"engine": "e", "document_type": " t ", "data": {}, "validation_status": " Valid ", "confidence": 0.12345}
    cases = [(good, None), ([], "not_an_object"), ({**good, "engine": " "}, "engine_missing"), ({**good, "document_type": 1}, "document_type_missing"), ({**good, "data": []}, "data_not_an_object"), ({**good, "validation_status": None}, "validation_status_missing"), ({**good, "validation_status": "ok"}, "validation_status_unknown"), ({**good, "confidence": "0.5"}, "confidence_out_of_range"), ({**good, "confidence": 1.01}, "confidence_out_of_range"), ({**good, "confidence": None}, None)]
    reason, stored = G.check_result_payload(F.col("p"))
    got = spark.createDataFrame([(json.dumps(c),) for c, _ in cases], "p string").select(reason.alias("r"), stored.alias("s")).collect()
    assert [r.r for r in got] == [r for _, r in cases]
    assert (got[0].s.document_type, got[0].s.validation_status, str(got[0].s.confidence)) == ("t", "Valid", "0.1235")


def test_storage_keys(spark):
    cases = {"2026/09/document.pdf": None, "../outside.pdf": "key_outside_root", "a/../../b": "key_outside_root", "a/../b": None, " ": "key_blank", None: "key_blank", "/a": "key_absolute", "..\\a": "key_outside_root", ".": "key_outside_root"}
    got = spark.createDataFrame([(c,) for c in cases], "k string").select(G.check_storage_key(F.col("k")).alias("r")).collect()
    assert [r.r for r in got] == list(cases.values())


def test_registering_as_a_stream(spark, tmp_path):
    docs = spark.createDataFrame([("a", "Uploaded"), ("b", "Uploaded")], "id string, status string")
    docs.write.parquet(str(tmp_path / "docs"))
    payload = json.dumps({"engine": "e", "document_type": "t", "data": {}, "validation_status": "incomplete"})
    schema = "document_id string, arrival bigint, payload string"

    def send(n, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        register_results_stream(stream, str(tmp_path / "docs"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()

    send(1, [("a", 2, payload), ("a", 1, payload), ("z", 3, payload)])
    send(2, [("a", 4, payload), ("b", 5, payload), ("b", 6, "{}")])
    got = {(r.document_id, r.arrival): r.outcome for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 1): 201, ("a", 2): 409, ("z", 3): 404, ("a", 4): 409, ("b", 5): 201, ("b", 6): 400}


def test_document_rows_and_keys(spark):
    rows = [("c", " a.pdf ", "application/pdf", "k", 1, None, None), ("", "", "x" * 101, "k", 0, "t" * 101, "S")]
    df = spark.createDataFrame([(r[0] or None, *r[1:]) for r in rows], "customer_id string, original_file_name string, content_type string, storage_key string, size bigint, document_type string, status string").withColumn("created_at", F.lit(None).cast("timestamp"))
    good, bad = G.check_document_rows(df).collect()
    assert good.problems == [] and good.status == "Uploaded" and good.original_file_name == "a.pdf" and good.created_at is not None
    assert bad.problems == ["customer_id_empty", "original_file_name_blank", "size_not_positive", "content_type_too_long", "document_type_too_long"]
    key = spark.range(1).select(G.mint_storage_key(F.lit("2026-09-02").cast("timestamp"), F.lit(".pdf")).alias("k")).first().k
    assert key.startswith("2026/09/") and len(key) == 8 + 32 + 4


def test_engines(spark):
    engines = EngineRegistry()
    engines.register("upper", lambda df: df.withColumn("up", F.upper("t")))
    engines.register("drops", lambda df: df.drop("t"))
    df = spark.createDataFrame([("a",)], "t string")
    assert engines.names() == ["drops", "upper"] and engines.apply("upper", df).first().up == "A"
    with pytest.raises(ValueError):
        engines.apply("drops", df)
    with pytest.raises(ValueError):
        engines.register("upper", lambda df: df)


@pytest.mark.parametrize(
    "part",
    [
        {"required": "abc"},
        {"required": ["a", "a"]},
        {"minLength": "x"},
        {"minLength": -1},
        {"maxItems": -1},
        {"maxItems": 1.5},
        {"pattern": "("},
        {"patternProperties": {"(": True}},
        {"properties": [1]},
        {"properties": {"a": 1}},
        {"minimum": "x"},
        {"minimum": True},
        {"multipleOf": 0},
        {"uniqueItems": 1},
        {"enum": "a"},
        {"items": [True]},
        {"anyOf": []},
        {"not": None},
        {"$defs": {"a": {"type": "text"}}},
        {"dependentRequired": {"a": "b"}},
        {"properties": {"a": {"items": {"maxLength": []}}}},
        {"title": 1},
    ],
)
def test_malformed_schemas_are_refused(spark, part):
    with pytest.raises(J.SchemaRequestError):
        J.schema_request("s", 1, {"type": "object", **part})


def test_well_formed_schemas_pass(spark):
    assert J.schema_request(" s ", 2, {"type": "object", "minProperties": 1.0, "properties": {"a": True, "b": {"type": ["string", "null"], "default": 3}}}).name == "s"


def test_whole_numbers_are_compared_exactly(spark):
    big = 9007199254740993
    schema = {"type": "object", "properties": {"a": {"maximum": big - 1}, "b": {"const": big}, "c": {"exclusiveMinimum": big}, "d": {"multipleOf": 2}, "e": {"maximum": 0.5}}}
    got = errors(spark, schema, f'{{"a":{big}}}', f'{{"a":{big - 1},"b":{big - 1}}}', f'{{"b":{big},"c":{big}}}', f'{{"c":{big + 1},"d":{10**30 + 1}}}', f'{{"d":{10**30},"e":1}}', '{"a":1e3,"e":0.5,"d":4.0}')
    assert [[(p, v) for p, _, v in row] for row in got] == [[('$["a"]', "maximum")], [('$["b"]', "const")], [('$["c"]', "exclusiveMinimum")], [('$["d"]', "multipleOf")], [('$["e"]', "maximum")], []]


def test_paths_quote_keys_as_json(spark):
    schema = {"type": "object", "additionalProperties": {"type": "string"}, "patternProperties": {"^é": {"minimum": 3}}}
    (got,) = errors(spark, schema, {'a"b': 1, "c\n": 2, "é\\": 1})
    assert sorted(p for p, _, _ in got) == ['$["a\\"b"]', '$["c\\n"]', '$["é\\\\"]']


def test_ties_register_one_result(spark):
    payload = json.dumps({"engine": "e", "document_type": "t", "data": {}, "validation_status": "valid"})
    other = payload.replace('"e"', '"f"')
    docs = spark.createDataFrame([(i, "Uploaded", None, None) for i in "abcd"], "id string, status string, document_type string, processed_at timestamp")
    taken = spark.createDataFrame([("d",)], "document_id string")
    rows = [("a", 1, payload), ("a", 1, payload), ("a", 1, other), ("a", None, payload), ("b", None, payload), ("b", None, payload), ("c", None, payload), ("c", 9, other), ("d", 1, payload), ("z", 1, payload), ("a", 0, "{}"), (None, 1, payload)]
    incoming = spark.createDataFrame([(*r, "x") for r in rows], "document_id string, arrival bigint, payload string, known string").repartition(5)
    done = G.register_results(docs, taken, incoming.drop("known"))
    got = sorted((r.document_id or "", r.outcome) for r in done.collect())
    assert got == sorted([("a", 201), ("a", 409), ("a", 409), ("a", 409), ("b", 201), ("b", 409), ("c", 201), ("c", 409), ("d", 409), ("z", 404), ("a", 400), ("", 404)])
    assert done.where("document_id = 'c' and outcome = 201").first().arrival == 9
    after = G.apply_status(docs, done.unionByName(done), F.current_timestamp()).orderBy("id").collect()
    assert [(r.id, r.status) for r in after] == [("a", "Processed"), ("b", "Processed"), ("c", "Processed"), ("d", "Uploaded")]


def test_a_stream_of_many_batches_keeps_one_result(spark, tmp_path, monkeypatch):
    from ledgerleaf.streaming import registration

    monkeypatch.setattr(registration, "COMPACTED", 3)
    spark.createDataFrame([(str(i), "Uploaded") for i in range(4)], "id string, status string").write.parquet(str(tmp_path / "docs"))
    payload = json.dumps({"engine": "e", "document_type": "t", "data": {}, "validation_status": "valid"})
    schema = "document_id string, arrival bigint, payload string"
    for n in range(8):
        spark.createDataFrame([(str(n % 4), n, payload), (str(n % 2), n, payload)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    register_results_stream(stream, str(tmp_path / "docs"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    done = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.document_id for r in done.where("outcome = 201").collect()) == list("0123") and done.count() == 16
    assert {r.kind for r in spark.read.parquet(str(tmp_path / "out-ids")).select("kind").distinct().collect()} == {"new", "whole"}
