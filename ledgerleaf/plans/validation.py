"""Queries over JSON payloads, backend outputs, the registry and request bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.functions.nested import exploded
from ledgerleaf.operators import documents as D
from ledgerleaf.operators import jsonschema as J
from ledgerleaf.operators import registry as G
from ledgerleaf.operators import results as X
from ledgerleaf.plans.transcripts import accepted_turns, distinct_turns, document_ctes, table, transcripts

def event_request() -> J.SchemaRequest:
    return J.schema_request("event props", 1, {"type": "object", "additionalProperties": False, "required": ["k", "source"], "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 90}}})


def label_request() -> J.SchemaRequest:
    return J.schema_request("label", 1, {"type": "object", "additionalProperties": False, "required": ["category", "score"], "properties": {"category": {"type": "string", "enum": ["good", "bad"]}, "score": {"type": "number", "exclusiveMinimum": 0}}})


def schema_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every schema error of the events' properties."""
    done = J.validate_json(table(spark, sf_dir, "events").select("event_id", "props"), "props", event_request())
    return exploded(done, "schema_errors", "at", "e", "event_id").select("event_id", "e.path", "e.schema_path", "e.validator")


def schema_error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema errors of the events' properties, counted."""
    return J.schema_error_summary(J.validate_json(table(spark, sf_dir, "events").select("event_id", "props"), "props", event_request()))


def backend_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs made from each label, in nine forms by doc_id."""
    category = F.when(F.col("quality") == 1, "good").otherwise("bad")
    good = F.concat(F.lit('{"category":"'), category, F.lit('","score":'), F.col("quality") + 0.5, F.lit("}"))
    forms = [good, F.lit(""), F.lit("   "), F.lit("not-json"), F.lit("[1,2,3]"), F.lit("null"), F.replace(good, F.lit('"score":'), F.lit('"score":"x","extra":')), F.concat(F.lit('{"category":'), F.col("toxic"), F.lit("}")), good]
    n = F.col("doc_id") % 9
    output = F.element_at(F.array(*forms), (n + 1).cast("int"))
    status = F.when(F.col("doc_id") % 11 == 10, "incomplete").otherwise("completed")
    confidence = F.when(F.col("doc_id") % 13 == 12, 1.5).when(F.col("doc_id") % 13 == 11, None).otherwise(0.75)
    return table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id")).alias("document_id"), F.lit("openai_responses_v1:model-a").alias("backend"), output.alias("output_text"), status.alias("status"), confidence.alias("confidence"))


def backend_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each backend output fails, in both styles."""
    rows = backend_outputs(spark, sf_dir)
    plain = X.classify_backend_output(F.col("output_text"), "openai", status=F.col("status"))
    chat = X.classify_backend_output(F.col("output_text"), "groq", n_choices=F.when(F.col("doc_id") % 7 == 6, 0).otherwise(1), has_message=F.col("doc_id") % 5 != 4)
    return rows.select("doc_id", plain.alias("openai"), chat.alias("groq"), X.check_backend_result(F.col("confidence")).alias("confidence"))


def _labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id")).alias("document_id"), F.col("source").alias("document_type"))


def structured_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its backend output: a result that fits the schema or not, or a failure."""
    done = X.extract_with_results(_labelled_documents(spark, sf_dir), backend_outputs(spark, sf_dir).drop("doc_id"), label_request())
    return done.select("doc_id", "failure", "result.engine", "result.document_type", "result.data", "result.confidence", "result.validation_status", F.size("schema_errors").alias("n_errors"))


def extraction_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents end in each outcome."""
    done = X.extract_with_results(_labelled_documents(spark, sf_dir), backend_outputs(spark, sf_dir).drop("doc_id"), label_request())
    return X.outcome_of(done).groupBy("outcome", "error_type").agg(F.count(F.lit(1)).alias("n"))


def model_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the canonical JSON of every transcript, as a backend would get it."""
    return X.model_input(D.split_valid(transcripts(spark, sf_dir))[0]).select("document_id", F.sha2("model_input", 256).alias("input_sha256"), F.length("model_input").alias("n_chars"))


def unknown_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that names no segment: a copied id in conversations 0 modulo 4 is changed."""
    good = accepted_turns(spark, sf_dir)
    ident = F.when(F.col("conv_id") % 4 == 0, F.concat("segment_id", F.lit("x"))).otherwise(F.col("segment_id"))
    return X.check_evidence_rows(good, good.select("document_id", ident.alias("segment_id"), "sequence"))


def registry_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a registry; every tenth shares its key with the one before."""
    n = F.col("doc_id")
    key = F.concat(F.lit("2026/09/"), F.when(n % 10 == 9, n - 1).otherwise(n), F.lit(".pdf"))
    none = F.lit(None)
    return table(spark, sf_dir, "documents").select(n.cast("string").alias("id"), F.col("source").alias("customer_id"), F.concat(n, F.lit(".pdf")).alias("original_file_name"), F.lit("application/pdf").alias("content_type"), key.alias("storage_key"), F.col("n_chars").alias("size"), none.cast("string").alias("document_type"), F.lit("Uploaded").alias("status"), F.lit("2026-09-01 00:00:00").cast("timestamp").alias("created_at"), none.cast("timestamp").alias("processed_at"), none.cast("timestamp").alias("delete_at"))


def incoming_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results for each label and, again, for every third; some payloads break a rule, some documents don't exist."""
    n = F.col("doc_id")
    status = F.element_at(F.array(*map(F.lit, ("valid", " INVALID", "incomplete", "unknown"))), (n % 4 + 1).cast("int"))
    confidence = F.element_at(F.array(*map(F.lit, ("0.5", "null", "1.5", '"0.5"', "1", "0"))), (n % 6 + 1).cast("int"))
    data = F.when(n % 17 == 16, "[]").otherwise("{}")
    payload = F.concat(F.lit('{"engine":"e","document_type":" t'), n % 3, F.lit(' ","data":'), data, F.lit(',"validation_status":"'), status, F.lit('","confidence":'), confidence, F.lit("}"))
    target = F.when(n % 19 == 18, F.concat(F.lit("lost-"), n)).otherwise(n.cast("string"))
    labels = table(spark, sf_dir, "labels").select(target.alias("document_id"), n.alias("arrival"), payload.alias("payload"))
    return labels.unionAll(labels.where("arrival % 3 = 0").withColumn("arrival", F.col("arrival") + 1_000_000))


def earlier_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("doc_id % 23 = 22").select(F.col("doc_id").cast("string").alias("document_id"))


def _registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.register_results(registry_documents(spark, sf_dir), earlier_results(spark, sf_dir), incoming_results(spark, sf_dir))


def result_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of every incoming result and what is stored of it."""
    return _registered(spark, sf_dir).select("document_id", "arrival", "outcome", "reason", "stored.validation_status", "stored.document_type", "stored.confidence")


def document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after the registration."""
    at = F.lit("2026-09-02 00:00:00").cast("timestamp")
    return G.apply_status(registry_documents(spark, sf_dir), _registered(spark, sf_dir), at).select("id", "status", "document_type", "processed_at")


def registry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by status after the registration."""
    return G.registry_counts(G.apply_status(registry_documents(spark, sf_dir), _registered(spark, sf_dir)), "status")


def registry_key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storage keys used twice, documents with several good results, results without a document."""
    return G.check_registry_keys(registry_documents(spark, sf_dir), incoming_results(spark, sf_dir))


def surviving_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier results after the documents with an even id are deleted."""
    deleted = registry_documents(spark, sf_dir).where("cast(id as bigint) % 2 = 0")
    return G.cascade_delete(earlier_results(spark, sf_dir), deleted)


def document_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its stored result, if it has one."""
    stored = G.stored_results(_registered(spark, sf_dir), F.lit("2026-09-02 00:00:00").cast("timestamp"))
    return G.documents_with_results(registry_documents(spark, sf_dir).select("id", "customer_id"), stored).select("id", "customer_id", "validation_status", "confidence")


def intake_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads made of the documents, screened; every rule is broken by some."""
    n = F.col("doc_id")
    uploads = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(n % 7 == 0, "").otherwise(F.col("source")).alias("customer_id"),
        F.when(n % 5 == 0, "a.txt").otherwise("a.PDF").alias("file_name"),
        F.when(n % 11 == 0, 0).when(n % 13 == 0, 30_000_000).otherwise(F.col("n_chars")).cast("long").alias("size"),
        F.when(n % 3 == 0, "text/plain").otherwise("Application/PDF").alias("content_type"),
        F.when(n % 2 == 0, F.lit(b"%PDF-1.7")).otherwise(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("content"),
    )
    return G.screen_intake(uploads).select("doc_id", "rejection")


def storage_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in eight shapes, by doc_id."""
    n = F.col("doc_id").cast("string")
    shapes: list[Column] = [F.concat(F.lit("2026/09/"), n), F.concat(F.lit("../"), n), F.lit("  "), F.concat(F.lit("/abs/"), n), F.concat(F.lit("a/../"), n), F.concat(F.lit("a/../../"), n), F.lit("a/.."), F.concat(F.lit("C:/"), n)]
    key = F.element_at(F.array(*shapes), (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", G.check_storage_key(key).alias("reason"))


def storage_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry keys against files: every 31st file is missing, every 29th document has a file too many."""
    docs = table(spark, sf_dir, "documents")
    files = docs.where("doc_id % 31 <> 30").select(F.concat(F.lit("k/"), F.col("doc_id")).alias("storage_key")).unionAll(docs.where("doc_id % 29 = 28").select(F.concat(F.lit("x/"), F.col("doc_id"))))
    return G.reconcile_storage(docs.select(F.concat(F.lit("k/"), F.col("doc_id")).alias("storage_key")), files)


def request_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies made of conversation turns, triaged; most rules are broken by some."""
    n = F.col("conv_id")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("t"))), r'(?s)\A\{"t":(.*)\}\z', 1)
    provider = F.when(n % 5 == 4, "other").when(n % 2 == 0, "openai").otherwise("groq")
    model = F.when(n % 7 == 6, "").otherwise("m")
    uri = F.when(n % 11 == 10, '""').otherwise('"u"')
    more = F.when(n % 13 == 12, ',"more":1').otherwise("")
    wrong = F.when(n % 17 == 16, '{"maxLength":"3"}').when(n % 19 == 18, '{"pattern":"("}').when(n % 23 == 22, '{"required":["a","a"]}').otherwise('{"type":["string","null"]}')
    schema = F.concat(F.lit('{"type":"object","properties":{"a":{"items":{"anyOf":[true,'), wrong, F.lit(',{"$ref":"#"}]}}}}'))
    body = F.concat(F.lit('{"schemaVersion":'), F.when(n % 3 == 2, "2").otherwise("1"), F.lit(',"rawDocument":{"title":"t","document_type":"d","source":{"provider":"p","source_uri":'), uri, F.lit('},"participants":[],"segments":[{"sequence":1,"text":'), quoted, F.lit('}]},"schemaRequest":{"name":"n","version":1,"schema":'), schema, F.lit('},"provider":"'), provider, F.lit('","model":"'), model, F.lit('"'), more, F.lit("}"))
    return X.triage_requests(turns.select("conv_id", "turn", body.alias("body"))).select("conv_id", "turn", "outcome")


QUERIES = {f.__name__: f for f in (schema_errors, schema_error_summary, backend_classification, structured_results, extraction_outcomes, model_inputs, unknown_evidence, result_registration, document_status, registry_counts, registry_key_violations, surviving_results, document_results, intake_screen, storage_key_check, storage_reconcile, request_triage)}

_EVENT_ERRORS = """errors as (
    select event_id, '$["k"]' as path, '#/properties/k/minimum' as schema_path, 'minimum' as validator from events where cast(props->>'$.k' as int) < 10
    union all select event_id, '$["k"]', '#/properties/k/maximum', 'maximum' from events where cast(props->>'$.k' as int) > 90
    union all select event_id, '$', '#/required', 'required' from events where not json_exists(props, '$.source')
    union all select event_id, '$', '#/required', 'required' from events where not json_exists(props, '$.k')
    union all select event_id, '$', '#/additionalProperties', 'additionalProperties' from events where len(list_filter(json_keys(props), lambda x: x <> 'k')) > 0)"""

_OUTPUTS = """outputs as (select doc_id, quality, toxic, doc_id % 9 as form, doc_id % 11 = 10 as unfinished,
    case when doc_id % 13 = 12 then 1.5 when doc_id % 13 <> 11 then 0.75 end::double as confidence,
    '{"category":"' || case when quality = 1 then 'good' else 'bad' end || '","score":' || (quality + 0.5)::varchar || '}' as good from labels),
  told as (select *, case form when 6 then replace(good, '"score":', '"score":"x","extra":') when 7 then '{"category":' || toxic || '}' else good end as text,
    case when form in (1, 2) then 'blank_output' when form = 3 then 'invalid_json' when form in (4, 5) then 'not_an_object' end as bad,
    case when confidence > 1 then 'confidence_out_of_range' end as high from outputs)"""

_RESULTS = f"""with {_OUTPUTS}, done as (select d.doc_id, d.source, t.*, case when t.doc_id is null then 'missing_output' when unfinished then 'not_completed' else coalesce(bad, high) end as failure,
    case when form = 6 then 2 when form = 7 then 3 else 0 end as n from documents d left join told t on t.doc_id = d.doc_id)"""

_INCOMING = """incoming as (select case when doc_id % 19 = 18 then 'lost-' || doc_id else doc_id::varchar end as document_id, doc_id as n, doc_id + k as arrival
      from labels, (values (0), (1000000)) v(k) where k = 0 or doc_id % 3 = 0),
  judged as (select *, case when n % 17 = 16 then 'data_not_an_object' when n % 4 = 3 then 'validation_status_unknown' when n % 6 in (2, 3) then 'confidence_out_of_range' end as reason from incoming),
  firsts as (select document_id, min(arrival) as first from judged where reason is null group by document_id),
  outcomes as (select j.*, case when reason is not null then 400 when not exists (select 1 from documents d where d.doc_id::varchar = j.document_id) then 404
      when exists (select 1 from labels l where l.doc_id % 23 = 22 and l.doc_id::varchar = j.document_id) or arrival > first then 409 else 201 end as outcome,
      case when reason is null then case n % 4 when 0 then 'Valid' when 1 then 'Invalid' else 'NeedsReview' end end as validation_status,
      case when reason is null then 't' || (n % 3) end as document_type,
      case when reason is null then case n % 6 when 0 then 0.5 when 4 then 1 when 5 then 0 end end::decimal(5,4) as confidence
    from judged j left join firsts using (document_id)),
  after as (select d.doc_id::varchar as id, d.source as customer_id, o.validation_status, o.confidence, case when o.document_id is null then 'Uploaded' when o.validation_status = 'Valid' then 'Processed' else 'NeedsReview' end as status,
      o.document_type, case when o.document_id is not null then timestamp '2026-09-02 00:00:00' end as processed_at
    from documents d left join (select * from outcomes where outcome = 201) o on o.document_id = d.doc_id::varchar)"""

ORACLES = {
    "schema_errors": f"with {_EVENT_ERRORS} select event_id, path, schema_path, validator from errors",
    "schema_error_summary": f"with {_EVENT_ERRORS} select path, validator, count(*) as n from errors group by path, validator",
    "backend_classification": f"""with {_OUTPUTS} select doc_id, case when unfinished then 'not_completed' else bad end as openai,
        case when doc_id % 7 = 6 then 'no_choices' when doc_id % 5 = 4 then 'no_message' else bad end as groq, high as confidence from told""",
    "structured_results": f"""{_RESULTS} select doc_id, failure, case when failure is null then 'schema_driven_text_v1:openai_responses_v1:model-a' end as engine,
        case when failure is null then source end as document_type, case when failure is null then text end as data, case when failure is null then confidence end as confidence,
        case when failure is null then case when n = 0 then 'valid' else 'invalid' end end as validation_status, case when failure is null then n else null end as n_errors from done""",
    "extraction_outcomes": f"{_RESULTS} select case when failure is not null then 1 when n = 0 then 0 else 2 end as outcome, failure as error_type, count(*) as n from done group by 1, 2",
    "model_inputs": f"""with {document_ctes()}, said as (select conv_id, list({{'participant_id': s.participant_id, 'segment_id': i.segment_id, 'sequence': s.sequence, 'text': s.text}} order by s.sequence) as segments
          from segs s join ids i using (conv_id, sequence) group by conv_id),
        people_in as (select conv_id, list({{'display_name': p, 'organization': null::varchar, 'participant_id': p, 'role': p}} order by p) as participants from (select distinct conv_id, participant_id as p from segs) group by conv_id),
        inputs as (select m.document_id, to_json({{'document_id': m.document_id, 'document_type': 'conversation', 'fingerprint': fingerprint, 'participants': p.participants, 'segments': said.segments,
          'source': {{'provider': 'chat', 'published_at': null::varchar, 'retrieved_at': null::varchar, 'source_document_id': 'conv-' || conv_id, 'source_timestamp': null::varchar, 'source_uri': null::varchar}}, 'title': title}})::varchar as t
          from marked m join said using (conv_id) join people_in p using (conv_id) where {distinct_turns()})
        select document_id, sha256(t) as input_sha256, length(t)::int as n_chars from inputs""",
    "unknown_evidence": f"with {document_ctes()} select document_id, segment_id || 'x' as segment_id, sequence from ids where conv_id % 4 = 0 and {distinct_turns()}",
    "result_registration": f"with {_INCOMING} select document_id, arrival, outcome, reason, validation_status, document_type, confidence from outcomes",
    "document_status": f"with {_INCOMING} select id, status, document_type, processed_at from after",
    "registry_counts": f"with {_INCOMING} select status, count(*) as n from after group by status",
    "document_results": f"with {_INCOMING} select id, customer_id, validation_status, confidence from after",
    "registry_key_violations": f"""with {_INCOMING} select 'storage_key_repeated' as problem, '2026/09/' || k || '.pdf' as key, count(*) as n
          from (select case when doc_id % 10 = 9 then doc_id - 1 else doc_id end as k from documents) group by k having count(*) > 1
        union all select 'result_repeated', document_id, count(*) from incoming group by document_id having count(*) > 1
        union all select 'document_missing', document_id, count(*) from incoming where document_id not in (select doc_id::varchar from documents) group by document_id""",
    "surviving_results": "select doc_id::varchar as document_id from labels where doc_id % 23 = 22 and doc_id not in (select doc_id from documents where doc_id % 2 = 0)",
    "intake_screen": """select doc_id, case when doc_id % 7 = 0 then 'customer_required' when doc_id % 11 = 0 then 'file_required' when doc_id % 13 = 0 then 'file_too_large'
        when n_chars = 0 then 'file_required' when doc_id % 5 = 0 then 'not_a_pdf_name' when doc_id % 3 = 0 then 'not_a_pdf_type' when doc_id % 2 = 1 and not coalesce(starts_with(text, '%PDF-'), false) then 'no_pdf_signature' end as rejection from documents""",
    "storage_key_check": "select doc_id, case doc_id % 8 when 1 then 'key_outside_root' when 2 then 'key_blank' when 3 then 'key_absolute' when 5 then 'key_outside_root' when 6 then 'key_outside_root' when 7 then 'key_absolute' end as reason from documents",
    "storage_reconcile": "select 'k/' || doc_id as storage_key, 'file_missing' as problem from documents where doc_id % 31 = 30 union all select 'x/' || doc_id, 'file_orphaned' from documents where doc_id % 29 = 28",
    "request_triage": """select conv_id, turn, case when conv_id % 3 = 2 or conv_id % 5 = 4 or conv_id % 7 = 6 or conv_id % 11 = 10 or conv_id % 13 = 12 or conv_id % 17 = 16 or conv_id % 19 = 18 or conv_id % 23 = 22 or trim(text, ' ' || chr(10) || chr(9)) = '' then 'invalid_request' else 'accepted' end as outcome from conversations""",
}
