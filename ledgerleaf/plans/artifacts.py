"""Queries that write the tables' documents as files, or stream them, and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.operators import documents as D
from ledgerleaf.operators import layout as L
from ledgerleaf.operators import quotation as Q
from ledgerleaf.operators import results as X
from ledgerleaf.operators.engines import EngineRegistry
from ledgerleaf.plans import quotations as P
from ledgerleaf.plans import validation as V
from ledgerleaf.plans.transcripts import distinct_turns, document_ctes, raw_transcripts, table, transcripts
from ledgerleaf.sources import readers, sinks
from ledgerleaf.sources.scratch import new_folder
from ledgerleaf.streaming.keyed import write_results_keyed
from ledgerleaf.streaming.registration import register_results_stream


def _raw_lines(spark: SparkSession, sf_dir: str) -> str:
    """Every transcript as a raw JSON document, one a line of text files."""
    path = new_folder(spark, "raw")
    sinks.write_documents(raw_transcripts(spark, sf_dir).select(F.to_json(F.struct(*D.NAMES)).alias("value")), path, "text")
    return path


def _identity(normalized: DataFrame) -> DataFrame:
    return D.split_valid(normalized)[0].select("document_id", "fingerprint", F.size("segments").alias("segment_count"))


def raw_document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of transcripts written as raw JSON files and read back."""
    return _identity(D.normalize_documents(readers.read_raw_documents(spark, _raw_lines(spark, sf_dir), lines=True)))


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised transcripts and their summaries, written as artifacts and joined as read back."""
    path = new_folder(spark, "artifacts")
    good = D.split_valid(transcripts(spark, sf_dir))[0]
    sinks.write_artifacts(good.drop("conv_id"), D.document_summary(good), path)
    whole, brief = (spark.read.parquet(f"{path}/{part}") for part in ("normalized", "structured"))
    return whole.join(brief.select("document_id", F.col("fingerprint").alias("told")), "document_id").where("fingerprint = told").select("document_id", "fingerprint", F.size("segments").alias("segment_count"))


def published_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted transcripts published twice, the second time as a later version with a run that broke off between."""
    root = new_folder(spark, "published")
    good = D.split_valid(transcripts(spark, sf_dir))[0].drop("conv_id")
    sinks.publish_artifacts(good.where("false"), D.document_summary(good.where("false")), root, "v1")
    sinks.write_documents(good, f"{root}/versions/v2/normalized")  # what a run leaves that ends before the manifest
    sinks.publish_artifacts(good, D.document_summary(good), root, "v2")
    sinks.publish_artifacts(good.where("false"), D.document_summary(good), root, "v2")  # published already
    whole, brief = sinks.read_artifacts(spark, root)
    return whole.join(brief.select("document_id", F.col("fingerprint").alias("told")), "document_id").where("fingerprint = told").select("document_id", "fingerprint", F.size("segments").alias("segment_count"))


def layout_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotations of layout documents written as JSON files, a bounded array of them in each, and read back."""
    path = new_folder(spark, "layouts")
    listed = P.quotation_layouts(spark, sf_dir).groupBy(F.floor(F.col("quotation") / 1000).alias("part")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct("pages"))), ","), F.lit("]")).alias("value"))
    listed.repartition("part").write.partitionBy("part").text(path)
    read = readers.read_layout_documents(spark, path)
    return Q.as_decimals(Q.extract_quotations(read)).select("quotation_number", "supplier_name", "total", F.size("items").alias("n_items"))


def stored_file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the documents' texts by language: bytes, and files whose leading bytes were not read."""
    path = new_folder(spark, "files")
    table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("text", F.lit("")).alias("value")).write.partitionBy("lang").text(path)
    files = readers.read_stored_files(spark, path)
    lang = F.regexp_extract("storage_key", "^lang=([^/]+)/", 1)
    return files.groupBy(lang.alias("lang")).agg(F.sum("size").alias("n_bytes"), F.count(F.when(F.octet_length("content") != F.least(F.col("size"), F.lit(8)), 1)).alias("n_unread"))


def exported_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotation items exported as CSV with a head line and read back."""
    path = new_folder(spark, "export")
    sinks.export_items(P.nested_quotations(spark, sf_dir), path, "quotation")
    kinds = "quotation bigint, line int, sku string, description string, quantity decimal(18,6), unit string, unit_price decimal(18,6), lead_time_days int, line_total decimal(18,6)"
    return spark.read.schema(kinds).option("header", True).csv(path)


def streamed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw JSON lines read as a stream, normalised as in batch, and stored."""
    source, path = _raw_lines(spark, sf_dir), new_folder(spark, "streamed")
    lines = spark.readStream.schema("value string").text(source).withColumnRenamed("value", "raw")
    _identity(D.normalize_documents(readers.parse_raw_documents(lines))).writeStream.option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path, "parquet").awaitTermination()
    return spark.read.parquet(path)


def tied_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming results whose arrivals tie, are null, or whose rows are equal."""
    plain = V.incoming_results(spark, sf_dir).where("arrival < 1000000")
    same = plain.withColumn("arrival", F.lit(7).cast("long"))
    other = same.withColumn("payload", F.replace("payload", F.lit('"engine":"e"'), F.lit('"engine":"other"')))
    unknown = plain.withColumn("arrival", F.lit(None).cast("long"))
    return same.unionAll(same).unionAll(other).unionAll(unknown).unionAll(unknown)


def _outcome_counts(registered: DataFrame) -> DataFrame:
    count = lambda k: F.count(F.when(F.col("outcome") == k, 1)).alias(f"n{k}")
    return registered.groupBy("document_id").agg(*(count(k) for k in (201, 400, 404, 409)))


def tied_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of each document's tied results: one at most is registered."""
    return _outcome_counts(V.G.register_results(V.registry_documents(spark, sf_dir), V.earlier_results(spark, sf_dir), tied_results(spark, sf_dir)))


def tied_document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after the registration of tied results, one row each."""
    documents = V.registry_documents(spark, sf_dir)
    done = V.G.register_results(documents, V.earlier_results(spark, sf_dir), tied_results(spark, sf_dir))
    return V.G.apply_status(documents, done, F.lit("2026-09-02 00:00:00").cast("timestamp")).select("id", "status", "document_type")


def streamed_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tied results registered micro-batch by micro-batch, as many as there are files."""
    path = new_folder(spark, "incoming")
    V.registry_documents(spark, sf_dir).write.parquet(f"{path}/documents")
    tied_results(spark, sf_dir).repartition(3).write.parquet(f"{path}/results")
    stream = spark.readStream.schema("document_id string, arrival bigint, payload string").option("maxFilesPerTrigger", 1).parquet(f"{path}/results")
    register_results_stream(stream, f"{path}/documents", f"{path}/store", f"{path}/state").awaitTermination()
    return _outcome_counts(spark.read.parquet(f"{path}/store"))


def keyed_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tied results registered by keyed state, beside what earlier runs registered, and sent once more after a restart."""
    path = new_folder(spark, "keyed")
    V.registry_documents(spark, sf_dir).write.parquet(f"{path}/documents")
    documents, earlier = spark.read.parquet(f"{path}/documents"), V.earlier_results(spark, sf_dir)
    for _ in range(2):
        tied_results(spark, sf_dir).repartition(2).write.mode("append").parquet(f"{path}/results")
        stream = spark.readStream.schema("document_id string, arrival bigint, payload string").option("maxFilesPerTrigger", 1).parquet(f"{path}/results")
        write_results_keyed(documents, earlier, stream, f"{path}/store", f"{path}/state").awaitTermination()
    return _outcome_counts(spark.read.parquet(f"{path}/store"))


def engine_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured results by a registered engine that keeps its input's columns."""
    engines = EngineRegistry()
    outputs = V.backend_outputs(spark, sf_dir).drop("doc_id")
    engines.register("schema_driven_text", lambda docs: X.extract_with_results(docs, outputs, V.label_request()))
    done = engines.apply("schema_driven_text", V._labelled_documents(spark, sf_dir))
    return done.select("doc_id", "failure", "result.engine", "result.validation_status")


def response_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the JSON responses of transcripts whose backend echoes their title."""
    good = D.split_valid(transcripts(spark, sf_dir))[0]
    data = F.concat(F.lit('{"title": '), F.to_json(F.array("title")), F.lit(', "a":1.50}'))
    outputs = good.select("document_id", F.lit("openai_responses_v1:m").alias("backend"), data.alias("output_text"), F.when(F.col("conv_id") % 5 == 4, "incomplete").otherwise("completed").alias("status"), F.lit(0.75).alias("confidence"))
    done = X.extract_with_results(good, outputs, V.J.schema_request("title", 1, {"type": "object", "required": ["title"]}))
    return X.response_envelope(done).select("document_id", F.sha2("response", 256).alias("response_sha256"), F.length("response").alias("n_chars"))


QUERIES = {f.__name__: f for f in (raw_document_files, stored_documents, published_artifacts, layout_files, stored_file_sizes, exported_items, streamed_documents, tied_registration, tied_document_status, streamed_registration, keyed_registration, engine_results, response_envelopes)}

_IDENTITY = f"with {document_ctes()} select document_id, fingerprint, len(segments)::int as segment_count from marked where {distinct_turns()}"

# 201 at most once a document; the other good results of a known document are 409.
def _tied(taken: str = "bool_or(doc_id % 23 = 22) and not starts_with(document_id, 'lost-')", times: int = 5) -> str:
    return f"""plain as (select case when doc_id % 19 = 18 then 'lost-' || doc_id else doc_id::varchar end as document_id,
      case when doc_id % 17 = 16 or doc_id % 4 = 3 or doc_id % 6 in (2, 3) then 1 else 0 end as bad, doc_id from labels),
  counts as (select document_id, count(*) filter (where bad = 0) * {times} as good, count(*) filter (where bad = 1) * {times} as n400,
      document_id in (select doc_id::varchar from documents) as known, {taken} as taken from plain group by document_id),
  told as (select document_id, case when known and not taken and good > 0 then 1 else 0 end as n201, n400, case when known then 0 else good end as n404,
      case when not known then 0 when taken or good = 0 then good else good - 1 end as n409 from counts)"""


_TIED_COUNTS = "select document_id, n201, n400, n404, n409 from told"

ORACLES = {
    "raw_document_files": _IDENTITY,
    "stored_documents": _IDENTITY,
    "published_artifacts": _IDENTITY,
    "streamed_documents": _IDENTITY,
    "layout_files": f"with {P._ITEMS} select 'QT-' || quotation as quotation_number, 'Example Supplies Ltd.' as supplier_name, (exact + vat_amount)::decimal(18,6) as total, n::int as n_items from heads where n > 0",
    "stored_file_sizes": "select coalesce(lang, 'none') as lang, sum(octet_length(encode(coalesce(text, ''))) + 1)::bigint as n_bytes, 0 as n_unread from documents group by 1",
    "exported_items": f"with {P._ITEMS} select quotation, line, sku, description, quantity, 'pcs' as unit, unit_price, null::int as lead_time_days, line_total from priced",
    "tied_registration": f"with {_tied()} {_TIED_COUNTS}",
    "streamed_registration": f"with {_tied('false')} {_TIED_COUNTS}",
    "keyed_registration": f"with {_tied(times=10)} {_TIED_COUNTS}",
    "tied_document_status": f"""with {_tied()}, won as (select t.document_id, l.doc_id from told t join labels l on t.document_id = l.doc_id::varchar where n201 = 1)
        select d.doc_id::varchar as id, case when w.doc_id is null then 'Uploaded' when w.doc_id % 4 = 0 then 'Processed' else 'NeedsReview' end as status, case when w.doc_id is not null then 't' || (w.doc_id % 3) end as document_type
        from documents d left join won w on w.doc_id = d.doc_id""",
    "engine_results": f"""{V._RESULTS} select doc_id, failure, case when failure is null then 'schema_driven_text_v1:openai_responses_v1:model-a' end as engine,
        case when failure is null then case when n = 0 then 'valid' else 'invalid' end end as validation_status from done""",
    "response_envelopes": f"""with {document_ctes()}, said as (select conv_id, list({{'participant_id': s.participant_id, 'segment_id': i.segment_id, 'sequence': s.sequence, 'text': s.text}} order by s.sequence) as segments
          from segs s join ids i using (conv_id, sequence) group by conv_id),
        people_in as (select conv_id, list({{'display_name': p, 'organization': null::varchar, 'participant_id': p, 'role': p}} order by p) as participants from (select distinct conv_id, participant_id as p from segs) group by conv_id),
        made as (select m.document_id, '{{"schemaVersion":1,"normalizedDocument":' || to_json({{'document_id': m.document_id, 'document_type': 'conversation', 'fingerprint': fingerprint, 'participants': p.participants, 'segments': said.segments,
            'source': {{'provider': 'chat', 'published_at': null::varchar, 'retrieved_at': null::varchar, 'source_document_id': 'conv-' || conv_id, 'source_timestamp': null::varchar, 'source_uri': null::varchar}}, 'title': title}})::varchar
          || ',"structuredResult":{{"engine":"schema_driven_text_v1:openai_responses_v1:m","document_type":"conversation","data":{{"title": ["' || title || '"], "a":1.50}},"confidence":0.75,"validation_status":"valid",'
          || '"validation":{{"status":"valid","checks":{{"json_schema":{{"status":"passed","message":"The data fits the schema.","details":{{"errors":[]}}}}}},"confidence":1.0}}}}}}' as t
          from marked m join said using (conv_id) join people_in p using (conv_id) where {distinct_turns()} and conv_id % 5 <> 4)
        select document_id, sha256(t) as response_sha256, length(t)::int as n_chars from made""",
}
