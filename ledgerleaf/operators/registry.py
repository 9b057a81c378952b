"""Document registry: screening of uploads, storage keys, payload rules, registering results and statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.functions import text
from ledgerleaf.operators.jsonschema import kind
from ledgerleaf.operators.quotation import bind
from ledgerleaf.sources.scratch import new_folder

#: Limits and statuses of the registry.
MAX_FILE_BYTES = 20 * 1024 * 1024
EMPTY_ID = "00000000-0000-0000-0000-000000000000"
LENGTHS = {"original_file_name": 512, "content_type": 100, "storage_key": 1024, "document_type": 100, "status": 32}
STATUSES = {"valid": "Valid", "invalid": "Invalid", "incomplete": "NeedsReview"}
DOCUMENT_COLUMNS = ("id", "customer_id", "original_file_name", "content_type", "storage_key", "size", "document_type", "status", "created_at", "processed_at", "delete_at")


def screen_intake(df: DataFrame) -> DataFrame:
    """Add ``rejection``, the first rule that an upload breaks.

    ``df``: customer_id, file_name, size, content_type, content (leading bytes suffice).
    """
    c = F.col
    rule = (
        F.when(c("customer_id").isNull() | (F.trim("customer_id") == "") | (c("customer_id") == EMPTY_ID), "customer_required")
        .when(c("size").isNull() | (c("size") <= 0), "file_required")
        .when(c("size") > MAX_FILE_BYTES, "file_too_large")
        .when(~F.coalesce(F.lower("file_name").endswith(".pdf"), F.lit(False)), "not_a_pdf_name")
        .when(~F.coalesce(F.lower("content_type") == "application/pdf", F.lit(False)), "not_a_pdf_type")
        .when(~F.coalesce(F.substring("content", 1, 5) == F.lit(b"%PDF-"), F.lit(False)), "no_pdf_signature")
    )
    return df.withColumn("rejection", rule)


def check_document_rows(df: DataFrame) -> DataFrame:
    """Fill defaults (status Uploaded, created_at), trim texts and add ``problems`` of registry rows."""
    df = df.withColumns({n: text.strip(F.col(n)) for n in ("original_file_name", "content_type", "storage_key")})
    df = df.withColumns({"status": F.coalesce("status", F.lit("Uploaded")), "created_at": F.coalesce("created_at", F.current_timestamp())})
    checks = [F.when(F.col("customer_id").isNull() | (F.col("customer_id") == EMPTY_ID), "customer_id_empty")]
    checks += [F.when(F.coalesce(F.col(n), F.lit("")) == "", f"{n}_blank") for n in ("original_file_name", "content_type", "storage_key")]
    checks += [F.when(F.coalesce(F.col("size"), F.lit(0)) <= 0, "size_not_positive")]
    checks += [F.when(F.length(n) > most, f"{n}_too_long") for n, most in LENGTHS.items()]
    return df.withColumn("problems", F.array_compact(F.array(*checks)))


def check_storage_key(key: Column) -> Column:
    """Reason if a key is blank, absolute, or leaves the storage root at any point that matters."""
    steps = F.filter(F.split(F.replace(key, F.lit("\\"), F.lit("/")), "/"), lambda s: ~s.isin("", "."))
    depth = F.aggregate(steps, F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")), lambda a, s: _step(a, s))
    absolute = key.startswith("/") | key.startswith("\\") | key.rlike("^[A-Za-z]:")
    return F.when(text.is_blank(key), "key_blank").when(absolute, "key_absolute").when((depth["least"] < 0) | (depth["now"] <= 0), "key_outside_root")


def _step(a: Column, s: Column) -> Column:
    now = a["now"] + F.when(s == "..", -1).otherwise(1)
    return F.struct(now.alias("now"), F.least(a["least"], now).alias("least"))


def reconcile_storage(registry: DataFrame, files: DataFrame) -> DataFrame:
    """storage_key and problem: registered keys without a file, files that no row registers."""
    keys = registry.select("storage_key").distinct()
    found = files.select("storage_key").distinct()
    missing = keys.join(found, "storage_key", "left_anti").select("storage_key", F.lit("file_missing").alias("problem"))
    return missing.unionAll(found.join(keys, "storage_key", "left_anti").select("storage_key", F.lit("file_orphaned").alias("problem")))


def get_document(documents: DataFrame, ident: str) -> DataFrame:
    return documents.where(F.col("id") == ident).select(*DOCUMENT_COLUMNS)


def get_extraction_result(results: DataFrame, document: str) -> DataFrame:
    """The result of one document, its JSON parsed."""
    return results.where(F.col("document_id") == document).withColumn("structured_data", F.try_parse_json("structured_data_json"))


def documents_with_results(documents: DataFrame, results: DataFrame) -> DataFrame:
    """Every document with its result, if it has one."""
    own = results.select("document_id", "structured_data_json", "confidence", "validation_status", F.col("created_at").alias("result_created_at"))
    return documents.join(own, documents.id == own.document_id, "left").drop("document_id")


def check_registry_keys(documents: DataFrame, results: DataFrame) -> DataFrame:
    """problem, key and n: storage keys used twice, documents with two results, results without a document."""
    twice = lambda df, c, problem: df.groupBy(F.col(c).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(problem).alias("problem"), "key", "n")
    lost = results.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_anti").groupBy(F.col("document_id").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return twice(documents, "storage_key", "storage_key_repeated").unionAll(twice(results, "document_id", "result_repeated")).unionAll(lost.select(F.lit("document_missing").alias("problem"), "key", "n"))


def _member(payload: Column, key: str) -> Column:
    return F.try_variant_get(payload, f"$.{key}", "variant")


def _required(payload: Column, key: str) -> Column:
    """A member's trimmed text; null unless it is a string that isn't blank."""
    return F.when(kind(_member(payload, key)) == "string", text.optional_text(F.try_variant_get(payload, f"$.{key}", "string")))


def map_validation_status(status: Column) -> Column:
    """The stored status of a reported one, in any case and padding; null if it is none of the three."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in STATUSES.items() for x in pair)), F.lower(text.strip(status)))


def check_result_payload(payload: Column) -> tuple[Column, Column]:
    """(reason, struct of document_type, validation_status and confidence) of a JSON result, by the first broken rule."""
    def parts(v: Column) -> Column:
        given = _member(v, "confidence")
        return F.struct(
            kind(v).alias("root"),
            _required(v, "engine").alias("engine"),
            _required(v, "document_type").alias("document_type"),
            kind(_member(v, "data")).alias("data"),
            _required(v, "validation_status").alias("told"),
            kind(given).alias("given"),
            F.when(kind(given).isin("integer", "number"), F.try_variant_get(given, "$", "decimal(38,18)")).alias("number"),
        )

    def judged(p: Column) -> Column:
        status = map_validation_status(p["told"])
        reason = (
            F.when(~p["root"].eqNullSafe(F.lit("object")), "not_an_object")
            .when(p["engine"].isNull(), "engine_missing")
            .when(p["document_type"].isNull(), "document_type_missing")
            .when(~p["data"].eqNullSafe(F.lit("object")), "data_not_an_object")
            .when(p["told"].isNull(), "validation_status_missing")
            .when(status.isNull(), "validation_status_unknown")
            .when((p["given"] != "null") & ~F.coalesce(p["number"].between(0, 1), F.lit(False)), "confidence_out_of_range")
        )
        stored = F.struct(p["document_type"].alias("document_type"), status.alias("validation_status"), p["number"].cast("decimal(5,4)").alias("confidence"))
        return F.struct(reason.alias("reason"), stored.alias("stored"))

    made = bind(bind(F.try_parse_json(payload), parts), judged)
    return made["reason"], made["stored"]


def register_results(documents: DataFrame, results: DataFrame, incoming: DataFrame) -> DataFrame:
    """Judge incoming results (document_id, arrival, payload) against the registry.

    Adds outcome (201 registered, 400 with a reason, 404 no such document, 409 there is a result already), and what
    is stored. Of several good results for a document the first arrival wins, a null one being last; of equal arrivals
    the payload with the smallest SHA-256; of rows equal in both any one. The rows of one document compete by an
    aggregate that combines before the shuffle, so a document with very many incoming results gathers nowhere.

    The judged rows are written to the shared folder first, so each payload is read once, and rows that are equal in
    everything differ by their number.
    """
    reason, stored = check_result_payload(F.col("payload"))
    judged = incoming.withColumn("reason", reason).withColumn("stored", F.when(F.col("reason").isNull(), stored))
    mark = F.when(F.col("reason").isNull(), F.sha2("payload", 256))
    judged = judged.withColumn("_rank", F.struct(F.col("arrival").isNull().alias("late"), F.col("arrival").alias("arrival"), mark.alias("mark"), F.monotonically_increasing_id().alias("row")))
    folder = new_folder(incoming.sparkSession, "judged")
    judged.write.parquet(folder)
    judged = incoming.sparkSession.read.schema(judged.schema).parquet(folder)
    known = documents.select(F.col("id").alias("document_id"), F.lit(True).alias("known")).dropDuplicates(["document_id"])
    taken = results.select("document_id", F.lit(True).alias("taken")).distinct()
    first = judged.where("reason is null").groupBy("document_id").agg(F.min("_rank").alias("_first"))
    joined = judged.join(known, "document_id", "left").join(taken, "document_id", "left").join(first, "document_id", "left")
    outcome = F.when(F.col("reason").isNotNull(), 400).when(F.col("known").isNull(), 404).when(F.col("taken").isNotNull() | ~F.col("_rank").eqNullSafe(F.col("_first")), 409).otherwise(201)
    return joined.withColumn("outcome", outcome).drop("known", "taken", "_first", "_rank")


def stored_results(registered: DataFrame, created_at: Column | None = None) -> DataFrame:
    """The rows to append to the results: every registered payload as it came."""
    good = registered.where("outcome = 201")
    return good.select("document_id", F.col("payload").alias("structured_data_json"), F.col("stored.confidence").alias("confidence"), F.col("stored.validation_status").alias("validation_status"), (F.current_timestamp() if created_at is None else created_at).alias("created_at"))


def apply_status(documents: DataFrame, registered: DataFrame, processed_at: Column | None = None) -> DataFrame:
    """Documents after registration: Processed if valid, NeedsReview otherwise; type and time are set.

    Every document stays one row, even if ``registered`` tells of several results for it: then the least of them counts.
    """
    told = F.struct(F.col("stored.document_type").alias("_type"), F.col("stored.validation_status").alias("_status"))
    new = registered.where("outcome = 201").groupBy(F.col("document_id").alias("_id")).agg(F.min(told).alias("_told")).select("_id", "_told.*")
    joined = documents.join(new, documents.id == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    status = F.when(hit, F.when(F.col("_status") == "Valid", "Processed").otherwise("NeedsReview")).otherwise(F.col("status"))
    when = F.current_timestamp() if processed_at is None else processed_at
    return joined.withColumns({"status": status, "document_type": F.when(hit, F.col("_type")).otherwise(F.col("document_type")), "processed_at": F.when(hit, when).otherwise(F.col("processed_at"))}).drop("_id", "_type", "_status")


def cascade_delete(results: DataFrame, deleted: DataFrame) -> DataFrame:
    """Results without those of deleted documents (id)."""
    return results.join(deleted.select(F.col("id").alias("document_id")).distinct(), "document_id", "left_anti")


def registry_counts(documents: DataFrame, *by: str) -> DataFrame:
    return documents.groupBy(*(by or ("status",))).agg(F.count(F.lit(1)).alias("n"))


def latest_by_customer(documents: DataFrame, most: int) -> DataFrame:
    """The ``most`` newest documents of each customer."""
    newest = Window.partitionBy("customer_id").orderBy(F.desc("created_at"), F.desc("id"))
    return documents.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= most)


def mint_storage_key(at: Column, extension: Column) -> Column:
    """A new key: year, month and 32 hex digits; different on every evaluation."""
    return F.concat(F.date_format(at, "yyyy/MM/"), F.replace(F.uuid(), F.lit("-"), F.lit("")), extension)
