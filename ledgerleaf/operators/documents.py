"""Text documents: assembling, normalising with reasons, integrity, revisions and child tables.

A document is a row with nested participants and segments; everything here is a projection over such rows, so only
assembling from flat rows and comparing two tables shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions import canonical, text
from ledgerleaf.functions.nested import exploded

RAW_SCHEMA = (
    "title string, document_type string, "
    "source struct<provider string, source_uri string, source_document_id string, source_timestamp string, published_at string, retrieved_at string>, "
    "participants array<struct<participant_id string, display_name string, role string, organization string>>, "
    "segments array<struct<sequence bigint, participant_id string, text string>>"
)
TIMES = ("source_timestamp", "published_at", "retrieved_at")
#: Keys that a raw document may have, by level.
DECLARED = {
    "document": ("title", "document_type", "source", "participants", "segments"),
    "source": ("provider", "source_uri", "source_document_id", *TIMES),
    "participants": ("participant_id", "display_name", "role", "organization"),
    "segments": ("sequence", "participant_id", "text"),
}
NAMES = ("title", "document_type", "source", "participants", "segments")


def assemble_documents(rows: DataFrame, key: str, sequence: Column, participant: Column, body: Column, title: Column, document_type: Column, provider: Column, roles: Column | None = None) -> DataFrame:
    """Nested raw documents from flat rows, one row a segment; participants are the distinct speakers in order.

    A document is one row, so all its segments meet in one task; ``segment_rows`` does without. The rows are dealt to
    as many tasks as the session has shuffle partitions: normalising costs far more than these small rows tell Spark.
    """
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(key))
    speaker = F.struct(participant.alias("participant_id"), participant.alias("display_name"), (roles if roles is not None else F.lit(None)).cast("string").alias("role"), F.lit(None).cast("string").alias("organization"))
    said = F.struct(sequence.cast("long").alias("sequence"), participant.alias("participant_id"), body.alias("text"))
    nested = rows.groupBy(F.col(key)).agg(F.sort_array(F.collect_list(said)).alias("segments"), F.sort_array(F.collect_set(F.when(participant.isNotNull(), speaker))).alias("participants"))
    none = F.lit(None).cast("string")
    source = F.struct(provider.alias("provider"), none.alias("source_uri"), F.concat(F.lit("conv-"), F.col(key)).alias("source_document_id"), *(none.alias(t) for t in TIMES))
    return nested.select(F.col(key), title.alias("title"), document_type.alias("document_type"), source.alias("source"), "participants", "segments")


def unknown_fields(raw: Column) -> Column:
    """Paths of undeclared keys of a raw document's JSON text, at every level; null if the text is no JSON object."""
    whole = F.try_parse_json(raw)
    keys = lambda v: F.map_keys(v.cast("map<string,variant>"))
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    none = F.array().cast("array<string>")

    def extra(v: Column, level: str, prefix: str) -> Column:
        found = F.array_except(keys(v), F.array(*map(F.lit, DECLARED[level])))
        return F.when(is_object(v), F.transform(found, lambda k: F.concat(F.lit(prefix), k))).otherwise(none)

    def listed(name: str) -> Column:
        v = F.try_variant_get(whole, f"$.{name}", "variant")
        is_array = F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))
        return F.when(is_array, F.flatten(F.transform(v.cast("array<variant>"), lambda x: extra(x, name, f"{name}[].")))).otherwise(none)

    source = F.try_variant_get(whole, "$.source", "variant")
    found = F.concat(extra(whole, "document", ""), extra(source, "source", "source."), listed("participants"), listed("segments"))
    return F.when(is_object(whole), F.array_sort(F.array_distinct(found)))


def check_source_identity(source: Column) -> Column:
    """Reason if a source has neither a uri nor an id of its own."""
    return F.when(F.coalesce(source["source_uri"], source["source_document_id"]).isNull(), F.lit("source_identity_missing"))


def check_time_order(source: Column) -> Column:
    """Reason if any two given times contradict source <= published <= retrieved."""
    a, b, c = (source[t] for t in TIMES)
    wrong = F.coalesce(a > b, F.lit(False)) | F.coalesce(b > c, F.lit(False)) | F.coalesce(a > c, F.lit(False))
    return F.when(wrong, F.lit("time_order"))


def check_participants_unique(ids: Column) -> Column:
    return F.when(F.size(F.array_distinct(ids)) < F.size(ids), F.lit("participants_not_unique"))


def check_segments_present(segments: Column) -> Column:
    return F.when(F.coalesce(F.size(segments), F.lit(0)) <= 0, F.lit("segments_missing"))


def check_participant_refs(refs: Column, ids: Column) -> Column:
    unknown = F.array_except(F.array_compact(refs), ids)
    return F.when(F.size(unknown) > 0, F.lit("participant_unknown"))


def _compact(*reasons: Column) -> Column:
    return F.array_compact(F.array(*(r.cast("string") for r in reasons)))


def normalize_documents(df: DataFrame) -> DataFrame:
    """Add the normalised document and why it is rejected, if it is.

    ``df`` has the columns of ``RAW_SCHEMA``; its other columns stay. Adds document_id, fingerprint, errors (all
    reasons, in the order of the checks) and first_error, and replaces the document's columns by normalised ones.
    """
    source, provider = F.col("source"), text.required_text(F.col("source.provider"), "provider")
    title, kind = text.required_text(F.col("title"), "title"), text.required_text(F.col("document_type"), "document_type")
    ids = {f: text.optional_identifier(source[f], f) for f in ("source_uri", "source_document_id")}
    times = {f: text.utc_timestamp(source[f], f) for f in TIMES}
    no_people = F.array().cast("array<struct<participant_id:string,display_name:string,role:string,organization:string>>")
    people = F.coalesce(F.col("participants"), no_people)
    said = F.coalesce(F.col("segments"), F.array().cast("array<struct<sequence:bigint,participant_id:string,text:string>>"))
    # One projection makes the normalised parts, the next reads them, so no expression is written out twice.
    df = df.withColumns(
        {
            "_people": F.transform(people, lambda p: F.struct(text.clean_text(p["participant_id"]).alias("participant_id"), text.clean_text(p["display_name"]).alias("display_name"), text.optional_text(p["role"]).alias("role"), text.optional_text(p["organization"]).alias("organization"))),
            "_said": F.transform(said, lambda s: F.struct(s["sequence"].alias("sequence"), text.optional_text(s["participant_id"]).alias("participant_id"), text.clean_text(s["text"]).alias("text"))),
            "_source": F.struct(provider[0].alias("provider"), ids["source_uri"][0].alias("source_uri"), ids["source_document_id"][0].alias("source_document_id"), *(times[t][0].alias(t) for t in TIMES)),
            "_heads": _compact(title[1], kind[1], provider[1], *(v[1] for v in ids.values()), *(v[1] for v in times.values())),
            "title": title[0],
            "document_type": kind[0],
        }
    )
    person = lambda p: F.array(F.when(F.coalesce(p["participant_id"], F.lit("")) == "", F.lit("participant_id_blank")).when(F.contains(p["participant_id"], F.lit("\n")), F.lit("participant_id_multiline")), F.when(F.coalesce(p["display_name"], F.lit("")) == "", F.lit("display_name_blank")))
    names = F.transform("_people", lambda p: p["participant_id"])
    def segment_reasons(bound: Column) -> Column:
        """Reasons segment by segment; ``bound`` holds what all segments share, made once."""

        def reasons(s: Column, i: Column) -> Column:
            return F.array(
                F.when(F.coalesce(s["sequence"], F.lit(0)) <= 0, F.lit("sequence_not_positive")),
                F.when(bound["repeated"], F.when(F.array_position(bound["sequences"], s["sequence"]) <= i, F.lit("sequence_not_unique"))),
                F.when(F.contains(s["participant_id"], F.lit("\n")), F.lit("participant_id_multiline")),
                F.when(s["participant_id"].isNotNull() & ~F.coalesce(F.array_contains(bound["names"], s["participant_id"]), F.lit(False)), F.lit("participant_unknown")),
                F.when(F.coalesce(s["text"], F.lit("")) == "", F.lit("segment_text_blank")),
            )

        return F.array_compact(F.flatten(F.transform(bound["said"], reasons)))

    sequences = F.transform("_said", lambda s: s["sequence"])
    bound = F.struct(F.col("_said").alias("said"), names.alias("names"), sequences.alias("sequences"), (F.size(F.array_distinct(sequences)) < F.size(sequences)).alias("repeated"))
    errors = F.concat(
        F.col("_heads"),
        _compact(check_source_identity(F.col("_source")), check_time_order(F.col("_source"))),
        F.array_compact(F.flatten(F.transform("_people", person))),
        _compact(check_participants_unique(names), check_segments_present(F.col("_said"))),
        F.element_at(F.transform(F.array(bound), segment_reasons), 1),
    )
    df = df.withColumns({"document_id": canonical.document_id(F.col("_source")), "segments": F.array_sort("_said"), "participants": F.col("_people"), "source": F.col("_source"), "errors": errors})
    with_ids = F.transform("segments", lambda s: F.struct(s["sequence"].alias("sequence"), s["participant_id"].alias("participant_id"), s["text"].alias("text"), canonical.segment_id(F.col("document_id"), s["sequence"], s["participant_id"], s["text"]).alias("segment_id")))
    mark = canonical.fingerprint(*(F.col(c) for c in NAMES))
    return df.withColumns({"segments": with_ids, "fingerprint": mark, "first_error": F.get("errors", F.lit(0))}).drop("_people", "_said", "_source", "_heads")


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of normalised documents."""
    return df.where(F.size("errors") == 0).drop("errors", "first_error"), df.where(F.size("errors") > 0)


def unknown_participants(segments: DataFrame, participants: DataFrame) -> DataFrame:
    """Segments (document key, participant_id, ...) whose participant isn't listed: the flat form, by an anti join."""
    keys = [c for c in participants.columns if c in segments.columns]
    return segments.where(F.col("participant_id").isNotNull()).join(participants.select(*keys).distinct(), keys, "left_anti")


def verify_integrity(df: DataFrame) -> DataFrame:
    """Recompute every identity of normalised documents and check that what is stored is normal; adds ``failures``."""
    source, said = F.col("source"), F.col("segments")
    differs = lambda c, f: ~c.eqNullSafe(f(c))
    optional = lambda c: ~c.eqNullSafe(text.optional_text(c))
    ids = F.transform("participants", lambda p: p["participant_id"])
    sequence = F.transform(said, lambda s: s["sequence"])
    flat = lambda c: F.contains(F.coalesce(c, F.lit("")), F.lit("\n"))
    checks = {
        "title": differs(F.col("title"), text.clean_text) | text.is_blank(F.col("title")),
        "document_type": differs(F.col("document_type"), text.clean_text) | text.is_blank(F.col("document_type")),
        "provider": differs(source["provider"], text.clean_text) | text.is_blank(source["provider"]),
        "source_identifiers": optional(source["source_uri"]) | optional(source["source_document_id"]) | flat(source["source_uri"]) | flat(source["source_document_id"]),
        "source_identity_missing": check_source_identity(source).isNotNull(),
        "time_order": check_time_order(source).isNotNull(),
        "participants": F.exists("participants", lambda p: differs(p["participant_id"], text.clean_text) | text.is_blank(p["participant_id"]) | flat(p["participant_id"]) | differs(p["display_name"], text.clean_text) | text.is_blank(p["display_name"]) | optional(p["role"]) | optional(p["organization"])),
        "segments": F.exists(said, lambda s: (F.coalesce(s["sequence"], F.lit(0)) <= 0) | optional(s["participant_id"]) | flat(s["participant_id"]) | differs(s["text"], text.clean_text) | text.is_blank(s["text"])),
        "segments_missing": check_segments_present(said).isNotNull(),
        "participants_not_unique": check_participants_unique(ids).isNotNull(),
        "sequence_not_unique": F.size(F.array_distinct(sequence)) < F.size(sequence),
        "segments_not_sorted": ~sequence.eqNullSafe(F.array_sort(sequence)),
        "participant_unknown": check_participant_refs(F.transform(said, lambda s: s["participant_id"]), ids).isNotNull(),
        "document_id": ~F.col("document_id").eqNullSafe(canonical.document_id(source)),
        "segment_id": F.exists(said, lambda s: ~s["segment_id"].eqNullSafe(canonical.segment_id(F.col("document_id"), s["sequence"], s["participant_id"], s["text"]))),
        "fingerprint": ~F.col("fingerprint").eqNullSafe(canonical.fingerprint(*(F.col(c) for c in NAMES))),
    }
    return df.withColumn("failures", F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks.items()))))


def detect_revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents of two tables by document_id: added, removed, revised or unchanged, with the segments that differ."""
    side = lambda df, x: df.select("document_id", F.col("fingerprint").alias(f"{x}_mark"), F.transform("segments", lambda s: s["segment_id"]).alias(f"{x}_segments"))
    both = side(old, "old").join(side(new, "new"), "document_id", "full_outer")
    change = F.when(F.col("old_mark").isNull(), "added").when(F.col("new_mark").isNull(), "removed").when(F.col("old_mark") != F.col("new_mark"), "revised").otherwise("unchanged")
    none = F.array().cast("array<string>")
    older, newer = F.coalesce("old_segments", none), F.coalesce("new_segments", none)
    return both.select("document_id", change.alias("change"), F.array_except(newer, older).alias("segments_added"), F.array_except(older, newer).alias("segments_removed"))


def document_summary(df: DataFrame, engine: Column | None = None, status: Column | None = None) -> DataFrame:
    """document_id, fingerprint, segment_count, engine and validation_status; never any text."""
    none = F.lit(None).cast("string")
    return df.select("document_id", "fingerprint", F.size("segments").alias("segment_count"), (none if engine is None else engine).alias("engine"), (none if status is None else status).alias("validation_status"))


def _identity(source: Column) -> Column:
    """What a document's id is made of, normalised."""
    return F.struct(text.clean_text(source["provider"]).alias("provider"), *(text.optional_text(source[f]).alias(f) for f in ("source_uri", "source_document_id")))


def segment_rows(rows: DataFrame, source: Column, sequence: Column, participant: Column, body: Column, *keep: str) -> DataFrame:
    """Normalised segments of flat rows, one row each, without gathering a document.

    Returns the columns ``keep``, document_id, sequence, participant_id, text, segment_id and reason, which is why the
    segment alone makes its document invalid.
    """
    made = rows.select(*keep, canonical.document_id(_identity(source)).alias("document_id"), sequence.cast("long").alias("sequence"), text.optional_text(participant).alias("participant_id"), text.clean_text(body).alias("text"))
    reason = (
        F.when(F.coalesce("sequence", F.lit(0)) <= 0, "sequence_not_positive")
        .when(F.contains("participant_id", F.lit("\n")), "participant_id_multiline")
        .when(F.coalesce("text", F.lit("")) == "", "segment_text_blank")
    )
    ident = canonical.segment_id(F.col("document_id"), F.col("sequence"), F.col("participant_id"), F.col("text"))
    return made.withColumns({"segment_id": ident, "reason": reason})


def accepted_segments(segments: DataFrame) -> DataFrame:
    """Rows of ``segment_rows`` whose document has neither a segment with a reason nor a sequence twice."""
    counts = segments.groupBy("document_id", "sequence").agg(F.count(F.lit(1)).alias("n"), F.max("reason").alias("reason"))
    bad = counts.where("n > 1 or reason is not null").select("document_id").distinct()
    return segments.drop("reason").join(bad, "document_id", "left_anti")


def participant_rows(rows: DataFrame, source: Column, participant: Column, role: Column) -> DataFrame:
    """The distinct speakers of flat rows, normalised: document_id, participant_id, display_name, role and organization."""
    raw = rows.select(source.alias("source"), participant.alias("participant"), role.alias("role")).where("participant is not null").distinct()
    name = text.clean_text(F.col("participant"))
    return raw.select(canonical.document_id(_identity(F.col("source"))).alias("document_id"), name.alias("participant_id"), name.alias("display_name"), text.optional_text(F.col("role")).alias("role"), F.lit(None).cast("string").alias("organization"))


def explode_segments(df: DataFrame) -> DataFrame:
    return exploded(df, "segments", "_at", "_item", "document_id").select("document_id", "_item.*")


def explode_participants(df: DataFrame) -> DataFrame:
    return exploded(df, "participants", "_at", "_item", "document_id").select("document_id", "_item.*")
