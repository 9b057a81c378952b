"""Queries over transcripts assembled from ``conversations`` and over the lines of ``documents``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.functions import text
from ledgerleaf.functions.nested import exploded
from ledgerleaf.operators import documents as D
from ledgerleaf.operators.alignment import segment_changes
from ledgerleaf.operators.streamed import streamed_fingerprints


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_keys(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """The keys of a table, dealt to as many tasks as the session has shuffle partitions: what is made of each costs far
    more than a small file tells Spark."""
    return table(spark, sf_dir, name).select(key).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)


def raw_transcripts(spark: SparkSession, sf_dir: str, first: int = 1) -> DataFrame:
    """Raw documents, a conversation each; a turn's sequence is its number plus ``first``."""
    rows = table(spark, sf_dir, "conversations")
    title = F.concat(F.lit("Conversation "), F.col("conv_id"))
    return D.assemble_documents(rows, "conv_id", F.col("turn") + first, F.col("role"), F.col("text"), title, F.lit("conversation"), F.lit("chat"), roles=F.col("role"))


def turn_source() -> Column:
    """The source of the transcript that a turn belongs to."""
    return F.struct(F.lit("chat").alias("provider"), F.lit(None).cast("string").alias("source_uri"), F.concat(F.lit("conv-"), F.col("conv_id")).alias("source_document_id"))


def accepted_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of the accepted transcripts, one row each."""
    rows = table(spark, sf_dir, "conversations")
    return D.accepted_segments(D.segment_rows(rows, turn_source(), F.col("turn") + 1, F.col("role"), F.col("text"), "conv_id"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.normalize_documents(raw_transcripts(spark, sf_dir))


def transcript_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity and fingerprint of every accepted transcript."""
    accepted, _ = D.split_valid(transcripts(spark, sf_dir))
    return accepted.select("conv_id", "document_id", "fingerprint", F.size("segments").alias("segment_count"))


def flat_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every accepted transcript, hashed piece by piece from the flat rows: no conversation is gathered."""
    rows = table(spark, sf_dir, "conversations")
    said = accepted_turns(spark, sf_dir)
    none = F.lit(None).cast("timestamp")
    source = turn_source().withField("source_timestamp", none).withField("published_at", none).withField("retrieved_at", none)
    titled = said.select("document_id", "conv_id").distinct()
    heads = titled.select("document_id", F.concat(F.lit("Conversation "), F.col("conv_id")).alias("title"), F.lit("conversation").alias("document_type"), source.alias("source"))
    people = D.participant_rows(rows, turn_source(), F.col("role"), F.col("role"))
    return streamed_fingerprints(heads, people, said).withColumn("segment_count", F.col("segment_count").cast("int"))


def segment_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity of every segment of an accepted transcript, from the flat rows."""
    return accepted_turns(spark, sf_dir).select("document_id", "sequence", "segment_id")


def transcript_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participants of every transcript, from the flat rows."""
    return D.participant_rows(table(spark, sf_dir, "conversations"), turn_source(), F.col("role"), F.col("role")).drop("organization")


def nested_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments and participants of every accepted transcript, from the nested documents."""
    good = D.split_valid(transcripts(spark, sf_dir))[0]
    said = D.explode_segments(good).select("document_id", F.col("segment_id").alias("item"), F.col("participant_id").alias("person"))
    return said.unionAll(D.explode_participants(good).select("document_id", "role", "participant_id"))


def rejected_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts whose turns are taken as they are, from 0: each breaks the rule of positive sequences."""
    _, rejected = D.split_valid(D.normalize_documents(raw_transcripts(spark, sf_dir, first=0)))
    return rejected.select("conv_id", "first_error", F.size("errors").alias("n_errors"))


def transcript_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of the accepted transcripts, without text."""
    return D.document_summary(D.split_valid(transcripts(spark, sf_dir))[0], F.lit("transcript_v1"), F.lit("valid"))


def line_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank lines of every document, stripped and numbered."""
    docs = exploded(table(spark, sf_dir, "documents"), text.split_lines(F.col("text")), "at", "line", "doc_id")
    line = text.optional_text(F.col("line"))
    return docs.select("doc_id", (F.col("at") + 1).alias("line_number"), line.alias("line")).where(F.col("line").isNotNull()).select("doc_id", "line_number", F.sha2("line", 256).alias("line_sha256"))


def unknown_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of roles that don't open their conversation, found by an anti join of the flat tables."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("participant_id"))
    listed = rows.where("turn = 0").select("conv_id", "participant_id")
    return D.unknown_participants(rows, listed)


def time_order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose date lies after a line's shipping date or whose line ships before another day of the order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    times = orders.join(lines, orders.o_orderkey == lines.l_orderkey).groupBy("o_orderkey", "o_orderdate").agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    parsed = {name: text.utc_timestamp(iso(F.col(c)), name)[0] for name, c in (("source_timestamp", "last"), ("published_at", "first"), ("retrieved_at", "o_orderdate"))}
    source = F.struct(*(c.alias(n) for n, c in parsed.items()))
    return times.select("o_orderkey", D.check_time_order(source).alias("reason")).where("reason is not null")


def integrity_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts after tampering: conversations 1 modulo 3 get a longer title, 2 modulo 3 a padded last segment."""
    good = D.split_valid(transcripts(spark, sf_dir))[0]
    last = F.size("segments") - 1
    padded = F.transform("segments", lambda s, i: F.when(i == last, s.withField("text", F.concat(s["text"], F.lit(" ")))).otherwise(s))
    kind = F.col("conv_id") % 3
    spoilt = good.withColumn("segments", F.when(kind == 2, padded).otherwise(F.col("segments"))).withColumn("title", F.when(kind == 1, F.concat("title", F.lit("!"))).otherwise(F.col("title")))
    return D.verify_integrity(spoilt).select("conv_id", F.array_join("failures", ",").alias("failures"))


def document_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts against a later state: even conversations lose their last turn, those with id 5 modulo 7 are gone."""
    old = D.split_valid(transcripts(spark, sf_dir))[0]
    raw = raw_transcripts(spark, sf_dir).where("conv_id % 7 <> 5")
    shorter = F.when((F.col("conv_id") % 2 == 0) & (F.size("segments") > 1), F.slice("segments", 1, F.size("segments") - 1)).otherwise(F.col("segments"))
    new = D.split_valid(D.normalize_documents(raw.withColumn("segments", shorter)))[0]
    changes = D.detect_revisions(old, new)
    return changes.select("document_id", "change", F.size("segments_added").alias("n_added"), F.size("segments_removed").alias("n_removed"))


def segment_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts against a later state: by id modulo 3 a line in front, another first text, or the last turn in front."""
    raw, kind = raw_transcripts(spark, sf_dir), F.col("conv_id") % 3
    numbered = lambda c: F.transform(c, lambda s, i: s.withField("sequence", (i + 1).cast("long")))
    said = F.col("segments")
    line = F.array(F.struct(F.lit(0).cast("long").alias("sequence"), F.lit(None).cast("string").alias("participant_id"), F.lit("A new line.").alias("text")))
    other = F.transform(said, lambda s, i: F.when(i == 0, s.withField("text", F.concat(s["text"], F.lit("!")))).otherwise(s))
    turned = F.concat(F.slice(said, -1, 1), F.slice(said, F.lit(1), F.size(said) - 1))
    later = F.when(kind == 0, F.concat(line, said)).when(kind == 1, other).otherwise(turned)
    old, new = (D.split_valid(D.normalize_documents(raw.withColumn("segments", numbered(c))))[0] for c in (said, later))
    return segment_changes(old, new)


QUERIES = {f.__name__: f for f in (transcript_identity, flat_fingerprints, segment_identity, transcript_participants, nested_segments, rejected_transcripts, transcript_summary, line_segments, unknown_participants, time_order_violations, integrity_failures, document_revisions, segment_diff)}

#: DuckDB: white space and clean text as in ``ledgerleaf.functions.text``.
_WS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _clean(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '\r\n?', chr(10), 'g'), '\A[{_WS}]+|[{_WS}]+\z', '', 'g')"


def document_ctes(first: int = 1, where: str = "true") -> str:
    """CTEs: segs (conv_id, sequence, participant_id, text) and docs with document_id, seg list and fingerprint."""
    return f"""
    segs as (select conv_id, turn + {first} as sequence, {_clean("role")} as participant_id, {_clean("text")} as text from conversations where {where}),
    people as (select conv_id, list({{'displayName': p, 'organization': null::varchar, 'participantId': p, 'role': p}} order by p) as participants
      from (select distinct conv_id, participant_id as p from segs) group by conv_id),
    docs as (select s.conv_id, 'textdoc:' || sha256(to_json({{'provider': 'chat', 'sourceDocumentId': 'conv-' || s.conv_id, 'sourceUri': null::varchar}})::varchar) as document_id,
        'Conversation ' || s.conv_id as title, list({{'participantId': participant_id, 'sequence': sequence, 'text': text}} order by sequence, participant_id, text) as segments
      from segs s group by s.conv_id),
    marked as (select d.*, participants, sha256(to_json({{'documentType': 'conversation', 'participants': participants, 'segments': segments,
        'source': {{'provider': 'chat', 'publishedAt': null::varchar, 'retrievedAt': null::varchar, 'sourceDocumentId': 'conv-' || d.conv_id, 'sourceTimestamp': null::varchar, 'sourceUri': null::varchar}},
        'title': title}})::varchar) as fingerprint from docs d join people using (conv_id)),
    ids as (select conv_id, document_id, sequence, 'textseg:' || sha256(to_json({{'documentId': document_id, 'participantId': participant_id, 'sequence': sequence, 'text': text}})::varchar) as segment_id
      from segs join docs using (conv_id))"""


def distinct_turns() -> str:
    return "conv_id in (select conv_id from segs group by conv_id having count(*) = count(distinct sequence))"


ORACLES = {
    "transcript_identity": f"with {document_ctes()} select conv_id, document_id, fingerprint, len(segments)::int as segment_count from marked where {distinct_turns()}",
    "flat_fingerprints": f"with {document_ctes()} select document_id, fingerprint, len(segments)::int as segment_count from marked where {distinct_turns()}",
    "segment_identity": f"with {document_ctes()} select document_id, sequence, segment_id from ids where {distinct_turns()}",
    "nested_segments": f"""with {document_ctes()} select i.document_id, segment_id as item, participant_id as person from ids i join segs using (conv_id, sequence) where {distinct_turns()}
        union all select distinct document_id, participant_id, participant_id from segs join docs using (conv_id) where {distinct_turns()}""",
    "transcript_participants": f"with {document_ctes()} select distinct document_id, participant_id, participant_id as display_name, participant_id as role from segs join docs using (conv_id)",
    "rejected_transcripts": f"""with {document_ctes(0)} select conv_id, 'sequence_not_positive' as first_error, count(*) filter (where sequence <= 0)::int as n_errors
        from segs group by conv_id having count(*) filter (where sequence <= 0) > 0""",
    "transcript_summary": f"with {document_ctes()} select document_id, fingerprint, len(segments)::int as segment_count, 'transcript_v1' as engine, 'valid' as validation_status from marked where {distinct_turns()}",
    "line_segments": rf"""with lines as (select doc_id, unnest(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')) as raw,
          generate_subscripts(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), 1)::int as line_number from documents)
        select doc_id, line_number, sha256({_clean("raw")}) as line_sha256 from lines where {_clean("raw")} <> ''""",
    "unknown_participants": """select c.conv_id, c.turn, c.role as participant_id from conversations c
        where not exists (select 1 from conversations o where o.turn = 0 and o.conv_id = c.conv_id and o.role = c.role)""",
    "time_order_violations": """select o_orderkey, 'time_order' as reason from orders join lineitem on o_orderkey = l_orderkey group by o_orderkey, o_orderdate
        having max(l_shipdate) > min(l_shipdate) or min(l_shipdate) > o_orderdate or max(l_shipdate) > o_orderdate""",
    "integrity_failures": f"""with {document_ctes()} select conv_id, case conv_id % 3 when 1 then 'fingerprint' when 2 then 'segments,segment_id,fingerprint' else '' end as failures
        from docs where {distinct_turns()}""",
    "segment_diff": f"""with {document_ctes()}, old as (select conv_id, document_id, len(segments) as n from docs)
        select document_id, case conv_id % 3 when 0 then 'inserted' when 1 then 'changed' else 'moved' end as change,
          case conv_id % 3 when 0 then null when 1 then 1 else case when n = 2 then 1 else n end end::bigint as old_sequence, case when conv_id % 3 = 2 and n = 2 then 2 else 1 end::bigint as new_sequence
        from old where conv_id % 3 <> 2 or n > 1""",
    "document_revisions": f"""with {document_ctes()}, old as (select conv_id, document_id, len(segments) as n from docs where {distinct_turns()})
        select document_id, case when conv_id % 7 = 5 then 'removed' when conv_id % 2 = 0 and n > 1 then 'revised' else 'unchanged' end as change,
          0 as n_added, case when conv_id % 7 = 5 then n when conv_id % 2 = 0 and n > 1 then 1 else 0 end::int as n_removed from old""",
}
