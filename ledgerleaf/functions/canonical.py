"""Canonical JSON and the identities hashed from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerleaf.functions.text import canonical_datetime

#: The control characters whose escape has a hex letter.
LETTERED = ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F")


def canonical_json(c: Column) -> Column:
    """Compact JSON of a struct whose fields stand in key order; nulls stay, control escapes are in lower case."""
    out = F.to_json(c, {"ignoreNullFields": "false"})
    # Most texts hold no such character, so the passes over the text are behind one cheap test.
    fixed = out
    for h in LETTERED:
        fixed = F.regexp_replace(fixed, rf"(?<!\\)((?:\\\\)*)\\u00{h}", rf"$1\\u00{h.lower()}")
    return F.when(out.rlike(r"\\u00[01][A-F]"), fixed).otherwise(out)


def sha256_hex(c: Column) -> Column:
    """SHA-256 of a struct's canonical JSON in UTF-8, in lower-case hex."""
    return F.sha2(canonical_json(c), 256)


def document_id(source: Column) -> Column:
    """Identity of a document: its provider and what the provider calls it."""
    named = F.struct(source["provider"].alias("provider"), source["source_document_id"].alias("sourceDocumentId"), source["source_uri"].alias("sourceUri"))
    return F.concat(F.lit("textdoc:"), sha256_hex(named))


def segment_id(document: Column, sequence: Column, participant: Column, text: Column) -> Column:
    """Identity of a segment: its document, place, speaker and text."""
    named = F.struct(document.alias("documentId"), participant.alias("participantId"), sequence.alias("sequence"), text.alias("text"))
    return F.concat(F.lit("textseg:"), sha256_hex(named))


def fingerprint(title: Column, document_type: Column, source: Column, participants: Column, segments: Column) -> Column:
    """Hash of a document's content: participants in the given order, segments in theirs, no identities."""
    people = F.transform(participants, lambda p: F.struct(p["display_name"].alias("displayName"), p["organization"].alias("organization"), p["participant_id"].alias("participantId"), p["role"].alias("role")))
    said = F.transform(segments, lambda s: F.struct(s["participant_id"].alias("participantId"), s["sequence"].alias("sequence"), s["text"].alias("text")))
    origin = F.struct(
        source["provider"].alias("provider"),
        canonical_datetime(source["published_at"]).alias("publishedAt"),
        canonical_datetime(source["retrieved_at"]).alias("retrievedAt"),
        source["source_document_id"].alias("sourceDocumentId"),
        canonical_datetime(source["source_timestamp"]).alias("sourceTimestamp"),
        source["source_uri"].alias("sourceUri"),
    )
    return sha256_hex(F.struct(document_type.alias("documentType"), people.alias("participants"), said.alias("segments"), origin.alias("source"), title.alias("title")))
