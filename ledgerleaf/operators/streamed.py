"""Fingerprints of documents larger than a task: canonical JSON hashed piece by piece.

A document's canonical JSON is its head, its participants, its segments in order and its tail. These pieces are rows,
dealt by document and sorted within it on disk, and a task feeds them to SHA-256 one batch after the other. What it
holds is a batch and a digest, however many segments a document has; nothing is gathered. The digest is the one of
``canonical.fingerprint``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions import canonical
from ledgerleaf.operators.documents import TIMES

HEAD, PEOPLE, BETWEEN, SAID, TAIL = range(5)


def _inner(c: Column) -> Column:
    """Canonical JSON of a struct without its braces."""
    whole = canonical.canonical_json(c)
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def document_pieces(heads: DataFrame, participants: DataFrame, segments: DataFrame) -> DataFrame:
    """(document_id, part, at, who, piece): the canonical JSON of each document of ``heads``, in sortable rows.

    ``heads``: document_id, title, document_type and source, one row a document. ``participants`` (participant_id,
    display_name, role, organization) stand in the order of their ids, ``segments`` (sequence, participant_id, text) in
    that of their sequences. All are normalised.
    """
    column = lambda part, at, who, piece: ("document_id", F.lit(part).alias("part"), at.cast("long").alias("at"), who.cast("string").alias("who"), piece.alias("piece"))
    source = F.struct(
        F.col("source.provider").alias("provider"),
        *(canonical.canonical_datetime(F.col(f"source.{t}")).alias(n) for t, n in ((TIMES[1], "publishedAt"), (TIMES[2], "retrievedAt"))),
        F.col("source.source_document_id").alias("sourceDocumentId"),
        canonical.canonical_datetime(F.col(f"source.{TIMES[0]}")).alias("sourceTimestamp"),
        F.col("source.source_uri").alias("sourceUri"),
    )
    none = F.lit(None)
    head = F.concat(F.lit("{"), _inner(F.struct(F.col("document_type").alias("documentType"))), F.lit(',"participants":['))
    tail = F.concat(F.lit("],"), _inner(F.struct(source.alias("source"), "title")), F.lit("}"))
    person = canonical.canonical_json(F.struct(F.col("display_name").alias("displayName"), "organization", F.col("participant_id").alias("participantId"), "role"))
    segment = canonical.canonical_json(F.struct(F.col("participant_id").alias("participantId"), "sequence", "text"))
    fixed = [heads.select(*column(part, none, none, piece)) for part, piece in ((HEAD, head), (BETWEEN, F.lit('],"segments":[')), (TAIL, tail))]
    people = participants.join(heads.select("document_id"), "document_id", "left_semi").select(*column(PEOPLE, none, F.col("participant_id"), person))
    said = segments.join(heads.select("document_id"), "document_id", "left_semi").select(*column(SAID, F.col("sequence"), F.col("participant_id"), segment))
    return fixed[0].unionAll(fixed[1]).unionAll(fixed[2]).unionAll(people).unionAll(said)


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest a document; its pieces come together, in order."""
    key, last, digest, count = None, None, hashlib.sha256(), 0

    def told(rows: list[tuple]) -> pa.RecordBatch:
        ids, digests, counts = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(digests, pa.string()), pa.array(counts, pa.int64())], ["document_id", "fingerprint", "segment_count"])

    for batch in batches:
        done = []
        ids, part = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        moves = [i for i in range(1, len(ids)) if part[i] != part[i - 1] or ids[i] != ids[i - 1]]
        for a, b in zip([0, *moves], [*moves, len(ids)], strict=True):
            if a == b:
                continue
            if ids[a] != key:
                if key is not None:
                    done.append((key, digest.hexdigest(), count))
                key, last, digest, count = ids[a], None, hashlib.sha256(), 0
            if last == part[a]:  # a list goes on from the batch before
                digest.update(b",")
            last = part[a]
            digest.update(",".join(batch.column(2)[a:b].to_pylist()).encode())
            count += b - a if last == SAID else 0
        if done:
            yield told(done)
    if key is not None:
        yield told([(key, digest.hexdigest(), count)])


def streamed_fingerprints(heads: DataFrame, participants: DataFrame, segments: DataFrame) -> DataFrame:
    """document_id, fingerprint and segment_count of each document of ``heads``, without gathering any."""
    pieces = document_pieces(heads, participants, segments)
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # By a hash of the key: pieces that joins have dealt by the key itself would not be dealt once more, and the tasks
    # that are left of those joins are merged list by list, so that a document's pieces would part.
    dealt = pieces.repartition(parts, F.xxhash64("document_id")).sortWithinPartitions("document_id", "part", "at", "who")
    return dealt.select("document_id", "part", "piece").mapInArrow(_hashed, "document_id string, fingerprint string, segment_count long")
