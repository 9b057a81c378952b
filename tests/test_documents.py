"""Normalising, identities and integrity against plain Python (json and hashlib)."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from ledgerleaf.functions import canonical, text
from ledgerleaf.operators import documents as D
from ledgerleaf.operators.alignment import changes, common_subsequence, segment_changes
from ledgerleaf.operators.streamed import streamed_fingerprints
from ledgerleaf.sources.readers import parse_raw_documents

BASE = {
    "title": "  Quarterly call\r\n",
    "document_type": "transcript",
    "source": {"provider": "archive", "source_uri": None, "source_document_id": "call-7", "source_timestamp": "2026-01-02T03:04:05.500+03:00", "published_at": "2026-01-02T00:05:00Z", "retrieved_at": None},
    "participants": [{"participant_id": "a", "display_name": "Ann", "role": " host ", "organization": None}, {"participant_id": "b", "display_name": "Ann", "role": None, "organization": "Org"}],
    "segments": [{"sequence": 2, "participant_id": "b", "text": "Déjà vu\rline \u000b\u001f\\u000B \"q\" "}, {"sequence": 1, "participant_id": " a ", "text": " Привет "}, {"sequence": 3, "participant_id": None, "text": "end"}],
}


def changed(**parts):
    out = json.loads(json.dumps(BASE))
    for key, value in parts.items():
        where, *path = key.split("__")
        if path:
            out[where][int(path[0]) if path[0].isdigit() else path[0]] = value
        else:
            out[where] = value
    return out


def run(spark, *docs):
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "n int, raw string")
    return D.normalize_documents(parse_raw_documents(rows)).orderBy("n").collect()


def sha(payload):
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def test_identities_equal_plain_python(spark):
    (row,) = run(spark, BASE)
    clean = lambda s: s.replace("\r\n", "\n").replace("\r", "\n").strip()
    ident = "textdoc:" + sha({"provider": "archive", "sourceDocumentId": "call-7", "sourceUri": None})
    segments = [{"sequence": s["sequence"], "participantId": s["participant_id"] and clean(s["participant_id"]), "text": clean(s["text"])} for s in sorted(BASE["segments"], key=lambda s: s["sequence"])]
    people = [{"participantId": p["participant_id"], "displayName": p["display_name"], "role": p["role"] and clean(p["role"]), "organization": p["organization"]} for p in BASE["participants"]]
    source = {"provider": "archive", "sourceUri": None, "sourceDocumentId": "call-7", "sourceTimestamp": "2026-01-02T00:04:05.500000Z", "publishedAt": "2026-01-02T00:05:00Z", "retrievedAt": None}
    assert row.errors == []
    assert row.document_id == ident
    assert [s.segment_id for s in row.segments] == ["textseg:" + sha({"documentId": ident, **s}) for s in segments]
    assert row.fingerprint == sha({"title": "Quarterly call", "documentType": "transcript", "source": source, "participants": people, "segments": segments})


def test_what_keeps_and_what_changes_a_document(spark):
    reversed_, spaced, text_, ident, time_, swapped = run(
        spark,
        changed(segments=BASE["segments"][::-1]),
        changed(title="Quarterly call"),
        changed(segments__0={"sequence": 2, "participant_id": "b", "text": "other"}),
        changed(source__source_document_id="call-8"),
        changed(source__source_timestamp="2026-01-02T00:04:05.5Z"),
        changed(participants=BASE["participants"][::-1]),
    )
    (base,) = run(spark, BASE)
    for same in (reversed_, spaced, time_):
        assert (same.document_id, same.fingerprint, same.segments) == (base.document_id, base.fingerprint, base.segments)
    assert text_.document_id == base.document_id and text_.fingerprint != base.fingerprint
    assert ident.document_id != base.document_id and swapped.fingerprint != base.fingerprint


def test_rejections_in_order(spark):
    cases = {
        "title_blank": changed(title=" \n"),
        "document_type_blank": changed(document_type=" "),
        "provider_blank": changed(source__provider=""),
        "source_document_id_multiline": changed(source__source_document_id="a\nb"),
        "source_timestamp_without_offset": changed(source__source_timestamp="2026-01-02T03:04:05"),
        "published_at_invalid": changed(source__published_at="2026-13-02T03:04:05Z"),
        "source_identity_missing": changed(source__source_document_id=" "),
        "time_order": changed(source__retrieved_at="2020-01-01T00:00:00Z", source__published_at=None),
        "participant_id_multiline": changed(participants__0={"participant_id": "a\nb", "display_name": "x"}),
        "display_name_blank": changed(participants__0={"participant_id": "a", "display_name": " "}),
        "participants_not_unique": changed(participants__1={"participant_id": "a ", "display_name": "x"}, segments=[{"sequence": 1, "text": "t"}]),
        "segments_missing": changed(segments=[]),
        "sequence_not_positive": changed(segments__0={"sequence": 0, "participant_id": "b", "text": "t"}),
        "sequence_not_unique": changed(segments__1={"sequence": 2, "participant_id": "b", "text": "t"}),
        "participant_unknown": changed(segments__0={"sequence": 2, "participant_id": "z", "text": "t"}),
        "segment_text_blank": changed(segments__0={"sequence": 2, "participant_id": "b", "text": "\t"}),
    }
    assert [r.first_error for r in run(spark, *cases.values())] == list(cases)
    both = run(spark, changed(title="", segments=[]))[0]
    assert both.errors == ["title_blank", "segments_missing"]


def test_empty_table_and_null_parts(spark):
    empty = parse_raw_documents(spark.createDataFrame([], "raw string"))
    assert D.normalize_documents(empty).count() == 0
    (row,) = D.normalize_documents(parse_raw_documents(spark.createDataFrame([("{}",)], "raw string"))).collect()
    assert row.first_error == "title_blank" and "segments_missing" in row.errors


def test_unknown_fields(spark):
    raw = [json.dumps(BASE), json.dumps(changed(source__extra=1)), json.dumps({**BASE, "z": 1, "segments": [{"sequence": 1, "text": "t", "x": 2}]}), "[]", "nope"]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "n int, raw string").select("n", D.unknown_fields(F.col("raw")).alias("u")).orderBy("n").collect()
    assert [r.u for r in got] == [[], ["source.extra"], ["segments[].x", "z"], None, None]


def test_integrity_and_revisions(spark):
    rows = spark.createDataFrame([(json.dumps(BASE),)], "raw string")
    good = D.split_valid(D.normalize_documents(parse_raw_documents(rows)))[0]
    failures = lambda df: D.verify_integrity(df).first().failures
    assert failures(good) == []
    assert failures(good.withColumn("fingerprint", F.lit("0" * 64))) == ["fingerprint"]
    assert "document_id" in failures(good.withColumn("document_id", F.lit("textdoc:0")))
    assert "segments_not_sorted" in failures(good.withColumn("segments", F.reverse("segments")))
    edited = D.split_valid(D.normalize_documents(parse_raw_documents(spark.createDataFrame([(json.dumps(changed(segments__2={"sequence": 3, "text": "END"})),)], "raw string"))))[0]
    (change,) = D.detect_revisions(good, edited).collect()
    assert change.change == "revised" and len(change.segments_added) == len(change.segments_removed) == 1
    assert D.detect_revisions(good, edited.where("false")).first().change == "removed"


def test_canonical_json_equals_python(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["\\", "u000B", '"', "é", "\u000b", "\u001f", "\n", "/", "\u007f", "😀", chr(rng.randrange(32))]) for _ in range(12)) for _ in range(2000)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", canonical.canonical_json(F.struct(F.col("t").alias("t"))).alias("j")).collect()
    assert all(r.j == json.dumps({"t": r.t}, separators=(",", ":"), ensure_ascii=False) for r in got)


def test_strip_equals_python(spark):
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    texts = [f"{c}x{c}y{c}" for c in spaces] + ["​x​", "", " "]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.strip(F.col("t")).alias("s")).collect()
    assert all(r.s == r.t.strip() for r in got)


def test_streamed_fingerprints_equal_nested_ones(spark):
    """Also of a document of many batches, with texts that need escapes, and of one without participants."""
    rng = random.Random(9)
    odd = ['q"\\', "a\x0b\x1f z", "é ü퟿", "line\nline", "\t", "</s>", "\x7f"]
    docs = []
    for i in range(12):
        people = [(f"p{k}", rng.choice(odd) + "n", rng.choice([None, "r"]), rng.choice([None, odd[0]])) for k in range(rng.randint(0, 3))]
        many = 30_000 if i == 3 else rng.randint(1, 9)
        said = [(k + 1, rng.choice([None, *[p[0] for p in people]]), f"{rng.choice(odd)}x{k}") for k in rng.sample(range(2 * many), many)]
        times = (None, "2026-01-02T03:04:05.250000Z", "2026-03-02T03:04:05Z") if i % 2 else (None, None, None)
        docs.append((f"t{i} {odd[i % 7]}x", "d", ("prov", None, f"s{i}", *times), people, said))
    raw = spark.createDataFrame(docs, D.RAW_SCHEMA)
    good = D.split_valid(D.normalize_documents(raw))[0].cache()
    assert good.count() == 12
    want = {r.document_id: (r.fingerprint, r.n) for r in good.select("document_id", "fingerprint", F.size("segments").alias("n")).collect()}
    flat = D.explode_segments(good).repartition(5)
    got = streamed_fingerprints(good.select("document_id", "title", "document_type", "source"), D.explode_participants(good), flat)
    assert {r.document_id: (r.fingerprint, r.segment_count) for r in got.collect()} == want
    assert streamed_fingerprints(good.where("false"), D.explode_participants(good), flat).count() == 0
    good.unpersist()


def test_streamed_fingerprints_after_joins_that_shuffle(spark):
    """What large tables do: the joins before have dealt the pieces by document, and their small tasks are merged."""
    from ledgerleaf.plans.transcripts import flat_fingerprints, transcript_identity

    adaptive = "spark.sql.adaptive"
    large = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", f"{adaptive}.coalescePartitions.parallelismFirst": "false", f"{adaptive}.advisoryPartitionSizeInBytes": "8KB", f"{adaptive}.coalescePartitions.minPartitionSize": "1B"}
    kept = {k: spark.conf.get(k) for k in large}
    data = "/root/testdata/sf0.01"
    try:
        for k, v in large.items():
            spark.conf.set(k, v)
        got = sorted(map(tuple, flat_fingerprints(spark, data).collect()))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == sorted(map(tuple, transcript_identity(spark, data).drop("conv_id").collect()))


def test_alignment_equals_plain_tables():
    """The subsequence is a longest one, and the changes turn one state into the other."""
    rng = random.Random(10)
    for _ in range(300):
        old, new = ([rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(0, 12))] for _ in range(2))
        if rng.random() < 0.4:
            new = old[:]
            for _ in range(rng.randint(0, 3)):
                new.insert(rng.randint(0, len(new)), rng.choice("xyz"))
        longest = [[0] * (len(new) + 1) for _ in range(len(old) + 1)]
        for i, a in enumerate(old):
            for j, b in enumerate(new):
                longest[i + 1][j + 1] = longest[i][j] + 1 if a == b else max(longest[i][j + 1], longest[i + 1][j])
        kept = common_subsequence(old, new)
        assert len(kept) == longest[-1][-1] and all(old[i] == new[j] for i, j in kept)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(kept, kept[1:], strict=False))
        told = changes(old, new)
        assert sorted([i for i, _ in kept] + [i for _, i, _ in told if i is not None]) == list(range(len(old)))
        assert sorted([j for _, j in kept] + [j for _, _, j in told if j is not None]) == list(range(len(new)))
        assert all(old[i] == new[j] for change, i, j in told if change == "moved")
        assert not {old[i] for c, i, _ in told if c in ("deleted", "changed")} & {new[j] for c, _, j in told if c in ("inserted", "changed")}


def test_one_line_in_front_is_one_change(spark):
    said = lambda *texts: [{"sequence": k + 1, "participant_id": None, "text": t} for k, t in enumerate(texts)]
    states = [(said("a", "b", "c", "d"), said("new", "a", "b", "c", "d")), (said("a", "b", "c", "d"), said("a", "B", "d", "c")), (said("a", "b"), said("a"))]
    docs = [[changed(segments=s[k], source__source_document_id=f"n{i}") for i, s in enumerate(states)] for k in (0, 1)]
    old, new = (D.normalize_documents(parse_raw_documents(spark.createDataFrame([(json.dumps(d),) for d in side], "raw string"))) for side in docs)
    ident = {r.document_id: r.source.source_document_id for r in old.collect()}
    got = sorted((ident[r.document_id], r.change, r.old_sequence, r.new_sequence) for r in segment_changes(old, new).collect())
    assert got == [("n0", "inserted", None, 1), ("n1", "changed", 2, 2), ("n1", "moved", 3, 4), ("n2", "deleted", 2, None)]
    assert segment_changes(old, old).count() == 0
