"""Results registered by keyed state: late, tied and repeated arrivals, a restart, a run that breaks off."""

import hashlib
import random
from collections import Counter

from ledgerleaf.streaming import keyed

GOOD = '{"engine":"%s","document_type":"t","data":{},"validation_status":"valid"}'
COLUMNS = "document_id string, arrival bigint, payload string"


def run(spark, folder, documents, earlier=(), parts=4):
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    docs = spark.createDataFrame([(d,) for d in documents], "id string")
    done = spark.createDataFrame([(d,) for d in earlier], "document_id string")
    return keyed.write_results_keyed(docs, done, stream, f"{folder}/out", f"{folder}/state", parts=parts)


def send(spark, folder, rows):
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def outcomes(spark, folder):
    return Counter((r.document_id, r.arrival, r.payload, r.outcome) for r in spark.read.parquet(f"{folder}/out").collect())


def test_first_batch_decides_and_ties_go_by_content(spark, tmp_path):
    folder, a, b = str(tmp_path), GOOD % "a", GOOD % "b"
    least = min((a, b), key=lambda p: hashlib.sha256(p.encode()).hexdigest())
    send(spark, folder, [("x", 5, a), ("x", 5, b), ("x", None, a), ("y", None, a), ("y", None, a), ("z", 1, "no json"), ("q", 1, a), (None, 1, a), ("old", 1, a), ("w", 1, None)])
    before = {name: spark.conf.get(name, None) for name in keyed.STORE}
    run(spark, folder, ["x", "y", "z", "w", "old", "old", None], earlier=["old", "old", None]).awaitTermination()
    assert before == {name: spark.conf.get(name, None) for name in keyed.STORE}
    got = outcomes(spark, folder)
    other = b if least == a else a
    assert got[("x", 5, least, 201)] == got[("x", 5, other, 409)] == got[("x", None, a, 409)] == 1
    assert got[("y", None, a, 201)] == got[("y", None, a, 409)] == 1
    assert got[("z", 1, "no json", 400)] == got[("w", 1, None, 400)] == got[("q", 1, a, 404)] == got[(None, 1, a, 404)] == got[("old", 1, a, 409)] == 1
    assert got.total() == 10
    # Restarted: an earlier arrival that comes late has lost, and what was not decided still can be.
    send(spark, folder, [("x", 1, b), ("z", 1, a)])
    run(spark, folder, ["x", "y", "z", "w", "old"]).awaitTermination()
    more = outcomes(spark, folder) - got
    assert more == Counter({("x", 1, b, 409): 1, ("z", 1, a, 201): 1})


def test_a_batch_that_breaks_off_is_repeated(spark, tmp_path):
    """What a commit did not reach is judged again: each row has one outcome, and each document one result."""
    folder = str(tmp_path)
    send(spark, folder, [("x", 1, GOOD % "a"), ("y", 1, GOOD % "a")])
    run(spark, folder, ["x", "y", "z"]).awaitTermination()
    send(spark, folder, [("x", 0, GOOD % "b"), ("z", 1, GOOD % "b"), ("z", 2, GOOD % "b")])
    run(spark, folder, ["x", "y", "z"]).awaitTermination()
    whole = outcomes(spark, folder)
    # As if the driver had died after writing the batch and its state, before it was committed.
    (tmp_path / "state" / "commits" / "1").unlink()
    (tmp_path / "state" / "commits" / ".1.crc").unlink()
    send(spark, folder, [("y", 0, GOOD % "c")])
    run(spark, folder, ["x", "y", "z"]).awaitTermination()
    assert outcomes(spark, folder) - whole == Counter({("y", 0, GOOD % "c", 409): 1}) and not whole - outcomes(spark, folder)


def test_equal_to_the_rule_whatever_the_batches(spark, tmp_path):
    rng, folder = random.Random(7), str(tmp_path)
    names = [f"d{i}" for i in range(12)]
    batches = [[(("hot" if rng.random() < 0.4 else rng.choice([*names, "lost"])), rng.choice([None, 1, 2, 3]), rng.choice([GOOD % rng.choice("abc"), "bad"])) for _ in range(80)] for _ in range(3)]
    taken = {"d0"}
    want = Counter()
    for rows in batches:
        send(spark, folder, rows)
        run(spark, folder, [*names, "hot"], earlier=["d0"]).awaitTermination()
        sha = lambda p: hashlib.sha256(p.encode()).hexdigest()
        won = {}
        for i, (d, at, p) in enumerate(rows):
            if p != "bad" and d != "lost" and d not in taken:
                won[d] = min(won.get(d, ((True, 9, "z"), 0)), ((at is None, at or 0, sha(p)), i))
        for i, (d, at, p) in enumerate(rows):
            want[d, at, p, 400 if p == "bad" else 404 if d == "lost" else 201 if won.get(d, (0, -1))[1] == i else 409] += 1
        taken |= set(won)
    assert outcomes(spark, folder) == want


def test_empty_stream(spark, tmp_path):
    folder = str(tmp_path)
    send(spark, folder, [])
    run(spark, folder, ["x"]).awaitTermination()
    assert not list((tmp_path / "out").glob("*.parquet")) or not outcomes(spark, folder)
