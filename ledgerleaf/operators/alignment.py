"""What changed between two states of a document, segment by segment, in order.

Segments are compared by speaker and text, not by identities, which hold the place: a line put in front changes one
segment, not all that follow. A longest common subsequence stays; of the rest, segments that are in both states have
moved, those that stand in the same gap are changed into each other in order, and what is left was inserted or deleted.

The join deals documents; a task aligns one document's hashes at a time (a few bytes a segment). Time grows with the
pairs of equal segments, which for one text repeated n times in both states are n * n.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def common_subsequence(old: list, new: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence: of increasing pairs of equal items the longest chain."""
    lo, ends = 0, (len(old), len(new))
    while lo < min(ends) and old[lo] == new[lo]:
        lo += 1
    tail = 0
    while tail < min(ends) - lo and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    places = defaultdict(list)
    for j in range(ends[1] - tail - 1, lo - 1, -1):
        places[new[j]].append(j)
    last: list[int] = []
    chains: list[tuple] = []
    for i in range(lo, ends[0] - tail):
        for j in places.get(old[i], ()):
            k = bisect_left(last, j)
            chain = (i, j, chains[k - 1] if k else None)
            if k == len(last):
                last.append(j)
                chains.append(chain)
            else:
                last[k], chains[k] = j, chain
    middle, chain = [], chains[-1] if chains else None
    while chain:
        middle.append(chain[:2])
        chain = chain[2]
    return [(i, i) for i in range(lo)] + middle[::-1] + [(ends[0] - k, ends[1] - k) for k in range(tail, 0, -1)]


def changes(old: list, new: list) -> list[tuple[str, int | None, int | None]]:
    """(change, place in ``old``, place in ``new``) of every item that does not simply stay."""
    kept = common_subsequence(old, new)
    gone, come = set(range(len(old))) - {i for i, _ in kept}, set(range(len(new))) - {j for _, j in kept}
    elsewhere = defaultdict(list)
    for j in sorted(come, reverse=True):
        elsewhere[new[j]].append(j)
    out = []
    for i in sorted(gone):
        if elsewhere[old[i]]:
            j = elsewhere[old[i]].pop()
            out.append(("moved", i, j))
            gone.discard(i)
            come.discard(j)
    before = (-1, -1)
    for stop in [*kept, (len(old), len(new))]:
        left, right = ([k for k in range(a + 1, b) if k in rest] for a, b, rest in zip(before, stop, (gone, come), strict=True))
        both = min(len(left), len(right))
        out += [("changed", i, j) for i, j in zip(left, right, strict=False)]
        out += [("deleted", i, None) for i in left[both:]] + [("inserted", None, j) for j in right[both:]]
        before = stop
    return out


def segment_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """document_id, change (inserted, deleted, changed or moved), old_sequence and new_sequence of every segment that is
    not as it was, for the normalised documents that both states have."""
    marks = lambda df, x: df.select("document_id", F.col("fingerprint").alias(f"{x}_mark"), F.transform("segments", lambda s: s["sequence"]).alias(f"{x}_at"), F.transform("segments", lambda s: F.xxhash64(s["participant_id"], F.lit("|"), s["text"])).alias(f"{x}_hash"))
    both = marks(old, "old").join(marks(new, "new"), "document_id").where("old_mark <> new_mark").select("document_id", "old_at", "old_hash", "new_at", "new_hash")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ident, old_at, old_hash, new_at, new_hash in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(ident, change, None if i is None else old_at[i], None if j is None else new_at[j]) for change, i, j in changes(old_hash, new_hash)]
            if rows:
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["document_id", "change", "old_sequence", "new_sequence"])

    return both.mapInArrow(run, "document_id string, change string, old_sequence long, new_sequence long")
