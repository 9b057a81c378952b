"""Fill-in-middle transformation by in-place block rotation.

A text is cut into tokens, a run of white space with the word after it each, white space at the end being a token of
its own. Two token counts drawn from a digest of ``seed`` and doc_id give the prefix, the middle and the suffix. The
sentinels go into a bytearray of the text in the order of the cuts; two neighbouring segments then change places by
reversing each and both together, block by block, so a text of any length needs no second copy. The inverse finds the
sentinels again, rotates back and takes them out, which gives the exact text: a text that has a sentinel stays plain,
so no sentinel is ambiguous.

Tasks take bounded batches of rows, nothing is shuffled, and a text costs its own length a few times.

Defined results: a null text is an empty one; an empty text is plain, without cuts (null). A text of white space alone
is one token. A null doc_id counts as no digits. Repeated rows get equal results, one a row; an empty table gives no
rows; further columns are kept only when asked for.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerleaf.llm.shared import _IS_SPACE

#: The marks before the prefix, the suffix and the middle, and the forms of output.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Bytes that a reversal moves at once.
BLOCK = 1 << 16


def token_ends(data: np.ndarray) -> np.ndarray:
    """Where the tokens of UTF-8 bytes end: behind every word, and at the end of the text."""
    solid = ~_IS_SPACE[data]
    ends = np.flatnonzero(solid & ~np.append(solid[1:], False)) + 1
    return np.append(ends, len(data)) if len(data) and not solid[-1] else ends


def _reverse(a: np.ndarray, lo: int, hi: int) -> None:
    while hi - lo > 1:
        k = min(BLOCK, (hi - lo) // 2)
        left = a[lo : lo + k].copy()
        a[lo : lo + k] = a[hi - k : hi][::-1]
        a[hi - k : hi] = left[::-1]
        lo, hi = lo + k, hi - k


def rotate(buffer: bytearray, lo: int, middle: int, hi: int) -> None:
    """Exchange ``buffer[lo:middle]`` and ``buffer[middle:hi]`` in place, by three reversals."""
    a = np.frombuffer(buffer, np.uint8)
    _reverse(a, lo, middle)
    _reverse(a, middle, hi)
    _reverse(a, lo, hi)


def transform(text: bytes, first: int, second: int, form: str) -> bytearray:
    """``text``, cut at two bytes, in the form ``psm`` or ``spm``."""
    out = bytearray(text)
    out[second:second] = SUFFIX
    out[first:first] = MIDDLE
    out[0:0] = PREFIX
    at_middle, at_suffix = len(PREFIX) + first, len(PREFIX) + len(MIDDLE) + second
    rotate(out, at_middle if form == PSM else 0, at_suffix, len(out))
    return out


def restore(output: bytes, form: str) -> bytearray:
    """The exact text from the output and its form."""
    out = bytearray(output)
    if form == PLAIN:
        return out
    if form == PSM:
        at_suffix = out.find(SUFFIX)
        at_middle = out.find(MIDDLE, at_suffix)
        rotate(out, at_suffix, at_middle, len(out))
        at_suffix, at_middle = at_suffix + len(out) - at_middle, at_suffix
    else:
        at_prefix = out.find(PREFIX)
        at_middle = out.find(MIDDLE, at_prefix) - at_prefix
        rotate(out, 0, at_prefix, len(out))
        at_suffix = len(out) - at_prefix
    for at, mark in ((at_suffix, SUFFIX), (at_middle, MIDDLE), (0, PREFIX)):
        del out[at : at + len(mark)]
    return out


def _draws(seed: int) -> list[Column]:
    """Four numbers below 2**32 from the digest of ``seed`` and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"draw{k}") for k in range(4)]


def _characters(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, suffix_first: int = 80, keep: Sequence[str] = ()) -> DataFrame:
    """Every document with ``percent`` of the texts transformed, ``suffix_first`` percent of those with the suffix first.

    Returns doc_id, the columns ``keep``, n (tokens), form, prefix_chars, middle_chars and output.
    """
    text = F.coalesce("text", F.lit("")).alias("_text")
    rows = docs.select("doc_id", *(F.col(c) for c in keep), text, *_draws(seed))
    given = [f for f in rows.schema.fields if f.name in ("doc_id", *keep)]
    made = T._parse_datatype_string("n long, form string, prefix_chars long, middle_chars long, output string").fields
    width = 1 + len(keep)

    def one(data: bytes, h: Sequence[int]) -> tuple:
        view = np.frombuffer(data, np.uint8)
        ends = np.append(0, token_ends(view))
        n = len(ends) - 1
        if not data or any(mark in data for mark in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= percent:
            return n, PLAIN, None, None, data
        first, second = sorted(int(ends[x % (n + 1)]) for x in h[:2])
        form = SPM if h[3] % 100 < suffix_first else PSM
        return n, form, _characters(view[:first]), _characters(view[first:second]), bytes(transform(data, first, second, form))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws = zip(*(batch.column(width + 1 + k).to_pylist() for k in range(4)), strict=True)
            done = [one(t.as_buffer().to_pybytes(), h) for t, h in zip(batch.column(width), draws, strict=True)]
            n, form, before, middle, output = zip(*done, strict=True) if done else ((),) * 5
            columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *columns], [*batch.schema.names[:width], *(f.name for f in made)])

    return rows.mapInArrow(run, T.StructType([*given, *made]))


def restore_texts(df: DataFrame) -> DataFrame:
    """Add ``restored``, the text that was transformed, from ``output`` and ``form`` alone."""
    at_output, at_form = df.columns.index("output"), df.columns.index("form")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [bytes(restore(t.as_buffer().to_pybytes(), f.as_py())) for t, f in zip(batch.column(at_output), batch.column(at_form), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*batch.schema.names, "restored"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("restored", T.StringType())]))
