"""What several operators need: tables, checkpoints and vectorised views of text columns."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ledgerleaf.sources.scratch import new_folder, shared_folder

#: Text handled at once inside a task; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Bytes of a batch that a task takes at once; the setting and what Spark has for it.
BATCH_BYTES, _BATCHES, _SPARKS_OWN = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

#: The whitespace bytes of the word rule ``[^\x20\x09-\x0D]+``.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE_HASH = np.random.RandomState(20240607).randint(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64)
_BYTE_HASH[_IS_SPACE] = 0
_POWERS = np.cumprod(np.full(64, _ODD, np.uint64))


def bounded_batches(spark: SparkSession) -> None:
    """Let tasks take whole texts in batches of about ``BATCH_BYTES``, unless the session says otherwise."""
    if spark.conf.get(_BATCHES) == _SPARKS_OWN:
        spark.conf.set(_BATCHES, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder, at once."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, uri: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet, in the shared folder unless told otherwise, and read it again."""
    uri = uri or new_folder(df.sparkSession, "written")
    df.write.mode("overwrite").parquet(uri)
    return df.sparkSession.read.parquet(uri)


def give_back() -> None:
    """Return what a worker has freed to the system, as it is kept for later tasks."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64): every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_chunks(column: pa.Array, target: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of rows of about ``target`` bytes.

    Yields (first row, end row, the rows' UTF-8 bytes, offsets into them). Null counts as empty.
    """
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, at, raw = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + target, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every whitespace-separated word, and where each row's words begin and end.

    Words never cross rows. Returns (hashes, bounds) where row i owns ``hashes[bounds[i]:bounds[i + 1]]``.
    """
    global _POWERS
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    solid = ~_IS_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    begins[inner] = solid[inner]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    body, solid_body, at = data[starts[0] :], solid[starts[0] :], starts - starts[0]
    spans = np.diff(at, append=len(body))
    place = np.arange(len(body)) - np.repeat(at, spans)
    if (longest := int(spans.max())) > len(_POWERS):
        _POWERS = np.cumprod(np.full(longest, _ODD, np.uint64))
    values = np.add.reduceat(_BYTE_HASH[body] * _POWERS[place], at)
    sizes = np.add.reduceat(solid_body, at, dtype=np.int64).astype(np.uint64)
    return mix(values + sizes), np.searchsorted(starts, offsets)


def windows(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``width`` consecutive words of a row; a shorter row is one window of all its words.

    Returns (hashes, bounds) as in ``word_hashes``; a row without words has none.
    """
    counts = np.diff(bounds)
    long = np.maximum(counts - width + 1, 0)
    out_bounds = np.concatenate([[0], np.cumsum(np.where(counts == 0, 0, np.maximum(long, 1)))])
    out = np.zeros(out_bounds[-1], np.uint64)
    if len(words) >= width:
        n = len(words) - width + 1
        acc = np.zeros(n, np.uint64)
        for k in range(width):
            acc = mix(acc * _ODD + words[k : k + n])
        keep = np.repeat(bounds[:-1], long) + (np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long))
        full = np.repeat(counts >= width, np.diff(out_bounds))
        out[full] = acc[keep]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        value = np.full(1, counts[i], np.uint64) * np.uint64(0x632BE59BD9B4E019)
        for w in words[bounds[i] : bounds[i + 1]]:
            value = mix(value * _ODD + w)
        out[out_bounds[i]] = value[0]
    return out, out_bounds
