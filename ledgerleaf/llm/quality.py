"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Each text becomes a short vector of statistics (shares of byte classes, word and line lengths, repetition). A Gaussian
kernel over the standardised vectors is approximated by ``features`` random cosines. Every partition of labelled rows
sums its part of the normal equations; the parts are summed by row of the matrix in Spark and only the total, whose
size depends on ``features`` alone, reaches the driver. Ridge scores of a calibration fold are counted per narrow bin,
and pool-adjacent-violators over these bounded counts turns scores into probabilities.

Every labelled row counts, none is sampled. Folds go by crc32 of doc_id as text: remainder 0 modulo 5 is held out,
remainder 1 calibrates, the others fit.

Defined results: a null or empty text has all statistics 0 and is scored like any other; a null doc_id is scored and
never learnt from; null labels are ignored; without both a fitting and a calibrating row every score is 0.5. Labels
of a document that occurs twice count for each occurrence. An empty table gives no rows; extra columns are ignored
unless asked for.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerleaf.llm.shared import cut_lineage, lower_ascii, text_chunks, windows, word_hashes

BINS, LOWEST, HIGHEST = 2000, -0.5, 1.5

_CLASSES = (
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b" ",
    b"\n",
    b".",
    b",;:",
    b"!",
    b"?",
    b"|<>{}[]()/\\=_",
    b"#$%&*+@^~",
    b"'\"-`",
    bytes(range(128, 192)),
    bytes(range(192, 256)),
)
_CLASS_OF = np.zeros((256, len(_CLASSES)))
for _i, _members in enumerate(_CLASSES):
    _CLASS_OF[list(_members), _i] = 1.0
STATISTICS = len(_CLASSES) + 6


def _distinct(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Distinct values of each row."""
    rows = len(bounds) - 1
    bits = np.uint64(max(1, rows.bit_length()))
    owner = np.repeat(np.arange(rows, dtype=np.uint64), np.diff(bounds))
    keys = np.sort(owner << (np.uint64(64) - bits) | hashes >> bits)
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[first] >> (np.uint64(64) - bits)).astype(np.int64), minlength=rows)


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics for each text of a chunk."""
    rows, sizes = len(offsets) - 1, np.diff(offsets)
    counts = np.bincount(np.repeat(np.arange(rows) * 256, sizes) + data, minlength=rows * 256).reshape(rows, 256)
    words, bounds = word_hashes(lower_ascii(data), offsets)
    n_words = np.diff(bounds)
    trios, trio_bounds = windows(words, bounds, 3)
    n_trios = np.diff(trio_bounds)
    lines = counts[:, 10] + 1
    some = np.maximum(sizes, 1)
    spaces = counts[:, [9, 10, 11, 12, 13, 32]].sum(1)
    out = np.empty((rows, STATISTICS))
    out[:, : len(_CLASSES)] = counts @ _CLASS_OF / some[:, None]
    out[:, -6] = np.log1p(sizes) / 10
    out[:, -5] = np.log1p(np.where(n_words, (sizes - spaces) / np.maximum(n_words, 1), 0))
    out[:, -4] = np.log1p(n_words / lines) / 3
    out[:, -3] = np.where(n_words, _distinct(words, bounds) / np.maximum(n_words, 1), 0)
    out[:, -2] = np.where(n_trios, _distinct(trios, trio_bounds) / np.maximum(n_trios, 1), 0)
    out[:, -1] = (counts > 0).sum(1) / 100
    return out


def statistics_table(docs: DataFrame) -> DataFrame:
    """doc_id and stats (array of doubles) of every whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                stats = text_statistics(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, stats.size + 1, STATISTICS, dtype=np.int32)), pa.array(stats.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(pa.int64()), lists], ["doc_id", "stats"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, stats array<double>")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % folds


@dataclass
class QualityModel:
    """Everything a task needs to score statistics; its size depends on the number of features only."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def cosines(self, stats: np.ndarray) -> np.ndarray:
        x = (stats - self.mean) / self.scale
        z = np.cos(x @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.cosines(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.values)


def _stacked(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _normal_equations(rows: DataFrame, model: QualityModel) -> np.ndarray:
    """Sum over (stats, label) rows of the outer products of [cosines, 1, label], summed by partition, then by row."""
    side = len(model.phases) + 2
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = "i int, v array<double>"

    def listed(keys: Iterable[int], values: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, side, dtype=np.int32)), pa.array(values.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(list(keys), pa.int32()), lists], ["i", "v"])

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((side, side)), False
        for batch in batches:
            if batch.num_rows:
                z = np.hstack([shared.value.cosines(_stacked(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False)[:, None]])
                total += z.T @ z
                seen = True
        if seen:
            yield listed(range(side), total)

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), _stacked(batch.column(1)) if batch.num_rows else (), strict=True):
                total[i] = total[i] + v if i in total else v
        if total:
            yield listed(total, np.array(list(total.values())))

    out = np.zeros((side, side))
    for r in rows.select("stats", F.col("label").cast("double")).mapInArrow(partial, schema).repartition("i").mapInArrow(summed, schema).collect():
        out[r.i] = r.v
    return out


def _pool(counts: np.ndarray, hits: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit by pool-adjacent-violators: knots (weighted middles of the pools) and their rates."""
    pools: list[list[float]] = []
    for n, k, x in zip(counts, hits, at, strict=True):
        pools.append([n, k, n * x])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            n2, k2, x2 = pools.pop()
            pools[-1] = [pools[-1][0] + n2, pools[-1][1] + k2, pools[-1][2] + x2]
    p = np.array(pools)
    return p[:, 2] / p[:, 0], np.maximum.accumulate((p[:, 1] + 0.5) / (p[:, 0] + 1))


def fit_quality(stats: DataFrame, labels: DataFrame, features: int = 128, width: float = 3.0, ridge: float = 1e-3, seed: int = 11) -> QualityModel:
    """Learn from ``stats`` (doc_id, stats) and ``labels`` (doc_id, label); rows with fold 0 of 5 are left out."""
    rows = stats.join(labels.where(F.col("label").isNotNull()).select("doc_id", "label"), "doc_id").where(fold(F.col("doc_id"), 5) != 0)
    rows = cut_lineage(rows.select("stats", "label", (fold(F.col("doc_id"), 5) == 1).alias("calibrates")))
    fitting = rows.where("not calibrates")
    sums = fitting.agg(F.count(F.lit(1)).alias("n"), *(f(F.col("stats")[i]).alias(f"{a}{i}") for i in range(STATISTICS) for a, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    rng = np.random.RandomState(seed)
    directions, phases = rng.randn(STATISTICS, features) / width, rng.uniform(0, 2 * np.pi, features)
    mean = np.array([sums[f"m{i}"] or 0.0 for i in range(STATISTICS)])
    scale = np.array([max(sums[f"s{i}"] or 0.0, 1e-3) for i in range(STATISTICS)])
    model = QualityModel(mean, scale, directions, phases, np.zeros(features + 1), np.array([0.0]), np.array([0.5]))
    if not sums.n:
        return model
    total = _normal_equations(fitting, model)
    model.weights = np.linalg.solve(total[:-1, :-1] + ridge * sums.n / features * np.eye(features + 1), total[:-1, -1])

    shared = rows.sparkSession.sparkContext.broadcast(model)

    def binned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = np.clip(shared.value.raw(_stacked(batch.column(0))), LOWEST, HIGHEST)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum((raw - LOWEST) / (HIGHEST - LOWEST) * BINS, BINS - 1).astype(np.int32)), batch.column(1)], ["bin", "label"])

    counts = rows.where("calibrates").select("stats", F.col("label").cast("double")).mapInArrow(binned, "bin int, label double").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("k")).orderBy("bin").collect()
    if counts:
        bins, n, k = (np.array(x, float) for x in zip(*counts, strict=True))
        model.knots, model.values = _pool(n, k, LOWEST + (bins + 0.5) * (HIGHEST - LOWEST) / BINS)
    return model


def score_statistics(stats: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score (0 to 1) of ``stats`` (doc_id, stats)."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(_stacked(batch.column(1))))], ["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double")


def keep_good_documents(docs: DataFrame, model: QualityModel, least: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose whole text scores at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(text_statistics(data, offsets)) for _, _, data, offsets in text_chunks(batch.column(at))]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) >= least))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
