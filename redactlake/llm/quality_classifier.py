"""Quality classifier: ridge regression on random Fourier features.

Statistics of each whole text are standardised and passed through cosines of random
projections, which approximate a Gaussian kernel. Partitions sum X'X and X'y over
the labelled rows, partial sums are added up in a second stage, and the driver
solves one system whose size is the number of features. Scores are calibrated by
isotonic regression (pool adjacent violators) on a histogram of the scores of
labelled rows that the ridge fit did not see.

Nulls, ties, empties: a null text counts as empty and gets the score of one; null
labels are not learnt from; a document labelled more than once counts each time;
without labels (or with one class alone) every score is the share of that class, or
0.5; extra columns are ignored or, by classify(), kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._batch import having, load, materialised
from ._statistics import NAMES, statistics

FEATURES = 192
RIDGE = 1.0
BINS = 1000
THRESHOLD = 0.7


class Model:
    """Plain arrays of a bounded size: what tasks get."""

    def __init__(self, mean, scale, omega, phase, weights, edges=None, levels=None):
        self.mean, self.scale, self.omega, self.phase, self.weights, self.edges, self.levels = mean, scale, omega, phase, weights, edges, levels

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return lifted(stats, self.mean, self.scale, self.omega, self.phase) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.raw(stats)
        return raw if self.edges is None else np.interp(raw, self.edges, self.levels)


def projection(d: int, features: int = FEATURES, width: float = 1.0, seed: int = 7):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(d, features)) / (width * np.sqrt(d)), rng.uniform(0, 2 * np.pi, features)


def lifted(stats, mean, scale, omega, phase) -> np.ndarray:
    z = np.clip((stats - mean) / scale, -4, 4)
    return np.concatenate([np.sqrt(2 / omega.shape[1]) * np.cos(z @ omega + phase), np.ones((len(z), 1))], axis=1)


def pool(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted isotonic regression by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks[-1]
            a[0] = (a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1])
            a[1] += b[1]
            a[2] += b[2]
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def _matrix(column) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def with_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    rows = docs.select(*keep, F.col(text).alias("__text"))

    def run(batches):
        for b in batches:
            s = statistics(b.column(len(keep)))
            stats = pa.FixedSizeListArray.from_arrays(pa.array(s.reshape(-1)), len(NAMES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], stats], names=[*keep, "stats"])

    return rows.mapInArrow(run, rows.select(*keep, F.array(F.lit(0.0)).alias("stats")).schema)


def _summed(df: DataFrame, run) -> np.ndarray | None:
    """Sum over all partitions of the arrays that run gives: added in a second, narrower stage before the driver."""

    def first(batches):
        total = None
        for b in batches:
            part = run(b)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float64).tobytes()], pa.binary())], names=["sums"])

    def again(batches):
        total = None
        for b in batches:
            for x in b.column(0).to_pylist():
                part = np.frombuffer(x)
                total = part.copy() if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    found = df.mapInArrow(first, "sums binary").repartition(4).mapInArrow(again, "sums binary").collect()
    return sum(np.frombuffer(bytes(r[0])) for r in found) if found else None


def fit(rows: DataFrame) -> Model | float:
    """From rows (stats, label, calibrate): a model, or the one score that all get."""
    d = len(NAMES)

    def moments(b):
        s, y = _matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False).astype(float)
        return np.concatenate([[len(s), y.sum()], s.sum(0), (s * s).sum(0)])

    m = _summed(rows.select("stats", "label"), moments)
    if m is None or m[0] == 0:
        return 0.5
    if m[1] in (0, m[0]):
        return float(m[1] / m[0])
    n, mean = m[0], m[2 : 2 + d] / m[0]
    scale = np.sqrt(np.maximum(m[2 + d :] / n - mean**2, 0))
    scale[scale < 1e-9] = 1.0
    omega, phase = projection(d)

    def normal(b):
        x = lifted(_matrix(b.column(0)), mean, scale, omega, phase)
        y = b.column(1).to_numpy(zero_copy_only=False).astype(float)
        return np.concatenate([(x.T @ x).reshape(-1), x.T @ y])

    sums = _summed(rows.filter(~F.col("calibrate")).select("stats", "label"), normal)
    if sums is None:
        return float(m[1] / m[0])
    k = len(phase) + 1
    ridge = RIDGE * np.eye(k)
    ridge[-1, -1] = 1e-6
    weights = np.linalg.solve(sums[: k * k].reshape(k, k) + ridge, sums[k * k :])
    model = Model(mean, scale, omega, phase, weights)

    def histogram(b):
        raw, y = np.clip(model.raw(_matrix(b.column(0))), -0.5, 1.5), b.column(1).to_numpy(zero_copy_only=False).astype(float)
        at = np.minimum(((raw + 0.5) / 2 * BINS).astype(int), BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)]).astype(float)

    bins = _summed(rows.filter("calibrate").select("stats", "label"), histogram)
    if bins is not None and bins[:BINS].sum() >= 20:
        full = np.flatnonzero(bins[:BINS])
        # a pseudo-count of 1 at the overall share keeps lone bins off 0 and 1
        share = m[1] / m[0]
        level = pool((bins[BINS + full] + share * 0.05) / (bins[full] + 0.05), bins[full] + 0.05)
        model.edges, model.levels = (full + 0.5) / BINS * 2 - 0.5, np.clip(level, 0, 1)
    else:
        model.edges, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def scored(rows: DataFrame, model: Model | float, keep: list[str]) -> DataFrame:
    """Columns keep and score; rows has stats."""

    def run(batches):
        for b in batches:
            s = _matrix(b.column(len(keep)))
            score = np.full(len(s), model) if isinstance(model, float) else np.clip(model.score(s), 0, 1)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(score)], names=[*keep, "score"])

    return rows.select(*keep, "stats").mapInArrow(run, rows.select(*keep, F.lit(0.0).alias("score")).schema)


def fold(key: Column, n: int) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def trained(stats: DataFrame, labels: DataFrame, learn: Column, label: str, key: str = "doc_id") -> Model | float:
    """Learns from the labelled rows for which learn holds, a fifth of them for calibration. All of them count: what is gathered is sums."""
    y = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).filter(learn).select(F.col(key).alias("__key"), F.col(label).cast("double").alias("label"))
    rows = stats.join(y, stats[key] == y["__key"]).select("stats", "label", (F.pmod(F.xxhash64("__key"), F.lit(5)) == 0).alias("calibrate"))
    return fit(materialised(rows))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    stats = materialised(with_statistics(docs, ["doc_id"]))
    model = trained(stats, labels, fold(F.col("doc_id"), 4) != 2, "quality")
    out = scored(stats, model, ["doc_id"])
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op10_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark, load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Documents whose score is at least `least`, unchanged.

    The statistics go with the rows, so that texts are neither shuffled nor read a
    second time for the decision: the model is fitted first, and the scan that
    writes the result scores as it goes.
    """
    labels = load(spark, sf_dir, "labels")
    y = materialised(labels.select("doc_id").filter("doc_id IS NOT NULL").distinct())
    model = trained(materialised(with_statistics(having(docs, y, "doc_id"), ["doc_id"])), labels, fold(F.col("doc_id"), 4) != 2, "quality")
    schema = docs.schema
    text_at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            if isinstance(model, float):
                keep = np.full(b.num_rows, model >= least)
            else:
                keep = np.clip(model.score(statistics(b.column(text_at))), 0, 1) >= least
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)
