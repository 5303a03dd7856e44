"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

A text becomes a vector of statistics (lengths, character classes, repetition). Random Fourier features
turn the Gaussian kernel over them into a dot product. Each partition of the training rows sums its part
of the normal equations, the driver adds the parts (a fixed number of fixed-size matrices) and solves
for ridge scores; pool-adjacent-violators on rows the fit has not seen turns scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.exprs import TEXTS, per_text, small_batches
from cellweave.plans.lineage import cut

#: Most labelled rows that are fitted, chosen by hash of the id; the fit's cost does not grow beyond it.
MAX_TRAINING_ROWS = 20_000
FEATURES = 384
PARTS = 12
THRESHOLD = 0.7

_KIND = np.full(256, 6)
_KIND[ord("a") : ord("z") + 1] = 0
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[[9, 11, 12, 13, 32]] = 3
_KIND[10] = 4
_KIND[[ord(c) for c in ".,;:'\"-?()"]] = 5
_KIND[ord("!")] = 7
_KIND[ord("|")] = 8
_KIND[128:192] = 9  # continuation bytes
_KIND[192:] = 10
STATISTICS = 27


def statistics(text: bytes | None) -> np.ndarray:
    """The statistics of a whole UTF-8 text; a null text is an empty one."""
    text = text or b""
    out = np.zeros(STATISTICS)
    n = len(text)
    kinds = np.bincount(_KIND, weights=np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=11)
    out[:11] = np.sqrt(kinds / max(n, 1))
    words = text.split()
    w = len(words)
    lines = text.split(b"\n")
    out[11] = np.log1p(n) / 4
    out[12] = np.log1p(w) / 4
    out[13] = np.log1p(len(lines)) / 3
    out[14] = len(set(lines)) / len(lines)
    if w:
        sizes = np.fromiter(map(len, words), np.int32, w)
        distinct = len(set(words))
        out[15], out[16] = sizes.mean() / 8, sizes.std() / 8
        out[17] = np.sqrt(sizes.max()) / 8
        out[18] = distinct / w
        out[19] = np.log(distinct + 1) / np.log(w + 1)
        out[20] = (sizes == 1).mean()
        out[21] = sum(map(bytes.__eq__, words, words[1:])) / w
        pairs = len(set(zip(words, words[1:], strict=False)))
        out[22] = pairs / max(w - 1, 1)
        out[23] = sum(x.isupper() for x in words) / w
        out[24] = sum(x.isalpha() or x.rstrip(b".,;:?").isalpha() for x in words) / w
        out[25] = sum(x[-1] in b"#$%&*@!|<>=+~^" for x in words) / w
        out[26] = np.log1p(w / len(lines)) / 4
    return out


@dataclass
class QualityModel:
    """What scoring needs: a few hundred kB, whatever the corpus. ``beta`` None: only the prior is known."""

    prior: float
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    phase: np.ndarray | None = None
    beta: np.ndarray | None = None
    steps: np.ndarray | None = None
    levels: np.ndarray | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.centre) / self.scale, -6, 6)
        z = np.sqrt(2 / len(self.phase)) * np.cos(x @ self.weights + self.phase)
        return np.hstack([z, np.ones((len(z), 1))])

    def ridge(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.beta

    def score(self, stats: np.ndarray) -> np.ndarray:
        """0 to 1. A small share of the uncalibrated score keeps the order within a calibrated step."""
        if self.beta is None:
            return np.full(len(stats), self.prior)
        # in blocks, so that the features of a batch take little memory
        raw = np.concatenate([self.ridge(stats[i : i + 512]) for i in range(0, len(stats), 512)] or [np.zeros(0)])
        calibrated = np.interp(raw, self.steps, self.levels)
        return np.clip(0.99 * calibrated + 0.01 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (block centres, block means), increasing; equal scores are one block."""
    at, inverse = np.unique(score, return_inverse=True)
    count = np.bincount(inverse).astype(float)
    blocks: list[list[float]] = []  # weight, mean, weighted score
    for n, y, s in zip(count, np.bincount(inverse, weights=label) / count, at, strict=True):
        blocks.append([n, y, s])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            b, a = blocks.pop(), blocks.pop()
            total = a[0] + b[0]
            blocks.append([total, (a[0] * a[1] + b[0] * b[1]) / total, (a[0] * a[2] + b[0] * b[2]) / total])
    return np.array([b[2] for b in blocks]), np.array([b[1] for b in blocks])


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def training_ids(labels: DataFrame, target: str, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """doc_id, y, fold of at most ``max_rows`` labelled documents outside the held-out fold (2).

    Repeated labels of a document are averaged; null ids and labels are left out.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1)).groupBy("doc_id").agg(F.avg(target).alias("y"))
    return usable.withColumn("fold", fold_of(F.col("doc_id"))).filter("fold <> 2").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, ridge: float = 1e-3, seed: int = 7) -> QualityModel:
    """Fit on labelled documents of folds 0 and 1, calibrate on fold 3; fold 2 is never seen.

    With no usable labels, or labels of one kind, the score is a constant: (ones + 1) / (rows + 1).
    """
    # bounded by max_rows: 24 bytes a row
    wanted = F.broadcast(training_ids(labels, "quality", max_rows))
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(wanted, "doc_id").select("text", "y", "fold")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = [statistics(t).tolist() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(stats, pa.list_(pa.float64())), b.column("y"), b.column("fold").cast(pa.int64())], ["stats", "y", "fold"])

    with small_batches(docs.sparkSession):
        train = cut(rows.mapInArrow(measured, "stats array<double>, y double, fold long").repartition(PARTS))

    def summed(of, size: int) -> np.ndarray:
        """The sum over partitions of ``of``(stats, y): one row of ``size`` numbers from each."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for b in batches:
                if b.num_rows:
                    total += of(np.array(b.column("stats").to_pylist()), b.column("y").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["part"])

        parts = train.filter("fold < 2").mapInArrow(run, "part binary").collect()  # PARTS rows
        return sum((np.frombuffer(p.part) for p in parts), np.zeros(size))

    s = STATISTICS
    n, ones, *sums = summed(lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(0), (x * x).sum(0)]), 2 + 2 * s)
    every = train.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    prior = float((every[1] + 1) / (every[0] + 1))
    if n < 2 or ones <= 0 or ones >= n:
        return QualityModel(prior)
    rng = np.random.default_rng(seed)
    mean = np.array(sums[:s]) / n
    deviation = np.sqrt(np.maximum(np.array(sums[s:]) / n - mean**2, 0))
    model = QualityModel(prior, mean, np.maximum(deviation, 1e-3), rng.normal(0, 0.6 / np.sqrt(s), (s, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES))
    d = FEATURES + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    total = summed(normal, d * d + d)
    penalty = ridge * n / FEATURES * np.eye(d)
    penalty[-1, -1] = 0
    model.beta = np.linalg.solve(total[: d * d].reshape(d, d) + penalty, total[d * d :])
    held = train.filter("fold = 3").select("stats", "y").toArrow()  # bounded by max_rows
    if held.num_rows < 2:
        held = train.select("stats", "y").toArrow()
    model.steps, model.levels = isotonic(model.ridge(np.array(held["stats"].to_pylist())), held["y"].to_numpy())
    return model


def _scored(model: QualityModel, texts: list[bytes | None]) -> np.ndarray:
    return model.score(np.array([statistics(t) for t in texts]).reshape(-1, STATISTICS))


def score_documents(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null texts count as empty; repeated rows are scored alike; a null id is not held out; an empty table
    gives an empty result. Only the id and the text of ``docs`` are read.
    """
    model = fit(docs, labels, max_rows)
    scored = per_text(docs, "doc_id", "text", "double", lambda texts: _scored(model, texts))
    held_out = F.coalesce(fold_of(F.col("doc_id")) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("value").alias("score"), (F.col("value") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their columns.

    Null texts count as empty; repeated rows stay or go together, whatever their ids, null ones too; an empty table stays
    empty. Other columns may be null and are passed through. A worker copies and sends back ``TEXTS`` rows at a time, however
    many the session's batches have.
    """
    model = fit(docs, labels, max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(at, TEXTS) for x in batches for at in range(0, x.num_rows, TEXTS)):
            score = _scored(model, b.column("text").cast(pa.binary()).to_pylist())
            yield b.filter(pa.array(score >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
