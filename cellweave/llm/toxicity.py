"""Toxicity: cumulative-link ordinal regression over sparse text features.

A text's features are its different lower-case words and their first four and five letters, by hash. Labels only
say whether a document is toxic, so severity grades are made: 0 for documents labelled clean, 1 to 3 for
toxic ones, thirds by how sure a binary model is that was fitted without them (two halves of the training rows,
each judged by the model of the other). One weight vector serves all thresholds,
P(grade > k) = sigmoid(weights . features - threshold_k), and the severity is the expected grade.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.exprs import TEXTS, per_text
from cellweave.llm.quality import fold_of, training_ids
from cellweave.plans.lineage import cut

#: Most labelled rows that are fitted.
MAX_TRAINING_ROWS = 8_000
#: Features kept: those in enough documents and most telling. A row comes to the driver as two bytes for each
#: kept feature that it has: 64 MB for all rows at most, however long the texts are.
MAX_FEATURES, LEAST_DOCUMENTS = 4_000, 4
#: Numbers that features are hashed to, and the grades.
HASHED, GRADES = 1 << 22, 4
#: Words a worker remembers before it starts anew.
REMEMBERED = 200_000

_WORD = re.compile(r"[^\W\d_]+").findall


def word_features(word: str) -> tuple[int, ...]:
    """The numbers of a word and of its beginnings."""
    names = (word, *(f"{word[:n]}*" for n in (4, 5) if len(word) > n))
    return tuple(zlib.crc32(x.encode("utf-8", "replace")) % HASHED for x in names)


def text_features(text: str) -> np.ndarray:
    """The sorted numbers of a whole text's different features."""
    return np.array(sorted({f for w in set(_WORD(text.lower())) for f in word_features(w)}), np.int32)


@dataclass
class ToxicityModel:
    """Weights by feature and the ordered thresholds; ``thresholds`` None: only the base rate is known."""

    weights: dict[int, float]
    thresholds: np.ndarray | None
    base: float

    def above(self, total: np.ndarray) -> np.ndarray:
        """(rows, 3): the chances that the grade is above 0, 1 and 2."""
        if self.thresholds is None:
            return np.tile([self.base, 0.0, 0.0], (len(total), 1))
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - total[:, None], -50, 50)))


def fit_ordinal(rows: list[np.ndarray], grade: np.ndarray, n_features: int, rounds: int = 250, l2: float = 2e-3, n_grades: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ordered thresholds) by Adam over the cumulative-link log-likelihood of sparse binary rows."""
    indptr = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    index = np.concatenate(rows).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), np.diff(indptr))
    w = np.zeros(n_features)
    raw = np.array([2.0, *np.full(n_grades - 2, 0.0)])  # the first threshold, then logs of the gaps
    over = (grade[:, None] > np.arange(n_grades - 1)[None, :]).astype(float)
    parts = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(raw), np.zeros_like(raw)]
    weight = np.where(grade > 0, 0.5 / max((grade > 0).mean(), 1e-9), 0.5 / max((grade == 0).mean(), 1e-9)) / len(rows)
    for step in range(1, rounds + 1):
        gaps = np.exp(raw[1:])
        theta = raw[0] + np.concatenate([[0], np.cumsum(gaps)])
        total = np.bincount(owner, weights=w[index], minlength=len(rows))
        p = 1 / (1 + np.exp(np.clip(theta[None, :] - total[:, None], -50, 50)))
        slope = (p - over) * weight[:, None]
        grad_w = np.bincount(index, weights=slope.sum(axis=1)[owner], minlength=n_features) + l2 * w / 10
        by_threshold = -slope.sum(axis=0)
        tails = np.cumsum(by_threshold[::-1])[::-1]
        grad_raw = np.concatenate([[tails[0]], tails[1:] * gaps])
        for value, grad, m, v in ((w, grad_w, parts[0], parts[1]), (raw, grad_raw, parts[2], parts[3])):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            value -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w, raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))])


def made_grades(rows: list[np.ndarray], toxic: np.ndarray, half: np.ndarray, n_features: int) -> np.ndarray:
    """0 for clean rows; 1, 2, 3 for the thirds of toxic ones, by the margin that the other half's binary model gives."""
    margin = np.zeros(len(rows))
    for h in (0, 1):
        own, other = np.flatnonzero(half == h), np.flatnonzero(half != h)
        if len(other) and len(np.unique(toxic[other])) == 2:
            w, _ = fit_ordinal([rows[i] for i in other], toxic[other].astype(int), n_features, rounds=100, n_grades=2)
            margin[own] = [w[rows[i]].sum() for i in own]
    cuts = np.quantile(margin[toxic], np.arange(1, GRADES - 1) / (GRADES - 1))
    return np.where(toxic, 1 + np.searchsorted(cuts, margin, side="left"), 0)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> ToxicityModel:
    """Fit on at most ``max_rows`` labelled documents outside the held-out fold, half of each kind.

    With no labels the severity is 0 everywhere; with one kind only, its share of toxic rows. A document that is
    labelled both ways counts as toxic. Null texts are empty ones.
    """
    half = max_rows // 2
    wanted = training_ids(labels.filter("toxic = 1"), "toxic", half).unionByName(training_ids(labels.filter("toxic = 0"), "toxic", half))
    wanted = wanted.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int"))
    # bounded by max_rows: 24 bytes a row
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").select("text", "y", "half")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(at, TEXTS) for x in batches for at in range(0, x.num_rows, TEXTS)):
            features = pa.array([text_features(t or "") for t in b.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([features, b.column("y"), b.column("half")], ["features", "y", "half"])

    train = cut(rows.mapInArrow(hashed, "features array<int>, y double, half int"))
    n, n1 = train.agg(F.count(F.lit(1)), F.count_if(F.col("y") > 0.5)).first()
    n0 = n - n1
    if not n1 or not n0:
        return ToxicityModel({}, None, n1 / n if n else 0.0)
    counts = train.select("y", F.explode("features").alias("feature")).groupBy("feature").agg(F.count_if(F.col("y") > 0.5).alias("toxic"), F.count_if(F.col("y") <= 0.5).alias("clean"))
    p, q = (F.col("toxic") + 0.5) / (n1 + 1), (F.col("clean") + 0.5) / (n0 + 1)
    worth = F.abs(p - q) / F.sqrt((p + q) * 0.5 / min(n1, n0))
    telling = counts.filter(F.col("toxic") + F.col("clean") >= LEAST_DOCUMENTS).withColumn("worth", worth).filter("worth > 3")
    kept = np.array(sorted(r.feature for r in telling.orderBy(F.desc("worth"), "feature").limit(MAX_FEATURES).collect()), np.int32)
    if not len(kept):
        return ToxicityModel({}, None, n1 / n)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.searchsorted(kept, np.intersect1d(x.values.to_numpy(), kept)).astype("<u2").tobytes() for x in b.column("features")]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), b.column("y"), b.column("half")], ["places", "y", "half"])

    table = train.mapInArrow(places, "places binary, y double, half int").toArrow().sort_by([("places", "ascending"), ("y", "ascending"), ("half", "ascending")])
    sparse = [np.frombuffer(x, "<u2").astype(np.int64) for x in table["places"].to_pylist()]
    grade = made_grades(sparse, table["y"].to_numpy() > 0.5, table["half"].to_numpy(), len(kept))
    weights, thresholds = fit_ordinal(sparse, grade, len(kept))
    return ToxicityModel({int(f): float(w) for f, w in zip(kept, weights, strict=True) if abs(w) > 1e-3}, thresholds, 0.0)


class _Scorer:
    """Sums the weights of a text's different features; remembers words that were seen."""

    def __init__(self, weights: dict[int, float]):
        self.weights, self.known = weights, {}

    def word(self, word: str) -> tuple[int, ...]:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[word] = out = tuple(f for f in word_features(word) if f in self.weights)
        return out

    def total(self, text: str) -> float:
        known = self.known
        found: set[int] = set()
        for w in set(_WORD(text.lower())):
            fs = known.get(w)
            if fs is None:
                fs = self.word(w)
            if fs:
                found.update(fs)
        return sum(self.weights[f] for f in sorted(found))


def grade_documents(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, severity (the expected grade, 0 to 3), grade (rounded), toxic (0 or 1) for every row.

    A document is toxic if it is likelier than not that its grade is above 0. Null texts count as empty;
    repeated rows are graded alike; null ids give a row; an empty table gives an empty result. Only the
    id and the text of ``docs`` are read.
    """
    model = fit(docs, labels, max_rows)
    scorer = _Scorer(model.weights)

    def chances(texts: list[bytes | None]) -> list[list[float]]:
        return model.above(np.array([scorer.total((t or b"").decode("utf-8", "replace")) for t in texts], dtype=float)).tolist()

    held_out = F.coalesce(fold_of(F.col("doc_id")) == 2, F.lit(False)).alias("held_out")
    graded = per_text(docs, "doc_id", "text", "array<double>", chances).select("doc_id", held_out, F.col("value").alias("p"))
    severity = F.aggregate("p", F.lit(0.0), lambda acc, x: acc + x)
    return graded.select("doc_id", "held_out", severity.alias("severity"), F.round(severity).cast("int").alias("grade"), (F.get("p", F.lit(0)) >= 0.5).cast("int").alias("toxic"))
