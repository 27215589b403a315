"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

A text becomes a vector of log-odds of smoothed shares (upper case, digits, symbols, marks, line feeds, distinct words)
and a log mean word length. Per class, counts, sums and sums of products are aggregated over all labelled training rows
(a few numbers, however many rows), the driver shrinks each class covariance towards a multiple of the identity and
keeps its Cholesky factor. A score is the logistic of the difference of the two Mahalanobis log densities with priors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._common import batches, small_batches, stored

#: Shares are smoothed by as many characters (or words) of typical text, so short texts lie near the centre.
PSEUDO = 120
#: (name, share in typical text): fixed values of the smoothing.
SHARES = (("upper", 0.02), ("digit", 0.003), ("symbol", 0.002), ("exclamation", 0.001), ("pipe", 0.001), ("newline", 0.004), ("comma", 0.01), ("period", 0.01), ("distinct", 0.7))
WORD_LENGTH = 6.0
N_FEATURES = len(SHARES) + 1
#: Shrinkage of a class covariance towards its mean variance.
SHRINKAGE = 0.1


def features(text: bytes) -> list[float]:
    """The vector of one UTF-8 text; an empty text gives that of typical text."""
    n = len(text)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=128)
    count = lambda *spans: int(sum(seen[a:b].sum() for a, b in spans))
    bang, comma, period, pipe = int(seen[33]), int(seen[44]), int(seen[46]), int(seen[124])
    symbols = count((33, 48), (58, 65), (91, 97), (123, 127)) - bang - comma - period - pipe
    words = text.split()
    shares = ((count((65, 91)), n), (count((48, 58)), n), (symbols, n), (bang, n), (pipe, n), (int(seen[10]), n), (comma, n), (period, n), (len(set(words)), len(words)))
    odds = [math.log((a + PSEUDO * p) / (m - a + PSEUDO * (1 - p))) for (a, m), (_, p) in zip(shares, SHARES)]
    return [*odds, math.log((n + PSEUDO * WORD_LENGTH) / (len(words) + PSEUDO))]


def _text(docs: DataFrame, text_col: str):
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def feature_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and the array x of features: one row per input row."""
    kind = docs.schema[id_col].dataType
    schema = pa.schema([(id_col, to_arrow_type(kind)), ("x", pa.list_(pa.float64()))])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches(((key, features(text)) for b in stream for key, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist())), schema, lambda r: 128)

    return small_batches(docs).select(F.col(id_col), _text(docs, text_col).alias("text")).mapInArrow(run, f"{id_col} {kind.simpleString()}, x array<double>")


def held_out(id_col: str = "doc_id", folds: int = 5):
    """True where crc32 of the id as text is divisible by folds: these rows' labels are never learnt."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


@dataclass
class Discriminant:
    """Scale of the features and, per class, mean, Cholesky factor and log prior; a class never seen is None."""

    centre: np.ndarray
    scale: np.ndarray
    classes: list[tuple[np.ndarray, np.ndarray, float] | None]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row; 0.5 without labels, 0 or 1 if only one class was seen."""
        bad, good = self.classes
        if bad is None or good is None:
            return np.full(len(x), 0.5 if bad is good else float(bad is None))
        z = (x - self.centre) / self.scale

        def density(mean, factor, prior):
            distance = np.square(np.linalg.solve(factor, (z - mean).T)).sum(0)
            return prior - 0.5 * distance - np.log(np.diag(factor)).sum()

        return 1 / (1 + np.exp(np.clip(density(*bad) - density(*good), -700, 700)))


def fit(labelled: DataFrame, shrinkage: float = SHRINKAGE) -> Discriminant:
    """The discriminant of rows (x, y) with y 0 or 1. Only sums reach the driver: 2 rows of 66 numbers."""
    d = N_FEATURES
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    at = lambda i: F.get("x", F.lit(i))
    sums = labelled.groupBy("y").agg(F.count("*").alias("n"), *[F.sum(at(i)).alias(f"s{i}") for i in range(d)], *[F.sum(at(i) * at(j)).alias(f"p{i}_{j}") for i, j in pairs]).collect()
    stats = {}
    for r in sums:
        s = np.array([r[f"s{i}"] for i in range(d)])
        p = np.zeros((d, d))
        for i, j in pairs:
            p[i, j] = p[j, i] = r[f"p{i}_{j}"]
        stats[int(r["y"])] = (r["n"], s, p)
    n = sum(x[0] for x in stats.values())
    if not n:
        return Discriminant(np.zeros(d), np.ones(d), [None, None])
    centre = sum(x[1] for x in stats.values()) / n
    spread = np.diag(sum(x[2] for x in stats.values())) / n - centre**2
    scale = np.sqrt(np.maximum(spread, 1e-12))
    classes: list = [None, None]
    for y, (k, s, p) in stats.items():
        mean = (s / k - centre) / scale
        cov = (p / k - np.outer(s, s) / k**2) / np.outer(scale, scale)
        cov = (1 - shrinkage) * cov + shrinkage * max(np.trace(cov) / d, 1e-6) * np.eye(d)
        classes[y] = (mean, np.linalg.cholesky(cov + 1e-9 * np.eye(d)), math.log(k / n))
    return Discriminant(centre, scale, classes)


def train(feats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant:
    """Fit on all labelled rows of feats that aren't held out; labels other than 0 and 1 are left out, repeats count once."""
    given = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1)).distinct()
    rows = feats.where(~held_out(id_col)).join(given, F.col(id_col) == F.col("label_id"))
    return fit(rows.select("x", "y"))


def score_rows(feats: DataFrame, model: Discriminant, threshold: float = 0.3, id_col: str = "doc_id") -> DataFrame:
    """id_col, held_out, score, predicted (1 if score >= threshold): one row per row of feats."""
    kind = feats.schema[id_col].dataType

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            if b.num_rows:
                x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, N_FEATURES)
                score = model.score(x)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    return feats.select(id_col, held_out(id_col).alias("held_out"), "x").mapInArrow(run, f"{id_col} {kind.simpleString()}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score, predicted for every row of docs, by a model of the labels that aren't held out.

    Inputs of a score are the text's features alone. Null and empty texts are scored as typical text; null ids are
    scored and never learnt from; repeated rows are scored (and, if labelled, learnt) each; an empty table gives no
    rows. Without labels every score is 0.5; with one class only, that class.
    """
    feats = stored(feature_rows(docs, id_col, text_col), "quality-features")
    return score_rows(feats, train(feats, labels, id_col), threshold, id_col)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that classify() would predict 1, with all their columns; texts aren't shuffled."""
    given = labels.select(F.col(id_col)).distinct()
    labelled = feature_rows(docs, id_col, text_col)
    model = train(stored(labelled.join(given, id_col, "left_semi"), "quality-features"), labels, id_col)
    at = docs.columns.index(text_col)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            if b.num_rows:
                x = np.array([features(t or b"") for t in b.column(at).cast(pa.binary()).to_pylist()])
                yield b.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
