"""Quality scores by regularised quadratic discriminant analysis.

Every text becomes a short vector of transformed statistics. Each class has a mean and a covariance, shrunk towards
a scaled identity; a score is the logistic of the difference of the two Gaussian log densities, which are Mahalanobis
distances computed with Cholesky factors that are made once per model.

The sums that the model needs (counts, sums, sums of products per class) are taken over all labelled rows, by Spark.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.session import materialize

#: Share of the scaled identity in a covariance, and the weight of a class's mean variance that is always added.
SHRINKAGE, FLOOR = 0.1, 1e-4
#: So many words of usual prose are added to every count, so that a few words alone are not strange.
PRIOR_WORDS = 12
#: Log density differences are divided by this before the logistic: statistics of a text are not independent.
TEMPERATURE = 4.0
THRESHOLD = 0.3
FOLDS = 5
FEATURES = ("length", "word_mean", "word_spread", "upper", "marks", "odd", "digits", "repeats", "variety", "top_word", "bare", "stops", "same_lines", "line_length")
_USUAL = frozenset(b".,;:'\"!?-()")
_CLASSES = np.zeros(256, np.uint8)  # 1 upper, 2 lower or beyond ASCII, 3 digit, 4 usual mark, 5 other mark, 6 exclamation
for _b in range(256):
    _c = chr(_b)
    _CLASSES[_b] = 0 if _b in b" \t\n\v\f\r" else 1 if "A" <= _c <= "Z" else 2 if _b > 127 or "a" <= _c <= "z" else 3 if _c.isdigit() and _b < 128 else 6 if _c == "!" else 4 if _b in _USUAL else 5
_LETTER = re.compile(r"[^\W\d_]")


def statistics(text: str | None) -> list[float]:
    """The FEATURES of a whole text, each transformed towards a bell shape. An empty text has all at 0."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(_CLASSES[np.frombuffer(raw, np.uint8)], minlength=7)
    letters, marks = int(kinds[1] + kinds[2]), int(kinds[4] + kinds[5] + kinds[6])
    solid = letters + int(kinds[3]) + marks
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    repeats = sum(map(bytes.__eq__, words[1:], words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    bare = sum(c for w, c in counts.items() if not _has_letter(w))
    stops = sum(c for w, c in counts.items() if w[-1] in b".!?")
    root, m = math.sqrt, PRIOR_WORDS
    return [
        math.log(n + m),
        math.log1p((float(lengths.sum()) + 5 * m) / (n + m)),
        math.log1p(root((float(lengths.var()) * n + 9 * m) / (n + m))),
        root((kinds[1] + 0.25 * m) / (letters + 5 * m)),
        root((marks + 0.25 * m) / (solid + 5.25 * m)),
        root((kinds[5] + kinds[6]) / (solid + 5.25 * m)),
        root(kinds[3] / (solid + 5.25 * m)),
        root(repeats / (n + m)),
        math.log(len(counts) + m) / math.log(n + m),
        root(max(counts.values()) / (n + m)),
        root(bare / (n + m)),
        root((stops + m / 8) / (n + m)),
        root(1 - (len(set(lines)) + 1) / (len(lines) + 1)),
        math.log(n / len(lines) + m),
    ]


def _has_letter(word: bytes) -> bool:
    return word.isalpha() or _LETTER.search(word.decode("utf-8", "replace")) is not None


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f0, f1, ...): statistics of every whole text."""
    names = [f"f{i}" for i in range(len(FEATURES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([statistics(t.as_py()) for t in batch.column(1)], np.float64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, i]) for i in range(len(names)))], names=["doc_id", *names])

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names))


@dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors and log terms of the classes 0 and 1; constant score where a class is missing."""

    means: tuple[np.ndarray, ...]
    factors: tuple[np.ndarray, ...]
    logs: tuple[float, ...]
    scale: np.ndarray
    constant: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = x / self.scale
        density = [log - 0.5 * (((z - mean) @ factor.T) ** 2).sum(axis=1) for mean, factor, log in zip(self.means, self.factors, self.logs, strict=True)]
        return 1.0 / (1.0 + np.exp(np.clip((density[0] - density[1]) / TEMPERATURE, -700, 700)))


def fit(labelled: DataFrame, label_col: str = "label") -> Model:
    """The model of rows with f0, f1, ... and a label of 0 or 1. Two rows of sums reach the driver.

    With no labelled rows every score is 0.5; with one class only, it is that class.
    """
    d = len(FEATURES)
    sums = [F.sum(f"f{i}").alias(f"s{i}") for i in range(d)] + [F.sum(F.col(f"f{i}") * F.col(f"f{j}")).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    found = {int(r[label_col]): r for r in labelled.where(F.col(label_col).isin(0, 1)).groupBy(label_col).agg(F.count("*").alias("n"), *sums).collect()}
    if len(found) < 2:
        return Model((), (), (), np.ones(d), 0.5 if not found else float(next(iter(found))))
    total = sum(r["n"] for r in found.values())
    everything = np.array([sum(r[f"p{i}_{i}"] for r in found.values()) / total - (sum(r[f"s{i}"] for r in found.values()) / total) ** 2 for i in range(d)])
    scale = np.sqrt(np.maximum(everything, 1e-9))
    means, factors, logs = [], [], []
    for label in (0, 1):
        r = found[label]
        n = r["n"]
        mean = np.array([r[f"s{i}"] for i in range(d)]) / n
        moment = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) / n
        cov = (moment - np.outer(mean, mean)) / np.outer(scale, scale)
        shrink = max(SHRINKAGE, min(1.0, d / n))
        cov = (1 - shrink) * cov + (shrink * np.trace(cov) / d + FLOOR) * np.eye(d)
        lower = np.linalg.cholesky(cov)
        means.append(mean / scale)
        factors.append(np.linalg.inv(lower))
        logs.append(float(math.log(n / total) - np.log(np.diag(lower)).sum()))
    return Model(tuple(means), tuple(factors), tuple(logs), scale)


def is_held_out(id_col, folds: int):
    """Whether crc32 of the id as text leaves 0; ids that are null are held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(True))


def labels_of(labels: DataFrame) -> DataFrame:
    """(doc_id, label) where quality is marked; ids once per mark."""
    return labels.select("doc_id", F.col("quality").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)").distinct()


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``; learned from the labels of rows not held out.

    Empty and null texts are scored as a text whose statistics are all 0; equal texts score alike; a null id is held out
    and never labelled; labels without a document, or null, are ignored; an empty table gives none.
    """
    known = materialize(with_statistics(docs, id_col, text_col).withColumn("held_out", is_held_out(F.col("doc_id"), folds)), "quality-statistics")
    model = fit(known.where(~F.col("held_out")).join(labels_of(labels), "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f"f{i}").to_numpy(zero_copy_only=False) for i in range(len(FEATURES))])
            score = model.scores(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    return known.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is predicted 1."""
    train = with_statistics(docs.select("doc_id", "text").where(~is_held_out(F.col("doc_id"), folds)))
    model = fit(train.join(labels_of(labels), "doc_id"))

    @F.pandas_udf("double")
    def scores(texts):
        import pandas as pd

        return pd.Series(model.scores(np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(FEATURES))))

    return docs.where(scores("text") >= threshold)


def op10(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_documents(docs.select("doc_id", "text"), labels)
