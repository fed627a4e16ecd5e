"""Language of a text: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of 1 to 3 characters are hashed into a fixed number of features. Document frequencies are counted over all
training documents by Spark; weights are trained by follow-the-regularised-leader with elastic-net penalties (L1 makes
them sparse) on a bounded sample; a temperature fitted on part of the sample calibrates the probabilities.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FEATURES = 1 << 14
#: The bound on labelled rows that the weights are trained on; everything else counts all rows.
SAMPLE = 2000
#: Labelled rows that a language is sampled with at least, as far as it has them.
LEAST_ROWS = 50
EPOCHS = 4
#: Follow-the-regularised-leader: learning rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-4
FOLDS = 3
UNDETERMINED = "und"
#: A stage that filters keeps documents of at least this score.
LEAST_SCORE = 0.4
_LETTER = re.compile(r"[^\W\d_]")
_BLOCK = 1 << 16


def gram_counts(text: str) -> np.ndarray:
    """Counts of the hashed 1- to 3-grams of the lower-cased text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    total = np.zeros(FEATURES, np.int64)
    for i in range(0, len(points), _BLOCK):
        p = points[i : i + _BLOCK + 2].astype(np.uint32)
        n = min(_BLOCK, len(points) - i)
        for width in (1, 2, 3):
            h = np.full(max(0, min(n, len(p) - width + 1)), width, np.uint32)
            for k in range(width):
                h = (h ^ p[k : k + len(h)]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            total += np.bincount(h & np.uint32(FEATURES - 1), minlength=FEATURES)
    return total


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the TF-IDF vector: (1 + ln count) * idf, of length 1."""
    counts = gram_counts(text)
    at = np.flatnonzero(counts)
    value = (1.0 + np.log(counts[at])) * idf[at]
    norm = math.sqrt(float((value * value).sum()))
    return at, value / norm if norm else value


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or text is None or not _LETTER.search(text):
            return UNDETERMINED, 0.0
        at, value = vector(text, self.idf)
        p = _softmax((value @ self.weights[at] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(samples: list[tuple[np.ndarray, np.ndarray, str]], idf: np.ndarray) -> Model:
    """Fit (indices, values, language) samples; every fifth is kept for the temperature."""
    names = tuple(sorted({s[2] for s in samples}))
    k = len(names)
    number = {n: i for i, n in enumerate(names)}
    if k < 2:
        return Model(names, idf, np.zeros((FEATURES, max(1, k))), np.zeros(max(1, k)), 1.0)
    taught = {s[2] for i, s in enumerate(samples) if i % 5}
    held, used = samples[::5], [s for i, s in enumerate(samples) if i % 5 or len(samples) < 25 or s[2] not in taught]
    z, n = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))

    def weights(rows) -> np.ndarray:
        zz = z[rows]
        return np.where(np.abs(zz) <= L1, 0.0, (np.sign(zz) * L1 - zz) / ((BETA + np.sqrt(n[rows])) / ALPHA + L2))

    order = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for i in order.permutation(len(used)):
            at, value, name = used[i]
            rows, x = np.append(at, FEATURES), np.append(value, 1.0)
            w = weights(rows)
            error = _softmax(x @ w)
            error[number[name]] -= 1.0
            g = x[:, None] * error[None, :]
            old = n[rows]
            new = old + g * g
            z[rows] += g - (np.sqrt(new) - np.sqrt(old)) / ALPHA * w
            n[rows] = new
    w = weights(slice(None))
    raw = np.array([value @ w[at] + w[FEATURES] for at, value, _ in held])
    truth = np.array([number[name] for _, _, name in held])

    def loss(log_t: float) -> float:
        p = _softmax(raw / math.exp(log_t))
        return -float(np.log(np.maximum(p[np.arange(len(truth)), truth], 1e-12)).mean())

    low, high = -3.0, 3.0
    for _ in range(60):  # golden section
        a, b = high - (high - low) * 0.618, low + (high - low) * 0.618
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return Model(names, idf, w[:FEATURES], w[FEATURES], math.exp((low + high) / 2))


def is_held_out(id_col, folds: int):
    """Whether crc32 of the id as text leaves 1; ids that are null are held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 1, F.lit(True))


def fit(docs: DataFrame, folds: int = FOLDS, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of the documents not held out that have a text and a language.

    The driver gets FEATURES document frequencies, a count per language, and about ``sample`` sparse vectors chosen by a
    hash of the id. Languages that these would hold fewer than LEAST_ROWS of are filled up, so that every one is learned.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.where(~is_held_out(F.col("id"), folds) & F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                df += gram_counts(text.as_py()) > 0
                rows += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], rows))], names=["feature", "df"])

    df = np.zeros(FEATURES)
    rows = 0
    for feature, n in known.select("text").mapInArrow(frequencies, "feature long, df long").groupBy("feature").agg(F.sum("df")).collect():
        if feature < 0:
            rows = int(n)
        else:
            df[feature] = n
    idf = np.log((1 + rows) / (1 + df)) + 1.0
    place = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.col("id"), F.col("text")), 1)  # rows of one place are alike
    known = known.withColumn("place", place)
    most = (1 << 63) - 1
    limits = []
    for lang, n, first in known.groupBy("lang").agg(F.count("*"), F.min("place")).collect():
        quota = max(sample * n // max(rows, 1), LEAST_ROWS)
        below = max(min(most, most * sample // max(rows, 1)), min(most, most * LEAST_ROWS // n), first)
        limits.append((lang, below, 2 * quota))
    bounds = F.broadcast(docs.sparkSession.createDataFrame(limits, "lang string, below long, most long"))
    ranked = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    chosen = known.join(bounds, "lang").where("place <= below").dropDuplicates(["place", "lang"]).withColumn("rank", ranked).where("rank <= most")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [vector(t.as_py(), idf) for t in batch.column("text")]
            bounds = pa.array(np.cumsum([0, *(len(a) for a, _ in found)]), pa.int32())
            at, value = (pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(x or [np.empty(0)]).astype(t))) for x, t in (([a for a, _ in found], np.int32), ([v for _, v in found], np.float64)))
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("lang"), at, value], names=["place", "lang", "at", "value"])

    got = chosen.select("place", "lang", "text").mapInArrow(vectors, "place long, lang string, at array<int>, value array<double>").toArrow().sort_by([("place", "ascending"), ("lang", "ascending")])
    return train(list(zip(_rows(got["at"]), _rows(got["value"]), got["lang"].to_pylist(), strict=True)), idf)


def _rows(lists: pa.ChunkedArray) -> list[np.ndarray]:
    """The rows of a column of lists, as views of its values."""
    whole = lists.combine_chunks()
    bounds, values = whole.offsets.to_numpy(), whole.values.to_numpy()
    return [values[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def identify(docs: DataFrame, folds: int = FOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row of ``docs``.

    A text that is null or has no letter is ``und`` with score 0, as is every text where nothing can be learned; null
    languages are not learned; a null id is held out; equal texts are predicted alike; an empty table gives none.
    """
    model = fit(docs, folds, id_col=id_col, text_col=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([p[0] for p in found], pa.string()), pa.array([p[1] for p in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), is_held_out(F.col(id_col), folds).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, folds: int = FOLDS, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is determined with at least this score."""
    model = fit(docs, folds)

    @F.pandas_udf("double")
    def scores(texts):
        import pandas as pd

        return pd.Series([model.predict(t)[1] for t in texts], dtype=float)

    return docs.where(scores("text") >= least)


def op9(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
