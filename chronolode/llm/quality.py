"""Quality by regularised quadratic discriminant analysis of document statistics.

Each document gives a fixed set of statistics, transformed towards symmetry (logarithms of sizes, square roots of
shares). A text of n words is drawn towards the mean of the training rows with the weight of ``PRIOR_WORDS`` words, for the
statistics of a few words say little. Class means and covariances come from sums over all labelled training rows, gathered by one
aggregation and never as rows. A class covariance is shrunk towards the pooled one and towards its own diagonal; its
Cholesky factor is inverted once and sent with the model. A document's score is the logistic of the difference
of the two Mahalanobis log densities and log priors.

Defined results: a null text is an empty one, an ordinary point with size zero. A label that is null is no label; where a
doc_id has several, their rounded mean holds. Without training rows of both classes the score is the share of label 1
(0.5 without any).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolode.llm.tables import read
from chronolode.session import cut_lineage

POOLED, DIAGONAL, RIDGE, PRIOR_WORDS = 0.3, 0.1, 1e-4, 20
SENT_LABELS = 1 << 20  # this many labels, 16 MB of numbers, are sent to meet the documents; more meet their statistics
STATISTICS = (
    "log_words", "log_word_length", "word_length_spread", "log_line_words", "letters", "digits", "symbols", "stops", "upper",
    "distinct_words", "repeated_next", "top_word", "repeated_lines", "symbol_ends", "entropy", "short_words",
)

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LETTER = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_STOP = np.isin(_BYTES, np.frombuffer(b".,", np.uint8))
_SYMBOL = ~(_LETTER | _DIGIT | _SPACE | _STOP)
_ENDS = frozenset(bytes([b]) for b in np.flatnonzero(_SYMBOL))


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of a whole text, in the order of ``STATISTICS``."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    solid = max(1, int(bytes_[~_SPACE].sum()))
    share = bytes_ / bytes_.sum()
    share = share[share > 0]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split(b"\n") if x.strip()]
    root = math.sqrt
    return [
        math.log1p(n),
        math.log(lengths.mean()),
        root(lengths.std()),
        math.log1p(n / len(lines)),
        root(bytes_[_LETTER].sum() / solid),
        root(bytes_[_DIGIT].sum() / solid),
        root(bytes_[_SYMBOL].sum() / solid),
        root(bytes_[_STOP].sum() / solid),
        root(bytes_[_UPPER].sum() / solid),
        math.log1p(len(counts)) / math.log1p(n),
        root(sum(map(bytes.__eq__, words, words[1:])) / n),
        root(max(counts.values()) / n),
        root(1 - len(set(lines)) / len(lines)),
        root(sum(c for w, c in counts.items() if w[-1:] in _ENDS) / n),
        float(-(share * np.log(share)).sum()),
        root(int((lengths <= 2).sum()) / n),
    ]


class Model(NamedTuple):
    """Class means, inverse Cholesky factors of the shrunken covariances, and log priors less half log determinants."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray
    center: np.ndarray  # what short texts are drawn towards
    base: float | None = None  # the score of everything, where two classes can't be told apart

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.base is not None:
            return np.full(len(x), self.base)
        x = drawn(x, self.center)
        log = [o - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, o in zip(self.means, self.factors, self.offsets)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def drawn(x: np.ndarray, center: np.ndarray) -> np.ndarray:
    """Statistics drawn towards ``center`` by ``PRIOR_WORDS``; the first statistic is log(1 + words)."""
    words = np.expm1(x[:, :1])
    weight = words / (words + PRIOR_WORDS)
    return center + weight * (x - center)


def fit(counts: list[float], sums: list[np.ndarray], products: list[np.ndarray], center: np.ndarray) -> Model:
    """A model from each class's row count, sum of drawn statistics and sum of their outer products."""
    d = len(STATISTICS)
    total = sum(counts)
    if min(counts) < 2:
        return Model(np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), center, counts[1] / total if total else 0.5)
    means = [s / n for s, n in zip(sums, counts)]
    own = [p / n - np.outer(m, m) for p, n, m in zip(products, counts, means)]
    pooled = sum(c * n for c, n in zip(own, counts)) / total
    factors, offsets = [], []
    for c, n in zip(own, counts):
        s = (1 - POOLED) * c + POOLED * pooled
        s = (1 - DIAGONAL) * s + DIAGONAL * np.diag(np.diag(s)) + RIDGE * np.eye(d)
        low = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(low))
        offsets.append(math.log(n / total) - np.log(np.diag(low)).sum())
    return Model(np.array(means), np.array(factors), np.array(offsets), center)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``x``, its statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py() or b"") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, x array<double>")


def training(doc_id: Column) -> Column:
    """Rows that labels may be learned from: crc32 of the id as text, mod 3, is not 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def training_labels(labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> DataFrame:
    """doc_id, y: a row a labelled training document."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("y")).where(F.col("y").isNotNull() & training(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.round(F.avg("y")).cast("int").alias("y"))


def fit_labelled(rows: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> Model:
    """The model of all labelled training rows of ``rows`` (doc_id, x)."""
    return fit_taught(rows.join(training_labels(labels, label_col, id_col), "doc_id"))


def fit_taught(rows: DataFrame) -> Model:
    """The model of ``rows`` (y, x): sums by class, combined on the map side."""
    d = len(STATISTICS)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    taught = cut_lineage(rows.select("y", "x"))
    means = taught.agg(*(F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(d))).first()
    center = np.array([means[i] or 0.0 for i in range(d)])
    words = F.expm1(F.col("x")[0])
    weight = words / (words + PRIOR_WORDS)
    near = taught.select("y", weight.alias("w"), "x").select("y", *(((F.col("x")[i] - float(c)) * F.col("w") + float(c)).alias(f"x{i}") for i, c in enumerate(center)))
    sums = near.groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(d)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in pairs)
    )
    found = {int(r["y"]): r for r in sums.collect()}  # at most a row a class
    counts, first, second = [0.0, 0.0], [np.zeros(d), np.zeros(d)], [np.zeros((d, d)), np.zeros((d, d))]
    for y in (0, 1):
        if y in found:
            counts[y] = float(found[y]["n"])
            first[y] = np.array([found[y][f"s{i}"] for i in range(d)])
            for i, j in pairs:
                second[y][i, j] = second[y][j, i] = found[y][f"p{i}_{j}"]
    return fit(counts, first, second, center)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut_lineage(document_statistics(read(spark, sf_dir, "documents", "doc_id", "text")))
    model = fit_labelled(rows, read(spark, sf_dir, "labels", "doc_id", "quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(len(batch), len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``threshold``.

    One pass fits the model, over the labelled documents, and one filters; rows stay where they are, so no text is exchanged.
    """
    known = cut_lineage(training_labels(labels, id_col=id_col))
    taught = docs.select(id_col, text_col)
    if known.count() <= SENT_LABELS:
        taught = taught.join(F.broadcast(known.select(F.col("doc_id").alias("_known"))), F.col(id_col).cast("long") == F.col("_known"), "left_semi")
    model = fit_taught(document_statistics(taught, id_col, text_col).join(known, "doc_id"))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics((t.as_py() or "").encode()) for t in batch.column(at)]).reshape(len(batch), len(STATISTICS))
            yield batch.filter(pa.array(model.scores(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
