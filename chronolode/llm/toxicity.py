"""Toxicity scores of texts restored from leetspeak, spacing and repetition through a noisy channel.

A character trigram model is counted over all documents. A token that looks disguised (a figure or sign before
a letter, a letter twice or more in a row, letters standing apart) becomes a lattice: each sign may stand for the letters it
resembles or for none, a run of one letter for one or two. Viterbi decoding finds the reading with the highest channel
and language-model probability. The restored text is scored by logistic regression over its words and their
openings, chosen from labelled training rows by log-likelihood ratio.

Labels are learned from at most ``MAX_TOXIC`` and ``MAX_CLEAN`` training rows, the first of each label in hash order;
the intercept is then set to the odds of all training rows, and the character counts cover every document.

Defined results: a null text is an empty one and scores as the base rate does. A null label is no label; where a doc_id has
several, the largest holds, and where it has several texts the least one is learned from. Without training rows of both labels every score is the share of label 1 (0 without any).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolode.llm.tables import read
from chronolode.session import cut_lineage

MAX_TOXIC, MAX_CLEAN, MAX_FEATURES, THRESHOLD = 4000, 8000, 2000, 0.3
CODES = 28  # 0: what is no letter; 1 to 26: a to z; 27: bytes of other letters
RESEMBLES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e"}
READ_AS, DROPPED_SIGN, DROPPED_GAP, ONE_OF_TWO, TWO_OF_MANY = -1.0, -9.0, -0.2, -3.0, -0.7
READINGS = 3  # decodings of a token that count as restored text
SIGNS = re.escape("".join(RESEMBLES))
DISGUISED = re.compile(rf"[{SIGNS}*.\-_]+[^\W\d_]|([^\W\d_])\1\1|[^\W\d_][{SIGNS}]+$")
DOUBLED = re.compile(r"([^\W\d_])\1")
APART = re.compile(rf"(?<![^\W_])(?:[^\W_]|[{SIGNS}])(?:[ .\-_*]{{1,3}}(?:[^\W_]|[{SIGNS}])(?![^\W_])){{2,}}")
GAPS = re.compile(r"[ .\-_*]+")
BRACKETS = ".,;:?\"')[]{}<>"
EDGES = ".,;:!?\"'()[]{}<>«»¿¡…*#%&"

_TABLE = bytes(ord(c) - 96 if (c := chr(b).lower()) in "abcdefghijklmnopqrstuvwxyz" else 27 if b >= 128 else 0 for b in range(256))


def character_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts of the character codes of all texts; one row a trigram reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CODES**3, np.int64)
        for batch in batches:
            for at in range(0, len(batch), 512):
                texts = [t for t in batch.column(0).slice(at, 512).to_pylist() if t]
                codes = np.frombuffer(b"\0\0" + b"\0\0".join(t.translate(_TABLE) for t in texts) + b"\0\0", np.uint8).astype(np.int32)
                total += np.bincount(codes[:-2] * CODES**2 + codes[1:-1] * CODES + codes[2:], minlength=CODES**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["gram", "n"])

    parts = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "gram int, n long")
    out = np.zeros(CODES**3)
    for r in parts.groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[r["gram"]] = r["n"]
    return out.reshape(CODES, CODES, CODES)


def language_model(counts: np.ndarray, weight: float = 5.0) -> np.ndarray:
    """log P(c | a, b), trigrams smoothed by bigrams and these by single characters."""
    one = counts.sum(axis=(0, 1)) + 1.0
    one /= one.sum()
    two = counts.sum(axis=0) + weight * one
    two /= two.sum(axis=1, keepdims=True)
    three = counts + weight * two[None]
    return np.log(three / three.sum(axis=2, keepdims=True))


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters, its readings with their channel log probabilities."""
    out = []
    at = 0
    while at < len(token):
        c, end = token[at], at
        while end < len(token) and token[end] == c:
            end += 1
        n = end - at
        if c.isalpha():
            out.append([(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, ONE_OF_TWO)] if n == 2 else [(c, 0.0), (c * 2, TWO_OF_MANY)])
        elif c in RESEMBLES:
            out.append([(r * k, READ_AS) for r in RESEMBLES[c] for k in range(1, min(n, 2) + 1)] + [("", DROPPED_SIGN)])
        else:
            out.append([("", DROPPED_GAP)])
        at = end
    return out


def decode(token: str, model: list, readings: int = 1) -> list[str]:
    """The most probable readings of a lower-case token, by Viterbi over pairs of preceding characters.

    Each pair of last characters keeps its best path; the best of these, after the closing boundary, are returned.
    """
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # with its letters as a chain, last first
    for options in lattice(token):
        step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in best.items():
            for letters, channel in options:
                x, y, s = a, b, score + channel
                for c in letters:
                    z = ord(c) - 96 if "a" <= c <= "z" else 27
                    s += model[x][y][z]
                    x, y = y, z
                if (x, y) not in step or s > step[x, y][0]:
                    step[x, y] = (s, (path, letters))
        best = step

    def spelt(path: tuple | None) -> str:
        out = []
        while path:
            path, letters = path
            out.append(letters)
        return "".join(reversed(out))

    ends = sorted(((s + model[a][b][0], spelt(t)) for (a, b), (s, t) in best.items()), reverse=True)
    return [t for _, t in ends[:readings]]


def restored(text: str, model: list, memo: dict[str, str], readings: int = 1) -> str:
    """The lower-case text with each disguised token replaced by its most probable readings, side by side.

    A token with a doubled letter is one if some reading is more probable than the token as it stands.
    """

    def read_token(token: str) -> str:
        if token not in memo:
            bare = token.strip(BRACKETS)
            found = decode(bare, model, readings) if DISGUISED.search(bare) or DOUBLED.search(bare) else [bare]
            memo[token] = token if found[0] == bare else " ".join(found)
        return memo[token]

    joined = APART.sub(lambda m: f" {' '.join(decode(GAPS.sub('', m[0]), model, readings))} ", text)
    return " ".join(map(read_token, joined.split()))


def openings(word: str) -> tuple[str, ...]:
    """The features of a word: itself and its first four to six letters."""
    return (word + "$", *(word[:k] for k in (4, 5, 6) if len(word) >= k))


class Restorer:
    """The set of words of a text once it is restored; keeps what it has decoded, up to a bound."""

    def __init__(self, model: np.ndarray) -> None:
        self.model, self.memo = model.tolist(), {}

    def words(self, text: str) -> set[str]:
        if len(self.memo) > 300_000:
            self.memo = {}
        text = text.lower()
        plain = set(text.split())  # a token as it stands is one of its readings: a sign at its end may be just that
        return plain.union(restored(text, self.model, self.memo, READINGS).split())


def chosen_features(rows: DataFrame, model: np.ndarray) -> list[str]:
    """The features most tied to label 1 among ``rows`` (text, y), by log-likelihood ratio."""
    n = {int(r["y"]): r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, counts = Restorer(model), ({}, {})
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mine = counts[y]
                for f in {f for w in restorer.words(t or "") if (b := w.strip(EDGES)) for f in openings(b)}:
                    mine[f] = mine.get(f, 0) + 1
        names = sorted(counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][f] for f in names], pa.int64()), pa.array([0] * len(names), pa.int64())], names=["f", "a", "b"])
        names = sorted(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([0] * len(names), pa.int64()), pa.array([counts[0][f] for f in names], pa.int64())], names=["f", "a", "b"])

    sums = rows.select("text", "y").mapInArrow(run, "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a >= 3")
    ones, zeros = float(n[1]), float(n[0])
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    both = (a + b) / (ones + zeros)
    part = lambda k, m, p: F.when(k > 0, k * F.log(k / (m * p))).otherwise(0.0)
    ratio = part(a, ones, both) + part(b, zeros, both) + part(ones - a, ones, 1 - both) + part(zeros - b, zeros, 1 - both)
    top = sums.where(a / ones > 2 * b / zeros).withColumn("g", ratio).where("g > 3").orderBy(F.desc("g"), "f").limit(MAX_FEATURES)
    return [r["f"] for r in top.collect()]


def fit_logistic(rows: list[list[int]], y: np.ndarray, width: int, penalty: float = 0.005, steps: int = 600) -> np.ndarray:
    """Weights and, last, the intercept of a ridge logistic regression on sets of features, by accelerated descent."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.fromiter((f for r in rows for f in r), np.int64, len(at))
    w = np.zeros(width + 1)
    w[-1] = math.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3))
    look, square = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.bincount(at, w[flat], len(rows)) + w[-1]
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.r_[np.bincount(flat, e[at], width), e.sum()] / len(rows)
        g[:-1] += penalty * w[:-1] / len(rows) * 10
        look = 0.9 * look + 0.1 * g
        square = 0.999 * square + 0.001 * g * g
        w -= 0.1 * (look / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return w


def shift(toxic: int, clean: int) -> float:
    """What the intercept lacks for having been fitted on the first rows of each label: the log of the ratio of their shares."""
    return math.log(max(toxic / MAX_TOXIC, 1.0) / max(clean / MAX_CLEAN, 1.0))


class Scorer:
    """Scores texts with the fitted features; words already looked at are kept, up to a bound."""

    def __init__(self, model: np.ndarray, features: list[str], weights: np.ndarray) -> None:
        self.restorer, self.index, self.weights = Restorer(model), {f: i for i, f in enumerate(features)}, weights
        self.seen: set[str] = set()
        self.telling: dict[str, tuple[int, ...]] = {}

    def features(self, text: str) -> list[int]:
        words = self.restorer.words(text)
        if len(self.seen) > 1_000_000:
            self.seen, self.telling = set(), {}
        for w in words.difference(self.seen):
            self.seen.add(w)
            found = tuple(i for f in openings(w.strip(EDGES)) if (i := self.index.get(f)) is not None)
            if found:
                self.telling[w] = found
        return sorted({i for w in words.intersection(self.telling) for i in self.telling[w]})

    def score(self, text: str) -> float:
        z = float(self.weights[-1] + self.weights[self.features(text)].sum())
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    model = language_model(character_counts(docs))
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    held = F.coalesce(remainder == 2, F.lit(False))
    labels = read(spark, sf_dir, "labels", "doc_id", "toxic").where("doc_id is not null and toxic is not null").where(~held)
    labels = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
    first = lambda y, n: labels.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    # at most MAX_TOXIC + MAX_CLEAN rows of two numbers: small enough to send whole; of an id's texts the least is learned from
    taught = docs.join(F.broadcast(first(1, MAX_TOXIC).union(first(0, MAX_CLEAN))), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    taught = cut_lineage(taught.select("text", "y"))
    n = {int(r["y"]): r["n"] for r in taught.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        features, weights = [], np.array([700.0 if 1 in n else -700.0])
    else:
        features = chosen_features(taught, model)

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(model, features, np.zeros(len(features) + 1))
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([scorer.features(t or "") for t in batch.column(0).to_pylist()], pa.list_(pa.int32())), batch.column(1)], names=["f", "y"])

        sets = taught.mapInArrow(mark, "f array<int>, y int").collect()
        weights = fit_logistic([r["f"] for r in sets], np.array([float(r["y"]) for r in sets]), len(features))
        total = {int(r["y"]): r["n"] for r in labels.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        weights[-1] += shift(total[1], total[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model, features, weights)
        for batch in batches:
            scores = [scorer.score(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
