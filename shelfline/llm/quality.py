"""Quality scores by naive Bayes support vectors over n-grams of word shapes.

A word's shape is its run-collapsed character classes (letters by case, digits, other characters as they are), or a
repeat mark if the word equals the one before. Indicators of 1- to 3-grams of shapes are hashed to a fixed width,
scaled by the classes' log-count ratios, and a linear hinge-loss model is fitted to them by dual coordinate descent; a
logistic curve over margins of rows left aside turns its margin into a score."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, chunks, text_of, text_parts
from .fitting import held_out, logistic, probability, training_sample

WIDTH_BITS = 18
#: The fit sees this many labelled rows at most.
MOST_TRAINING = 8000


def shape(word: str) -> str:
    """Runs of upper case, lower case and digits as one A, a or 0, runs of another character as one of it."""
    out, last = [], ""
    for c in word:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if kind != last:
            out.append(kind)
            last = kind
    return "".join(out)


def _codes(words: list[str]):
    for w in words:
        yield (zlib.crc32(w.encode()) << 32) | zlib.crc32(shape(w).encode())


_recent = Recent(_codes)
_REPEAT = np.uint64(zlib.crc32(b"repeat of the word before"))


def features(codes: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Ascending hashed n-grams that occur in a document; flags is an all-false scratch array and is left so."""
    if not len(codes):
        return np.zeros(0, np.int64)
    word, t = codes >> np.uint64(32), codes & np.uint64(0xFFFFFFFF)
    t[1:][word[1:] == word[:-1]] = _REPEAT
    shift = np.uint64(64 - WIDTH_BITS)
    with np.errstate(over="ignore"):
        one = (t + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        two = (one[:-1] ^ (t[1:] + np.uint64(7))) * np.uint64(0xBF58476D1CE4E5B9)
        three = (two[:-1] ^ (t[2:] + np.uint64(13))) * np.uint64(0x94D049BB133111EB)
    at = np.concatenate([one, two, three]) >> shift
    at = at.astype(np.int64)
    flags[at] = True
    found = np.unique(at) if len(at) < 2000 else np.flatnonzero(flags)
    flags[at] = False
    return found


def _documents(texts: list[str]) -> Iterator[np.ndarray]:
    """The feature arrays of whole texts, in order."""
    flags = np.zeros(1 << WIDTH_BITS, bool)
    for rows in chunks(texts):
        words = [texts[i].split() for i in rows]
        known = _recent.learn(set().union(*words))
        for doc in words:
            yield features(np.fromiter(map(known.__getitem__, doc), np.uint64, len(doc)), flags)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    intercept: float


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    counts = [np.full(1 << WIDTH_BITS, smooth) for _ in range(2)]
    for x, label in zip(rows, y):
        counts[int(label)][x] += 1
    q, p = (c / c.sum() for c in counts)
    return np.log(p / q)


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: float = 0.1, epochs: int = 20, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge-loss model over scaled indicators."""
    signs = np.where(np.asarray(y) > 0, 1.0, -1.0)
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    values = [scale[x] for x in rows]
    norms = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            x, v, sign = rows[i], values[i], signs[i]
            gradient = sign * (w[x] @ v + bias) - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * sign
                alpha[i] = new
                w[x] += step * v
                bias += step
                worst = max(worst, abs(step))
        if worst < 1e-4 * cost:
            break
    return w * scale, bias


def fit(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """Every fifth row is left aside for the logistic curve; the model is then fitted again to all. With one class or
    no rows every score is the smoothed rate of label 1."""
    y = np.asarray(y, np.float64)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << WIDTH_BITS), 0.0, 0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))

    def trained(keep: np.ndarray) -> tuple[np.ndarray, float]:
        some = [rows[i] for i in keep]
        return dual_coordinate_descent(some, log_count_ratio(some, y[keep]), y[keep])

    margins = np.zeros(len(y))
    for fold in range(5):  # each fifth is judged by a model of the other rows
        aside = np.arange(len(y)) % 5 == fold
        if len(set(y[~aside].tolist())) == 2:
            w, b = trained(np.flatnonzero(~aside))
            margins[aside] = [w[rows[i]].sum() + b for i in np.flatnonzero(aside)]
    slope, intercept = logistic(margins, y)
    w, b = trained(np.arange(len(y)))
    return Model(w, b, slope, intercept)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, remainder: int = 2, most: int = MOST_TRAINING) -> Model:
    """Fits on at most `most` labelled rows outside of the held-out fold; its features are made on the executors, and
    that many arrays come to the driver. Each row counts, also one whose text another row has; of rows with one doc_id
    the smallest text does. Null texts count as empty; extra columns are not looked at; with no rows the score is 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.astype("<u4").tobytes() for x in _documents(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["doc_id", "y", "features"])

    sample = training_sample(docs, labels, label, modulus, remainder, most)
    got = sorted((r.doc_id, r.y, bytes(r.features)) for r in sample.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, features binary").collect())
    return fit([np.frombuffer(f, "<u4").astype(np.int64) for _, _, f in got], np.array([y for _, y, _ in got]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier) for each row; no shuffle. Null and empty texts have no n-grams
    and get the score of the bias alone; repeated rows give repeated results."""
    w, bias, slope, intercept = model.weights.astype(np.float32), model.bias, model.slope, model.intercept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = np.array([w[x].sum(dtype=np.float64) + bias for x in _documents(batch.column(1).to_pylist())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probability(margins, slope, intercept))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs: whole texts, null as empty, repeated rows repeated, an
    empty table empty; extra columns are not looked at."""
    scored = score(docs, train(docs, labels, "quality", modulus, remainder))
    return scored.select("doc_id", held_out(modulus, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs that score at least the threshold, all columns kept, in place. Null texts are scored as empty ones;
    of an empty table nothing is left; equal rows stay or go together, and null ids don't matter."""
    column = next(x for x in (f"score{'_' * i}" for i in range(99)) if x not in docs.columns)
    w, bias, slope, intercept = model.weights.astype(np.float32), model.bias, model.slope, model.intercept

    @F.arrow_udf("double")
    def judged(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            margins = [w[x].sum(dtype=np.float64) + bias for texts in text_parts(column) for x in _documents(texts)]
            yield pa.array(probability(np.array(margins), slope, intercept), pa.float64())

    return docs.withColumn(column, judged(text_of(text_col))).filter(F.col(column) >= threshold).drop(column)
