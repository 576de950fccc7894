"""Small fits on the driver over bounded samples, shared by the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_id_bytes


def held_out(modulus: int, remainder: int, id_col: str = "doc_id"):
    """True for rows whose crc32(doc_id as text) leaves the remainder; a null doc_id counts as empty text."""
    return F.crc32(doc_id_bytes(id_col)) % modulus == remainder


def training_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, y) of at most `most` labelled ids outside of the held-out fold, the smallest by a hash of doc_id;
    an id with several labels has the largest. Of rows with one id the smallest text counts, so the bound holds for rows
    too. The ids are at most `most` rows of two columns, so they are broadcast and only chosen texts move. Other columns
    of docs and labels, of whatever name, are left behind first."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    given = labels.select(F.col(id_col).alias("doc_id"), F.col(label).alias("y"))
    chosen = (
        given.filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(modulus, remainder))
        .groupBy("doc_id")
        .agg(F.max("y").cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    return rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, with the slope drawn to 0, by Newton's method."""
    design, w = np.column_stack([x, np.ones(len(x))]), np.zeros(2)
    if len(x):
        rate = (y.sum() + 1) / (len(y) + 2)
        w[1] = np.log(rate / (1 - rate))
    for _ in range(steps if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + np.array([ridge * w[0], 1e-3 * w[1]])
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag([ridge, 1e-3])
        move = np.linalg.solve(hessian, gradient)
        w -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def probability(x: np.ndarray, slope: float, intercept: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope * x + intercept, -30, 30)))
