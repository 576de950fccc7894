"""Boosted trees for counts: gradients of the Tweedie deviance (or of squared error) summed by node, feature and bin on the
executors, splits chosen from these sums, rounds until held-out deviance no longer falls."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: The Tweedie power, the penalty on leaf values, the least hessian of a leaf.
POWER, PENALTY, LEAST_HESSIAN = 1.3, 1.0, 5.0
DEPTH, RATE, ROUNDS, BINS, PATIENCE = 4, 0.2, 60, 32, 3


@dataclass
class Trees:
    """A fitted model. A tree is three lists over its 2 ** depth - 1 inner nodes in level order (feature, or -1 where a
    node isn't split, and the last bin that goes left) and its 2 ** depth leaves."""

    features: list[str]
    edges: list[list[float]]
    loss: str
    start: float
    depth: int = DEPTH
    trees: list[tuple[list[int], list[int], list[float]]] = field(default_factory=list)
    deviance: list[float] = field(default_factory=list)  # held out, before the first tree and after each

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Trees:
        made = Trees(**json.loads(text))
        made.trees = [tuple(t) for t in made.trees]
        return made

    def binned(self, rows: pd.DataFrame) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, rows[f].to_numpy(float)) for f, e in zip(self.features, self.edges)]).astype(np.int16).reshape(len(rows), -1)

    def scores(self, bins: np.ndarray, begin: int = 0, base: np.ndarray | None = None) -> np.ndarray:
        out = np.full(len(bins), self.start) if base is None else base
        every = np.arange(len(bins))
        for feature, cut, leaves in self.trees[begin:]:
            out = out + np.asarray(leaves)[_node(bins, every, np.asarray(feature), np.asarray(cut), self.depth)]
        return out

    def values(self, scores: np.ndarray) -> np.ndarray:
        return np.exp(scores) if self.loss == "tweedie" else np.maximum(scores, 0.0)


def _node(bins: np.ndarray, every: np.ndarray, feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
    """The place, counted within its level, that each row has reached; a node that isn't split sends all to the left."""
    at = np.zeros(len(bins), np.int64)
    for depth in range(level):
        inner = at + 2**depth - 1
        f = feature[inner]
        right = (f >= 0) & (bins[every, np.maximum(f, 0)] > cut[inner])
        at = 2 * at + right
    return at


def gradients(loss: str, y: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of a row's loss by its score (the logarithm of the mean for `tweedie`)."""
    if loss == "squared":
        return score - y, np.ones_like(y)
    less, more = y * np.exp((1 - POWER) * score), np.exp((2 - POWER) * score)
    return more - less, (POWER - 1) * less + (2 - POWER) * more


def deviance(y: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The Tweedie deviance of each row, whatever loss it was fitted by."""
    mean = np.maximum(mean, 1e-6)
    p = POWER
    return 2 * (np.power(y, 2 - p) / ((1 - p) * (2 - p)) - y * np.power(mean, 1 - p) / (1 - p) + np.power(mean, 2 - p) / (2 - p))


def best_splits(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """feature and last left bin of the best split of each node, feature -1 where none gains. g, h: node x feature x bin."""
    left_g, left_h = g.cumsum(2)[:, :, :-1], h.cumsum(2)[:, :, :-1]
    all_g, all_h = g.sum(2)[:, :, None], h.sum(2)[:, :, None]
    right_g, right_h = all_g - left_g, all_h - left_h
    part = lambda a, b: a * a / (b + PENALTY)
    gain = np.where((left_h >= LEAST_HESSIAN) & (right_h >= LEAST_HESSIAN), part(left_g, left_h) + part(right_g, right_h) - part(all_g, all_h), -np.inf)
    flat = gain.reshape(len(g), -1)
    best = flat.argmax(1)
    found = flat[np.arange(len(g)), best] > 1e-9
    return np.where(found, best // gain.shape[2], -1), np.where(found, best % gain.shape[2], 0)


def _sums(rows: DataFrame, model: Trees, feature: list[int], cut: list[int], level: int, last: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradient and hessian sums of node, feature and bin at one level of the next tree, and the deviance so far of the rows
    after period `last`, which are held out. Tasks add up their rows; what comes to the driver has a row for each node, feature and bin."""
    f_count, some = len(model.features), (np.asarray(feature, np.int64), np.asarray(cut, np.int64))
    width = 2**level * f_count * BINS

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g_sum, h_sum, off, weight = np.zeros(width), np.zeros(width), 0.0, 0.0
        for part in parts:
            bins = model.binned(part)
            y, w, held = part["target"].to_numpy(float), part["weight"].to_numpy(float), part["t_idx"].to_numpy(float) > last
            score = model.scores(bins)
            off += float((w * deviance(y, model.values(score)))[held].sum())
            weight += float(w[held].sum())
            own = ~held
            g, h = (v * w[own] for v in gradients(model.loss, y[own], score[own]))
            node = _node(bins[own], np.arange(int(own.sum())), *some, level)
            for f in range(f_count):
                slot = (node * f_count + f) * BINS + bins[own, f]
                g_sum += np.bincount(slot, g, width)
                h_sum += np.bincount(slot, h, width)
        used = np.flatnonzero(h_sum)
        yield pd.DataFrame({"slot": np.append(used, -1), "g": np.append(g_sum[used], off), "h": np.append(h_sum[used], weight)})

    sums = rows.mapInPandas(add, "slot long, g double, h double").groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas().set_index("slot")
    off = sums.loc[-1, "g"] / max(sums.loc[-1, "h"], 1e-12) if -1 in sums.index else 0.0
    out = np.zeros((2, width))
    real = sums[sums.index >= 0]
    out[:, real.index] = real[["g", "h"]].to_numpy().T
    return *(v.reshape(2**level, f_count, BINS) for v in out), float(off)


def grow(rows: DataFrame, model: Trees, last: float) -> tuple[tuple[list[int], list[int], list[float]], float]:
    """The next tree, and the held-out deviance before it."""
    feature, cut, off = [], [], 0.0
    for level in range(model.depth):
        g, h, off_now = _sums(rows, model, feature, cut, level, last)
        off = off_now if level == 0 else off
        fs, cs = best_splits(g, h)
        feature, cut = feature + fs.tolist(), cut + cs.tolist()
    total = lambda v: v[:, 0].sum(1)  # noqa: E731  # any feature's bins add up to the node
    every = np.arange(len(fs))
    left = lambda v: np.where(fs >= 0, (v[every, np.maximum(fs, 0)] * (np.arange(BINS) <= cs[:, None])).sum(1), total(v))
    lg, lh = left(g), left(h)
    pairs = np.stack([lg, total(g) - lg], 1).ravel(), np.stack([lh, total(h) - lh], 1).ravel()
    leaves = -RATE * pairs[0] / (pairs[1] + PENALTY)
    return (feature, cut, leaves.tolist()), off


def bin_edges(rows: DataFrame, features: list[str]) -> list[list[float]]:
    """Up to BINS - 1 quantiles of each feature, to within a thousandth of the rows."""
    at = [i / BINS for i in range(1, BINS)]
    return [sorted(set(q)) for q in rows.approxQuantile(features, at, 0.001)]


def fit(rows: DataFrame, features: list[str], loss: str = "tweedie", rounds: int = ROUNDS, held_periods: int = 3, start: Trees | None = None) -> Trees:
    """Boosts trees over rows with the features, target, weight and t_idx (the period). The last held_periods are held out:
    rounds end when their deviance hasn't fallen for PATIENCE rounds, and the trees after the best round go. start: a model
    to go on from, with its bins. A table without rows gives a model without trees.

    Each level of a tree is one pass over the rows, in which tasks bin them, score them by the trees so far (a few hundred
    numbers each) and send at most nodes x features x BINS sums."""
    rows = rows.select(*dict.fromkeys([*features, "target", "weight", "t_idx"])).persist()
    try:
        last = rows.agg(F.max("t_idx").alias("t")).first().t
        if last is None:
            return start or Trees(features, [[] for _ in features], loss, 0.0)
        last, known = last - held_periods, rows.filter(F.col("t_idx") <= last - held_periods)
        if start is None:
            mean = known.agg((F.sum(F.col("target") * F.col("weight")) / F.sum("weight")).alias("m")).first().m or 0.0
            first = float(np.log(max(mean, 1e-6))) if loss == "tweedie" else float(mean)
            model = Trees(features, bin_edges(known, features), loss, first)
        else:
            model = Trees.from_json(start.to_json())
        begun = len(model.trees)
        model.deviance = model.deviance[:-1] if start else []
        for _ in range(rounds + 1):  # the last pass only measures
            tree, off = grow(rows, model, last)
            model.deviance.append(off)
            best = begun + int(np.argmin(model.deviance[begun:]))
            if len(model.trees) - best >= PATIENCE or len(model.trees) == begun + rounds:
                break
            model.trees.append(tree)
        model.trees, model.deviance = model.trees[:best], model.deviance[: best + 1]
    finally:
        rows.unpersist()
    return model


def predict(model: Trees, rows: DataFrame) -> DataFrame:
    """rows with yhat, never below 0. Batches pass through whole, so that steps which feed on each other stay apart in the plan."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(f)).to_numpy(zero_copy_only=False) for f in model.features]
            bins = np.column_stack([np.searchsorted(e, c) for e, c in zip(model.edges, columns)]).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.values(model.scores(bins)), pa.float64())], [*batch.schema.names, "yhat"])

    return rows.mapInArrow(tell, StructType([*rows.schema.fields, StructField("yhat", DoubleType())]))
