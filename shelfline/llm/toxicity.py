"""Toxicity by maximum-scoring segments over log-odds of words and their beginnings.

A text is a row of tokens: words of at most 16 letters or digits (longer runs are several) and single marks. A token is
known by its parts, its leading characters of several lengths and all of it, so that forms of one stem share what is
known of the stem. A part is counted in the distinct contexts (the token with its neighbours) in which it occurs, those
of innocent texts against those of toxic ones only: what copies of a text repeat counts once, and what a toxic text has
in common with an innocent one counts as innocent. The share of toxic contexts of a part has a Dirichlet prior around that of
the next shorter part, of the shortest around that of all contexts; a token's score is the log-odds of its longest known
part against all contexts, less a drift that makes innocent text lose. A linear scan finds every maximal segment of
positive sum. By extreme-value statistics a segment of sum S in n tokens is as good as K n exp(-lambda S) by chance; a
document's evidence is that of its significant segments together, and a logistic curve turns it into a score. Lambda, K
and the curve are fitted to training texts, each scored by counts without its own fifth of them."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Recent, chunks, stored, text_of
from .fitting import held_out, logistic, training_sample

#: The fit sees this many labelled rows at most.
MOST_TRAINING = 10_000
#: Lengths of leading characters, strength of the prior in contexts, contexts that a part needs to be known, what a
#: token loses, and the parts of the training rows.
LENGTHS, PRIOR, LEAST_CONTEXTS, DRIFT, FOLDS = (2, 3, 4, 5, 6, 7, 8, 10), 16.0, 6, 1.0, 5
_TOKEN = re.compile(r"\w{1,16}|[^\w\s]")
_WHOLE = "\n"  # ends a part that is all of its token; no token has it


def tokens_of(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal segments (first, last, sum) of a row of scores, in linear time after Ruzzo and Tompa.

    Candidates are kept with the sums before and after them. One that is about to be added looks for the last candidate
    with a smaller sum before it. Each points to the last one that has a smaller sum before it than itself, so those in
    between are never looked at again; and if there is none, all candidates are final and leave the list."""
    sums = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    final: list[tuple[int, int, float]] = []
    held: list[tuple[int, int, float, float]] = []  # first, last, sum before it, sum up to its end
    lower: list[int] = []
    at = np.flatnonzero(scores > 0)
    for place, low, high in zip(at.tolist(), sums[at].tolist(), sums[at + 1].tolist()):
        first, j = place, len(held) - 1
        while True:
            while j >= 0 and held[j][2] >= low:
                j = lower[j]
            if j < 0:
                final += [(a, b, hi - lo) for a, b, lo, hi in held]
                held, lower = [(first, place, low, high)], [-1]
                break
            if held[j][3] >= high:
                held.append((first, place, low, high))
                lower.append(j)
                break
            first, _, low, _ = held[j]
            after = lower[j]
            del held[j:], lower[j:]
            j = after
    return final + [(a, b, hi - lo) for a, b, lo, hi in held]


def parts_of(token: str) -> list[str]:
    """From the longest to the shortest."""
    return [token + _WHOLE, *(token[:k] for k in reversed(LENGTHS) if k < len(token))]


def scorer(table: dict[str, float], unknown: float = -DRIFT) -> Recent:
    """Scores of tokens by their longest part in the table."""
    return Recent(lambda tokens: [next((table[p] for p in parts_of(t) if p in table), unknown) for t in tokens])


def scored_texts(texts: list[str], known: Recent) -> Iterator[np.ndarray]:
    """The token scores of whole texts, in order."""
    for rows in chunks(texts):
        tokens = [tokens_of(texts[i]) for i in rows]
        score = known.learn(set().union(*tokens))
        for doc in tokens:
            yield np.fromiter(map(score.__getitem__, doc), np.float64, len(doc))


@dataclass
class Model:
    table: dict[str, float]  # scores of parts
    rate: float  # lambda of the extreme-value statistics
    log_k: float
    slope: float
    intercept: float


def log_odds(parts: list[str], toxic: np.ndarray, other: np.ndarray, contexts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The score of each part from the numbers of its toxic and other contexts; contexts: those of all tokens. Columns,
    where there are some, are models apart."""
    place = {p: i for i, p in enumerate(parts)}
    sizes = [len(p.removesuffix(_WHOLE)) for p in parts]
    above = np.array([next((place[p[:k]] for k in reversed(LENGTHS) if k < n and p[:k] in place), -1) for p, n in zip(parts, sizes)], np.int64)
    base = (contexts[0] + 1) / (contexts[0] + contexts[1] + 2)
    share = np.empty(np.shape(toxic))
    order = np.array([len(p) for p in parts], np.int64)
    for length in np.unique(order):  # shorter parts first
        at = np.flatnonzero(order == length)
        prior = np.where((above[at] < 0).reshape(-1, *[1] * (share.ndim - 1)), base, share[above[at]])
        share[at] = (toxic[at] + PRIOR * prior) / (toxic[at] + other[at] + PRIOR)
    return np.log(share / (1 - share)) - np.log(base / (1 - base)) - DRIFT


def chance_rate(values: np.ndarray, counts: np.ndarray) -> float:
    """The lambda > 0 with mean exp(lambda * score) = 1 over the tokens of innocent text; 1 where they never win."""
    if not len(values) or values.max() <= 0:
        return 1.0
    weight = counts / counts.sum()
    mean = lambda r: float((weight * np.exp(np.minimum(r * values, 500))).sum())
    low, high = 1e-3, 1.0
    while mean(high) < 1:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if mean(middle) < 1 else (low, middle)
    return high


def _contexts(texts: DataFrame) -> DataFrame:
    """context, token, y, fold: what each text has, once; texts: text, y, fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, y, fold in zip(*(c.to_pylist() for c in batch.columns)):
                doc = tokens_of(text)
                around = dict.fromkeys(zip(["", *doc[:-1]], doc, [*doc[1:], ""])) if doc else {}
                keys = np.array([xxhash.xxh64_intdigest("\n".join(c)) for c in around], np.uint64).view(np.int64)
                tokens = pa.array([c[1] for c in around], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(keys), tokens, pa.array(np.full(len(keys), y, np.int32)), pa.array(np.full(len(keys), fold, np.int32))], ["context", "token", "y", "fold"])

    return texts.mapInArrow(run, "context long, token string, y int, fold int")


def part_counts(texts: DataFrame) -> DataFrame:
    """part and, for f = 0 .. FOLDS, the numbers other_f and toxic_f of its contexts, without fold f (with all where f is
    FOLDS). The row whose part is null has those of all tokens."""
    seen = lambda y: F.bit_or(F.when(F.col("y") == y, F.expr("shiftleft(1, fold)")).otherwise(0))
    contexts = _contexts(texts).groupBy("context", "token").agg(seen(0).alias("in_other"), seen(1).alias("in_toxic"))

    def counted(f: int) -> list[Column]:
        kept = F.lit((1 << FOLDS) - 1 - ((1 << f) if f < FOLDS else 0))
        other, toxic = F.col("in_other").bitwiseAND(kept) != 0, F.col("in_toxic").bitwiseAND(kept) != 0
        return [F.sum(other.cast("long")).alias(f"other_{f}"), F.sum((toxic & ~other).cast("long")).alias(f"toxic_{f}")]

    by_token = contexts.groupBy("token").agg(*(c for f in range(FOLDS + 1) for c in counted(f)))
    size = F.length("token")
    parts = F.array(F.lit(None).cast("string"), F.concat("token", F.lit(_WHOLE)), *(F.when(size > k, F.substring("token", 1, k)).otherwise("") for k in LENGTHS))
    sums = [F.sum(c).alias(c) for f in range(FOLDS + 1) for c in (f"other_{f}", f"toxic_{f}")]
    found = by_token.select(F.explode(parts).alias("part"), *(c for f in range(FOLDS + 1) for c in (f"other_{f}", f"toxic_{f}")))
    return found.filter("part is null or part <> ''").groupBy("part").agg(*sums).filter(F.col(f"other_{FOLDS}") + F.col(f"toxic_{FOLDS}") >= LEAST_CONTEXTS)


def evidence(sums: Column, n: Column, rate: float, log_k: float) -> Column:
    """What segments of the given sums in n tokens are worth together: -log(expected number by chance), if above 0."""
    worth = lambda s: F.greatest(F.lit(0.0), rate * s - F.log(n.cast("double")) - log_k)
    return F.aggregate(sums, F.lit(0.0), lambda total, s: total + worth(s))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, remainder: int = 0, most: int = MOST_TRAINING) -> Model:
    """Fits to at most `most` labelled rows outside of the held-out fold; equal texts count once, with their largest
    label, and null ones as empty. Contexts and parts are grouped on the executors. To the driver come the parts that
    these rows have in LEAST_CONTEXTS contexts or more, a histogram of scores and two numbers a row. Extra columns are not looked
    at. With no rows, or with rows of one class, the model has no parts and one score for all."""
    sample = stored(training_sample(docs, labels, label, modulus, remainder, most), "training")
    once = sample.groupBy("text").agg(F.max("y").alias("y"))
    texts = stored(once.select("text", "y", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")), "texts")
    rows = stored(part_counts(texts), "parts").toPandas()
    named = rows["part"].notna().to_numpy()
    toxic, other = (rows[[f"{kind}_{f}" for f in range(FOLDS + 1)]].to_numpy(np.float64) for kind in ("toxic", "other"))
    parts, totals = rows["part"].to_numpy()[named].tolist(), (toxic[~named].sum(0), other[~named].sum(0))
    del rows
    if not (totals[0][FOLDS] and totals[1][FOLDS]):
        parts, toxic, other, named = [], toxic[:0], other[:0], named[:0]
    scores = log_odds(parts, toxic[named], other[named], totals).astype(np.float32)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [scorer(dict(zip(parts, scores[:, f].tolist()))) for f in range(FOLDS)]
        for batch in batches:
            held: dict[str, list] = {"y": [], "n": [], "sums": [], "value": [], "times": []}
            for text, y, fold in zip(*(c.to_pylist() for c in batch.columns)):
                row = next(scored_texts([text], known[fold]))
                value, times = np.unique(np.round(row, 2), return_counts=True)
                for name, x in zip(held, (y, len(row), [s for *_, s in maximal_segments(row)], value.tolist(), times.tolist())):
                    held[name].append(x)
            yield pa.RecordBatch.from_pydict(held, pa.schema([("y", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.float64())), ("value", pa.list_(pa.float64())), ("times", pa.list_(pa.int64()))]))

    scanned = stored(texts.mapInArrow(scan, "y int, n long, sums array<double>, value array<double>, times array<long>"), "scanned")
    bins = scanned.filter("y = 0").select(F.explode(F.arrays_zip("value", "times")).alias("bin")).groupBy("bin.value").agg(F.sum("bin.times").alias("times")).collect()
    rate = chance_rate(np.array([r.value for r in bins]), np.array([r.times for r in bins], np.float64))
    best = F.coalesce(F.array_max("sums"), F.lit(0.0)) * rate - F.log(F.col("n").cast("double"))
    middle = scanned.filter("y = 0 and n > 0").agg(F.median(best).alias("m")).collect()[0].m
    log_k = (middle or 0.0) + math.log(math.log(2))  # the median of extreme values
    pairs = scanned.select(F.log1p(F.when(F.col("n") > 0, evidence(F.col("sums"), F.col("n"), rate, log_k)).otherwise(0.0)).alias("x"), "y").toPandas()
    slope, intercept = logistic(pairs["x"].to_numpy(np.float64), pairs["y"].to_numpy(np.float64))
    return Model(dict(zip(parts, scores[:, FOLDS].tolist())), rate, log_k, max(0.0, slope), intercept)


def find_passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, evidence, passages (array of first token, last token, evidence) for each row of docs; no shuffle, no text
    cut. Null and empty texts have no passages; repeated rows give repeated results, an empty table an empty one."""
    table, rate, log_k = model.table, model.rate, model.log_k
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("evidence", pa.float64())]))

    def passages(scores: np.ndarray) -> list[dict]:
        space = math.log(len(scores)) + log_k if len(scores) else 0.0
        judged = ((a, b, rate * s - space) for a, b, s in maximal_segments(scores))
        return [{"first": a, "last": b, "evidence": e} for a, b, e in judged if e > 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = scorer(table)
        for batch in batches:
            found = [passages(s) for s in scored_texts(batch.column(1).to_pylist(), known)]
            total = pa.array([sum(p["evidence"] for p in f) for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), total, pa.array(found, kind)], ["doc_id", "evidence", "passages"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, evidence double, passages array<struct<first:int,last:int,evidence:double>>")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages for each row of docs. Null and empty texts have no passages and get
    the score of no evidence; without labels of both classes every score is the smoothed rate of label 1. Extra columns
    are not looked at."""
    model = train(docs, labels, "toxic", modulus, remainder)
    score = 1 / (1 + F.exp(-(F.lit(model.slope) * F.log1p("evidence") + F.lit(model.intercept))))
    found = find_passages(docs, model).withColumn("score", score)
    return found.select("doc_id", held_out(modulus, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
