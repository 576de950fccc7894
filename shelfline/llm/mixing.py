"""Mixing sources to target weights by drawing fixed-length blocks of words.

Each source's documents, in doc_id order, form one stream of words that is cut into blocks. An output shard draws how
many blocks it takes of each source from a multinomial over the sources' targets; slots of a source are numbered
through the shards, and a pseudorandom permutation of the source's block indices maps slots to blocks, a new one each
time all blocks have been used. Slots and blocks meet in a join by index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, stored, text_of

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
#: Words of a block, blocks of a shard, shards that are numbered at once, rounds of the permutation.
BLOCK_WORDS, SHARD_BLOCKS, RUN_SHARDS, ROUNDS = 256, 4096, 4096, 4
#: Sources are few by nature: weights go by their order. Their names and sizes come to the driver and are broadcast, so
#: more than this many are refused.
MOST_SOURCES = 100_000
#: Of the hash that rounds a document's times; apart from the draws' seed.
ROUND_SEED = 23


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words each source shall give: by weight, `most` times its size at most, the excess shared again by weight."""
    owed, weight = share * sum(sizes), [weights[i % len(weights)] for i in range(len(sizes))]
    full: set[int] = set()
    while True:
        left = owed - sum(most * sizes[i] for i in full)
        open_ = sum(w for i, w in enumerate(weight) if i not in full)
        goal = [most * s if i in full else left * weight[i] / open_ for i, s in enumerate(sizes)]
        above = {i for i, g in enumerate(goal) if i not in full and g > most * sizes[i]}
        if not above:
            return goal
        full |= above


def _keyed(values: np.ndarray, key: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (values + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _feistel(x: np.ndarray, half: np.ndarray, key: np.ndarray, back: bool) -> np.ndarray:
    mask = (np.uint64(1) << half) - np.uint64(1)
    left, right = x >> half, x & mask
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if back:
            left, right = right ^ (_keyed(left, key + np.uint64(r)) & mask), left
        else:
            left, right = right, left ^ (_keyed(right, key + np.uint64(r)) & mask)
    return (left << half) | right


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0 .. size-1 for each key: a Feistel network over the next power of four, walked
    until it falls inside. back=True is its inverse."""
    x, size, key = (np.array(v, np.uint64) for v in (index, size, key))
    bits = np.ceil(np.log2(np.maximum(size.astype(np.float64), 2)) / 2).astype(np.uint64)
    half = np.maximum(bits, np.uint64(1))
    x = _feistel(x, half, key, back)
    while (out := np.flatnonzero(x >= size)).size:
        x[out] = _feistel(x[out], half[out], key[out], back)
    return x.astype(np.int64)


def epoch_key(seed: int, source: np.ndarray, epoch: np.ndarray) -> np.ndarray:
    return _keyed(np.asarray(source, np.uint64) * np.uint64(1 << 20) + np.asarray(epoch, np.uint64), np.uint64(seed))


def slots_needed(size: int, goal: int, block: int, source: int, seed: int) -> tuple[int, int]:
    """How many slots of a source make up goal words, and how many words the last of them takes."""
    if not goal or not size:
        return 0, 0
    blocks = -(-size // block)
    short = blocks * block - size  # what the last block lacks
    epochs = np.arange(goal // size + 2)
    places = permuted(np.full(len(epochs), blocks - 1), np.full(len(epochs), blocks), epoch_key(seed, np.full(len(epochs), source), epochs), back=True)
    lacking = np.sort(epochs * blocks + places)
    words = lambda n: n * block - short * int((lacking < n).sum())
    n = -(-goal // block)
    while words(n) < goal:
        n += 1
    return n, goal - words(n - 1)


def shard_draws(spark: SparkSession, needed: list[int], seed: int) -> DataFrame:
    """Stored rows shard, sid, first, n: how many of its slots each shard takes of each source, at most SHARD_BLOCKS, and
    the first of them; first numbers a source's slots through the shards.

    Shards draw by themselves, on the executors: a multinomial over the sources in proportion to what they need, from a
    seed of their own. Draws beyond what a source needs fall away, and what its draws lack fills further shards in the
    same way of numbering, so that every source has the slots it needs, whatever the draws."""
    total = sum(needed)
    shards = -(-total // SHARD_BLOCKS)
    share = np.array(needed, np.float64) / max(1, total)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                size = min(SHARD_BLOCKS, total - shard * SHARD_BLOCKS)
                drawn = np.random.default_rng([seed, shard]).multinomial(size, share / share.sum())
                sid = np.flatnonzero(drawn)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sid), shard, np.int64)), pa.array(sid), pa.array(drawn[sid])], ["shard", "sid", "n"])

    drawn = stored(spark.range(0, shards, 1, partitions(spark)).mapInArrow(draw, "shard long, sid long, n long"), "draws") if total else spark.createDataFrame([], "shard long, sid long, n long")
    # slots are numbered in two steps, through the shards of a run and through the runs, so that no window is long
    run = (F.col("shard") / RUN_SHARDS).cast("long")
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    runs = drawn.groupBy("sid", run.alias("run")).agg(F.sum("n").alias("n"))
    ahead = runs.select("sid", "run", F.coalesce(F.sum("n").over(before("sid", "run")), F.lit(0)).alias("ahead"))
    numbered = drawn.withColumn("run", run).join(ahead, ["sid", "run"])
    numbered = numbered.withColumn("first", F.col("ahead") + F.coalesce(F.sum("n").over(before("sid", "run", "shard")), F.lit(0)))
    wanted = spark.createDataFrame([(i, int(n)) for i, n in enumerate(needed)], "sid long, needed long")
    taken = numbered.join(F.broadcast(wanted), "sid").select("shard", "sid", "first", F.least("n", F.col("needed") - F.col("first")).alias("n")).filter("n > 0")
    drawn_of = runs.groupBy("sid").agg(F.sum("n").alias("drawn"))
    short = wanted.join(drawn_of, "sid", "left").select("sid", "needed", F.coalesce("drawn", F.lit(0)).alias("at")).filter("at < needed")
    more = short.select("sid", "needed", F.explode(F.sequence("at", F.col("needed") - 1, F.lit(SHARD_BLOCKS).cast("long"))).alias("first"), "at")
    further = more.select((F.lit(shards) + ((F.col("first") - F.col("at")) / SHARD_BLOCKS).cast("long")).alias("shard"), "sid", "first", F.least(F.lit(SHARD_BLOCKS).cast("long"), F.col("needed") - F.col("first")).alias("n"))
    return stored(taken.unionByName(further), "shards")


def _streams(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, list]:
    """Stored rows (doc_id, tie, source, sid, size, begin), begin being where a document starts in its source's stream;
    and the sources in order with their sizes. Sources are collected, a row each; over MOST_SOURCES raise an error."""
    spark = docs.sparkSession
    rows = stored(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text_of(text_col)).alias("tie")),
        "sizes",
    )
    sources = rows.groupBy("source").agg(F.sum("size").alias("size")).orderBy(F.col("source").asc_nulls_last()).limit(MOST_SOURCES + 1).collect()
    if len(sources) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    named = spark.createDataFrame([(r.source, i) for i, r in enumerate(sources)], "name string, sid long")
    dealt = stored(
        rows.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("name")))
        .drop("name")
        .repartitionByRange(partitions(spark), "sid", "doc_id", "tie")
        .withColumn("part", F.spark_partition_id()),
        "streams",
    )
    within = Window.partitionBy("part", "sid").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    # the parts of a source follow each other; a row for each part and source that meet, so parts + sources at most
    parts = dealt.groupBy("part", "sid").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", "sid", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    placed = dealt.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(F.broadcast(parts), ["part", "sid"])
    return stored(placed.select("doc_id", "tie", "source", "sid", "size", (F.col("ahead") + F.col("inside")).alias("begin")), "placed"), sources


def _drawn(placed: DataFrame, sizes: list[int], goals: list[int], block: int, seed: int) -> DataFrame:
    """The mix as spans: shard, slot (number within its source), sid, begin (of the document in its stream), first and
    words (the span inside the document)."""
    spark = placed.sparkSession
    needed = [slots_needed(size, goal, block, i, seed) for i, (size, goal) in enumerate(zip(sizes, goals))]
    draws = shard_draws(spark, [n for n, _ in needed], seed)
    count = np.array([-(-s // block) for s in sizes], np.int64)
    last = np.array([n - 1 for n, _ in needed], np.int64)
    cut = np.array([c for _, c in needed], np.int64)

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, sid, slot = (batch.column(i).to_numpy() for i in range(3))
            index = permuted(slot % count[sid], count[sid], epoch_key(seed, sid, slot // count[sid]))
            limit = np.where(slot == last[sid], cut[sid], block)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shard, sid, slot, index, limit)], ["shard", "sid", "slot", "block", "most"])

    slots = (
        draws.repartition(partitions(spark))
        .select("shard", "sid", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot"))
        .mapInArrow(to_blocks, "shard long, sid long, slot long, block long, most long")
    )
    end = F.col("begin") + F.col("size")
    pieces = (
        placed.filter("size > 0")
        .select("sid", "begin", "size", F.explode(F.sequence((F.col("begin") / block).cast("long"), ((end - 1) / block).cast("long"))).alias("block"))
        .select("sid", "begin", "block", F.greatest("begin", F.col("block") * block).alias("lo"), F.least(end, (F.col("block") + 1) * block).alias("hi"))
    )
    hi = F.least("hi", F.col("block") * block + F.col("most"))
    # the planner can't tell how many slots the draws expand to, so it's told to shuffle them
    return pieces.join(slots.hint("merge"), ["sid", "block"]).select("shard", "slot", "sid", "begin", (F.col("lo") - F.col("begin")).alias("first"), (hi - F.col("lo")).alias("words")).filter("words > 0")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = BLOCK_WORDS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each input row: doc_id, size, source_size, target, taken, source, tie (a hash of the text).

    Sources weigh `weights` in turn, by code point, null last. The words taken of a source are its target rounded to
    a whole word, since the last slot takes a part of its block; no document is taken more than ceil(most) times.
    The draws depend on the seed and the data alone. Long texts lie in many blocks. Null texts and texts without words have size 0 and are never
    taken; a null doc_id comes first; rows equal in doc_id and text are placed one after another; an empty table gives
    an empty result."""
    placed, sources = _streams(docs, id_col, text_col, source_col)
    sizes = [int(r["size"]) for r in sources]
    goals = targets(sizes, weights, share, most) if sum(sizes) else [0.0] * len(sizes)
    spark = docs.sparkSession
    facts = spark.createDataFrame([(i, s, float(g)) for i, (s, g) in enumerate(zip(sizes, goals))], "sid long, source_size long, target double")
    spans = _drawn(placed, sizes, [min(round(g), int(most * s)) for g, s in zip(goals, sizes)], block, seed)
    taken = spans.groupBy("sid", "begin").agg(F.sum("words").alias("taken"))
    real = placed.filter("size > 0").join(taken, ["sid", "begin"], "left")
    rows = real.select("doc_id", "tie", "source", "sid", "size", "taken").unionByName(placed.filter("size = 0").select("doc_id", "tie", "source", "sid", "size", F.lit(None).cast("long").alias("taken")))
    return rows.join(F.broadcast(facts), "sid").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "source", "tie")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", on_average: bool = False, **how) -> DataFrame:
    """docs as the mix has them, all columns kept: each row as often as its words are taken, to the nearest whole number
    (half counts up). What is taken less than half is left out. Texts without words are left out.

    The nearest number is one-sided for long documents, all of which are taken at about their source's ratio. With
    on_average the fraction is the chance of one more time, by a hash of (doc_id, tie) and ROUND_SEED, so that a source's
    words are expected to be those taken. Rows equal in doc_id, text and source have one number. Null texts are without
    words, a null source is a source of its own, the last, and an empty table stays empty."""
    columns = docs.columns
    new = {a: next(x for x in (f"{a}{'_' * i}" for i in range(99)) if x not in columns) for a in ("key", "tie", "times")}
    plan = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    ratio = F.col("taken") / F.col("size")
    drawn = F.xxhash64(F.lit(ROUND_SEED), "doc_id", "tie").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    times = (F.floor(ratio) + F.when(drawn < ratio - F.floor(ratio), 1).otherwise(0) if on_average else F.floor(ratio + 0.5)).cast("int")
    plan = plan.filter("size > 0").groupBy("doc_id", "tie", "source").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size")).select(F.col("doc_id").alias("k"), F.col("tie").alias("t"), F.col("source").alias("s"), times.alias(new["times"])).filter(F.col(new["times"]) > 0)
    keyed = docs.withColumn(new["key"], F.col(id_col).cast("long")).withColumn(new["tie"], F.xxhash64(text_of(text_col)))
    same = F.col(new["key"]).eqNullSafe(F.col("plan.k")) & (F.col(new["tie"]) == F.col("plan.t")) & F.col(f"docs.{source_col}").eqNullSafe(F.col("plan.s"))
    met = keyed.alias("docs").join(plan.alias("plan"), same)
    return met.withColumn(new["key"], F.explode(F.sequence(F.lit(1), F.col(new["times"])))).select(*(f"docs.{c}" for c in columns))
