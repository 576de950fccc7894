"""Shards by a Feistel permutation of global row numbers.

Rows get global numbers 0 to n - 1 from their contents alone, a keyed Feistel permutation with cycle walking shuffles the
numbers, and the shuffled number says where a row goes: its remainder by the number of shards is the shard, its quotient
the slot there. So a shuffle can be repeated, shard sizes differ by one at most, slots have no gaps, and the place of a
number, or the number at a place, is a formula that needs no look-up. Everything is made of SQL functions."""

from __future__ import annotations

import hashlib
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_of

SHARDS, SEED = 8, 20_240_229
ROUNDS = 6
#: Round functions work modulo this prime, so that products fit in 64 bits.
PRIME = 2**31 - 1
#: One walk leads back into 0 to n - 1 but for a share of 1 / sqrt(n). Fewer than sqrt(n) numbers lie outside, so 64 walks
#: always do up to n = 4,096; beyond it a row needs more of them with a chance under 2 ** -384.
WALKS = 64
#: Rows are numbered in 2 ** BITS ranges of a hash; the numbers don't depend on it.
BITS = 14
#: Equal rows are counted before they move, and laid out again in pieces of at most so many.
PIECE = 65_536


def sides(n: int) -> tuple[int, int]:
    """The sides a and b of the permutation's domain: a * b is at least n, and less than n + a."""
    a = max(isqrt(max(n - 1, 0)) + 1, 1)
    return a, max(-(-n // a), 1)


def round_keys(seed: int) -> list[list[int]]:
    """Four numbers from 1 to PRIME - 1 for each round, from the SHA-256 of seed and round."""
    digests = (hashlib.sha256(f"{seed}:{r}".encode()).digest() for r in range(ROUNDS))
    return [[int.from_bytes(d[i : i + 8], "big") % (PRIME - 1) + 1 for i in (0, 8, 16, 24)] for d in digests]


def _noise(x: Column, k: Column) -> Column:
    u = (x * k.k0 + k.k1) % PRIME
    v = (u * u % PRIME * k.k2 + k.k3) % PRIME
    return v * v % PRIME


def _walk(x: Column, n: int, seed: int, back: bool) -> Column:
    """One pass through all rounds: even ones shift the left side by noise of the right, odd ones the other way."""
    a, b = (F.lit(side).cast("long") for side in sides(n))
    rounds = [F.struct(F.lit(r % 2 == 0).alias("even"), *(F.lit(v).cast("long").alias(f"k{i}") for i, v in enumerate(ks))) for r, ks in enumerate(round_keys(seed))]
    way = -1 if back else 1

    def one(s: Column, k: Column) -> Column:
        left = F.when(k.even, F.pmod(s.l + _noise(s.r, k) * way, a)).otherwise(s.l)
        right = F.when(k.even, s.r).otherwise(F.pmod(s.r + _noise(s.l, k) * way, b))
        return F.struct(left.alias("l"), right.alias("r"))

    start = F.struct(F.call_function("div", x, b).alias("l"), (x % b).alias("r"))
    return F.aggregate(F.array(*rounds[::way]), start, one, lambda s: s.l * b + s.r)


def permuted(x: Column, n: int, seed: int = SEED, back: bool = False) -> Column:
    """Where the permutation of 0 to n - 1 takes x; with back, what it takes to x. Null for null."""
    step = lambda v: _walk(v, n, seed, back)
    outside = lambda v: v >= F.lit(n).cast("long")
    # the inner fold holds one value, so that the first walk isn't worked out twice
    walked = lambda v: F.when(outside(v), F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), v, lambda s, _: F.when(outside(s), step(s)).otherwise(s))).otherwise(v)
    return F.transform(F.array(step(x.cast("long"))), walked)[0]


def numbered(df: DataFrame, number: str = "row_number") -> tuple[DataFrame, int]:
    """df with a global number for each row, 0 to n - 1, and n.

    Numbers follow an order by the MD5 of a row's values and then by the values, so they are the same however the rows
    are stored or dealt out. Ranges of the hash are numbered side by side; the only thing that all share is a table of
    2 ** BITS sums. Rows that are equal in every column are counted before they move, so no row, however often it
    repeats, crowds a task. Nulls and repeated rows count like any other; an empty table has n = 0. Columns need an order,
    so maps are not accepted. A column that is named like `number` is replaced. df is read twice: store what is dear."""
    df = df.drop(number)
    quoted = [f"`{c}`" for c in df.columns]
    values = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in quoted))
    key = F.conv(F.substring(F.md5(values.cast("binary")), 1, 15), 16, 10).cast("long")  # 60 bits
    rows = df.select(F.struct(*map(F.col, quoted)).alias("row"), key.alias("key")).groupBy("key", "row").agg(F.count(F.lit(1)).alias("times"))
    rows = rows.withColumn("part", F.shiftright("key", 60 - BITS))
    sums = stored(rows.groupBy("part").agg(F.sum("times").alias("rows")), "shard-sums")
    n = sums.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first().n
    before = lambda w: F.coalesce(F.sum(w[0]).over(w[1].rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = sums.select("part", before(("rows", Window.orderBy("part"))).alias("ahead"))  # 2 ** BITS rows at most
    placed = rows.join(F.broadcast(ahead), "part").withColumn("first", F.col("ahead") + before(("times", Window.partitionBy("part").orderBy("key", "row"))))
    few = placed.filter(F.col("times") <= PIECE).select("row", "first", "times")
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(PIECE).cast("long")))
    many = placed.filter(F.col("times") > PIECE).select("row", "first", "times", pieces.alias("skip"))
    many = many.select("row", (F.col("first") + F.col("skip")).alias("first"), F.least(F.col("times") - F.col("skip"), F.lit(PIECE)).alias("times")).repartition("first")
    laid = few.unionByName(many).select("row", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("at"))
    return laid.select("row.*", (F.col("first") + F.col("at")).alias(number)), n


def shuffled(df: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """df with row_number, shard (int) and slot (long), as numbered() and permuted() give them.

    Counts of shards differ by one at most and slots run from 0 without gaps. Null texts, repeated rows and empty tables
    need no rules of their own. Columns of these three names are replaced."""
    rows, n = numbered(df.drop("shard", "slot"))
    width = F.lit(shards).cast("long")
    place = rows.withColumn("slot", permuted(F.col("row_number"), n, seed))
    return place.withColumns({"shard": (F.col("slot") % width).cast("int"), "slot": F.call_function("div", F.col("slot"), width)})


def row_at(shard: Column, slot: Column, n: int, shards: int = SHARDS, seed: int = SEED) -> Column:
    """The global row number at a place; null beyond the shard's end."""
    place = slot.cast("long") * shards + shard
    return F.when((place >= 0) & (place < n), permuted(place, n, seed, back=True))


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, files: int | None = None) -> DataFrame:
    """Writes shuffled(df) as Parquet folders shard=0, 1 and so on, each file a run of slots in order, and reads them back.

    Ranges of (shard, slot) make the files, so a shard may have any number of them; `files` is their number in all, that
    of the session's shuffle partitions where None."""
    places = shuffled(df, shards, seed)
    by = ("shard", "slot")
    dealt = places.repartitionByRange(files, *by) if files else places.repartitionByRange(*by)
    dealt.sortWithinPartitions(*by).write.partitionBy("shard").parquet(path)
    return df.sparkSession.read.schema(places.schema).parquet(path)


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and row_number for every row of docs.

    The law is `rows`: counts of shards differ by one at most, whatever texts weigh; equal texts are spread like any
    others, and grown_shard is null. A null text has size 1 and the checksum of an empty one. Texts don't move: a row is
    numbered by its id, size and checksum, and rows with the same three are interchangeable in the result."""
    text = text_of("`text`")
    facts = docs.select(F.col("`doc_id`").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    places = shuffled(stored(facts, "shard-facts"), shards, seed)
    return places.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
