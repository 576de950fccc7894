"""The trie of conversation prefixes: what conversations share, counted by passing messages from leaves to the root.

A node is a distinct sequence of first turns. Nodes with the same smallest member form one downward run of the trie, as
that member takes part in all of them; so runs, of which there are as many as distinct conversations, do the peeling: each
holds a counter of the runs that branch off it, a run whose counter is 0 is complete and sends its totals to the node it
branches off, and rounds go on until the root's run is complete. Within a run the totals of its nodes are running sums."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, fresh_path, stored

#: Conversations are rebuilt in families of FAMILY ids; the first of a family lends up to MOST_LENT - 1 turns.
FAMILY, MOST_LENT = 5, 9
#: Rows, or characters of text, of an Arrow batch that leaves a task.
ROWS_AT_ONCE, CHARS_AT_ONCE = 20_000, 4_000_000
#: Bytes of joined ids in a row on the way to their hash.
BLOB = 65_536

TURNS = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("role", pa.string()), ("text", pa.string())])
STEPS = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("bytes", pa.int64()), ("ends", pa.bool_())])
ROOT = hashlib.blake2b(b"", digest_size=16).digest()


def _batches(rows: Iterable[tuple], schema: pa.Schema, weight=lambda row: 0) -> Iterator[pa.RecordBatch]:
    held, heavy = [], 0
    for row in rows:
        held.append(row)
        heavy += weight(row)
        if len(held) >= ROWS_AT_ONCE or heavy >= CHARS_AT_ONCE:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, heavy = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _values(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _in_order(conversations: DataFrame, *before: Column) -> list[Column]:
    return [*before, F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def _clean(conversations: DataFrame) -> DataFrame:
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c)
    return conversations.select(F.col("`conv_id`").cast("long").alias("conv_id"), F.col("`turn`").alias("turn"), empty("role"), empty("text")).filter("conv_id IS NOT NULL")


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, at, role and text of each turn, at counting from 1, and a row at 0 for each conversation. A conversation's
    rows lie in one partition in their order, as steps() needs them.

    Turns go by turn, null first, then by role and text; null roles and texts become empty; rows without a conv_id belong
    to no conversation."""
    dealt = _clean(conversations).repartition("conv_id").sortWithinPartitions(*_in_order(conversations))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            last, at = None, 0
            for conv, _, role, text in _values(batches):
                if conv != last:
                    yield conv, 0, "", ""
                    last, at = conv, 0
                at += 1
                yield conv, at, role, text

        yield from _batches(rows(), TURNS, lambda r: len(r[3]))

    return dealt.mapInArrow(count, "conv_id long, at long, role string, text string")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """turns_of() after each conversation c has traded its first turns for those of conversation c - c % 5.

    h, the unsigned crc32 of the decimal c modulo 9, says how many: the first h turns of the family's first (all if
    fewer, none if it's absent), then c's own turns after its first h. Families, of nine ids at most, are dealt out whole,
    the lender first; of a family a task holds only the lender's first eight turns."""
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    rows = _clean(conversations).withColumn("family", family)
    dealt = rows.repartition("family").sortWithinPartitions(*_in_order(conversations, F.col("family"), F.col("conv_id") != F.col("family")))

    def trade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            lent_by, lent, last = None, [], None
            lends = h = own = at = 0
            for conv, _, role, text, family in _values(batches):
                if conv != last:
                    if family != lent_by:
                        lent_by, lent = family, []
                    last, lends, own, at = conv, conv == family, 0, 0
                    h = 0 if lends else zlib.crc32(b"%d" % conv) % MOST_LENT
                    yield conv, 0, "", ""
                    for at, (r, t) in enumerate(lent[:h], 1):
                        yield conv, at, r, t
                own += 1
                if lends and own < MOST_LENT:
                    lent.append((role, text))
                if own > h:
                    at += 1
                    yield conv, at, role, text

        yield from _batches(rows(), TURNS, lambda r: len(r[3]))

    return dealt.mapInArrow(trade, "conv_id long, at long, role string, text string")


def steps(turns: DataFrame) -> DataFrame:
    """Each conversation's way from the root: depth, the 128-bit names of its node and the node above, UTF-8 bytes of the
    last text, and whether the conversation ends there. A name is a hash of the name above, role and text."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            held = None
            for conv, at, role, text in _values(batches):
                if held:
                    yield *held, at == 0
                if at == 0:
                    held = conv, 0, ROOT, None, 0
                else:
                    role, text = role.encode(), text.encode()
                    above = held[2]
                    held = conv, at, hashlib.blake2b(above + len(role).to_bytes(8, "big") + role + text, digest_size=16).digest(), above, len(text)
            if held:
                yield *held, True

        yield from _batches(rows(), STEPS)

    return turns.mapInArrow(walk, "conv_id long, depth long, node binary, parent binary, bytes long, ends boolean")


def ids_hashed(ends: DataFrame) -> DataFrame:
    """node and ends_sha256: the SHA-256 of the decimal conv_ids of a node, ascending, with commas between.

    Ids are joined in pieces of up to BLOB bytes wherever a range partition has them, so a node with many ends spans
    tasks; only pieces meet, and one after the other they run through one hash."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            node, first, ids, held = None, None, [], 0
            for conv, name in _values(batches):
                if ids and (name != node or held >= BLOB):
                    yield node, first, ",".join(ids)
                    ids, held = [], 0
                if not ids:
                    node, first = name, conv
                ids.append(str(conv))
                held += len(ids[-1]) + 1
            if ids:
                yield node, first, ",".join(ids)

        yield from _batches(rows(), pa.schema([("node", pa.binary()), ("first", pa.int64()), ("ids", pa.string())]), lambda r: len(r[2]))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            node, sha = None, None
            for name, _, ids in _values(batches):
                if name != node:
                    if sha:
                        yield node, sha.hexdigest()
                    node, sha = name, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if sha:
                yield node, sha.hexdigest()

        yield from _batches(rows(), pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())]))

    dealt = ends.select("conv_id", "node").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = dealt.mapInArrow(join, "node binary, first long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digest, "node binary, ends_sha256 string")


def _nodes(walks: DataFrame) -> DataFrame:
    """One row a node: its counts, the hash of who ends there and the node above's smallest member."""
    named = walks.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("bytes").alias("bytes")
    )
    nodes = stored(named, "trie-nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    hashed = ids_hashed(walks.filter("ends"))
    known = nodes.join(children, "node", "left").join(hashed, "node", "left").na.fill(0, ["n_children"]).na.fill(hashlib.sha256().hexdigest(), ["ends_sha256"])
    known = stored(known, "trie-known")
    above = known.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    return stored(attach(known.withColumnRenamed("n_children", "own_children"), above, "parent", "n_children", known.count()).withColumn("n_children", F.col("own_children")).drop("own_children"), "trie-above")


def _peeled(runs: DataFrame) -> DataFrame:
    """The runs with the totals of all that hangs on them. runs: conv_id, up (null for the root's run), leaves, saved.

    Rounds take as many passes as runs hang below one another at most, and each reads only what isn't complete."""
    spark = runs.sparkSession
    below = runs.filter("up IS NOT NULL").groupBy(F.col("up").alias("conv_id")).agg(F.count(F.lit(1)).alias("pending"))
    runs = runs.join(below, "conv_id", "left").na.fill(0, ["pending"])
    paths = []
    while True:
        paths.append(fresh_path(spark, "trie-runs"))
        runs.write.parquet(paths[-1])
        now = spark.read.schema(runs.schema).parquet(paths[-1])
        waiting = now.filter("pending > 0")
        if waiting.isEmpty():
            return spark.read.schema(runs.schema).parquet(*paths).filter("pending = 0")
        sent = now.filter("pending = 0").groupBy(F.col("up").alias("conv_id")).agg(F.count(F.lit(1)).alias("came"), F.sum("leaves").alias("leaves_"), F.sum("saved").alias("saved_"))
        added = waiting.join(sent, "conv_id", "left").na.fill(0, ["came", "leaves_", "saved_"])
        runs = added.select("conv_id", "top", "up", (F.col("leaves") + F.col("leaves_")).alias("leaves"), (F.col("saved") + F.col("saved_")).alias("saved"), (F.col("pending") - F.col("came")).alias("pending"))


def trie(turns: DataFrame) -> DataFrame:
    """The trie of conversations laid out as turns_of() or rebuilt() gives them, one row a node.

    conv_id is the smallest member, depth the number of turns, parent_conv_id the node above's conv_id (null at the root),
    n_convs the members, n_children the nodes right below, n_leaves the childless nodes of the subtree, saved_tokens the
    bytes of last texts that members after a node's first need not store again, summed over the subtree, and ends_sha256 the
    hash of who ends there. Repeated conversations are members of the same nodes; without conversations there is no node."""
    nodes = _nodes(stored(steps(turns), "trie-steps"))
    leaf, saved = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), (F.col("n_convs") - 1) * F.col("bytes")
    own = nodes.select("conv_id", "depth", leaf.alias("leaves"), saved.alias("saved"), F.struct("parent_conv_id", "n_convs", "n_children", "ends_sha256").alias("node"))
    runs = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.min_by("parent_conv_id", "depth").alias("up"), F.sum(leaf).alias("leaves"), F.sum(saved).alias("saved"))
    sent = _peeled(runs).filter("up IS NOT NULL").groupBy(F.col("up").alias("conv_id"), (F.col("top") - 1).alias("depth")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    # a run's nodes and what was sent to them, summed from its end upwards
    upwards = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = own.unionByName(sent, allowMissingColumns=True).withColumns({"n_leaves": F.sum("leaves").over(upwards), "saved_tokens": F.sum("saved").over(upwards)}).filter("node IS NOT NULL")
    return sums.select("conv_id", "depth", "node.parent_conv_id", "node.n_convs", "node.n_children", "n_leaves", "saved_tokens", "node.ends_sha256")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """trie() of the rebuilt conversations; other columns of the table are not looked at."""
    return trie(rebuilt(conversations))
