"""Near copies by the Jaccard similarity of five-word shingles: SimHash proposes pairs, the real sets decide, and bands of
min-hashes find what SimHash leaves.

Each set of shingles has a SimHash fingerprint. Fingerprints of at most RADIUS differing bits meet in the covering tables
of shelfline.llm.simhash; what they propose is compared by the real sets. At a similarity of 0.8 fingerprints differ in
9.7 of 64 bits on average, so most pairs just above it are beyond any radius that has few tables, and no link may be lost:
the others are found by bands.

With 24 bands of 5 min-hashes a pair at similarity 0.8 shares no band with a chance of (1 - 0.8**5)**24 = 0.00007, and
less above it; no pair below the threshold is linked. In each bucket a hub, the member that meets most others, is compared
with all others first. What that connects needs no more comparisons. The other pairs of a bucket of up to SMALL_BUCKET are
compared one by one; those of a larger one only if they share one of the first shingles that tell them from their hub,
which all that are alike do, see sharing(). The sets of a pair only move if so many of its min-hashes are equal that it can
be alike: of 120, a pair at similarity 0.8 has 66 or fewer equal with a chance below 10**-8."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom_dedup import filter_bits, flag_possible, member_filter
from .common import attach, stored, text_of
from .components import connected_components
from .simhash import SMALL_BUCKET, keep_one, majority
from .simhash import links as fingerprint_links

SHINGLE, ALIKE_PERMILLE = 5, 800
BANDS, ROWS, SEED = 24, 5, 43
#: Bits in which fingerprints may differ that SimHash's covering tables bring together.
RADIUS = 2
#: Equal min-hashes (their last 8 bits) that a pair needs before its sets are compared.
LEAST_EQUAL = 67
#: Sets are alike if they differ in at most this part of their sizes' sum: one in APART. A member of more than one in
#: MOST_HOT pairs is broadcast.
APART, MOST_HOT = (1000 + ALIKE_PERMILLE) // (1000 - ALIKE_PERMILLE), 2000
#: Shingles hashed, and shingles put through the permutations, at once.
AT_ONCE, MIXED_AT_ONCE = 100_000, 2048

_rng = np.random.default_rng(SEED)
_FACTORS = (_rng.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)).astype(np.uint32)
_FLIPS = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles: A-Z lower-cased, words between ASCII white space; fewer words than a
    shingle's are one; a text without words has the single shingle of no words."""
    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts, stops = np.r_[0, ends[:-1] + 1][: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    hashed, parts = xxhash.xxh64_intdigest, []
    for at in range(0, len(starts), AT_ONCE):
        parts.append(np.unique(np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[at : at + AT_ONCE], stops[at : at + AT_ONCE])], np.uint64)))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def set_print(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(values), MIXED_AT_ONCE):
        least = np.minimum(least, ((values[at : at + MIXED_AT_ONCE] ^ _FLIPS) * _FACTORS).min(axis=1))
    return least


def band_keys(least: np.ndarray) -> list[int]:
    return [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _row_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col).cast("long"), F.xxhash64(text_of(text_col)))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tie (a hash of the text), row (a hash of both), print (a hash of the set of shingles), n (their number),
    finger (the SimHash of the set), bands (a key for each) and marks (the last 8 bits of each min-hash) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, counts, fingers, bands, marks = [], [], [], [], []
            for text in batch.column(3).cast(pa.binary()):
                shingles = shingle_set(text.as_buffer().to_pybytes())
                prints.append(set_print(shingles))
                counts.append(len(shingles))
                fingers.append(majority(shingles))
                least = min_hashes(shingles)
                bands += band_keys(least)
                marks.append((least & np.uint32(0xFF)).astype(np.uint8).view(np.int8))
            each = np.arange(len(prints) + 1, dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(each * BANDS), pa.array(_signed(bands)))
            marked = pa.ListArray.from_arrays(pa.array(each * BANDS * ROWS), pa.array(np.concatenate(marks) if marks else np.zeros(0, np.int8)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(_signed(prints)), pa.array(counts, pa.int64()), pa.array(_signed(fingers)), lists, marked], ["doc_id", "tie", "row", "print", "n", "finger", "bands", "marks"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("tie"), _row_key(id_col, text_col).alias("row"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, tie long, row long, print long, n long, finger long, bands array<long>, marks array<tinyint>")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """print, shingles of the rows whose hash is wanted (stored). Texts that a filter of these doesn't let through don't
    move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_buffer().to_pybytes()) for t in batch.column(0).cast(pa.binary())]
            ends = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
            values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_signed([set_print(s) for s in sets])), pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))], ["print", "shingles"])

    bits = filter_bits(wanted.count())
    rows = docs.select(_row_key(id_col, text_col).alias("row"), text_of(text_col).alias("text"))
    rows = flag_possible(rows, "row", stored(member_filter(wanted, "row", bits), "wanted"), bits, "possible").filter("possible").join(wanted, "row", "left_semi")
    return rows.select("text").mapInArrow(run, "print long, shingles array<long>").dropDuplicates(["print"])


def _like_sizes(a: str, b: str):
    """Whether sets of these sizes can be alike enough; exact."""
    return 1000 * F.least(a, b) >= ALIKE_PERMILLE * F.greatest(a, b)


def _beside(pairs: DataFrame, values: DataFrame, value: str, name: str) -> DataFrame:
    """Stored pairs (a, b) with the value of each of both prints, as value_a and value_b; what else pairs have stays. The
    value of a member of very many pairs is broadcast."""
    least, met = max(1, pairs.count() // MOST_HOT), pairs
    for side in ("a", "b"):
        hot = F.broadcast(stored(pairs.groupBy(side).agg(F.count(F.lit(1)).alias("of")).filter(F.col("of") > least).select(side), f"{name}-hot"))
        table = values.select(F.col("print").alias(side), F.col(value).alias(f"{value}_{side}"))
        at_once = met.join(F.broadcast(table.join(hot, side, "left_semi")), side)
        met = at_once.unionByName(met.join(hot, side, "left_anti").join(table, side))
    return met


def _sets_of_pairs(pairs: DataFrame, nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Stored pairs with set_a and set_b; sets_of gives print and shingles for stored row hashes."""
    asked = pairs.select(F.col("a").alias("print")).union(pairs.select("b")).distinct()
    sets = stored(sets_of(stored(nodes.join(asked, "print", "left_semi").select("row"), f"{name}-rows")), f"{name}-sets").withColumnRenamed("shingles", "set")
    return _beside(pairs, sets, "set", name)


def _verified(pairs: DataFrame, nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """The stored pairs (a, b) whose sets are alike."""
    equal = F.aggregate(F.zip_with("marks_a", "marks_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    close = stored(_beside(pairs, nodes, "marks", name).filter(equal >= LEAST_EQUAL).select("a", "b"), f"{name}-close")
    both = F.size(F.array_intersect("set_a", "set_b"))
    met = _sets_of_pairs(close, nodes, sets_of, name)
    return stored(met.filter(1000 * both >= ALIKE_PERMILLE * (F.size("set_a") + F.size("set_b") - both)).select("a", "b"), f"{name}-links")


def _possible(rows: DataFrame, key: str, wanted: DataFrame, name: str) -> DataFrame:
    """rows without most of those whose key is not among that of the stored frame wanted; rows don't move."""
    bits = filter_bits(wanted.count())
    return flag_possible(rows, key, stored(member_filter(wanted, key, bits), name), bits, "possible").filter("possible").drop("possible")


def proposed(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of the prints of nodes (print, n, finger) that SimHash brings together: those of one fingerprint with
    the smallest of them, and the smallest ones of two fingerprints that its covering tables link. Pairs that can't be
    alike by their sizes are left out."""
    fingers = stored(nodes.groupBy("finger").agg(F.min(F.struct("print", "n")).alias("top"), F.count(F.lit(1)).alias("of")), "fingers")
    same = attach(nodes.select("print", "n", "finger"), fingers, "finger", "of", nodes.count()).select(F.struct("print", "n").alias("a"), F.col("top").alias("b"))
    tops = fingers.select("finger", "top")
    near = fingerprint_links(fingers.select(F.col("finger").alias("print")), RADIUS)
    near = near.join(tops.toDF("a", "top_a"), "a").join(tops.toDF("b", "top_b"), "b").select(F.col("top_a").alias("a"), F.col("top_b").alias("b"))
    pairs = same.union(near).filter((F.col("a.print") != F.col("b.print")) & _like_sizes("a.n", "b.n"))
    return pairs.select(F.least("a.print", "b.print").alias("a"), F.greatest("a.print", "b.print").alias("b"))


def sharing(crowds: DataFrame, differing: DataFrame) -> DataFrame:
    """Pairs (a, b) of the members of each crowd (hub, print, n, root, of one row each) that may be alike and have other
    roots. differing: a stored row for each hub and print with both sets, set_b the hub's.

    What tells sets X and Y from their hub H differs in as much as they do, so X and Y, of d(X) and d(Y) such shingles,
    share at least (d(X) + d(Y) - (|X| + |Y|) / APART) / 2 of these if they are alike. Two that are both alike to the hub
    have one root, so one, X, is not: d(X) > (|X| + |H|) / APART, and more than (d(Y) + (|H| - |Y|) / APART) / 2 are
    shared, and at least (d(X) - (|X| + |H|) / APART) / 2. In one order of shingles the first that they share is among
    all but that many, less one, of either side. What the hub lacks comes first, since copies of a text have little of
    that in common. Exact."""
    own = F.concat(F.sort_array(F.array_except("set_a", "set_b")), F.sort_array(F.array_except("set_b", "set_a")))
    told = differing.select(F.col("b").alias("hub"), F.col("a").alias("print"), own.alias("own"), F.size("set_a").alias("of_set"), F.size("set_b").alias("of_hub"))
    d = F.size("own")
    far = APART * d - F.col("of_set") - F.col("of_hub")
    told = told.withColumn("as_x", F.when(far > 0, d - F.floor((far - 1) / (2 * APART))).otherwise(0)).withColumn("as_y", d - F.floor((APART * d + F.col("of_hub") - F.col("of_set")) / (2 * APART)))
    first = F.slice("own", F.lit(1), F.greatest("as_x", "as_y").cast("int"))
    told = stored(told.select("hub", "print", "as_x", "as_y", F.posexplode(first).alias("at", "own")), "told")
    met = told.groupBy("hub", "own").agg(F.count(F.lit(1)).alias("of")).filter("of > 1").select("hub", "own")
    named = stored(told.join(met, ["hub", "own"]).join(crowds, ["hub", "print"]), "shared")
    x, y = (named.filter(F.col("at") < F.col(f"as_{s}")).select("hub", "own", *(F.col(c).alias(f"{c}_{s}") for c in ("print", "n", "root"))) for s in "xy")
    pairs = x.join(y, ["hub", "own"]).filter((F.col("root_x") != F.col("root_y")) & _like_sizes("n_x", "n_y"))
    return pairs.select(F.least("print_x", "print_y").alias("a"), F.greatest("print_x", "print_y").alias("b"))


def links(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) among the prints of rows, the stored sketches of docs, enough to connect all that are alike. What SimHash
    and the hubs of buckets connect needs no more comparisons."""
    nodes = stored(rows.groupBy("print").agg(F.first("n").alias("n"), F.first("finger").alias("finger"), F.min(F.struct("row", "bands", "marks")).alias("top")).select("print", "n", "finger", "top.row", "top.bands", "top.marks"), "nodes")
    keyed = nodes.select("print", "n", F.explode("bands").alias("bucket"))
    met = stored(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
    places = stored(_possible(keyed, "bucket", met, "met"), "places")
    members = stored(attach(places, met, "bucket", "size", places.count()).filter("size is not null"), "members")
    # the hub is the member that meets most others: of copies of a text that is the text, if it is there; hubs of large
    # buckets give way to the strongest that they meet, so that a crowd has few
    weights = members.groupBy("print").agg(F.sum("size").alias("weight"))
    hubs = members.join(weights, "print").groupBy("bucket", "size").agg(F.max(F.struct("weight", "print", "n")).alias("top"))
    hubs = stored(hubs, "hubs")
    large = hubs.filter(F.col("size") > SMALL_BUCKET)
    met_by = members.join(large.select(F.col("top.print").alias("print")).distinct(), "print", "left_semi").drop("size").join(hubs, "bucket")
    tops = met_by.groupBy(F.col("print").alias("was")).agg(F.max("top").alias("leader"))
    led_by = large.join(tops, F.col("top.print") == F.col("was")).select("bucket", "size", F.col("leader").alias("top")).union(hubs.filter(F.col("size") <= SMALL_BUCKET).select("bucket", "size", "top"))
    hubs = stored(led_by.select("bucket", "size", F.col("top.print").alias("hub"), F.col("top.n").alias("hub_n")), "hubs")
    led = stored(attach(members.drop("size"), hubs, "bucket", "size", members.count()).filter("print <> hub"), "led")
    sets_of = lambda wanted: _sets(docs, wanted, id_col, text_col)

    at_hubs = led.filter(_like_sizes("n", "hub_n")).select(F.least("print", "hub").alias("a"), F.greatest("print", "hub").alias("b"))
    pairs = stored(proposed(nodes).union(at_hubs).distinct(), "pairs")
    meeting = stored(members.select("print").union(pairs.select("a")).union(pairs.select("b")).distinct(), "meeting")
    nodes = stored(_possible(nodes.select("print", "row", "marks"), "print", meeting, "met"), "nodes")
    first = _verified(pairs, nodes, sets_of, "led")
    roots = connected_components(first)
    rooted = led.select("bucket", "size", "hub", "print", "n").join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    rooted = stored(rooted, "rooted_members")

    def mixed(groups: DataFrame, by: str) -> DataFrame:
        some = groups.groupBy(by).agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select(by)
        return stored(groups.join(some, by, "left_semi"), "open")

    small = mixed(rooted.filter(F.col("size") <= SMALL_BUCKET), "bucket")
    a, b = (small.select("bucket", *(F.col(c).alias(f"{c}_{s}") for c in ("print", "n", "root"))) for s in "ab")
    rest = a.join(b, "bucket").filter((F.col("print_a") < F.col("print_b")) & (F.col("root_a") != F.col("root_b")) & _like_sizes("n_a", "n_b")).select(F.col("print_a").alias("a"), F.col("print_b").alias("b"))
    crowds = mixed(rooted.filter(F.col("size") > SMALL_BUCKET).select("hub", "print", "n", "root").distinct(), "hub")
    if crowds.limit(1).count():
        of_hubs = stored(crowds.select(F.col("print").alias("a"), F.col("hub").alias("b")), "crowds")
        rest = rest.union(sharing(crowds, _sets_of_pairs(of_hubs, nodes, sets_of, "crowds")))
    return first.union(_verified(stored(rest.distinct(), "pairs"), nodes, sets_of, "rest"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each class of near copies, all columns kept: those that a chain of pairs at similarity
    0.8 or more connects. Which stays, and what becomes of null ids and equal rows, is as in simhash.one_of_each. Null
    and empty texts are one class, and an empty table stays empty."""
    rows = stored(sketches(docs, id_col, text_col), "sketches")
    return keep_one(docs, rows, lambda _: links(docs, rows, id_col, text_col), id_col, text_col)
