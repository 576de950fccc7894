"""SimHash fingerprints of word shingles, linked by covering locality-sensitive hashing.

A table keeps some of a fingerprint's 64 bits. Which ones is set by a code: bit i has a nonzero vector of radius + 1
bits, and the table of vector v keeps the bits whose vector has an odd product with v. Any `radius` bits leave a v that
has an even product with all their vectors, so two fingerprints that differ in these bits only are equal in that table:
every pair within the radius meets in one of 2**(radius + 1) - 1 tables, with certainty."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom_dedup import without
from .common import attach, stored, text_of
from .components import connected_components

BITS, SEED = 64, 42
#: Shingles hashed at once, which bounds a task's memory for very long texts.
AT_ONCE = 100_000
#: Buckets up to this many fingerprints are compared pair by pair; larger ones meet at midpoints.
SMALL_BUCKET = 32


def covering_masks(radius: int) -> list[int]:
    width = radius + 1
    code = [i % ((1 << width) - 1) + 1 for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (code[i] & v).bit_count() % 2) for v in range(1, 1 << width)]


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the given 64-bit hashes."""
    totals = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), AT_ONCE):
        octets = hashes[at : at + AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        totals += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * totals > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """A-Z lower-cased, words between ASCII white space, shingles of words with repeats (fewer words: all of them; none:
    0); a bit is set if it is in over half of the shingles' XXH64."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - shingle + 1)
    stops = ends[-n:].tolist()
    starts = begins[:n].tolist()
    hashed, totals = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, AT_ONCE):
        part = [hashed(joined[a:b], SEED) for a, b in zip(starts[at : at + AT_ONCE], stops[at : at + AT_ONCE])]
        octets = np.array(part, "<u8").view(np.uint8).reshape(-1, 8)
        totals += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * totals > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, print (the fingerprint as a signed long), tie (a hash of the text) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_buffer().to_pybytes(), shingle) for t in batch.column(2).cast(pa.binary())], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], ["doc_id", "tie", "print"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("tie"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, tie long, print long")


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) among the distinct values of column print, enough to connect all that are within the radius.

    Fingerprints of a small bucket are compared with each other. Members of larger buckets are not: each names all
    values within half the radius of it, and those that name the same value are linked to the smallest of them. For a
    radius of 2 that is every pair within it, with 65 rows a fingerprint whatever a bucket's size."""
    if radius not in (1, 2):
        raise ValueError("radius 1 or 2")
    keyed = prints.select(
        "print", F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("print").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64))).alias("key")) for t, m in enumerate(covering_masks(radius))))).alias("k")
    ).select("print", F.struct("k.t", "k.key").alias("bucket"))
    met = stored(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
    n = prints.count()
    members = stored(attach(keyed, met, "bucket", "size", n * (2 ** (radius + 1) - 1)).filter("size is not null"), "members")

    near = F.filter("all", lambda x: (x > F.col("a")) & (F.bit_count(x.bitwiseXOR(F.col("a"))) <= radius))
    small = (
        members.filter(F.col("size") <= SMALL_BUCKET)
        .groupBy("bucket")
        .agg(F.collect_list("print").alias("all"))
        .select(F.explode("all").alias("a"), "all")
        .select("a", F.explode(near).alias("b"))
    )
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(BITS)))
    crowded = members.filter(F.col("size") > SMALL_BUCKET).select("print").distinct()
    middles = crowded.select("print", F.explode(flips).alias("flip")).select("print", F.col("print").bitwiseXOR(F.col("flip")).alias("middle"))
    large = (
        middles.groupBy("middle")
        .agg(F.collect_list("print").alias("all"))  # 65 at most
        .filter(F.size("all") > 1)
        .select(F.array_min("all").alias("a"), F.explode("all").alias("b"))
        .filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
    )
    return small.union(large)


def _classes(rows: DataFrame, link: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, int]:
    """Of stored fingerprint rows: a row for each fingerprint with the root it reaches, its documents' number and
    smallest (doc_id, tie); a row for each root with the smallest of all; and the number of rows."""
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "tie")))
    distinct = stored(rows.groupBy("print").agg(F.count(F.lit(1)).alias("copies"), least.alias("first")), "prints")
    roots = connected_components(link(distinct))
    by_print = stored(
        distinct.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print")), "rooted"
    )
    tops = stored(by_print.groupBy("root").agg(F.min("first").alias("top"), F.count(F.lit(1)).alias("prints"), F.sum("copies").alias("docs")), "tops")
    return by_print, tops, rows.count()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links of
    at most `radius` bits reach, itself included). Fingerprints meet in covering tables; those of buckets with over
    SMALL_BUCKET of them meet at the values within half the radius instead, which loses no link either.

    Null texts count as empty, with fingerprint zero, and link like any other. A null doc_id is no component_id, but
    its row links others; a component of null doc_ids only has component_id null. Repeated rows give repeated results,
    an empty table an empty one."""
    rows = stored(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    by_print, tops, n = _classes(rows, lambda prints: links(prints, radius))
    table = stored(attach(by_print, tops, "root", "prints", by_print.count()).select("print", "copies", F.col("top.doc_id").alias("component_id")), "classes")
    named = attach(rows, table, "print", "copies", n)
    return named.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, all columns kept: the smallest doc_id, of equal ones the smallest text
    hash. Rows equal in both are one document and stay or go together. Rows with a null doc_id stay, as nothing names
    them. Null texts are like empty ones, which are linked with each other; an empty table stays empty."""
    rows = stored(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    return keep_one(docs, rows, lambda prints: links(prints, radius), id_col, text_col)


def keep_one(docs: DataFrame, rows: DataFrame, link: Callable[[DataFrame], DataFrame], id_col: str, text_col: str) -> DataFrame:
    """docs with one document of each component that link makes of the distinct values of print; rows: doc_id, tie and
    print of docs, stored."""
    by_print, tops, n = _classes(rows, link)
    table = stored(attach(by_print, tops, "root", "prints", by_print.count()).filter("docs > 1").select("print", "copies", "top"), "classes")
    grouped = attach(rows, table, "print", "copies", n).filter("top is not null and doc_id is not null")
    dropped = stored(grouped.filter(F.struct("doc_id", "tie") != F.col("top")).select("doc_id", "tie").distinct(), "near_copies")
    columns = docs.columns
    tie, key = (next(x for x in (f"{a}{'_' * i}" for i in range(99)) if x not in columns) for a in ("tie", "key"))
    keyed = docs.withColumn(key, F.col(id_col).cast("long")).withColumn(tie, F.xxhash64(text_of(text_col)))
    left = without(keyed, dropped.select(F.col("doc_id").alias(key), F.col("tie").alias(tie)), [key, tie])
    return left.select(columns)
