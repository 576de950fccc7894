"""Exact dedup by two passes over a Bloom filter, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, fresh_path, stored, text_of

#: The filter's bits: 16 for each row as a power of two, within these bounds. The upper bound (64 MB) is what makes the
#: broadcast safe. More rows are dealt by their digest into slices that have a filter of their own each.
LEAST_BITS, MOST_BITS, BITS_PER_ROW = 1 << 15, 1 << 29, 16
_CHUNK = 1 << 15  # bits of one bitmap_construct_agg value


def filter_bits(n_rows: int) -> int:
    wanted = max(1, BITS_PER_ROW * n_rows - 1).bit_length()
    return min(MOST_BITS, max(LEAST_BITS, 1 << wanted))


def slices(n_rows: int) -> int:
    """How many filters n_rows need, so that each keeps BITS_PER_ROW."""
    return max(1, -(-BITS_PER_ROW * n_rows // MOST_BITS))


def _positions(digest: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(digest, F.lit(i)), F.lit(bits)) for i in range(2)]


def repeat_filter(hashed: DataFrame, digest: str, bits: int) -> DataFrame:
    """First pass: a Bloom filter of the positions that two or more rows set, as (chunk, bitmap) rows of 4 KB. Positions
    of one partition are counted before they move, and what moves is a number of a few bytes for each; whole bitmaps of
    every partition would be the filter's size times the number of partitions."""
    at = hashed.select(F.explode(F.array(*_positions(F.col(digest), bits))).alias("bit"))
    return _bitmaps(at.groupBy("bit").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))


def member_filter(hashed: DataFrame, digest: str, bits: int) -> DataFrame:
    """A plain Bloom filter of the digests, in the same form."""
    return _bitmaps(hashed.select(F.explode(F.array(*_positions(F.col(digest), bits))).alias("bit")))


def _bitmaps(positions: DataFrame) -> DataFrame:
    return positions.groupBy((F.col("bit") / _CHUNK).cast("long").alias("chunk")).agg(
        F.bitmap_construct_agg(F.pmod("bit", F.lit(_CHUNK))).alias("bitmap")
    )


def without(docs: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """docs without the rows whose keys are in dropped (a stored frame with the same key columns; null equals null).
    Only rows that a Bloom filter of dropped lets through are joined; the rest pass straight through."""
    n = dropped.count()
    if not n:
        return docs
    columns, bits = docs.columns, filter_bits(n)
    digest, flag = (next(x for x in (f"{a}{'_' * i}" for i in range(99)) if x not in columns) for a in ("digest", "possible"))
    seen = stored(member_filter(dropped.withColumn(digest, F.xxhash64(*keys)), digest, bits), "dropped")
    flagged = flag_possible(docs.withColumn(digest, F.xxhash64(*keys)), digest, seen, bits, flag)
    gone = dropped.select(*(F.col(k).alias(f"{flag}_{k}") for k in keys))
    same = [F.col(k).eqNullSafe(F.col(f"{flag}_{k}")) for k in keys]
    stay = flagged.filter(flag).join(gone, same, "left_anti")
    return flagged.filter(~F.col(flag)).select(columns).unionByName(stay.select(columns))


def _is_set(bitmap: Column, bit: Column) -> Column:
    within = F.pmod(bit, F.lit(_CHUNK)).cast("int")
    octet = F.conv(F.hex(F.substring(bitmap, (within / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(octet, F.pmod(within, F.lit(8))) == 1, F.lit(False))


def flag_possible(rows: DataFrame, digest: str, repeats: DataFrame, bits: int, flag: str) -> DataFrame:
    """Second pass: adds the flag column, false only where no other row can have the digest. The filter is
    broadcast (MOST_BITS at most); rows don't move."""
    for i, position in enumerate(_positions(F.col(digest), bits)):
        chunk, bitmap, hit = (f"{flag}_{x}{i}" for x in ("chunk", "bitmap", "hit"))
        part = F.broadcast(repeats.select(F.col("chunk").alias(chunk), F.col("bitmap").alias(bitmap)))
        rows = (
            rows.withColumn(chunk, (position / _CHUNK).cast("long"))
            .join(part, chunk, "left")
            .withColumn(hit, _is_set(F.col(bitmap), position))
            .drop(chunk, bitmap)
        )
    return rows.withColumn(flag, F.col(f"{flag}_hit0") & F.col(f"{flag}_hit1")).drop(f"{flag}_hit0", f"{flag}_hit1")


def flag_repeats(rows: DataFrame, digest: str, n: int, flag: str) -> DataFrame:
    """The n stored rows with the flag of flag_possible(), stored. Beyond one filter's bits they are dealt into slices by
    a hash of the digest, written so that each slice is read by itself, and a slice at a time passes its own filter."""
    spark, many = rows.sparkSession, slices(n)
    if many == 1:
        bits = filter_bits(n)
        return stored(flag_possible(rows, digest, stored(repeat_filter(rows, digest, bits), "repeats"), bits, flag), "flagged")
    dealt, out = fresh_path(spark, "slices"), fresh_path(spark, "flagged")
    part = next(x for x in (f"slice{'_' * i}" for i in range(99)) if x not in rows.columns)
    kept = rows.withColumn(part, F.pmod(F.xxhash64(F.lit(many), digest), F.lit(many)).cast("int"))
    kept.write.partitionBy(part).parquet(dealt)
    table = spark.read.schema(kept.schema).parquet(dealt)
    for i in range(many):
        own = table.filter(F.col(part) == i).drop(part)
        bits = filter_bits(-(-n // many))
        flag_possible(own, digest, stored(repeat_filter(own, digest, bits), "repeats"), bits, flag).write.mode("append").parquet(out)
    return spark.read.parquet(out)


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty; of equal texts the row with the largest doc_id stays (null
    is the smallest). Of rows equal in doc_id and text exactly one stays. Other columns are not read. An empty table
    gives an empty result."""
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.unhex(F.sha2(text_of(text_col), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    n = rows.count()
    flagged = flag_repeats(rows, "digest", n, "possible")
    whole = F.struct("doc_id", "row")
    possible = flagged.filter("possible").drop("possible")
    groups = stored(
        possible.groupBy("digest").agg(F.max(whole).alias("keep"), F.count(F.lit(1)).alias("group_size")), "groups"
    )
    grouped = attach(possible, groups, "digest", "group_size", n).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (whole == F.col("keep")).alias("kept"),
        "digest",
    )
    alone = flagged.filter(~F.col("possible")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest"
    )
    return alone.unionByName(grouped).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without repeated texts, all columns kept. The two passes over digests find the repeated ones; rows that a
    filter of these doesn't let through pass straight, only the others meet their group. (That filter has MOST_BITS at
    most: beyond some 30 million repeated texts more rows meet groups, with the same result.) Nulls, ties and empty tables as in decide(); which of several rows equal
    in doc_id and text stays is not fixed where their other columns differ."""
    columns = docs.columns
    digest, flag, keep, size = (next(x for x in (f"{a}{'_' * i}" for i in range(99)) if x not in columns) for a in ("digest", "possible", "keep_id", "group_size"))
    hashed = docs.withColumn(digest, F.unhex(F.sha2(text_of(text_col), 256)))
    rows = stored(hashed.select(F.col(id_col).alias("id"), F.col(digest).alias("digest")), "digests")
    n = rows.count()
    groups = stored(
        flag_repeats(rows, "digest", n, "possible")
        .filter("possible")
        .groupBy(F.col("digest").alias(digest))
        .agg(F.max("id").alias(keep), F.count(F.lit(1)).alias(size))
        .filter(F.col(size) > 1),
        "groups",
    )
    bits = filter_bits(groups.count())
    flagged = flag_possible(hashed, digest, stored(member_filter(groups, digest, bits), "repeated"), bits, flag)
    met = attach(flagged.filter(flag), groups, digest, size, n)
    first = met.filter(F.col(size).isNotNull() & F.col(id_col).eqNullSafe(F.col(keep))).dropDuplicates([id_col, digest])
    stay = met.filter(F.col(size).isNull()).unionByName(first)
    return flagged.filter(~F.col(flag)).select(columns).unionByName(stay.select(columns))
