"""Shards by a permutation of row numbers against plain code, and the SQL of the newest queries against DuckDB."""

import hashlib
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfline.llm import queries, sharding

from ..conftest import TESTDATA


def plain_permuted(x, n):
    a, b = sharding.sides(n)
    while True:
        left, right = divmod(x, b)
        for r, (k0, k1, k2, k3) in enumerate(sharding.round_keys(sharding.SEED)):
            noise = lambda t: pow((pow((t * k0 + k1) % sharding.PRIME, 2, sharding.PRIME) * k2 + k3), 2, sharding.PRIME)  # noqa: B023, E731
            left, right = ((left + noise(right)) % a, right) if r % 2 == 0 else (left, (right + noise(left)) % b)
        x = left * b + right
        if x < n:
            return x


def plain_shards(docs, shards=8):
    facts = [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs]
    key = lambda f: (hashlib.md5(":".join("" if v is None else str(v) for v in f).encode()).hexdigest()[:15], f[0] is not None, f[0] or 0, f[1:])
    rows = []
    for i, f in enumerate(sorted(facts, key=key)):
        place = plain_permuted(i, len(facts))
        rows.append((*f, "rows", place % shards, place // shards, None, i))
    return Counter(rows)


COLUMNS = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "row_number")


def got(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect())


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 101, 1000, 4099])
def test_permutation_and_its_inverse(spark, n):
    rows = spark.range(n).select("id", sharding.permuted(F.col("id"), n).alias("p")).withColumn("back", sharding.permuted(F.col("p"), n, back=True)).collect()
    assert sorted(r.p for r in rows) == list(range(n))
    assert all(r.back == r.id and r.p == plain_permuted(r.id, n) for r in rows)


def test_domains_reach_beyond_a_billion_rows(spark):
    n = 3 * 10**12 + 7
    xs = [0, 1, 12345, 10**12, n - 1]
    df = spark.createDataFrame([(x,) for x in xs], "x long").select("x", sharding.permuted(F.col("x"), n).alias("p"))
    for r in df.withColumn("back", sharding.permuted(F.col("p"), n, back=True)).collect():
        assert r.back == r.x and r.p == plain_permuted(r.x, n) < n


def test_against_plain_code(spark, documents, awkward, nameless, empty):
    for docs in (documents, awkward, nameless, awkward.union(awkward), empty):
        assert got(sharding.shard_rows(docs)) == plain_shards(pairs(docs))


def test_rows_that_repeat_more_often_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE", 7)
    docs = spark.createDataFrame([(1, "same")] * 100 + [(i, f"t{i}") for i in range(50)] + [(None, None)] * 30, "doc_id long, text string")
    assert got(sharding.shard_rows(docs)) == plain_shards(pairs(docs))


def test_numbers_do_not_depend_on_how_rows_are_dealt(spark, documents):
    assert got(sharding.shard_rows(documents.repartition(7))) == got(sharding.shard_rows(documents.coalesce(1)))


def test_whole_rows_are_written_and_read_by_place(spark, awkward, tmp_path):
    docs = awkward.withColumn("Shard", F.lit("clash")).withColumn("a.b", F.lit(1))
    n = docs.count()
    back = sharding.write_shards(docs, str(tmp_path / "shards"), shards=3, files=5)
    rows = sorted(back.collect(), key=lambda r: (r.shard, r.slot))
    assert [(r.shard, r.slot) for r in rows] == sorted((p % 3, p // 3) for p in range(n))
    assert Counter((r.doc_id, r.text, r["a.b"]) for r in rows) == Counter((r.doc_id, r.text, 1) for r in awkward.collect())
    places = back.select("row_number", sharding.row_at(F.col("shard"), F.col("slot"), n, 3).alias("at"), sharding.row_at(F.lit(2), F.lit(10**6), n, 3).alias("none"))
    assert all(r.row_number == r["at"] and r.none is None for r in places.collect())


@pytest.mark.parametrize("name", ["op11_spelling", "op12_prefix_trie", "op13_sharding"])
def test_sql(spark, name):
    con = duckdb.connect()
    folder = f"{TESTDATA}/sf0.001"
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    df = queries.QUERIES[name](spark, folder)
    assert sorted(names) == sorted(df.columns)
    assert Counter(map(tuple, df.select(*names).collect())) == Counter(cursor.fetchall())
