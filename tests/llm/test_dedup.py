"""Exact, substring and near dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from shelfline.llm import bloom_dedup, simhash, substring_dedup
from shelfline.llm.components import connected_components

from .conftest import SCHEMA, pairs_of, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = ["awkward", "documents", "nameless", "empty"]


def least(d):
    return (d is not None, d if d is not None else 0)


@pytest.mark.parametrize("name", KINDS)
def test_exact_dedup(request, name):
    docs = request.getfixturevalue(name)
    groups = defaultdict(list)
    for d, t in pairs_of(docs):
        groups[t].append(d)
    want = Counter()
    for t, ids in groups.items():
        keep = max(ids, key=least)
        for i, d in enumerate(sorted(ids, key=least)):
            want[d, keep, len(ids), i == len(ids) - 1, hashlib.sha256(t.encode()).hexdigest()] += 1
    got = bloom_dedup.decide(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert Counter(map(tuple, got.collect())) == want


@pytest.mark.parametrize("name", KINDS)
def test_distinct_documents(request, name):
    docs = request.getfixturevalue(name)
    groups = defaultdict(list)
    for d, t in pairs_of(docs):
        groups[t].append(d)
    kept = bloom_dedup.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert Counter(pairs_of(kept)) == Counter((max(ids, key=least), t) for t, ids in groups.items())


def test_a_crowded_filter_gives_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(rows_of([(i, f"text {i % 700}") for i in range(1500)]), SCHEMA)
    want = Counter(map(tuple, bloom_dedup.decide(docs).collect()))
    monkeypatch.setattr(bloom_dedup, "filter_bits", lambda n: 1 << 10)
    monkeypatch.setattr(bloom_dedup, "_CHUNK", 1 << 10)
    assert Counter(map(tuple, bloom_dedup.decide(docs).collect())) == want


@pytest.mark.parametrize("name", KINDS)
def test_slices_with_a_filter_each_give_the_same(request, monkeypatch, name):
    docs = request.getfixturevalue(name)
    want = [Counter(map(tuple, f(docs).select("doc_id", x).collect())) for f, x in ((bloom_dedup.decide, "keep_id"), (bloom_dedup.distinct_documents, "text"))]
    monkeypatch.setattr(bloom_dedup, "slices", lambda n: 5)
    assert [Counter(map(tuple, f(docs).select("doc_id", x).collect())) for f, x in ((bloom_dedup.decide, "keep_id"), (bloom_dedup.distinct_documents, "text"))] == want


def test_slices_keep_the_filter_dilute():
    for n in (0, 1, 10**6, 10**8, 10**10):
        assert n <= bloom_dedup.slices(n) * bloom_dedup.MOST_BITS / bloom_dedup.BITS_PER_ROW


def test_most_rows_pass_straight_through(spark):
    rows = spark.range(20_000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    bits = bloom_dedup.filter_bits(20_000)
    flagged = bloom_dedup.flag_possible(rows, "digest", bloom_dedup.repeat_filter(rows, "digest", bits), bits, "possible")
    assert flagged.filter("possible").count() < 1000


def plain_repeats(pairs, window=20):
    """Kept words by comparing all windows; pairs in the order of documents."""
    seen, out = set(), []
    for d, t in pairs:
        words = WORD.findall(t)
        gone = set()
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone.update(range(i, i + window))
            seen.add(w)
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((d, len(words), len(words) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def substring_rows(docs):
    return Counter(tuple(r)[:4] for r in substring_dedup.remove_repeats(docs).collect())


def test_substring_dedup_of_documents(documents):
    assert substring_rows(documents) == Counter(plain_repeats(sorted(pairs_of(documents))))


def test_substring_dedup_of_passages_lines_and_loops(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(18, 70))] for _ in range(8)]
    pairs = []
    for d in range(300):
        words = []
        for _ in range(rng.randint(0, 4)):
            part = list(rng.choice(passages))
            if rng.random() < 0.4:
                part[rng.randrange(len(part))] = "changed"
            a = rng.randrange(len(part))
            words += part[a:] if rng.random() < 0.3 else part
            words += [rng.choice(vocabulary) for _ in range(rng.randint(0, 5))]
        if d % 50 == 3:
            words += ["same"] * rng.randint(15, 80)
        if d % 50 == 4:
            words += ["tic", "tac"] * 40
        pairs.append((d * 3, rng.choice([" ", "\n", "\t "]).join(words)))
    docs = spark.createDataFrame(rows_of(pairs), SCHEMA).repartition(6)
    assert substring_rows(docs) == Counter(plain_repeats(pairs))


@pytest.mark.parametrize("name", ["awkward", "nameless", "empty"])
def test_substring_dedup_of_odd_rows(request, name):
    """Rows equal in doc_id and text are one document; else the order is doc_id, null first, then a hash of the text."""
    docs = request.getfixturevalue(name)
    ties = {(r.doc_id, r.text or ""): r.tie_ for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie_")).collect()}
    order = sorted(ties, key=lambda p: (*least(p[0]), ties[p]))
    each = {p: row for p, row in zip(order, plain_repeats(order))}
    assert substring_rows(docs) == Counter(each[p] for p in pairs_of(docs))


def test_kept_text_is_returned(spark):
    docs = spark.createDataFrame(rows_of([(1, " ".join(map(str, range(30)))), (2, "x " + " ".join(map(str, range(25))) + " y")]), SCHEMA)
    got = {r.doc_id: r.text for r in substring_dedup.remove_repeats(docs, with_text=True).collect()}
    assert got == {1: " ".join(map(str, range(30))), 2: "x y"}


def test_automaton_matching_lengths():
    rng = random.Random(3)
    for _ in range(30):
        known = [[rng.randrange(3) for _ in range(rng.randint(0, 12))] for _ in range(3)]
        asked = [rng.randrange(3) for _ in range(20)]
        machine = substring_dedup.Automaton()
        for s in known:
            machine.add(s)
        subs = {tuple(s[i:j]) for s in known for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        want = [max([0, *(k for k in range(1, e + 2) if tuple(asked[e + 1 - k : e + 1]) in subs)]) for e in range(len(asked))]
        assert machine.matching(asked) == want


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = WORD.findall(lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def plain_components(prints):
    """Smallest member by fingerprint, from all pairs."""
    values = sorted(set(prints))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("name", KINDS)
def test_near_duplicates(request, name):
    docs = request.getfixturevalue(name)
    rows = [(d, plain_fingerprint(t)) for d, t in pairs_of(docs)]
    top = plain_components([p for _, p in rows])
    smallest = {}
    for d, p in rows:
        if d is not None:
            smallest[top[p]] = min(d, smallest.get(top[p], d))
    want = Counter((d, f"{p:016x}", smallest.get(top[p])) for d, p in rows)
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want


@pytest.mark.parametrize("name", KINDS)
def test_one_of_each(request, name):
    docs = request.getfixturevalue(name)
    rows = pairs_of(docs)
    ties = {(r.doc_id, r.text or ""): r.tie_ for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie_")).collect()}
    top = plain_components([plain_fingerprint(t) for _, t in rows])
    best = {}
    for d, t in rows:
        if d is not None:
            k = top[plain_fingerprint(t)]
            best[k] = min(best.get(k, (d, ties[d, t])), (d, ties[d, t]))
    want = Counter((d, t) for d, t in rows if d is None or best[top[plain_fingerprint(t)]] == (d, ties[d, t]))
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter(pairs_of(kept)) == want


def test_covering_masks_miss_no_pair():
    rng = random.Random(9)
    masks = simhash.covering_masks(2)
    assert len(masks) == 7
    for _ in range(3000):
        x = rng.getrandbits(64)
        y = x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        assert any(x & m == y & m for m in masks)


@pytest.mark.parametrize("small", [2, 32, 10_000])
def test_links_of_crowded_buckets(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL_BUCKET", small)
    rng = random.Random(4)
    values = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        values.add(centre)
        for _ in range(40):
            x = centre
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    edges = simhash.links(spark.createDataFrame(signed, "print long")).collect()
    root = {v: v for (v,) in signed}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 2
        root[find(a)] = find(b)
    want = plain_components(values)
    by_want, by_got = defaultdict(set), defaultdict(set)
    for v in values:
        by_want[want[v]].add(v)
        by_got[find(v - (1 << 64) if v >> 63 else v)].add(v)
    assert sorted(map(sorted, by_want.values())) == sorted(map(sorted, by_got.values()))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 400)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 100 for i in range(100, 401)}, **{i: 1000 for i in range(1000, 1300)}}


@pytest.mark.parametrize("step", [1, 2, 3, 7])
def test_meeting_segments_does_not_depend_on_batches(step):
    import pyarrow as pa

    rng = random.Random(step)
    rows = sorted((2 if rng.random() < 0.9 else 0, rng.randrange(12), rng.randrange(3), rng.randrange(6), rng.randrange(2), 1) for _ in range(80))
    rows.sort(key=lambda r: r[1:5])

    def met(size):
        parts = [pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + size]), substring_dedup._ROW.values())], list(substring_dedup._ROW)) for i in range(0, len(rows), size)]
        return Counter(tuple(r.values()) for b in substring_dedup._meet(iter(parts)) for r in b.to_pylist())

    got = met(step)
    assert got == met(1000)
    firsts = [r for r in rows if r[0] == 2]
    contents = defaultdict(set)
    for _, m, c, *_ in firsts:
        contents[m].add(c)
    first_of = {}
    for r in firsts:
        first_of.setdefault(r[1:3], r[3:5])
    asked = {(m, c, *first_of[m, c]) for m, cs in contents.items() if len(cs) > 1 for c in cs}
    assert {tuple(list(k)[1:5]) for k in got if k[0] == 1} == asked
    assert sum(n for k, n in got.items() if k[0] == 0) == sum(r[0] == 0 for r in rows) + len({r[1:5] for r in firsts}) - len(first_of)
