"""Substring dedup: words covered by a window of 20 that also starts earlier in the corpus are removed.

A window's minimizer is the leftmost of its word 6-grams with the least hash, so equal windows have equal minimizers at
equal offsets. Consecutive windows of a document with the same minimizer are a segment; every window is in one segment.
Segments are dealt out by minimizer: two equal windows always meet. Segments that are equal as a whole are settled by
their hashes, the first of them stays. Where segments of a minimizer differ, their words are fetched, and the earlier
segments are the reference of a suffix automaton: each segment is streamed through it for matching statistics, its
spans of 20 or more matching words are marked, and it joins the reference.

So a reference shard holds passages that share 17 words instead of a part of the corpus that would have to be sent to
every task: nothing that grows with the data is broadcast."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bloom_dedup import filter_bits, flag_possible, member_filter
from .common import chunks, partitions, stored, text_of

WINDOW, GRAM, OFFSETS = 20, 6, 4
#: Segments that a task holds before it passes them on.
AT_ONCE = 1_000_000
_B = 0x9E3779B97F4A7C15 | 1


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_B, n, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(33))


def _joined(left: np.ndarray, right: np.ndarray, a: int, b: int) -> np.ndarray:
    """Hashes of a + b words from those of the first a and of the next b."""
    return left[: len(right) - a] * _power(b) + right[a:]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)


def _leftmost_least(m: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value in each run of `width`, by doubling."""
    value, place, have = m, np.arange(len(m)), 1
    while have < width:
        step = min(have, width - have)
        left, right = value[:-step], value[step:]
        first = left <= right
        value, place, have = np.where(first, left, right), np.where(first, place[:-step], place[step:]), have + step
    return place


def _orders(hashes: np.ndarray) -> np.ndarray:
    """The order of minimizers: a mixed hash of the gram that begins at each word."""
    with np.errstate(over="ignore"):
        g2 = _joined(hashes, hashes, 1, 1)
        return _mixed(_joined(_joined(g2, g2, 2, 2), g2, 4, 2))


def segments(hashes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of documents' word hashes one after another, begins[i] being where document i begins (and a last entry, the end):
    minimizer hash, content hash, document, first window, number of windows of all segments."""
    if len(hashes) < WINDOW:
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    with np.errstate(over="ignore"):
        g2 = _joined(hashes, hashes, 1, 1)
        g4 = _joined(g2, g2, 2, 2)
        g8 = _joined(g4, g4, 4, 4)
        g20 = _joined(_joined(g8, g8, 8, 8), g4, 16, 4)
        order = _orders(hashes)
        place = _leftmost_least(order, WINDOW - GRAM + 1)
        document = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
        room = begins[1:][document] - np.arange(len(hashes))
        at = np.flatnonzero(room[: len(g20)] >= WINDOW)
        p = place[at]
        new = np.ones(len(at), bool)
        new[1:] = (p[1:] != p[:-1]) | (at[1:] != at[:-1] + 1)
        heads = np.flatnonzero(new)
        n = np.diff(np.r_[heads, len(at)])
        first = at[heads]
        content = _mixed(_mixed(g20[first]) * _power(3) + _mixed(g20[first + n - 1]) * _power(5) + n.astype(np.uint64))
    return order[p[heads]], content, document[first], first - begins[:-1][document[first]], n


class Automaton:
    """A suffix automaton of several sequences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _clone(self, p: int, q: int, c) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list) -> None:
        last = 0
        for c in sequence:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
                continue
            state = len(self.next)
            self.next.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = state
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
            last = state

    def matching(self, sequence: list) -> list[int]:
        """At each place the length of the longest match that ends there."""
        state = length = 0
        lengths = []
        for c in sequence:
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                length += 1
            lengths.append(length)
        return lengths


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, text), key being unique to a document and ascending with doc_id: doc_id itself, or where doc_ids
    are null or repeat a number in the order of (doc_id, hash of the text), null first."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    odd = docs.groupBy(F.col(id_col).alias("d")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or d is null").limit(1).count()
    if not odd:
        return rows.select("doc_id", F.col("doc_id").alias("key"), "text")
    rows = rows.withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ranged = stored(rows.select("doc_id", "tie").distinct().repartitionByRange(partitions(docs.sparkSession), *order).withColumn("part", F.spark_partition_id()), "order")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    numbered = ranged.withColumn("number", F.row_number().over(Window.partitionBy("part").orderBy(*order))).join(F.broadcast(parts), "part")
    numbered = stored(numbered.select(F.col("doc_id").alias("d"), F.col("tie").alias("t"), (F.col("ahead") + F.col("number")).alias("key")), "numbers")
    return rows.join(numbered, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t"))).select("doc_id", "key", "text")


_ROW = {"kind": pa.int8(), "route": pa.int64(), "content": pa.int64(), "key": pa.int64(), "first": pa.int32(), "n": pa.int32()}
_SURE, _ASK, _FIRST = 0, 1, 2  # a repeated segment; one whose words are wanted; the first of its content so far


def _firsts(minimizer: np.ndarray, content: np.ndarray, key: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """The order by minimizer, content, document and place; in that order whether a row is the first of its content,
    and whether it is the very same segment as the row before."""
    order = np.lexsort((first, key, content, minimizer))
    m, c, k, f = minimizer[order], content[order], key[order], first[order]
    lead, same = np.ones(len(order), bool), np.zeros(len(order), bool)
    lead[1:] = (m[1:] != m[:-1]) | (c[1:] != c[:-1])
    same[1:] = ~lead[1:] & (k[1:] == k[:-1]) & (f[1:] == f[:-1])
    return order, lead, same


def _rows(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c].view(np.int64) if columns[c].dtype == np.uint64 else columns[c], t) for c, t in _ROW.items()], list(_ROW))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents into segments. Of segments equal within this task's rows only the first has to meet others."""
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        m, c, k, f, n = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order, lead, same = _firsts(m, c, k, f)
        order, lead = order[~same], lead[~same]
        # repeats go anywhere, so that a frequent passage crowds no task
        route = np.where(lead, m[order], _mixed(k[order].view(np.uint64) * _power(1) + f[order].astype(np.uint64)))
        return _rows(kind=np.where(lead, _FIRST, _SURE), route=route, content=c[order], key=k[order], first=f[order], n=n[order])

    for batch in batches:
        keys, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        for rows in chunks(texts):
            words = [texts[i].encode().split() for i in rows]
            begins = np.cumsum([0, *map(len, words)])
            m, c, document, f, n = segments(word_hashes([w for doc in words for w in doc]), begins)
            held.append((m, c, keys[rows.start + document], f, n))
        if sum(len(x[0]) for x in held) > AT_ONCE:
            yield out()
    if held:
        yield out()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by minimizer, content, document and place: repeats of a content are sure; first ones of a
    minimizer with several contents are asked for their words. Besides a batch only two rows are held."""
    before: list | None = None  # the row before the batch
    alone: list | None = None  # the first row of a minimizer that has one content so far
    for batch in batches:
        columns = [batch.column(i).to_numpy() for i in range(6)]
        sure = columns[0] == _SURE
        if sure.any():
            yield _rows(**{c: x[sure] for c, x in zip(_ROW, columns)})
            columns = [x[~sure] for x in columns]
        size = len(columns[0])
        if not size:
            continue
        kind, m, c, k, f, n = columns
        last = before or [0, ~m[0], c[0], k[0], f[0], n[0]]
        changed = [x != np.r_[y, x[:-1]] for x, y in zip((m, c, k, f), last[1:5])]
        opens, lead, fresh = changed[0], changed[0] | changed[1], changed[0] | changed[1] | changed[2] | changed[3]
        # a minimizer's second content calls for its first one too
        second = lead & ~opens
        where = np.maximum.accumulate(np.where(opens, np.arange(size), -1))  # its opening row, -1: before this batch
        wanted = np.zeros(size, bool)
        wanted[where[second & (where >= 0)]] = True
        if alone is not None and (second & (where < 0)).any():
            yield _rows(**{c: np.array([x]) for c, x in zip(_ROW, [_ASK, *alone[1:]])})
            alone = None
        ask = second | wanted
        keep = ask | (fresh & ~lead)
        yield _rows(kind=np.where(ask, _ASK, _SURE)[keep], route=m[keep], content=c[keep], key=k[keep], first=f[keep], n=n[keep])
        before = [x[-1] for x in columns]
        if opens.any():
            at = where[-1]
            alone = None if wanted[at] else [x[at] for x in columns]


_SCHEMA = "kind byte, route long, content long, key long, first int, n int"


def shards_of(hashes: np.ndarray, place: np.ndarray, first: int, n: int) -> Iterator[tuple[int, int, int]]:
    """A segment's reference shards: (shard, first window, number of windows). Windows in which as many words precede
    the minimizer, up to OFFSETS - 1, go together, by all words that each of them must have: 17 or 18 of 20. So a
    short phrase that is frequent in many contexts makes many shards, not a large one."""
    p = int(place[first])
    for ahead in range((p - first - n + 1) // OFFSETS * OFFSETS, p - first + 1, OFFSETS):
        most = min(ahead + OFFSETS - 1, WINDOW - GRAM)
        lo, hi = max(first, p - most), min(first + n - 1, p - ahead)
        shard = xxhash.xxh3_64_intdigest(hashes[p - ahead : p + WINDOW - most].tobytes(), ahead)
        yield shard - (1 << 64) if shard >> 63 else shard, lo, hi - lo + 1


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, texts, asked = (batch.column(i).to_pylist() for i in range(3))
        out: list[tuple] = []

        def rows() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["route", "key", "first", "words"])
            out.clear()
            return made

        for key, text, wanted in zip(keys, texts, asked):
            hashes = word_hashes(text.encode().split())
            place = _leftmost_least(_orders(hashes), WINDOW - GRAM + 1)
            for x in wanted:
                for shard, lo, n in shards_of(hashes, place, x["first"], x["n"]):
                    out.append((shard, key, lo, hashes[lo : lo + n + WINDOW - 1].tobytes()))
                if len(out) >= 50_000:
                    yield rows()
        if out:
            yield rows()


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by shard, document and place: each against the automaton of those before it. The automaton is
    begun when a shard's second segment comes."""
    shard, reference, before, waiting = None, Automaton(), None, []
    for batch in batches:
        out: list[tuple] = []
        for route, key, first, words in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if route != shard:
                shard, before, waiting = route, (key, first), [words]
                if len(reference.next) > 1:
                    reference = Automaton()
                continue
            if (key, first) == before:
                continue
            before = (key, first)
            for x in waiting:
                reference.add(np.frombuffer(x, np.uint64).tolist())
            waiting = []
            sequence = np.frombuffer(words, np.uint64).tolist()
            repeated = [length >= WINDOW for length in reference.matching(sequence)[WINDOW - 1 :]]
            begin = None
            for i, hit in enumerate([*repeated, False]):
                if hit and begin is None:
                    begin = i
                elif not hit and begin is not None:
                    out.append((key, first + begin, i - begin))
                    begin = None
            if not all(repeated):
                waiting = [words]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32()))], ["key", "first", "n"])


def repeated_windows(keyed: DataFrame) -> DataFrame:
    """Stored (key, first, n): n consecutive windows from word `first` on of document `key` also start earlier."""
    spark = keyed.sparkSession
    n = partitions(spark)
    met = stored(keyed.select("key", "text").mapInArrow(_cut, _SCHEMA).repartition(n, "route").sortWithinPartitions("route", "content", "key", "first").mapInArrow(_meet, _SCHEMA).select("kind", "route", "key", "first", "n"), "segments")
    asked = stored(met.filter(F.col("kind") == _ASK).groupBy("key").agg(F.collect_list(F.struct("route", "first", "n")).alias("asked")), "asked")
    words = _with(keyed, asked, "asked", inner=True).select("key", "text", "asked").mapInArrow(_fetch, "route long, key long, first int, words binary")
    streamed = words.repartition(n, "route").sortWithinPartitions("route", "key", "first").mapInArrow(_stream, "key long, first int, n int")
    return stored(met.filter(F.col("kind") == _SURE).select("key", "first", "n").union(streamed), "repeats")


def _with(keyed: DataFrame, table: DataFrame, column: str, inner: bool = False) -> DataFrame:
    """keyed joined with a stored table of unique keys; only rows that a Bloom filter of its keys lets through move."""
    bits = filter_bits(table.count())
    seen = stored(member_filter(table, "key", bits), "keys")
    flagged = flag_possible(keyed, "key", seen, bits, "possible")
    met = flagged.filter("possible").drop("possible").join(table, "key", "inner" if inner else "left")
    if inner:
        return met
    alone = flagged.filter(~F.col("possible")).drop("possible").withColumn(column, F.lit(None).cast(table.schema[column].dataType))
    return alone.unionByName(met.select(alone.columns))


def kept_words(words: list[bytes], spans: list) -> list[bytes]:
    if not spans:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        edges[s["first"]] += 1
        edges[s["first"] + s["n"] + WINDOW - 1] -= 1
    return [w for w, covered in zip(words, np.cumsum(edges[:-1]).tolist()) if not covered]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row, and with_text the kept words joined by spaces.

    Words lie between ASCII white space, unchanged. Null counts as no words. Documents are ordered by doc_id; where
    doc_ids repeat by a hash of the text after it, null first; rows equal in both are one document and get the same
    result. Documents of fewer than 20 words lose nothing; an empty table gives an empty result."""
    keyed = _keyed(docs, id_col, text_col)
    spans = stored(repeated_windows(keyed).groupBy("key").agg(F.collect_list(F.struct("first", "n")).alias("spans")), "spans")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cuts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            counts, removed, digests, kept = [], [], [], []
            for text, spans in zip(texts, cuts):
                words = text.encode().split()
                left = kept_words(words, spans)
                joined = b" ".join(left)
                counts.append(len(words))
                removed.append(len(words) - len(left))
                digests.append(hashlib.sha256(joined).hexdigest())
                kept.append(joined.decode() if with_text else None)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(kept, pa.string())] * with_text], ["doc_id", "n_words", "n_removed", "kept_sha256", *["text"] * with_text])

    rows = _with(keyed, spans, "spans").select("doc_id", "text", "spans")
    return rows.mapInArrow(clean, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text)
