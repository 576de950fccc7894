"""Spelling variants: words one edit apart, and the commonest form that each leads to.

Words within one edit share many q-grams at nearly the same place, so an inverted index of positional q-grams proposes
pairs: of two words of which the shorter has l code points, one edit leaves either the first l // 2 or the last l - l // 2
untouched. These two long grams are postings that Spark deals out, and those with many words are halved again where
they may still differ, up to a single place. Within a posting the rest of each word is indexed by bigrams; their
postings, limited to the same length or one more and to a shift of one place, are merged through a heap, pairs that meet as
often as one edit must leave are kept, and then compared."""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, stored, text_of

#: Fixed by the definition of words: letters of Latin-1, and which occurrences lose a letter.
RUN, LOSES = r"[A-Za-zÀ-ÿ]+", 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A form has at least so many times the occurrences of the words it stands for.
TIMES = 2
#: Postings of more words are halved.
MOST_WORDS = 2000
#: Distinct words that a task counts before it passes them on, and rows of a batch that leaves it.
COUNTED_AT_ONCE, ROWS_AT_ONCE = 300_000, 20_000

_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words_of(doc_id: int | None, text: str) -> Iterator[tuple[str, int]]:
    """The words of a text with their counts: lower-cased runs, some of which lose a code point by a hash with doc_id."""
    start = b"%d:" % doc_id if doc_id is not None else b":"
    begun = zlib.crc32(start)
    for word, n in Counter(re.findall(RUN, text.translate(_LOWER))).items():
        h = zlib.crc32(word.encode(), begun)
        if h % LOSES == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= LEAST_LENGTH:
            yield word, n


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n of all words of docs with LEAST_LENGTH code points or more. Counts of a task are summed before they move."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            for some in chunks(texts):
                for i in some:
                    for word, n in words_of(ids[i], texts[i]):
                        found[word] += n
                if len(found) >= COUNTED_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], schema=schema)
                    found = Counter()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], schema=schema)

    parts = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), text_of("`text`").alias("text")).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def one_edit(s: str, t: str) -> bool:
    """Whether one inserted, deleted or replaced code point leads from s to t, t being as long or one longer."""
    at = next((i for i, (a, b) in enumerate(zip(s, t)) if a != b), len(s))
    if len(s) == len(t):
        return at < len(s) and s[at + 1 :] == t[at + 1 :]
    return len(t) == len(s) + 1 and s[at:] == t[at + 1 :]


def first_meeting(s: str, t: str, halvings: list[tuple[int, int, int]]) -> bool:
    """Whether no earlier posting has the pair: of each halving, (b, e, a) of common first b and last e code points and
    a more of the beginning, the half by the end counts only where that by the beginning doesn't hold."""
    return all(s[b : b + a] != t[b : b + a] for b, _, a in halvings)


def near_in_posting(words: list[str], length: int, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """Pairs of positions of words one edit apart, the shorter of `length` code points; all words share their first
    `begin` and last `end` code points and have `length` or one more."""
    rest = [f" {w[begin : len(w) - end]} " for w in words]
    postings: dict = defaultdict(list)
    for i, r in enumerate(rest):
        for place in range(len(r) - 1):
            postings[len(r), place, r[place : place + 2]].append(i)
    room = length - begin - end + 2
    for i, r in enumerate(rest):
        if len(r) != room:
            continue
        for longer in (room, room + 1):
            if longer == room == 3:  # one place is left, where all of this length differ
                yield from ((i, j) for j in range(i + 1, len(words)) if len(rest[j]) == room)
                continue
            least = longer - 3  # of the longer one's longer - 1 bigrams an edit changes two at most
            lists = [postings[key] for place in range(room - 1) for shift in (-1, 0, 1) if (key := (longer, place + shift, r[place : place + 2])) in postings]
            for j, met in groupby(heapq.merge(*lists)):
                if (longer > room or j > i) and sum(1 for _ in met) >= least and one_edit(words[i], words[j]):
                    yield i, j


def _dealt(words: DataFrame, begin, end) -> DataFrame:
    """Words as members of the two postings below common first `begin` and last `end` code points."""
    rest = F.col("length") - begin - end
    half = F.floor(rest / 2).cast("int")
    sides = F.array(F.struct((begin + half).alias("begin"), end.alias("end"), F.lit(False).alias("late")), F.struct(begin.alias("begin"), (end + rest - half).alias("end"), F.lit(True).alias("late")))
    once = words.withColumn("half", half).withColumn("side", F.explode(sides))
    trail = F.when(F.col("side.late"), F.concat("trail", F.array(F.struct(begin.alias("b"), end.alias("e"), F.col("half").alias("a"))))).otherwise(F.col("trail"))
    return once.select("word", "n", "length", F.col("side.begin").alias("begin"), F.col("side.end").alias("end"), trail.alias("trail"))


def _keyed(members: DataFrame) -> DataFrame:
    """posting: a hash of what the members of a posting share."""
    begin, end = F.substring("word", F.lit(1), F.col("begin")), F.substring("word", F.char_length("word") - F.col("end") + 1, F.col("end"))
    return members.withColumn("posting", F.xxhash64("length", "begin", "end", begin, end))


def _near_words(members: DataFrame) -> DataFrame:
    """word, n_near, best_n and best of each member of a posting that has near words there."""
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        out: list = []
        for (_, length, begin, end), group in groupby(rows, key=lambda r: r[:4]):
            group = list(group)
            texts = [r[4] for r in group]
            halvings = [(h["b"], h["e"], h["a"]) for h in group[0][6]]
            found: dict = {}
            for i, j in near_in_posting(texts, length, begin, end):
                if first_meeting(texts[i], texts[j], halvings):
                    for one, other in ((i, j), (j, i)):
                        times, best = found.get(one, (0, None))
                        rank = (-group[other][5], texts[other])
                        found[one] = times + 1, rank if best is None else min(best, rank)
            out.extend((texts[i], times, -best[0], best[1]) for i, (times, best) in found.items())
            if len(out) >= ROWS_AT_ONCE:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    columns = ("posting", "length", "begin", "end", "word", "n", "trail")
    return members.select(*columns).repartition("posting").sortWithinPartitions(*columns[:5]).mapInArrow(near, "word string, n_near long, best_n long, best string")


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n and best (of the near word with the largest n; ties: the first in code-point order) of every
    word that has near words. words: distinct word and n.

    Each round halves the postings with more than MOST_WORDS members that still have more than one open place; every
    posting that fits, or that has one open place (where an alphabet bounds it), is compared whole."""
    each = F.explode(F.array(F.char_length("word"), F.char_length("word") - 1))
    zero = F.lit(0)
    trail = F.array().cast("array<struct<b:int,e:int,a:int>>")
    open_ = _dealt(words.select("word", "n", each.alias("length"), trail.alias("trail")).filter("length > 0"), zero, zero)
    found = None
    while True:
        members = stored(_keyed(open_), "postings")
        sizes = members.groupBy("posting").agg(F.count(F.lit(1)).alias("size"), F.first("begin").alias("begin"), F.first("end").alias("end"), F.first("length").alias("length"))
        crowded = (F.col("size") > MOST_WORDS) & (F.col("length") - F.col("begin") - F.col("end") > 1)
        sizes = stored(sizes.filter("size > 1").select("posting", crowded.alias("crowded")), "posting-sizes")
        ready = members.join(sizes.filter("NOT crowded").select("posting"), "posting", "left_semi")
        pairs = stored(_near_words(ready), "near-words")
        found = pairs if found is None else found.unionByName(pairs)
        if sizes.filter("crowded").isEmpty():
            break
        open_ = _dealt(members.join(sizes.filter("crowded").select("posting"), "posting", "left_semi"), F.col("begin"), F.col("end"))
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("top")).select("word", "n_near", (-F.col("top.less")).alias("best_n"), "top.best")


def rooted(forms: DataFrame) -> DataFrame:
    """word and root of each word that has a form: the last of its chain of forms. forms: word, form.

    A form occurs at least twice as often as its word, so chains are shorter than the logarithm of the largest count, and
    each round halves what is left of them. Words whose chain has ended leave the rounds."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        now = stored(now, "roots")
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        met = stored(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots-moved")
        if met.filter("moved").isEmpty():
            return met.select("word", "root")
        now = met.select("word", "root")


def variants(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word. words: distinct word and n, stored.

    form is the near word of largest n where that is TIMES the word's own or more. Words without near words have n_near 0
    and are their own root."""
    near = near_words(words)
    known = words.join(near, "word", "left").withColumn("has", F.col("best_n") >= TIMES * F.col("n"))
    known = stored(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("has"), F.col("best")).alias("form"), F.when(F.col("has"), F.col("best_n")).alias("form_n")), "forms")
    roots = rooted(known.filter("form IS NOT NULL"))
    return known.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """variants() of the words of all texts that occur LEAST_COUNT times or more.

    Null texts have no words; a null doc_id hashes as an empty one; repeated rows count each time; texts without words and
    empty tables give no rows; of other columns none is looked at."""
    words = stored(word_counts(docs).filter(F.col("n") >= LEAST_COUNT), "words")
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")
