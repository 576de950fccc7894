"""Words one edit apart, their forms and roots against plain code."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from shelfline.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string, posting string"


def plain_counts(docs):
    counts = Counter()
    for doc_id, text in docs:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in word)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 5:
                counts[word] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def plain_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    near = {w: [v for v in counts if plain_near(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        if others and counts[best := min(others, key=lambda v: (-counts[v], v))] >= 2 * counts[w]:
            form[w] = best
    rows = {}
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        rows[w] = (form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None)
    return rows


def got(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def docs_of(spark, pairs):
    return spark.createDataFrame([(d, t, "x", "x", "x") for d, t in pairs], SCHEMA).repartition(3)


def crowd(seed, words):
    """Texts of words over few letters, so that many are one edit apart, with repeats and empty ones."""
    rng = random.Random(seed)
    made = ["".join(rng.choice("abÀé") for _ in range(rng.randint(4, 8))) for _ in range(words)]
    return [(i, " ".join(rng.choices(made, [1 / (i + 5) for i in range(words)], k=60))) for i in range(200)] + [(None, None), (7, ""), (8, "ß×÷ Ābcdef A1bcdefg")]


@pytest.mark.parametrize("most", [2000, 8])
def test_against_plain_code(spark, monkeypatch, most):
    monkeypatch.setattr(spelling, "MOST_WORDS", most)  # with 8, postings are halved down to one place
    docs = crowd(most, 900)
    want = plain_variants(plain_counts(docs))
    assert sum(r[3] for r in want.values()) > 500 and any(w != r[1] != r[0] for w, r in want.items())
    assert got(spelling.spelling_variants(docs_of(spark, docs))) == want


def test_lengths_places_and_long_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "MOST_WORDS", 3)
    long = "k" * 20_000
    words = ["abcde", "abcd" "f", "xabcde", "abcdex", "abxcde", "bcdea", "aaaaa", "aaaaaa", "aaaaaaa", "aaaab", long, long + "k", long[:-1] + "z", "z" + long[1:]]
    texts = [(1, " ".join(w for i, w in enumerate(words, 3) for _ in range(i * i)))]
    want = plain_variants(plain_counts(texts))
    assert got(spelling.spelling_variants(docs_of(spark, texts))) == want


def test_awkward_tables(spark, awkward, nameless, empty):
    for docs in (awkward, nameless, empty, awkward.union(awkward).union(awkward)):
        want = plain_variants(plain_counts([(r.doc_id, r.text) for r in docs.collect()]))
        assert got(spelling.spelling_variants(docs)) == want


def test_one_edit_and_the_count_filter():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(5, 7))) for _ in range(120)})
    for length in (5, 6):
        some = [w for w in words if len(w) in (length, length + 1)]
        pairs = {frozenset((some[i], some[j])) for i, j in spelling.near_in_posting(some, length, 0, 0)}
        assert pairs == {frozenset((a, b)) for a in some for b in some if a != b and min(len(a), len(b)) == length and plain_near(a, b)}


def test_chains_of_forms_end_at_their_last(spark):
    chain = [(f"w{i:03d}", f"w{i + 1:03d}") for i in range(70)]
    roots = {r.word: r.root for r in spelling.rooted(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert roots == {w: "w070" for w, _ in chain}
    assert math.ceil(math.log2(70)) == 7
