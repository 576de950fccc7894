"""The pipeline's near-copy stage against brute force over the real five-word sets."""

import random
from collections import Counter

import corpus_pipeline
from shelfline.llm import near_copies

from .conftest import SCHEMA, pairs_of, rows_of


def plain_set(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_kept(rows):
    """Smallest doc_id of each class of texts chained at 0.8 or more."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if 5 * both >= 4 * (len(x) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, t) for i, (d, t) in enumerate(rows) if least[find(i)] == d)


def copies(groups=60, words=300):
    """Texts with copies whose similarity is 0.7 to 0.97."""
    rng, rows = random.Random(5), []
    for g in range(groups):
        first = [f"w{rng.randrange(5000)}" for _ in range(words)]
        rows.append(first)
        for changed in (1, 2, 4, 6, 7, 10):
            copy = list(first)
            for at in rng.sample(range(words), changed):
                copy[at] = f"new{rng.randrange(5000)}"
            rows.append(copy)
    made = [(i, " ".join(w)) for i, w in enumerate(rows)]
    rng.shuffle(made)
    return made


def stage(spark, made):
    return corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows_of(made), SCHEMA).repartition(5), "")


def test_copies_at_08_and_more_go(spark):
    made = copies()
    want, got = plain_kept(made), Counter(pairs_of(stage(spark, made)))
    assert got == want and len(want) < len(made) // 2


def test_a_crowd_and_a_chain(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(400)]
    crowd = []
    for _ in range(150):
        copy = list(base)
        for at in rng.sample(range(400), rng.choice((2, 5, 9, 12))):
            copy[at] = f"new{rng.randrange(10**6)}"
        crowd.append(copy)
    # each step moves on by 20 words: neighbours are alike, the ends are not
    crowd += [[f"c{i}" for i in range(20 * k, 20 * k + 300)] for k in range(12)]
    made = [(i, " ".join(w)) for i, w in enumerate(crowd)]
    assert Counter(pairs_of(stage(spark, made))) == plain_kept(made)


def test_copies_far_from_each_other_make_few_pairs(spark, monkeypatch):
    """All pairs of a bucket's members with other roots were made: the square of the copies that are near 0.8 but below it."""
    rng, words = random.Random(4), 300
    base = [f"w{i}" for i in range(words)]

    def changed(text, n):
        copy = list(text)
        for at in rng.sample(range(words), n):
            copy[at] = f"new{rng.randrange(10**6)}"
        return copy

    crowd = [base, *(changed(base, rng.choice((2, 5))) for _ in range(60)), *(changed(base, rng.choice((7, 8, 9))) for _ in range(200))]
    crowd += [changed(text, 2) for text in crowd[61:91]]  # alike to one of those, not to the base
    made = [(i, " ".join(w)) for i, w in enumerate(crowd)]
    rng.shuffle(made)
    compared, verified = {}, near_copies._verified

    def counted(pairs, nodes, sets_of, name):
        compared[name] = pairs.distinct().count()
        return verified(pairs, nodes, sets_of, name)

    monkeypatch.setattr(near_copies, "_verified", counted)
    want = plain_kept(made)
    assert Counter(pairs_of(stage(spark, made))) == want and 150 < len(want) < 250
    assert compared["rest"] < 25 * len(made)


def test_awkward_rows(spark, awkward, nameless, empty):
    assert corpus_pipeline.near_dedup(spark, empty, "").count() == 0
    rows = {(d, t) for d, t in pairs_of(awkward)}
    got = pairs_of(corpus_pipeline.near_dedup(spark, awkward, ""))
    assert (1, rows and next(t for d, t in rows if d == 1)) in got and not {5, 6, 3, 4} & {d for d, _ in got}
    assert [d for d, _ in pairs_of(corpus_pipeline.near_dedup(spark, nameless, ""))].count(None) == 4


def test_simhash_proposes_what_its_radius_reaches(spark):
    made = copies(groups=20)
    rows = near_copies.sketches(spark.createDataFrame(rows_of(made), SCHEMA))
    sets = {r.print: (r.finger, r.n) for r in rows.select("print", "finger", "n").collect()}
    want = {near_copies.set_print(s): near_copies.majority(s) for s in (near_copies.shingle_set(t.encode()) for _, t in made)}
    assert {p: f % (1 << 64) for p, (f, _) in sets.items()} == {p - (p >> 63 << 64): f for p, f in want.items()}
    got = {(r.a, r.b) for r in near_copies.proposed(rows).collect()}
    prints = sorted(sets)
    near = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (sets[a][0] ^ sets[b][0]).bit_count() <= near_copies.RADIUS or (sets[a][0] - sets[b][0]) % (1 << 64) == 0}
    assert got == {(a, b) for a, b in near if 1000 * min(sets[a][1], sets[b][1]) >= 800 * max(sets[a][1], sets[b][1])} and got


def test_sets_are_as_stated():
    assert len(near_copies.shingle_set(b"a b c d e f")) == 2 and len(near_copies.shingle_set(b"a b")) == 1
    assert (near_copies.shingle_set(b"A b\n C") == near_copies.shingle_set(b"a b c")).all()
