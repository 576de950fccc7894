"""Classifiers by held-out accuracy, mixing by its contract, and the pipeline stage by stage."""

import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from shelfline.llm import mixing, quality, toxicity

from .conftest import SCHEMA, pairs_of, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def labelled(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, {r.doc_id: r for r in labels.collect()}


def held(d, modulus, remainder):
    return zlib.crc32(str(d).encode()) % modulus == remainder


@pytest.mark.parametrize(("name", "cut"), [("quality", 0.7), ("toxic", 0.5)])
def test_held_out_accuracy(labelled, name, cut):
    docs, labels, truth = labelled
    fold = (4, 2) if name == "quality" else (5, 0)
    rows = (quality.quality if name == "quality" else toxicity.toxicity)(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == held(r.doc_id, *fold) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
    judged = [(r.predicted, truth[r.doc_id][name]) for r in rows if r.held_out and r.doc_id in truth and truth[r.doc_id][name] in (0, 1)]
    right = sum(p == t for p, t in judged) / len(judged)
    assert len(judged) > 30 and right >= 0.9, right


@pytest.mark.parametrize("kind", ["awkward", "nameless", "empty"])
def test_scores_of_odd_rows(request, labelled, kind):
    docs, labels, _ = labelled
    odd = request.getfixturevalue(kind)
    for model, rows in ((quality.train(docs, labels), quality.score), (toxicity.train(docs, labels), toxicity.find_passages)):
        assert Counter(r.doc_id for r in rows(odd, model).collect()) == Counter(d for d, _ in pairs_of(odd))
    for train in (quality.train, toxicity.train):
        train(odd, labels.union(labels.sparkSession.createDataFrame([(d, d % 2, d % 3 % 2) for d in range(1, 17)], labels.schema)))
    kept = quality.accepted(odd, quality.train(docs, labels), 0.0)
    assert kept.columns == odd.columns and Counter(pairs_of(kept)) == Counter(pairs_of(odd))


def test_no_labels_give_one_score(spark, awkward):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.quality(awkward, none).collect()} == {0.5}
    assert {r.score for r in toxicity.toxicity(awkward, none).collect()} == {0.5}


def test_labels_of_the_held_out_fold_change_nothing(spark, labelled):
    docs, labels, _ = labelled
    turned = spark.createDataFrame(
        [(r.doc_id, 1 - r.quality if held(r.doc_id, 4, 2) else r.quality, 1 - r.toxic if held(r.doc_id, 5, 0) else r.toxic) for r in labels.collect() if r.quality in (0, 1) and r.toxic in (0, 1)],
        "doc_id long, quality int, toxic int",
    )
    same = labels.filter("quality in (0, 1) and toxic in (0, 1)")
    assert (quality.train(docs, turned).weights == quality.train(docs, same).weights).all()
    assert toxicity.train(docs, turned) == toxicity.train(docs, same)


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(30, rng.integers(1, 8), replace=False)) for _ in range(60)]
    y = np.array([int(3 in r or 5 in r) for r in rows])
    scale = rng.normal(0, 1, 30)
    w, b = quality.dual_coordinate_descent(rows, scale, y, cost=0.5, epochs=2000)
    v = w / scale
    sign = np.where(y > 0, 1, -1)
    margins = np.array([sign[i] * (w[r].sum() + b) for i, r in enumerate(rows)])
    primal = 0.5 * (v @ v + b * b) + 0.5 * np.maximum(0, 1 - margins).sum()
    for _ in range(300):
        v2, b2 = v + rng.normal(0, 0.02, 30), b + rng.normal(0, 0.02)
        m = np.array([sign[i] * ((v2 * scale)[r].sum() + b2) for i, r in enumerate(rows)])
        assert 0.5 * (v2 @ v2 + b2 * b2) + 0.5 * np.maximum(0, 1 - m).sum() >= primal - 1e-3


def test_maximal_segments_against_their_definition():
    rng = random.Random(8)
    for _ in range(300):
        n = rng.randint(1, 14)
        values = [rng.choice([-0.25, 0.5, 0.75, 2.0, -0.25, -0.25, -1.0]) for _ in range(n)]
        got = toxicity.maximal_segments(np.array(values))

        def best(lo, hi):
            """The definition: the largest sum (shortest on ties) splits a stretch, and both sides go on."""
            found = [(sum(values[a : b + 1]), -(b - a), -a, b) for a in range(lo, hi) for b in range(a, hi)]
            found = [x for x in found if x[0] > 0]
            if not found:
                return []
            s, _, a, b = max(found)
            return [*best(lo, -a), (-a, b, s), *best(b + 1, hi)]

        want = best(0, n)
        assert abs(sum(s for *_, s in got) - sum(s for *_, s in want)) < 1e-9
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]


@pytest.mark.parametrize("gap", [-3.0, -1.0, -0.5, -0.2])
def test_segments_take_linear_time(gap):
    scores, begin = np.tile([1.0, gap, gap / 2], 200_000), time.perf_counter()
    toxicity.maximal_segments(scores)
    assert time.perf_counter() - begin < 5  # a scan that looks back takes hours


def test_log_odds_by_their_rule():
    parts = ["abc", "ab", "xyz\n", "abcd\n", "xy"]
    counts = np.array([[20, 5], [30, 10], [0, 3], [9, 1], [0, 40]]).T
    found = toxicity.log_odds(parts, *counts, (99, 899))
    assert (toxicity.log_odds(parts, *(np.stack([c, c], 1) for c in counts), (np.array([99, 99]), np.array([899, 899]))) == found[:, None]).all()
    made = dict(zip(parts, found.tolist()))
    logit = lambda p: np.log(p / (1 - p))
    two = (30 + 16 * 0.1) / 56
    three = (20 + 16 * two) / 41
    whole, other = (9 + 16 * three) / 26, 16 * 0.1 / 56
    want = {"ab": two, "abc": three, "abcd\n": whole, "xy": other, "xyz\n": 16 * other / 19}
    assert set(made) == set(want)
    assert all(abs(made[p] - (logit(x) - logit(0.1) - 1)) < 1e-9 for p, x in want.items())
    known = toxicity.scorer(made)
    got = known.learn({"abcd", "abce", "abx", "xyz", "qq"})
    assert [got[t] for t in ("abcd", "abce", "abx", "xyz", "qq")] == [made["abcd\n"], made["abc"], made["ab"], made["xyz\n"], -1.0]


def test_part_counts_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST_CONTEXTS", 2)
    texts = [("Bad dog, bad dog", 1, 0), ("bad dog, good dog", 0, 1), ("badly done", 1, 2), ("badly done", 0, 3), ("", 1, 4), ("a\u4e2d" * 30, 0, 2)]
    rows = toxicity.part_counts(spark.createDataFrame(texts, "text string, y int, fold int")).collect()
    for f in range(6):
        seen = defaultdict(set)
        for text, y, fold in texts:
            if fold != f:
                doc = ["", *toxicity.tokens_of(text), ""]
                for c in zip(doc, doc[1:], doc[2:]):
                    seen[c].add(y)
        want = defaultdict(lambda: [0, 0])
        for (_, token, _), found in seen.items():
            for part in [None, *toxicity.parts_of(token)]:
                want[part][min(found)] += 1
        for r in rows:
            assert [r[f"other_{f}"], r[f"toxic_{f}"]] == want.get(r.part, [0, 0])
        if f == 5:
            assert {r.part for r in rows} == {p for p, n in want.items() if sum(n) > 1}


def test_evidence_of_planted_passages(spark):
    model = toxicity.Model({"vile\n": 3.0, "vil": 1.0}, 1.5, -2.0, 1.0, -3.0)
    text = "calm words " * 20 + "vile vile villa vile " + "calm words " * 20 + "vile"
    row = toxicity.find_passages(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    space = np.log(85) - 2.0
    want = [(40, 43, 1.5 * 10.0 - space), (84, 84, 1.5 * 3.0 - space)]
    assert [(p["first"], p["last"]) for p in row[0].passages] == [w[:2] for w in want]
    assert np.allclose([p.evidence for p in row[0].passages], [w[2] for w in want]) and abs(row[0].evidence - sum(w[2] for w in want)) < 1e-9
    assert row[1].passages == [] and row[1].evidence == 0


def test_toxic_documents_of_every_language(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.toxicity(docs, labels).filter("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    judged = defaultdict(list)
    for r in scored.select("lang", "toxic", "predicted").collect():
        judged[r.lang, r.toxic].append(r.predicted)
    assert set(judged) == {(lang, t) for lang in ("en", "de", "fr", "es") for t in (0, 1)}
    for (lang, t), found in judged.items():
        right = np.mean(np.array(found) == t)
        # about one in fifteen of the toxic rows is junk with nothing toxic in it, one of the 15 German ones too
        assert right >= (0.9 if t else 0.98), (lang, t, right)


def test_targets_share_the_excess():
    assert mixing.targets([100, 100, 100]) == [200.0, 83.33333333333333, 166.66666666666666]
    goals = mixing.targets([10, 1000, 1000, 5, 0])
    assert abs(sum(goals) - 1.5 * 2015) < 1e-6 and all(g <= 2 * s + 1e-9 for g, s in zip(goals, [10, 1000, 1000, 5, 0]))


def test_permutations_are_one_to_one():
    for n in (1, 2, 5, 64, 1000):
        index, size, key = np.arange(n), np.full(n, n), np.full(n, 99)
        there = mixing.permuted(index, size, key)
        assert sorted(there.tolist()) == list(range(n))
        assert (mixing.permuted(there, size, key, back=True) == index).all()


@pytest.mark.parametrize("kind", ["documents", "awkward", "nameless", "empty"])
def test_mix(request, kind):
    docs = request.getfixturevalue(kind)
    rows = mixing.mix(docs).collect()
    assert Counter(map(tuple, mixing.mix(docs.repartition(3)).collect())) == Counter(map(tuple, rows))
    held_ = docs.select("doc_id", "text", "source").collect()
    assert Counter((r.doc_id, r["size"], r.source) for r in rows) == Counter((r.doc_id, len(WORD.findall(r.text or "")), r.source) for r in held_)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    if sum(sizes.values()):
        for source, goal in zip(order, mixing.targets([sizes[s] for s in order])):
            assert abs(target[source] - goal) < 1e-6 * max(1, goal) and abs(taken[source] - goal) <= 1
    assert all(r.source_size == sizes[r.source] for r in rows)


@pytest.mark.parametrize("kind", ["documents", "awkward", "nameless", "empty"])
def test_mixed_documents(request, kind):
    docs = request.getfixturevalue(kind)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    plan = defaultdict(lambda: [0, 0])
    for r in mixing.mix(docs).collect():
        plan[r.doc_id, r.tie, r.source][0] += r.taken
        plan[r.doc_id, r.tie, r.source][1] += r["size"]
    from pyspark.sql import functions as F

    keyed = docs.select("doc_id", "text", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie_")).collect()
    want = Counter()
    for r in keyed:
        t, s = plan[r.doc_id, r.tie_, r.source]
        if s and (n := int(t / s + 0.5)):
            want[r.doc_id, r.text, r.source] += n
    assert Counter(map(tuple, mixed.select("doc_id", "text", "source").collect())) == want


def test_draws_of_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 50)
    monkeypatch.setattr(mixing, "RUN_SHARDS", 4)
    needed = [1203, 0, 397, 5, 2000]
    rows = mixing.shard_draws(spark, needed, 17).collect()
    assert sorted(map(tuple, mixing.shard_draws(spark, needed, 17).collect())) == sorted(map(tuple, rows))
    shards = -(-sum(needed) // 50)
    plain, at = [], [0] * 5  # the same draws one after another
    for shard in range(shards):
        for s, n in enumerate(np.random.default_rng([17, shard]).multinomial(min(50, sum(needed) - 50 * shard), np.array(needed) / sum(needed))):
            if min(n, needed[s] - at[s]) > 0:
                plain.append((shard, s, at[s], min(n, needed[s] - at[s])))
            at[s] += n
    for s, n in enumerate(needed):
        plain += [(shards + i, s, first, min(50, n - first)) for i, first in enumerate(range(at[s], n, 50))]
    assert sorted((r.shard, r.sid, r.first, r.n) for r in rows) == sorted(plain)
    for s, n in enumerate(needed):
        slots = sorted(x for r in rows if r.sid == s for x in range(r.first, r.first + r.n))
        assert slots == list(range(n))


def test_mix_by_its_rule(spark):
    """Draws, permuted blocks and spans, word by word."""
    texts = [(i, " ".join(f"w{j}" for j in range(i * 7 % 40)), "abc"[i % 3]) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    want, block = Counter(), 9
    sizes = [sum(len(t.split()) for _, t, s in texts if s == x) for x in "abc"]
    goals = [round(g) for g in mixing.targets(sizes)]
    for sid, source in enumerate("abc"):
        stream = [d for d, t, s in texts if s == source for _ in t.split()]
        blocks = [stream[i : i + block] for i in range(0, len(stream), block)]
        left, slot = goals[sid], 0
        while left:
            epoch, i = divmod(slot, len(blocks))
            at = mixing.permuted([i], [len(blocks)], mixing.epoch_key(17, [sid], [epoch]))[0]
            taken = blocks[at][:left]
            want.update(taken)
            left -= len(taken)
            slot += 1
    got = {r.doc_id: r.taken for r in mixing.mix(docs, block=block).collect()}
    assert {d: n for d, n in got.items() if n} == want


def test_mixing_of_a_large_and_a_tiny_source(spark):
    rows = [(i, "a b c d e") for i in range(400)]
    made = [(*r[:3], "big" if i else "tiny", *r[4:]) for i, r in enumerate(rows_of(rows))]
    got = mixing.mix(spark.createDataFrame(made, SCHEMA), block=7).collect()
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
    assert {(r.source, round(r.target)) for r in got} == {("big", 2990), ("tiny", 10)} and taken == {"big": 2990, "tiny": 10}
