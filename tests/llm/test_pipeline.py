"""The corpus pipeline stage by stage against plain versions, and over odd tables."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from shelfline.llm import mixing, quality

from .conftest import SCHEMA, pairs_of

STAGES = dict(corpus_pipeline.STAGES)


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words)} if len(words) <= 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables, with copies near the similarity of 0.8 on both sides of it."""
    out = str(tmp_path_factory.mktemp("corpus"))
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    longest = sorted((t for _, t in pairs_of(base) if 60 <= len(t.split()) <= 400), key=len)[-6:]
    made = []
    for i, text in enumerate(longest):
        words = text.split()
        for j, every in enumerate((200, 100, 60, 45, 30, 12)):
            changed = [f"changed{i}x{k}" if k % every == every // 2 else w for k, w in enumerate(words)]
            made.append((1_000_000 + 10 * i + j, " ".join(changed), "en", "web", 0))
        made.append((2_000_000 + i, text, "en", "web", 0))
    extra = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_chars", F.length("text"))
    base.unionByName(extra.select(*(F.col(c).cast(base.schema[c].dataType) for c in base.columns))).write.parquet(f"{out}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{out}/labels.parquet")
    return out


def test_stages_against_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = STAGES["quality classifier"](spark, docs, folder).persist()
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = {(r.doc_id): r.score for r in quality.score(docs, model).collect()}
    assert kept.columns == docs.columns and Counter(pairs_of(kept)) == Counter(p for p in pairs_of(docs) if scores[p[0]] >= 0.7)

    unique = STAGES["exact dedup"](spark, docs, folder).persist()
    last = {}
    for d, t in pairs_of(docs):
        last[t] = max(d, last.get(t, d))
    assert unique.columns == docs.columns and Counter(pairs_of(unique)) == Counter((d, t) for t, d in last.items())

    far = STAGES["simhash near-dedup"](spark, unique, folder).persist()
    rows = sorted(pairs_of(unique))
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert far.columns == docs.columns and Counter(pairs_of(far)) == Counter(rows[i] for i in range(len(rows)) if find(i) == i)
    assert 6 <= len(rows) - far.count()

    mixed = STAGES["mixing sources"](spark, far, folder).persist()
    plan = mixing.mix(far).collect()
    taken, size = defaultdict(int), {}
    for r in plan:
        taken[r.doc_id] += r.taken
        size[r.doc_id] = r["size"]
    times = Counter(d for d, _ in pairs_of(mixed))
    assert mixed.columns == docs.columns and all(size[d] and abs(n - taken[d] / size[d]) < 1 for d, n in times.items())
    words, goal = defaultdict(int), {r.source: r.target for r in plan}
    for r in mixed.select("source", "text").collect():
        words[r.source] += len(r.text.split())
    largest = max(size.values())
    assert all(abs(words[s] - goal[s]) <= 6 * (largest * goal[s]) ** 0.5 + 1 for s in goal)

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter()
    for d, t in pairs_of(mixed):
        ids = library.encode(t)
        want[d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert Counter(map(tuple, STAGES["sentencepiece"](spark, mixed, folder).collect())) == want


def test_run_is_the_stages_one_after_another(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        if i < len(corpus_pipeline.STAGES) - 1:
            docs = docs.persist()
            docs.count()
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == Counter(map(tuple, docs.collect()))


@pytest.mark.parametrize("kind", ["awkward", "nameless", "empty"])
def test_odd_tables_pass_every_stage(request, spark, folder, kind):
    docs = request.getfixturevalue(kind)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, folder)
        assert rows.columns == docs.columns, name
        assert {d for d, _ in pairs_of(rows)} <= {d for d, _ in pairs_of(docs)}
    got = STAGES["sentencepiece"](spark, docs, folder)
    assert Counter(r.doc_id for r in got.collect()) == Counter(d for d, _ in pairs_of(docs))
    assert spark.createDataFrame([], SCHEMA).columns == docs.columns
