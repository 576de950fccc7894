"""The words of each source after the pipeline's mix against its target, with long documents."""

from collections import defaultdict

import pytest

import corpus_pipeline
from shelfline.llm import mixing

from .conftest import SCHEMA


@pytest.mark.parametrize("words", [40, 3000])
def test_source_totals_meet_their_targets(spark, words):
    # in order of names the weights are 3, 1, 2; the small ones stop at 2 times, "hot" has the rest, 1.35 times its size
    count = {"a": 90, "hot": 1500, "z": 350} if words == 40 else {"a": 60, "hot": 700, "z": 150}
    rows, n = [], 0
    for source, k in count.items():
        for _ in range(k):
            rows.append((n, " ".join([f"d{n}"] * words), "en", source, 1, *["x"] * (len(SCHEMA.split(",")) - 5)))
            n += 1
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    sizes = [k * words for k in count.values()]
    goals = dict(zip(count, mixing.targets(sizes)))
    got = defaultdict(int)
    for r in corpus_pipeline.mix_sources(spark, docs, "").select("source", "doc_id").collect():
        got[r.source] += words
    for source, size in zip(count, sizes):
        # three standard deviations of independent roundings
        q = goals[source] / size % 1
        room = 3 * words * (count[source] * q * (1 - q)) ** 0.5 + words * 2
        assert abs(got[source] - goals[source]) <= room, (source, got[source] / size, goals[source] / size)


def test_a_source_with_a_ratio_under_a_half(spark):
    docs = spark.createDataFrame([(i, " ".join([f"d{i}"] * 3000), "en", "abc"[i % 3], 1, *["x"] * (len(SCHEMA.split(",")) - 5)) for i in range(900)], SCHEMA)
    # 0.3 of all words, by weights of 3, 1, 2: 0.45, 0.15 and 0.3 of each source
    kept = mixing.mixed_documents(docs, share=0.3, on_average=True).groupBy("source").count().collect()
    assert {r.source for r in kept} == {"a", "b", "c"}
    for r in kept:
        q = {"a": 0.45, "b": 0.15, "c": 0.3}[r.source]
        assert abs(r["count"] / 300 - q) <= 3 * (q * (1 - q) / 300) ** 0.5 + 0.02
