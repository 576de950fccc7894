"""The trie of rebuilt conversations against plain code."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

from shelfline.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth string, at string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain_turns(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [(role, text) for _, role, text in sorted(ts)] for c, ts in turns.items()}


def plain_rebuilt(turns):
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(turns.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:])
    return built


def plain_trie(built):
    members, leaves, saved, children = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += children[node] == 0
        if node:
            saved[node] += (len(members[node]) - 1) * len(node[-1][1].encode())
            children[node[:-1]] += 1
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    ends = {n: ",".join(str(c) for c in cs if len(built[c]) == len(n)) for n, cs in members.items()}
    return sorted(
        (cs[0], len(n), members[n[:-1]][0] if n else -(10**9), len(cs), children[n], leaves[n], saved[n], hashlib.sha256(ends[n].encode()).hexdigest()) for n, cs in members.items()
    )


def got(df):
    return sorted(tuple(-(10**9) if r[c] is None else r[c] for c in COLUMNS) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA).repartition(3)


def crowd(seed, convs):
    """Conversations that share beginnings, copies, negative and sparse ids, null turns, roles and texts, and tied turns."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-60, 4 * convs), convs):
        for turn in range(rng.randint(1, 14)):
            said = rng.choice(["ä", "b", None, "", f"own {c}"])
            rows.append((c, rng.choice([turn, turn, turn, None, 3]), rng.choice(["user", "user", None]), said))
    return rows + [(None, 1, "user", "no conversation")]


def test_rebuilt_conversations_against_plain_code(spark):
    for seed in (1, 2):
        rows = crowd(seed, 120)
        want = plain_trie(plain_rebuilt(plain_turns(rows)))
        assert got(prefix_trie.prefix_trie(table(spark, rows))) == want


def test_conversations_as_they_are(spark):
    rows = crowd(3, 80)
    assert got(prefix_trie.trie(prefix_trie.turns_of(table(spark, rows)))) == plain_trie({c: tuple(ts) for c, ts in plain_turns(rows).items()})


def test_runs_that_hang_below_one_another(spark):
    # each conversation goes one turn further than the one before and one aside: every run waits for the next
    rows = [(c, t, "user", "same") for c in range(12) for t in range(c)] + [(100 + c, t, "user", "same" if t < c else "aside") for c in range(12) for t in range(c + 1)]
    rows += [(c, 50, "", "") for c in (0,)]
    assert got(prefix_trie.trie(prefix_trie.turns_of(table(spark, rows)))) == plain_trie({c: tuple(ts) for c, ts in plain_turns(rows).items()})


def test_many_ends_in_one_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOB", 64)
    monkeypatch.setattr(prefix_trie, "ROWS_AT_ONCE", 50)
    rows = [(c, 0, "user", "hello") for c in range(0, 15_000, 5)] + [(c, 0, "user", "hello") for c in range(1, 300, 5)]
    assert got(prefix_trie.prefix_trie(table(spark, rows))) == plain_trie(plain_rebuilt(plain_turns(rows)))


def test_long_conversations_and_texts(spark):
    rows = [(5, t, "user", f"turn {t}") for t in range(900)] + [(6, t, "user", f"turn {t}") for t in range(700)] + [(7, 0, "user", "long " * 200_000)]
    assert got(prefix_trie.prefix_trie(table(spark, rows))) == plain_trie(plain_rebuilt(plain_turns(rows)))


def test_turnless_and_empty(spark):
    # 18 takes eight turns of an absent conversation and has none after its own first eight
    lone = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(lone, 0, "user", "gone")]
    assert got(prefix_trie.prefix_trie(table(spark, rows))) == plain_trie(plain_rebuilt(plain_turns(rows))) == [(lone, 0, -(10**9), 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    assert got(prefix_trie.prefix_trie(table(spark, rows).limit(0))) == []
    assert got(prefix_trie.prefix_trie(table(spark, [(None, 1, "user", "x")]))) == []
