"""Token store, token counts and SentencePiece codec against their libraries; media columns against a plain version."""

import cmath
import hashlib
import io
import math
import wave
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from shelfline.llm import media, piece_codec, token_counts, token_store
from shelfline.llm.common import fresh_path
from shelfline.llm.mph_index import PerfectHash
from shelfline.llm.piece_bpe import marked, vocabulary

from .conftest import pairs_of

WORD = public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE)


@pytest.mark.parametrize("name", ["awkward", "documents", "nameless", "empty"])
def test_token_counts(request, pieces, name):
    docs = request.getfixturevalue(name)
    want = Counter()
    for d, t in pairs_of(docs):
        n = len(pieces.encode(t))
        want[d, len(t.encode()), n, n > 4096] += 1
    assert Counter(map(tuple, token_counts.count_tokens(docs, PIECE).collect())) == want


@pytest.mark.parametrize("name", ["awkward", "documents", "nameless", "empty"])
def test_sentencepiece_round_trip(request, pieces, name):
    docs = request.getfixturevalue(name)
    want = Counter()
    for d, t in pairs_of(docs):
        ids = pieces.encode(t)
        want[d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(pieces.decode(ids).encode()).hexdigest()] += 1
    assert Counter(map(tuple, piece_codec.round_trip(docs, PIECE).collect())) == want


def test_encode_and_decode_give_ids_and_texts(awkward, pieces):
    encoded = piece_codec.encode(awkward, PIECE)
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == Counter((d, tuple(pieces.encode(t))) for d, t in pairs_of(awkward))
    decoded = piece_codec.decode(encoded, PIECE)
    assert Counter(map(tuple, decoded.collect())) == Counter((d, pieces.decode(pieces.encode(t))) for d, t in pairs_of(awkward))


def test_merging_of_random_words(pieces):
    rng = np.random.default_rng(5)
    alphabet = list("aabeinorst ▁.,é漢<>0") + ["th", "ing", "\n"]
    words = ["".join(rng.choice(alphabet, rng.integers(1, 40))).strip(" ▁") for _ in range(3000)] + ["a" * n for n in (63, 64, 65, 200)]
    words = [w.replace("▁", "") for w in words]
    known = vocabulary(PIECE)
    marks = [m for m in marked(words) if "▁▁" not in m and m != "▁"]
    assert known.ids(marks) == [pieces.encode(m[1:].replace("▁", " ")) for m in marks]


@pytest.mark.parametrize("name", ["awkward", "documents", "empty"])
def test_token_store(request, name):
    docs = request.getfixturevalue(name)
    library = Tokenizer.from_file(WORD)
    want, start = Counter(), 0
    got = token_store.token_rows(docs, WORD, 2).collect()
    by_id = sorted(pairs_of(docs), key=lambda p: p[0])
    plain = {(d, t): library.encode(t, add_special_tokens=False).ids + [2] for d, t in by_id}
    for d, t in by_id:
        ids = plain[d, t]
        want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [d for d, _ in by_id]


def test_token_store_keyed_access(spark, documents):
    library = Tokenizer.from_file(WORD)
    folder = fresh_path(spark, "shards")
    manifest = token_store.write_tokens(documents, WORD, 2, folder)
    texts = dict(pairs_of(documents))
    asked = sorted(texts)[::7]
    keys = spark.createDataFrame([(k,) for k in [*asked, -99, 10**12, None]], "doc_id long")
    got = {r.doc_id: list(r.ids) for r in token_store.fetch(keys, manifest).collect()}
    assert got == {k: library.encode(texts[k], add_special_tokens=False).ids + [2] for k in asked}


def test_rows_come_through_the_index(spark, documents, monkeypatch):
    manifest = token_store.write_tokens(documents, WORD, 2, fresh_path(spark, "shards"))
    shard = token_store._load(manifest.first().path)
    assert (shard.numbered() == np.arange(len(shard.keys))).all()
    shard.numbers = shard.numbers[::-1]
    assert (shard.numbered() != np.arange(len(shard.keys))).any()
    shard.index.prints = shard.index.prints ^ np.uint32(1)
    with pytest.raises(ValueError):
        shard.numbered()


def test_keyed_access_beside_clashing_columns(awkward):
    manifest = token_store.write_tokens(awkward, WORD, 2, fresh_path(awkward.sparkSession, "shards"))
    texts = dict(reversed([(d, t) for d, t in sorted(pairs_of(awkward), key=lambda p: p[0]) if d != 17]))
    library = Tokenizer.from_file(WORD)
    got = {r.doc_id: list(r.ids) for r in token_store.fetch(awkward.filter("doc_id <> 17").dropDuplicates(["doc_id"]), manifest).collect()}
    assert got == {d: library.encode(t, add_special_tokens=False).ids + [2] for d, t in texts.items()}


def test_null_keys_are_stored_and_not_indexed(spark, nameless):
    rows = token_store.token_rows(nameless, WORD, 2).collect()
    assert Counter(r.doc_id for r in rows) == Counter({None: 4, 1: 1, 2: 1})
    assert all(r.doc_id is None for r in sorted(rows, key=lambda r: r.start)[:4])


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_is_minimal_and_tells_strangers(n):
    keys = np.random.default_rng(n).choice(2**40, n, replace=False).astype(np.int64) - 2**39
    made = PerfectHash.of(keys)
    assert sorted(made.slots(keys).tolist()) == list(range(n))
    others = np.setdiff1d(np.arange(2**41, 2**41 + 1000), keys)
    assert (made.slots(others) >= 0).sum() <= 1


def plain_media(text):
    data = text.encode()
    payload = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setparams((1, 1, 8000, 0, "NONE", "not compressed"))
        f.writeframes(payload)
    stored = out.getvalue()
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest()


@pytest.mark.parametrize("name", ["awkward", "documents", "nameless", "empty"])
def test_media_columns(request, name):
    docs = request.getfixturevalue(name)
    got = media.media_rows(docs).collect()
    assert Counter(tuple(r)[:7] for r in got) == Counter((d, *plain_media(t)) for d, t in pairs_of(docs))
    assert len({(r.payload_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})


def test_peaks_of_a_tone():
    t = np.arange(192 * 20)
    tone = (128 + 100 * np.sin(2 * np.pi * 12 * t / 192)).astype(np.uint8).tobytes()
    found = media.peaks(tone)
    assert (found[:, 0] == 12).all()
    codes = media.pair_codes(found)
    assert (np.diff(codes) >= 0).all() and ((codes >> 16 & 255) == 12).sum() >= len(found) - 3
    assert len(media.pair_codes(media.peaks(b" " * 192))) == 3


def plain_codes(payload):
    """The codes by a transform written out, sum by sum."""
    best, codes = [], []
    for at in range(0, len(payload) - 191, 96):
        x = [(payload[at + i] - payload[max(0, at + i - 1)]) / 128 * (0.54 - 0.46 * math.cos(2 * math.pi * i / 191)) for i in range(192)]
        size = [abs(sum(v * cmath.exp(-2j * math.pi * k * i / 192) for i, v in enumerate(x))) for k in range(1, 97)]
        best.append([k + 1 for k in sorted(range(96), key=lambda k: -round(size[k], 3))[:4]])
    for t, peaks in enumerate(best):
        codes += [t << 32 | peaks[0] << 16 | p << 8 for p in peaks[1:]]
        codes += [t << 32 | peaks[0] << 16 | best[t + g][0] << 8 | g for g in (1, 2) if t + g < len(best)]
    return sorted(codes)


def test_stored_codes_against_a_plain_transform(spark):
    texts = ["", "hello world", "another short text", "Short, too!", " ".join(f"word{i * i}" for i in range(120)), "aXbY" * 100]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in media.read_media(media.encode_media(docs)).collect()}
    for i, text in enumerate(texts):
        payload = text.encode().ljust(max(1, -(-len(text) // 192)) * 192)
        assert got[i].codes == plain_codes(payload)
    assert len({r.feature for r in media.media_rows(docs).collect()}) == len(texts)


def test_peaks_do_not_depend_on_the_parts_they_are_made_in(monkeypatch):
    sound = np.random.default_rng(1).integers(0, 256, 192 * 50).astype(np.uint8).tobytes()
    whole = media.peaks(sound)
    monkeypatch.setattr(media, "FRAMES_AT_ONCE", 7)
    assert (media.peaks(sound) == whole).all()


def test_marks_after_letters_whose_lower_case_is_longer(spark):
    library = Tokenizer.from_file(WORD)
    longer = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and len(chr(c).lower()) > 1]
    assert "İ" in longer
    rng = np.random.default_rng(11)
    alphabet = [*longer * 3, *"aAıIeǅßŒ", ".", ",", " ", "\n", "1", "-"]
    texts = ["TARİHİ, YENİ.", "Kısa: İKİ.", "İ", ".İ,İ"] + ["".join(rng.choice(alphabet, rng.integers(1, 25))) for _ in range(3000)]
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_store.token_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), WORD, 2).collect()}
    for i, x in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        ids = np.array([*x.ids, 2], "<u4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes())), texts[i]


def test_texts_of_a_batch_come_in_parts_and_caches_don_t_pile_up():
    import pyarrow as pa

    from shelfline.llm.common import Recent, text_parts

    texts = ["", "abc" * 10, "", "é" * 40, "x", "y" * 500, "z", ""]
    parts = list(text_parts(pa.array(["left out", *texts]).slice(1), 50))
    assert [t for p in parts for t in p] == texts and len(parts) > 3 and all(len(p) == 1 or sum(len(t.encode()) for t in p) <= 50 for p in parts)
    assert list(text_parts(pa.array([], pa.string()))) == []
    one, other = Recent(lambda words: map(len, words)), Recent(lambda words: map(len, words))
    one.learn({"a"})
    other.learn({"b"})
    other.alone()
    assert not one.now and other.now == {"b": 1} and one.learn({"cc"}) == {"cc": 2}
