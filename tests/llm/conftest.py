"""Documents with nulls, ties, repeated rows, long texts and columns whose names clash with the operators' own."""

import pytest

CLASHING = "digest possible keep_id group_size row tie key score print size sid times plan docs path kind n begin y labelled part fold token y_ evidence".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)

PASSAGE = " ".join(f"passage{i}" for i in range(60))
TEXTS = [
    (1, "The quick brown fox, 12 jumps; over the lazy dog."),
    (2, None),
    (3, ""),
    (4, " \t\n\r\x0b\x0c "),
    (5, "The quick brown fox, 12 jumps; over the lazy dog."),
    (6, "the quick brown fox, 12 jumps; over the lazy dog."),
    (7, "x"),
    (8, f"{PASSAGE} then an end of its own"),
    (9, f"a start of its own {PASSAGE}"),
    (10, "Ünïcödé ─ 漢字 かな 한국어 🙂🙂 ▁   nbsp � <s> </s> <unk> <|endoftext|> <0x41>"),
    (11, "word " * 30_000),
    (12, "".join(chr(97 + i % 7) for i in range(50_000))),
    (13, "  two  spaces   here "),
    (14, "loop of words " * 40),
    (15, "İstanbul ẞ STRASSE ﬁ ①"),
    (16, "nul \x00 and \x1f control \x85   ends"),
    (16, "nul \x00 and \x1f control \x85   ends"),
    (17, "two rows with one id, first"),
    (17, "two rows with one id, second"),
    (-3, "a negative id"),
    (9_000_000_000, "a large id, and at last\nsome\nlines, of text."),
]


def rows_of(pairs):
    sources = ["web", "books", None, "code"]
    return [(d, t, "en", sources[i % 4], None if t is None else len(t), *["x"] * len(CLASHING)) for i, (d, t) in enumerate(pairs)]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(rows_of(TEXTS), SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def nameless(spark):
    """Rows with null doc_ids among others."""
    return spark.createDataFrame(rows_of([(None, "no id"), (None, None), (None, "no id"), (1, "no id"), (2, f"{PASSAGE} x"), (None, f"{PASSAGE} y")]), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pairs_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
