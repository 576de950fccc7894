"""SentencePiece encoding and decoding of whole texts with vectorised merge rounds: flat numpy symbol arrays, the
segmented minimum pair rank of each word, simultaneous leftmost merges, and compaction until no pair remains."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, chunks, text_of, text_parts
from .piece_bpe import marked, pre_tokens, vocabulary

_recent: dict[str, Recent] = {}


def _words(model: str) -> Recent:
    """For recent pre-tokens of this worker: ids as text, their number, and the text they decode to."""
    if model not in _recent:
        known = vocabulary(model)

        def make(words: list[str]):
            for ids in known.ids(marked(words)):
                yield ",".join(map(str, ids)), len(ids), known.decoded(ids)

        _recent[model] = Recent(make, words=60_000, chars=1_500_000)
    return _recent[model]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int): the pieces of each whole text as sentencepiece gives them, without begin and end ids.
    Null counts as empty and has no ids; repeated rows are repeated, extra columns are not looked at, long runs are merged
    as round_trip says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for rows in chunks(texts):
                words = [pre_tokens(texts[i]) for i in rows]
                distinct = list(set().union(*words))
                ids = dict(zip(distinct, known.ids(marked(distinct))))
                lists = [[i for w in doc for i in ids[w]] for doc in words]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.start, len(rows)), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: the texts that ids stand for. A dummy space in front is taken off, byte pieces are joined, and what
    is not UTF-8 becomes U+FFFD. Null or no ids give an empty text; control pieces give nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(model)
        for batch in batches:
            texts = [known.decoded(ids or []).removeprefix(" ") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of the decoded text) for each
    row, without shuffles. Null counts as empty; repeated rows give repeated results; no text is cut; extra columns are
    not looked at; an empty table is empty. Runs of more than 4,096 characters that no piece ends in leave the rounds and
    are merged through a heap, with the same result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _words(model).alone()
        for batch in batches:
            sizes, ids, back = [], [], []
            for texts in text_parts(batch.column(1)):
                words = [pre_tokens(text) for text in texts]
                known = cache.learn(set().union(*words))
                for doc in words:
                    parts = list(map(known.__getitem__, doc))
                    text = "".join([p[2] for p in parts]).removeprefix(" ")
                    sizes.append(sum([p[1] for p in parts]))
                    ids.append(hashlib.sha256(",".join([p[0] for p in parts]).encode()).hexdigest())
                    back.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(sizes, np.int64)), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
