"""Token counts of whole texts by rank-synchronous merging, without making the ids.

The pre-tokens of a batch of documents are held as ragged numpy arrays; in each round every sequence applies its
lowest-ranked pair at once with all others, and what survives is counted. A pre-token that came up recently in the
worker is not merged again."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, chunks, text_of
from .piece_bpe import marked, pre_tokens, vocabulary

_recent: dict[str, Recent] = {}


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for each row: the counts that sentencepiece gives with the model
    file, without begin and end tokens. Null counts as empty (0 tokens); repeated rows give repeated results; other
    columns are not read; there is no shuffle and no text is cut. An empty table is empty. Runs of more than 4,096
    characters that no piece ends in leave the rounds and are merged through a heap, with the same result."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _recent:
            known = vocabulary(model)
            _recent[model] = Recent(lambda words: known.token_counts(marked(words)))
        cache = _recent[model]
        for batch in batches:
            texts, totals = batch.column(2).to_pylist(), []
            for rows in chunks(texts):
                words = [pre_tokens(texts[i]) for i in rows]
                counts = cache.learn(set().union(*words))
                totals += [sum(map(counts.__getitem__, doc)) for doc in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(totals, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"), text_of(text_col).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
