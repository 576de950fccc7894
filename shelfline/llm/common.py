"""What the corpus operators share: the cluster's shared folder, whole-text batches, word caches and a
join that stays even when one key holds a large part of the rows."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: dict[str, str] = {}

#: Characters of text that a task holds as word lists at once.
CHUNK_CHARS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local one only where that is unset (tests, local mode)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own_folder[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, so a lost executor costs one stage, and
    what several plans read is computed once. codec: the Parquet compression, the session's where None."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text"):
    """The text as every operator sees it: null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def doc_id_bytes(column: str = "doc_id"):
    """doc_id as text, for the crc32 that deals out folds; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[range]:
    """Row ranges of a batch, each up to about `limit` characters, one row at least; no text is cut."""
    begin = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= limit:
            yield range(begin, i + 1)
            begin, held = i + 1, 0
    if begin < len(texts):
        yield range(begin, len(texts))


def text_parts(column: pa.Array, limit: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """The texts of a batch's column in order, as lists of up to about `limit` bytes, one text at least; the batch as a
    whole never becomes Python strings."""
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(ends):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + limit, "right")))
        yield column.slice(begin, end - begin).to_pylist()
        begin = end


class Recent:
    """What was computed for recent distinct words, in two generations so that memory stays bounded: when the new
    one is full it becomes the old one, and what is used again moves on."""

    _every: ClassVar[weakref.WeakSet] = weakref.WeakSet()

    def __init__(self, make: Callable[[list[str]], Iterable], words: int = 100_000, chars: int = 2_000_000):
        Recent._every.add(self)
        self.make, self.words, self.chars = make, words, chars
        self.now: dict = {}
        self.before: dict = {}
        self.held = 0

    def alone(self) -> Recent:
        """Empties what a worker still has of other operators' words. Spark hands workers on from stage to stage."""
        for other in list(Recent._every):
            if other is not self:
                other.now, other.before, other.held = {}, {}, 0
        return self

    def learn(self, words: set[str]) -> dict:
        """A dict that has at least the given words."""
        if len(self.now) > self.words or self.held > self.chars:
            self.before, self.now, self.held = self.now, {}, 0
        now, before = self.now, self.before
        missing = words.difference(now)
        if missing:
            self.held += sum(map(len, missing))
            again = missing.intersection(before)
            now.update((w, before[w]) for w in again)
            new = list(missing.difference(again))
            now.update(zip(new, self.make(new)))
        return now


def attach(facts: DataFrame, table: DataFrame, key: str, rows: str, total: int, most_hot: int = 2000) -> DataFrame:
    """facts left join table on key, where table has one row a key and `rows` counts the facts of that key.

    Keys with more than total / most_hot rows would crowd into single tasks of a shuffle. There are fewer than
    most_hot of them by their definition, so their table rows are broadcast and their facts stay where they are;
    all other keys are joined by a shuffle. facts should be stored, as it is read twice."""
    hot = F.col(rows) > max(1, total // most_hot)
    heavy = F.broadcast(table.filter(hot))
    light = table.filter(~hot)
    at_once = facts.join(heavy, key, "inner")
    dealt = facts.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key, "left")
    return at_once.unionByName(dealt)
