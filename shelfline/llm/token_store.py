"""Token ids of whole documents in binary shards, with constant-time access by document key.

A shard file is: magic, version and section lengths; the ids of its documents one after another, raw little-endian;
where each document starts; its doc_ids; and a minimal perfect hash (level sizes, bits, fingerprints, and the
document's number for each slot). Shards are written in doc_id order, so that all shards together are one long array
of ids. Ids are stored in 16 bits where the vocabulary allows it, else in 32."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Recent, chunks, fresh_path, partitions, stored, text_of
from .mph_index import PerfectHash

MAGIC, VERSION = b"TOKSHARD", 1
_HEAD = struct.Struct("<8sHHQQQQQ")  # magic, version, bytes of an id, documents, ids, keys, levels, bits
#: A shard is closed beyond so many bytes of ids, which bounds a writer's memory.
SHARD_BYTES = 64 << 20

_encoders: dict[str, Recent] = {}


def _word_ids(path: str) -> Recent:
    """Ids of words by the tokenizers library, as little-endian 16-bit or 32-bit bytes, for recent words of this worker.

    Words of letters only are one pre-token each, so that many are encoded as one text and cut where a token ends a
    word; all others are encoded one by one."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        kind = id_type(path)
        vocabulary = library.get_vocab()
        ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            ends_word[i] = token.endswith("</w>")

        if library.encode("Ab, c.", add_special_tokens=False).ids != [i for x in ("ab", ",", "c", ".") for i in library.encode(x, add_special_tokens=False).ids]:
            raise ValueError("expected a tokenizer that drops white space, lower-cases and parts words from marks")

        def encode(words: list[str]):
            got = dict.fromkeys(words, b"")
            plain = [w for w in words if w.isalpha()]
            ids = np.array(library.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, kind)
            ends = (np.flatnonzero(ends_word[ids]) + 1) * ids.itemsize
            if len(ends) == len(plain):
                data = ids.tobytes()
                for w, begin, end in zip(plain, [0, *ends.tolist()], ends.tolist()):
                    got[w] = data[begin:end]
                words = [w for w in words if w and not w.isalpha()]
            for w, x in zip(words, library.encode_batch_fast(words, add_special_tokens=False)):
                got[w] = np.array(x.ids, kind).tobytes()
            return got.values()

        _encoders[path] = Recent(encode, words=150_000, chars=4_000_000)
    return _encoders[path]


def _spaced(text: str, mark: str) -> str:
    """A space before each mark where all marks follow letters, digits or spaces: the tokenizer parts them there anyway.
    What counts is the lower-cased letter: that of U+0130 ends in a combining dot, which a mark stays with."""
    parts = text.split(mark)
    fits = len(parts) > 1 and all(p and (p[-1].lower()[-1].isalnum() or p[-1] == " ") for p in parts[:-1])
    return f" {mark}".join(parts) if fits else text


def _units(text: str) -> list[str]:
    """Parts of a text that the tokenizer encodes by themselves; it drops white space and lower-cases, so line ends count
    as spaces, and texts of Latin-1 without special tokens are lower-cased for fewer distinct parts."""
    text = text.replace("\n", " ")
    if "<|" not in text and _is_latin(text):
        text = text.lower()
    return _spaced(_spaced(text, "."), ",").split(" ")


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def id_type(path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def shard_bytes(keys: list[int | None], payloads: list[bytes], width: int) -> bytes:
    """The file of documents in the given order. Null keys are stored and not indexed; of equal keys the first is."""
    ends = np.cumsum([0, *(len(p) // width for p in payloads)]).astype("<u8")
    first: dict[int, int] = {}
    for i, k in enumerate(keys):
        if k is not None:
            first.setdefault(k, i)
    indexed = np.fromiter(first, np.int64, len(first))
    index = PerfectHash.of(indexed)
    numbers = np.zeros(len(first), "<u4")
    numbers[index.slots(indexed)] = np.fromiter(first.values(), np.int64, len(first))
    known = np.array([k is not None for k in keys], np.uint8)
    ids = np.array([k or 0 for k in keys], "<i8")
    head = _HEAD.pack(MAGIC, VERSION, width, len(keys), int(ends[-1]), len(first), len(index.sizes), len(index.bits))
    return b"".join(
        [head, *payloads, ends.tobytes(), ids.tobytes(), known.tobytes(), index.sizes.astype("<i8").tobytes(), np.packbits(index.bits).tobytes(), index.prints.astype("<u4").tobytes(), numbers.tobytes()]
    )


class Shard:
    """A shard file's contents; get() finds a document's ids by its key in constant time."""

    def __init__(self, data: bytes):
        magic, version, width, docs, ids, keys, levels, bits = _HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token shard of this version")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, n, at)
            at += got.nbytes
            return got

        self.ids = take(f"<u{width}", ids)
        self.ends = take("<u8", docs + 1).astype(np.int64)
        self.keys, self.known = take("<i8", docs), take("u1", docs).astype(bool)
        sizes, packed = take("<i8", levels), take("u1", -(-bits // 8))
        self.index = PerfectHash(np.unpackbits(packed)[:bits].astype(bool), sizes, take("<u4", keys))
        self.numbers = take("<u4", keys)

    def document(self, number: int) -> np.ndarray:
        return self.ids[self.ends[number] : self.ends[number + 1]]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of the documents with these keys by the index, all at once; -1 for keys that aren't there."""
        slots = self.index.slots(keys)
        return np.where(slots < 0, -1, self.numbers[np.maximum(slots, 0)].astype(np.int64)) if len(self.numbers) else slots

    def numbered(self) -> np.ndarray:
        """The number under which each stored key leads to its document: by the index, and by place for null keys and
        for repeats of a key (they follow each other), which the index doesn't hold."""
        found, again = np.arange(len(self.keys)), np.zeros(len(self.keys), bool)
        again[1:] = (self.keys[1:] == self.keys[:-1]) & self.known[:-1]
        asked = np.flatnonzero(self.known & ~again)
        found[asked] = self.find(self.keys[asked])
        if len(found) and found.min() < 0:
            raise ValueError("a stored key is not in its shard's index")
        return found


def _put(folder: str, name: str, data: bytes) -> str:
    """Writes under a name of its own and then moves, so that a task run again leaves one whole file."""
    fs, root = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    draft = f"{root}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as f:
        f.write(data)
    fs.move(draft, f"{root}/{name}")
    return f"{folder}/{name}"


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts (null: empty) without special tokens, appends end_id and writes shards in ascending doc_id
    order (null first; equal doc_ids by a hash of their texts). Returns the stored manifest: one row for each shard
    of up to 64 MB (more only where one text alone has more), none for an empty table. Each task encodes and writes one
    range of doc_ids and can be run again alone; there are spark.sql.shuffle.partitions ranges. Extra columns are not
    looked at."""
    spark = docs.sparkSession
    n = partitions(spark)
    kind = id_type(tokenizer)
    end = np.array([end_id], kind).tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        cache = _word_ids(tokenizer)
        keys: list = []
        payloads: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal keys, payloads, held, shard
            path = _put(folder, f"shard-{part:06d}-{shard:04d}.bin", shard_bytes(keys, payloads, len(end)))
            real = [k for k in keys if k is not None]
            row = {"part": [part], "shard": [shard], "path": [path], "n_docs": [len(keys)], "n_tokens": [held // len(end)], "first_id": [min(real, default=None)], "last_id": [max(real, default=None)]}
            keys, payloads, held, shard = [], [], 0, shard + 1
            return pa.RecordBatch.from_pydict(row, schema=_MANIFEST)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for rows in chunks(texts):
                words = [_units(texts[i]) for i in rows]
                known = cache.learn(set().union(*words))
                for i, doc in zip(rows, words):
                    payload = b"".join(map(known.__getitem__, doc)) + end
                    keys.append(ids[i])
                    payloads.append(payload)
                    held += len(payload)
                    if held >= SHARD_BYTES:
                        yield close()
        if keys:
            yield close()

    ordered = (
        docs.select(F.col(id_col).cast("long").alias("key"), text_of(text_col).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(n, F.col("key").asc_nulls_first(), "tie")
        .sortWithinPartitions(F.col("key").asc_nulls_first(), "tie")
    )
    return stored(ordered.select("key", "text").mapInArrow(write, "part int, shard int, path string, n_docs long, n_tokens long, first_id long, last_id long"), "manifest")


_MANIFEST = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())])


def _load(path: str) -> Shard:
    folder, _, name = path.rpartition("/")
    fs, root = pa.fs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{root}/{name}") as f:
        return Shard(f.read())


def _in_order(manifest: DataFrame) -> DataFrame:
    """Adds where each shard starts. The manifest has a row for each 64 MB, so one task can order it."""
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(manifest: DataFrame) -> DataFrame:
    """Reads the shard files back: doc_id, start (ids before it in all shards), n_tokens, ids_crc32 (of the ids as
    32-bit little-endian integers). Each key is looked up in its shard's perfect hash, and the document it leads to is
    read. One shard is in a task's memory at a time. Null and repeated doc_ids have a row for each document; an empty
    manifest has none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = _load(path)
                numbers = shard.numbered()
                for lo in range(0, len(numbers), 10_000):
                    at = numbers[lo : lo + 10_000]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(shard.keys[lo : lo + 10_000], pa.int64(), mask=~shard.known[lo : lo + 10_000]),
                            "start": pa.array(shard.ends[at] + base, pa.int64()),
                            "n_tokens": pa.array(shard.ends[at + 1] - shard.ends[at], pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(shard.document(i).astype("<u4").tobytes()) for i in at], pa.int64()),
                        }
                    )

    placed = _in_order(manifest).select("path", "base").repartition(partitions(manifest.sparkSession))
    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(keys: DataFrame, manifest: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """Keyed access for a frame of distinct keys: doc_id, ids. Keys go to the first shard whose range holds them and
    are found by its perfect hash; unknown and null keys give no row. The shards' ranges, a row for each 64 MB, go to
    the driver and the tasks."""
    spark = keys.sparkSession
    ranges = manifest.filter("last_id is not null").orderBy("part", "shard").select("path", "last_id").collect()
    paths, last = [r.path for r in ranges], np.array([r.last_id for r in ranges], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(last, batch.column(0).to_numpy(zero_copy_only=False))
            inside = at < len(last)
            wanted = batch.filter(pa.array(inside)).column(0)
            yield pa.RecordBatch.from_arrays([wanted, pa.array([paths[i] for i in at[inside]], pa.string())], ["key", "path"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, shard = None, None
        for batch in batches:
            keys, paths = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), object)
            for at in dict.fromkeys(paths):
                if at != path:
                    path, shard = at, _load(at)
                asked = keys[paths == at]
                numbers = shard.find(asked)
                ids = [shard.document(n).astype(np.int64) for n in numbers[numbers >= 0]]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(asked[numbers >= 0], pa.int64()), "ids": pa.array(ids, pa.list_(pa.int64()))})

    placed = keys.select(F.col(key_col).cast("long").alias("key")).filter("key is not null").mapInArrow(place, "key long, path string")
    return placed.repartition(partitions(spark), "path").sortWithinPartitions("path").mapInArrow(look_up, "doc_id long, ids array<long>")


def token_rows(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes the shards of docs to a new folder in the shared folder and reads them back, as read_documents does."""
    spark: SparkSession = docs.sparkSession
    return read_documents(write_tokens(docs, tokenizer, end_id, fresh_path(spark, "tokens")))
