"""Token ids in Arrow stream files: fixed-size lists of equal-length sequences and their masks.

A shard holds the ids of a run of documents in ascending doc_id order, cut into sequences of
``sequence`` ids; the last one is padded and its mask, a byte for each id, is 0 there. Every record batch but the
last has ``BATCH_ROWS`` rows, so sequence i of a mapped file is row i % BATCH_ROWS of batch
i // BATCH_ROWS and is read without a copy. A second file of the shard lists its documents.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import arrow_fs, fresh_dir
from .common import bound_batches, frugal, table, text_batches, text_column
from .tokenids import PieceCache, load_tokenizer

SEQUENCE = 1024
BATCH_ROWS = 64
#: Ids up to which a task reads shards that follow each other; a larger shard has a task of its own.
READ_IDS = 1 << 25
END_ID = 1
VOCABULARY = "word_bpe_49k.json"


@dataclass(frozen=True)
class Shard:
    """One shard of a token data set; ``start`` counts the ids of all shards before it."""

    path: str
    docs: int
    ids: int
    start: int


def id_type(largest: int) -> np.dtype:
    """The narrowest unsigned type of 16 or 32 bits that holds all ids."""
    if not 0 <= largest < 1 << 32:
        raise ValueError(f"{largest} is no id of 32 bits")
    return np.dtype(np.uint16) if largest < 1 << 16 else np.dtype(np.uint32)


class ShardWriter:
    """Writes one shard under a name that no other writer has; it is whole after :meth:`close`."""

    def __init__(self, uri: str, name: str, dtype: np.dtype, sequence: int = SEQUENCE):
        self.fs, folder = arrow_fs(uri)
        self.fs.create_dir(folder, recursive=True)
        self.dtype, self.sequence = dtype, sequence
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.uint8(), sequence))])
        self.doc_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.out = [self.fs.open_output_stream(f"{folder}/{name}{x}") for x in (".arrow", ".docs.arrow")]
        # sequences are mapped as they lie; the list of documents is read once, from first to last
        packed = pa.ipc.IpcWriteOptions(compression="zstd")
        self.files = [pa.ipc.new_file(o, s, options=x) for o, s, x in zip(self.out, (self.schema, self.doc_schema), (None, packed))]
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.ids = self.docs = 0

    def _put(self, ids: np.ndarray, real: int) -> None:
        mask = np.zeros(len(ids), np.uint8)
        mask[:real] = 1
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (ids, mask)]
        self.files[0].write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def add(self, doc_ids: list[int | None], ids: list[np.ndarray]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        starts = self.ids + np.cumsum(sizes) - sizes
        self.files[1].write_batch(pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(sizes)], schema=self.doc_schema))
        most = max((int(x.max()) for x in ids if len(x)), default=0)
        if most > np.iinfo(self.dtype).max:
            raise ValueError(f"id {most} does not fit {self.dtype}")
        self.waiting += [x.astype(self.dtype) for x in ids]
        self.n_waiting += int(sizes.sum())
        self.ids += int(sizes.sum())
        self.docs += len(ids)
        step = self.sequence * BATCH_ROWS
        if self.n_waiting >= step:
            flat = np.concatenate(self.waiting)
            full = len(flat) // step * step
            for at in range(0, full, step):
                self._put(flat[at : at + step], step)
            self.waiting, self.n_waiting = [flat[full:]], len(flat) - full

    def close(self) -> None:
        if self.n_waiting:
            flat = np.concatenate(self.waiting)
            padded = np.zeros(-(-len(flat) // self.sequence) * self.sequence, self.dtype)
            padded[: len(flat)] = flat
            self._put(padded, len(flat))
        for f, o in zip(self.files, self.out):
            f.close()
            o.close()


class ShardReader:
    """Random access to a shard's sequences and documents; local files are mapped."""

    def __init__(self, path: str):
        fs, at = arrow_fs(path)
        local = isinstance(fs, pa.fs.LocalFileSystem)
        self.file, self.docs = (pa.ipc.open_file(pa.memory_map(x) if local else fs.open_input_file(x)) for x in (at, at.removesuffix(".arrow") + ".docs.arrow"))
        self.sequence = self.file.schema.field("ids").type.list_size
        self._batch: tuple[int, np.ndarray] = (-1, np.zeros(0))

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of sequence i, as views of the mapped file."""
        batch = self.file.get_batch(i // BATCH_ROWS)
        k = i % BATCH_ROWS
        return tuple(batch.column(c)[k].values.to_numpy(zero_copy_only=True) for c in (0, 1))

    def ids(self, start: int, n: int) -> np.ndarray:
        """The n ids from place ``start`` of the shard."""
        step, parts = self.sequence * BATCH_ROWS, []
        while n:
            k = start // step
            if self._batch[0] != k:
                self._batch = (k, self.file.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True))
            part = self._batch[1][start - k * step : start - k * step + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        for k in range(self.docs.num_record_batches):
            yield from zip(*(c.to_pylist() for c in self.docs.get_batch(k).columns))


def write_tokens(docs: DataFrame, tokenizer_path: str, out_dir: str, end_id: int = END_ID, sequence: int = SEQUENCE) -> list[Shard]:
    """Encodes whole texts, adds the end id to each and writes shards in ascending doc_id order.

    Rows of one doc_id are ordered by their text's hash, and ranges cut by it too; a null doc_id
    comes first; null text is empty and gives its end id alone. An empty table gives no shard.
    Ids are of 16 bits if the vocabulary and the end id fit, else of 32. Every attempt of a task
    writes files of its own, and only those of the attempts that Spark took are in the result, a
    row for each shard, which is what :func:`read_tokens` needs; other attempts' files are
    removed. ``out_dir`` is a path that Arrow can open too (file, hdfs, s3 or s3a, abfs, gs).
    """
    dtype = id_type(max(load_tokenizer(tokenizer_path).get_vocab_size(with_added_tokens=True) - 1, end_id))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, context, out = PieceCache.of(tokenizer_path), TaskContext.get(), None
        name = f"shard-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        for batch in text_batches(batches):
            out = out or ShardWriter(out_dir, name, dtype, sequence)
            out.add(batch.column(0).to_pylist(), [np.append(x, np.uint32(end_id)) for x in cache.encode(batch.column(1).to_pylist())])
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [context.partitionId()], "path": [f"{out_dir}/{name}.arrow"], "docs": [out.docs], "ids": [out.ids]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    found = sorted(tuple(r) for r in rows.mapInArrow(frugal(write), "part long, path string, docs long, ids long").collect())  # a row for each shard
    shards, start = [], 0
    for _, path, n_docs, ids in found:
        shards.append(Shard(path, n_docs, ids, start))
        start += ids
    if shards:
        _remove_others(out_dir, shards)
    return shards


def _remove_others(out_dir: str, shards: list[Shard]) -> None:
    """Files of attempts that were lost or ran twice."""
    fs, folder = arrow_fs(out_dir)
    mine = {x.path.rsplit("/", 1)[1].removesuffix(".arrow") for x in shards}
    for f in fs.get_file_info(pa.fs.FileSelector(folder)):
        if f.base_name.startswith("shard-") and f.base_name.split(".", 1)[0] not in mine:
            fs.delete_file(f.path)


def _runs(shards: list[Shard]) -> list[list[Shard]]:
    """Shards by the task that reads them: a task for each of many small ones costs more than to read it."""
    out: list[list[Shard]] = []
    size = 0
    for x in shards:
        if not out or size + x.ids > READ_IDS:
            out.append([])
            size = 0
        out[-1].append(x)
        size += x.ids
    return out


def read_tokens(spark: SparkSession, shards: list[Shard]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files; start counts the
    ids of all documents before it, ids_crc32 the ids as little-endian unsigned 32-bit."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], schema)

    runs = _runs(shards)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in (x for i in batch.column(0).to_pylist() for x in runs[i]):
                reader, base = ShardReader(shard.path), shard.start
                for k in range(reader.docs.num_record_batches):
                    docs, start, n = reader.docs.get_batch(k).columns
                    crc = [zlib.crc32(reader.ids(s, m).astype("<u4").tobytes()) for s, m in zip(start.to_pylist(), n.to_pylist())]
                    yield pa.RecordBatch.from_arrays([docs, pa.array(start.to_numpy() + base), n, pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(runs), 1, len(runs)).mapInArrow(frugal(read), schema)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    shards = write_tokens(table(bound_batches(spark), sf_dir, "documents"), public_tokenizers.path(VOCABULARY), fresh_dir(spark, "tokens"))
    return read_tokens(spark, shards)
