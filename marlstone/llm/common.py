"""What several operators share: inputs, written tables, word shingles."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import fresh_dir
from .tokenids import _U, _mix, span_keys

#: Words in a shingle and the similarity from which two documents are near-duplicates.
SHINGLE_WORDS = 5
NEAR = 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage with a table in the shared folder: lost executors cost no recomputation."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Removes a table that :func:`written` made, once nothing reads it any more."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that df has a column of (any letter case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def aside(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """df with its columns of these names (any letter case) under other, unused names."""
    return df.toDF(*[unused(df, f"own_{c}")[0] if c.lower() in names else c for c in df.columns])


def own_columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def place_of(df: DataFrame, name: str) -> int:
    """Where a column stands in df, by its name in any letter case."""
    return [c.lower() for c in df.columns].index(name.lower())


def text_column(df: DataFrame, name: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


#: Rows and bytes of text that a Python worker has as strings at once. Spark bounds the batches
#: that it sends by rows and bytes of its own (spark.sql.execution.arrow.maxBytesPerBatch).
BATCH_ROWS = 1000
BATCH_BYTES = 1 << 23


def bound_batches(spark: SparkSession) -> SparkSession:
    """For a job that has its session to itself, as registered queries and stages have: Arrow
    batches of BATCH_ROWS rows at most, which executors of little memory can hold several of.
    Operators leave the session's settings as they are."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


def text_batches(batches: Iterator[pa.RecordBatch], at: int = 1) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, of at most BATCH_ROWS rows and, if of more than one row, of about
    BATCH_BYTES bytes in column ``at``."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        upto, begin = np.cumsum(size, dtype=np.int64), 0
        while begin < batch.num_rows:
            before = upto[begin - 1] if begin else 0
            end = int(np.searchsorted(upto, before + BATCH_BYTES, side="right"))
            end = max(begin + 1, min(end, begin + BATCH_ROWS))
            yield batch.slice(begin, end - begin)
            begin = end


#: glibc's; other C libraries have none.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Gives the system what this process has freed, which its allocators keep otherwise."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def frugal(run: Callable) -> Callable:
    """A function of batches after which its Python worker, which Spark keeps beside the executor
    for later tasks, gives back what it has freed."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text). Words are lower-cased runs of ASCII
    letters and digits and of all characters beyond ASCII."""
    raw = [x.lower().encode("utf-8", "replace") for x in texts]
    joined = b"\0".join(raw) + b"\0"
    codes = np.frombuffer(joined, np.uint8)
    word = _WORD[codes]
    edge = np.diff(word.astype(np.int8), prepend=0)
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text_ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1) - 1
    upto = np.searchsorted(begins, text_ends)
    return span_keys(joined + bytes(8), begins, ends), np.diff(upto, prepend=0)


def shingles(texts: list[str], words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, number of shingles of each text), repeats included. A text of
    fewer words has one shingle of all of them, a text without words one of all it has."""
    h, n = word_hashes(texts)
    bare = np.flatnonzero(n == 0)
    if len(bare):
        own = [xxhash.xxh3_64_intdigest(texts[i].encode("utf-8", "replace")) for i in bare.tolist()]
        h, n = np.insert(h, (np.cumsum(n) - n)[bare], np.array(own, np.uint64)), np.maximum(n, 1)
    first = np.cumsum(n) - n
    count = np.where(n >= words, n - words + 1, 1)
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    size = np.repeat(np.minimum(n, words), count)
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate([h, np.zeros(words, np.uint64)])
    with np.errstate(over="ignore"):
        for j in range(words):
            w = padded[at + j]
            out = np.where(j < size, _mix(out * _U(0x9E3779B97F4A7C15) + w), out)
    return out, count


def text_blocks(texts: list[str], chars: int = 1 << 20):
    """Slices (begin, end) of a list with about so many characters each."""
    begin = size = 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= chars:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
