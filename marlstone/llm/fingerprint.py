"""Document fingerprints by one-permutation MinHash.

Each word shingle is hashed once; the high bits choose one of BINS bins and a bin keeps its least
hash. An empty bin copies the first full bin that its own hash sequence meets (optimal
densification). Only BITS low bits of each bin are stored, and the likeness of two fingerprints
takes off what equals by chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, bound_batches, shingles, table, text_batches, text_blocks, text_column
from .tokenids import _U, _mix

BINS = 512
BITS = 4
#: Rows that one task streams.
TASK_ROWS = 2000
MOST_TASKS = 50_000
_FREE = np.uint32(0xFFFFFFFF)


def densify(bins: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Fills the empty bins of each row from full ones; rows without a full bin stay."""
    n_full = full.sum(axis=1)
    out = bins.copy()
    single = np.flatnonzero(n_full == 1)
    if len(single):  # every sequence ends at the only full bin
        out[single] = bins[single, full[single].argmax(axis=1)][:, None]
    row, col = np.nonzero(~full & (n_full > 1)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        with np.errstate(over="ignore"):
            other = (_mix(col.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + _U(attempt)) >> _U(32)).astype(np.int64) % bins.shape[1]
        hit = full[row, other]
        out[row[hit], col[hit]] = bins[row[hit], other[hit]]
        row, col = row[~hit], col[~hit]
    return out


def fingerprints(texts: list[str], words: int = SHINGLE_WORDS) -> np.ndarray:
    """A row of BINS values of BITS bits for each text."""
    out = [np.zeros((0, BINS), np.uint8)]
    for a, b in text_blocks(texts):
        h, n = shingles(texts[a:b], words)
        flat = np.full((b - a) * BINS, _FREE, np.uint32)
        at = np.repeat(np.arange(b - a), n) * BINS + (h >> _U(64 - BINS.bit_length() + 1)).astype(np.int64)
        np.minimum.at(flat, at, ((h >> _U(16)) & _U(0xFFFFFFFF)).astype(np.uint32))
        bins = flat.reshape(b - a, BINS)
        dense = densify(bins, bins != _FREE).astype(np.uint64)
        with np.errstate(over="ignore"):  # low bits of different bins with one hash are independent
            low = _mix(dense * _U(BINS) + np.arange(BINS, dtype=np.uint64)) & _U((1 << BITS) - 1)
        out.append(low.astype(np.uint8))
    return np.concatenate(out)


def to_hex(rows: np.ndarray) -> list[str]:
    packed = (rows[:, 0::2] << BITS) | rows[:, 1::2]
    return [x.tobytes().hex() for x in packed.astype(np.uint8)]


def from_hex(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
    return np.stack([raw >> BITS, raw & ((1 << BITS) - 1)], axis=1).reshape(-1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of rows of bins, without the part that equals by chance."""
    chance = 2.0**-BITS
    return np.clip(((a == b).mean(axis=-1) - chance) / (1 - chance), 0, 1)


def edited(text: str, following: str) -> str:
    """The last half of a text's code points replaced by as many first ones of another text."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_LOWEST = -(1 << 63)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, those with pos 1 last: the first of these follows the partition's last."""
    waiting: list[tuple] = []
    for batch in text_batches(batches):
        rows = [*waiting, *zip(*(c.to_pylist() for c in batch.columns))]
        own = next((i for i, r in enumerate(rows) if r[2]), len(rows))
        rows = rows[: own + 1]
        if len(rows) > 1:
            texts = [r[1] for r in rows]
            changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
            prints, prints_changed = fingerprints(texts), fingerprints(changed)
            columns = [
                pa.array([r[0] for r in rows[:-1]], pa.int64()),
                pa.array([len(x) for x in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(x.encode("utf-8")).hexdigest() for x in changed]),
                pa.array(to_hex(prints[:-1])),
                pa.array(to_hex(prints_changed)),
                pa.array(likeness(prints[:-1], prints_changed)),
                pa.array(likeness(prints[:-1], prints[1:])),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        waiting = rows[-1:]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every whole text; null counts as empty, other columns are not
    read. Equal texts have equal fingerprints; a text of few words is its one shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(to_hex(fingerprints(batch.column(1).to_pylist())), pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs)).mapInArrow(run, "doc_id long, fingerprint string")


@dataclass(frozen=True)
class Ranges:
    """Ranges of documents by descending key, then hash. ``cuts`` part the keys; a key of more rows
    than a range has ranges of its own, ``splits`` of equal shares of the hashes."""

    cuts: np.ndarray
    splits: np.ndarray

    @classmethod
    def of(cls, quantiles: list[int]) -> "Ranges":
        keys, times = np.unique(np.array(quantiles, np.int64), return_counts=True)
        hot = dict(zip(keys[times > 1].tolist(), times[times > 1].tolist()))
        alone = [k - 1 for k in hot if k > _LOWEST]
        cuts = np.unique(np.concatenate([keys, np.array(alone, np.int64)]))
        return cls(cuts, np.array([1, *(hot.get(k, 1) for k in cuts[::-1].tolist())], np.int64))

    @property
    def count(self) -> int:
        return int(self.splits.sum())

    def part(self, key: np.ndarray, row_hash: np.ndarray) -> np.ndarray:
        at = len(self.cuts) - np.searchsorted(self.cuts, key, side="left")
        share = ((row_hash >> 32) + (1 << 31)) * self.splits[at] >> 32
        return ((np.cumsum(self.splits) - self.splits)[at] + share).astype(np.int32)


def compare_with_next(docs: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Fingerprints of each text, its edited text and the next document's text, and how alike.

    Documents go by descending doc_id (rows of one doc_id by their text's hash, null doc_ids
    last); behind the last comes the first, so a single document is its own next. Texts are
    dealt once, by ranges of doc_id, and of the hash where a doc_id has very many rows; the first
    document of each range also goes to the range before. Null text counts as empty; an empty
    table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    rows = rows.withColumn("_key", F.coalesce("doc_id", F.lit(_LOWEST))).withColumn("_hash", F.xxhash64("text"))
    tasks = min(MOST_TASKS, max(1, -(-docs.count() // task_rows)))
    ranges = Ranges.of([])
    if tasks > 1:
        at = ", ".join(f"{i / tasks}D" for i in range(1, tasks))
        ranges = Ranges.of(rows.select("_key").agg(F.expr(f"percentile_approx(_key, array({at}), {max(10_000, 20 * tasks)})")).first()[0])

    @F.pandas_udf("int")
    def part_of(key, row_hash):
        import pandas as pd

        return pd.Series(ranges.part(key.to_numpy(), row_hash.to_numpy()))

    if len(ranges.splits) == ranges.count:  # keys alone: texts need not be read for the heads
        heads = rows.select("_key", F.lit(0).cast("long").alias("_hash"))
    else:
        heads = rows.select("_key", "_hash")
    heads = heads.groupBy(part_of("_key", "_hash").alias("part")).agg(F.min(F.struct(F.bitwise_not("_key").alias("k"), F.col("_hash").alias("h"))).alias("head")).collect()  # a row for each range
    heads = {r["part"]: (~r["head"]["k"], r["head"]["h"]) for r in heads}
    order = sorted(heads)
    before = {heads[p]: order[i - 1] for i, p in enumerate(order)}  # first row of a range -> the range before
    by_hash = len(ranges.splits) != ranges.count

    @F.pandas_udf("array<int>")
    def parts_of(key, row_hash):
        import pandas as pd

        k, h = key.to_numpy(), row_hash.to_numpy()
        rows = zip(ranges.part(k, h).tolist(), k.tolist(), h.tolist() if by_hash else [0] * len(k))
        return pd.Series([[p, before[x, y]] if (x, y) in before else [p] for p, x, y in rows])

    dealt = rows.withColumn("_parts", parts_of("_key", "_hash")).select("doc_id", "text", "_key", F.posexplode("_parts").alias("_pos", "_part"))
    dealt = dealt.repartitionById(ranges.count, F.col("_part")).sortWithinPartitions("_pos", F.desc("_key"), F.xxhash64("text"), "text")
    return dealt.select("doc_id", "text", "_pos").mapInArrow(_compare, _SCHEMA)


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(bound_batches(spark), sf_dir, "documents"))
