"""Line deduplication by range-partitioned hashes, returning keep bitmaps instead of text.

Every distinct line key of a document is one row (128-bit hash, document, places). Rows are
range-partitioned and sorted by hash, document and place, so a stream over a partition meets a
key's first document first and drops the rest. A key of very many documents spreads over several
partitions: the ranges cut by document too, and whether a partition's first key began in an
earlier one follows from the partitions' first and last keys, one row each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import aside, bound_batches, drop_written, frugal, own_columns, place_of, table, text_batches, text_column, unused, written

LEAST_CHARS = 10
#: Line rows that leave a Python worker at once.
LINE_ROWS = 1 << 15
#: Stripped at both ends of a line before comparing.
BLANKS = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """A UTF-8 line without blanks at its ends, A-Z in lower case."""
    return line.strip(BLANKS).lower()


def _line_rows(least_chars: int):
    kinds = {"h1": pa.int64(), "h2": pa.int64(), "doc_id": pa.int64(), "row_hash": pa.int64(), "places": pa.list_(pa.int32())}

    def packed(cols: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[k], t) for k, t in kinds.items()], [*kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 2):
            cols: dict[str, list] = {k: [] for k in kinds}
            for doc, row, text in zip(*(c.to_pylist() for c in batch.columns)):
                places: dict[bytes, list[int]] = {}
                for i, line in enumerate(text.encode("utf-8").split(b"\n")):
                    key = line_key(line)
                    if len(key) >= least_chars and (len(key) >= 4 * least_chars or len(key.decode("utf-8")) >= least_chars):
                        places.setdefault(xxhash.xxh3_128_digest(key), []).append(i)
                for key, at in places.items():
                    for k, x in zip(kinds, (int.from_bytes(key[:8], "big", signed=True), int.from_bytes(key[8:], "big", signed=True), doc, row, at)):
                        cols[k].append(x)
                if len(cols["h1"]) >= LINE_ROWS:
                    yield packed(cols)
                    cols = {k: [] for k in kinds}
            yield packed(cols)

    return run


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that lose their lines (kind 0), rows of the partition's first key and document, which
    lose theirs if an earlier partition ends with that key (1), and a row with its first and last
    key (2)."""
    part = TaskContext.get().partitionId()
    first = last = None  # (h1, h2, doc_id)
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2 = (batch.column(i).to_numpy() for i in (0, 1))
        doc = batch.column(2)
        null, doc = doc.is_null().to_numpy(zero_copy_only=False), doc.fill_null(-(1 << 63)).to_numpy()
        new_key = np.ones(len(h1), bool)
        new_key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        run = np.cumsum(new_key) - 1
        starts = np.flatnonzero(new_key)
        holder, holder_null = doc[starts], null[starts]
        if first is None:
            first = (h1[0], h2[0], doc[0], null[0])
        elif (h1[0], h2[0]) == last[:2]:
            holder[0], holder_null[0] = last[2:]
        mine = (doc == holder[run]) & (null == holder_null[run])
        head = mine & (h1 == first[0]) & (h2 == first[1])
        last = (h1[-1], h2[-1], holder[run[-1]], holder_null[run[-1]])
        take = np.flatnonzero(~mine | head)
        if len(take):
            out = batch.take(pa.array(take))
            kind = np.where(head[take], 1, 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.full(len(take), part, np.int32)), *out.columns, pa.nulls(len(take), pa.int64()), pa.nulls(len(take), pa.int64())], _NAMES)
    if first is not None:
        one = lambda x: pa.array([int(x)], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([part], pa.int32()), one(first[0]), one(first[1]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int32())), one(last[0]), one(last[1])], _NAMES)


_NAMES = ["kind", "part", "h1", "h2", "doc_id", "row_hash", "places", "last1", "last2"]
_SCHEMA = "kind int, part int, h1 long, h2 long, doc_id long, row_hash long, places array<int>, last1 long, last2 long"


def dropped_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, row_hash, dropped): the places of the lines that each document loses, for
    documents that lose any; row_hash is xxhash64 of the text."""
    keys = _keyed(docs).mapInArrow(frugal(_line_rows(least_chars)), "h1 long, h2 long, doc_id long, row_hash long, places array<int>")
    keys = written(keys, "keys")  # read twice: for the bounds of the ranges and for their rows
    rows = keys.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "row_hash", "places")
    found = written(rows.mapInArrow(frugal(_first_occurrences), _SCHEMA), "lines")
    drop_written(keys)
    ends = sorted(tuple(r) for r in found.where("kind = 2").select("part", "h1", "h2", "last1", "last2").collect())  # a row for each partition
    continued = [b[0] for a, b in zip(ends, ends[1:]) if a[3:] == b[1:3]]
    lost = found.where((F.col("kind") == 0) | ((F.col("kind") == 1) & F.col("part").isin(continued)))
    return lost.groupBy("doc_id", "row_hash").agg(F.flatten(F.collect_list("places")).alias("dropped"))


def _keyed(docs: DataFrame) -> DataFrame:
    text = text_column(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row_hash"), text.alias("text"))


def pack_bits(n: int, dropped: list[int]) -> tuple[int, bytes]:
    """(lines dropped, deflated bitmap of n lines, 1 for a line that stays)."""
    keep = np.ones(n, np.uint8)
    keep[dropped] = 0
    return int(n - keep.sum()), zlib.compress(np.packbits(keep).tobytes(), 6)


def unpack_bits(n: int, bitmap: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n).astype(bool)


def line_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, row_hash, n_lines, n_dropped, keep): a row for each different (doc_id, text).

    A text is split at line feeds; null or empty text is one empty line. Keys of at least
    ``least_chars`` code points that two documents hold lose all their lines except in the
    smallest doc_id that holds them; rows of one doc_id are one document here, and a null doc_id
    is the smallest. Repeated rows share a bitmap; an empty table gives no rows; other columns
    are not read.
    """
    lines = _keyed(docs).select("doc_id", "row_hash", F.size(F.split("text", "\n", -1)).alias("n_lines")).dropDuplicates(["doc_id", "row_hash"])
    lost = dropped_lines(docs, least_chars).withColumnsRenamed({"doc_id": "_doc", "row_hash": "_row"})
    both = lines.join(lost, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row_hash") == F.col("_row")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, row, n, lost = batch.columns
            bits = [pack_bits(k, x or []) for k, x in zip(n.to_pylist(), lost.to_pylist())]
            columns = [doc, row, n, pa.array([x[0] for x in bits], pa.int64()), pa.array([x[1] for x in bits], pa.binary())]
            yield pa.RecordBatch.from_arrays([columns[0], columns[1], columns[2].cast(pa.int64()), *columns[3:]], ["doc_id", "row_hash", "n_lines", "n_dropped", "keep"])

    return both.select("doc_id", "row_hash", "n_lines", "dropped").mapInArrow(frugal(run), "doc_id long, row_hash long, n_lines long, n_dropped long, keep binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The rows of docs with text cut to its kept lines, and n_lines and n_dropped behind. A null
    text stays null. The new columns replace old ones of these names."""
    new = ("n_lines", "n_dropped")
    kept = docs.drop(*[c for c in docs.columns if c.lower() in new])
    doc, row, keep = unused(kept, "bits_doc", "bits_row", "bits_keep")
    bits = bitmaps.select(F.col("doc_id").alias(doc), F.col("row_hash").alias(row), *new, F.col("keep").alias(keep))
    joined = kept.join(bits, kept["doc_id"].cast("long").eqNullSafe(bits[doc]) & (F.xxhash64(text_column(kept)) == bits[row]))
    joined = joined.select(*own_columns(kept), *new, keep)
    at = place_of(kept, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, at):
            *columns, n_lines, n_dropped, keep = batch.columns
            texts = columns[at].to_pylist()
            for i, (n, lost, bits) in enumerate(zip(n_lines.to_pylist(), n_dropped.to_pylist(), keep.to_pylist())):
                if lost:
                    stay = unpack_bits(n, bits).tolist()
                    texts[i] = "\n".join(x for x, k in zip(texts[i].split("\n"), stay) if k)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, n_lines, n_dropped], batch.schema.names[:-1])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return joined.mapInArrow(frugal(run), f"{schema}, n_lines long, n_dropped long")


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with repeated lines cut from the texts; the columns of docs, n_chars counted anew."""
    named = docs.columns
    docs = aside(docs, ("n_lines", "n_dropped"))
    out = apply_bitmaps(docs, line_bitmaps(docs))
    chars = [F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias(c) if c.lower() == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*chars).toDF(*named)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(bound_batches(spark), sf_dir, "documents").select("doc_id", "text")
    kept = apply_bitmaps(docs, line_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(text_column(kept).cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), holders AS (
  SELECT key, min(doc_id) AS holder FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
)
SELECT k.doc_id, count(*) AS n_lines, CAST(count(*) FILTER (h.holder IS NOT NULL AND h.holder <> k.doc_id) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (h.holder IS NULL OR h.holder = k.doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN holders h ON k.key = h.key
GROUP BY k.doc_id
"""
