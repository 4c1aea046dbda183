"""Best-fit packing behind a Martello-Toth dominance reduction.

Documents become token pieces of at most ``capacity`` tokens. What decides a packing is how many
pieces have each length, so the solver works on that histogram: at most ``capacity`` rows,
however large the corpus. The reduction fixes sets of up to three pieces that dominate every
other set with the same largest piece and takes them out; best-fit decreasing packs the rest,
whole groups of equal pieces at a time. Its result is a list of patterns (lengths in a
sequence, how many sequences); pieces get their places by their rank among those of one length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, frugal, own_columns, table, text_batches, text_column, unused, written
from .tokenids import PieceCache

CAPACITY = 2048
END_ID = 0
#: Rows that one task ranks at once.
RANK_ROWS = 100_000
VOCABULARY = "byte_bpe_50k.json"


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(fixed sets with how often, what is left). Each fixed set dominates all other sets that
    hold its largest piece: the piece alone if nothing fits beside it, an exact or best pair
    where no three others fit, or the best triple where no four do."""
    left = Counter({k: v for k, v in counts.items() if v > 0})
    lengths = sorted(left)
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(lengths_used: tuple[int, ...]) -> None:
        used = Counter(lengths_used)
        times = min(left[x] // k for x, k in used.items())
        for x, k in used.items():
            left[x] -= times * k
            if not left[x]:
                del left[x]
                del lengths[bisect_left(lengths, x)]
        fixed.append((lengths_used, times))

    def others(big: int, n: int) -> list[int]:
        """The n smallest pieces besides one of the length ``big``."""
        out: list[int] = []
        for x in lengths:
            out += [x] * min(n - len(out), left[x] - (x == big))
            if len(out) == n:
                break
        return out

    def largest(room: int, without: Counter) -> int | None:
        i = bisect_left(lengths, room + 1) - 1
        while i >= 0 and left[lengths[i]] <= without[lengths[i]]:
            i -= 1
        return lengths[i] if i >= 0 else None

    for big in sorted(left, reverse=True):
        while left.get(big, 0):
            small = others(big, 3)
            room = capacity - big
            if not small or small[0] > room:
                take((big,))
                continue
            best = largest(room, Counter([big]))
            if best == room or len(small) == 1 or small[0] + small[1] > room:
                take((big, best))
                continue
            if len(small) == 3 and sum(small) <= room:
                break  # three others fit: nothing is proven
            top, pair = 0, None
            for x in lengths:
                if x > room or left[x] <= (x == big):
                    continue
                y = largest(min(room - x, x), Counter([big, x]))
                if y is not None and x + y > top:
                    top, pair = x + y, (x, y)
            if best >= top:
                take((big, best))
            elif best == pair[0]:
                take((big, *pair))
            else:
                break
    return fixed, dict(left)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram, the same as piece by piece: (lengths, how often)."""
    rooms: list[int] = []
    open_: dict[int, list[list]] = {}  # room -> [lengths as (length, times) runs, bins]

    def put(room: int, runs: tuple, bins: int) -> None:
        if room not in open_:
            insort(rooms, room)
            open_[room] = []
        open_[room].append([runs, bins])

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                runs, bins = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[i]
            else:
                room, runs, bins = capacity, (), n
            fit = room // length
            full = min(bins, n // fit)
            if full:
                put(room - fit * length, (*runs, (length, fit)), full)
            n -= full * fit
            rest = bins - full
            if n and rest and n < fit:
                put(room - n * length, (*runs, (length, n)), 1)
                n, rest = 0, rest - 1
            if rest and runs:
                put(room, runs, rest)
    return [(tuple(x for x, k in runs for _ in range(k)), bins) for found in open_.values() for runs, bins in found]


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with how many sequences follow each; every piece is in one."""
    if any(x < 1 or x > capacity for x in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    fixed, left = reduce_dominated(counts, capacity)
    return fixed + best_fit(left, capacity)


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length rows (first rank, pieces per sequence, first sequence, offset): the piece
    of rank r in [first, next first) is number (r - first) % pieces of its length in sequence
    first sequence + (r - first) // pieces."""
    out: dict[int, list] = {}
    seen: Counter = Counter()
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        runs = Counter(lengths)
        for length in sorted(runs, reverse=True):
            k = runs[length]
            out.setdefault(length, []).append((seen[length], k, sequence, offset))
            seen[length] += k * times
            offset += k * length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each document's ids and end id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = PieceCache.of(tokenizer_path)
        for batch in text_batches(batches):
            rows: tuple[list, ...] = ([], [], [], [], [])
            keep: list[np.ndarray] = []
            for doc, ids in zip(batch.column(0).to_pylist(), cache.encode(batch.column(1).to_pylist())):
                ids = np.append(ids, np.uint32(end_id))
                begin, end = 0, len(ids) % capacity or min(capacity, len(ids))
                piece = 0
                while begin < len(ids):
                    part = ids[begin:end]
                    for to, x in zip(rows, (doc, piece, begin, len(part), zlib.crc32(part.astype("<u4").tobytes()))):
                        to.append(x)
                    if with_ids:
                        keep.append(part.astype(np.int32))
                    begin, end, piece = end, end + capacity, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(x, k) for x, k in zip(rows, kinds)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                ends = np.cumsum([0, *map(len, keep)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keep) if keep else np.zeros(0, np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), text_column(docs)).mapInArrow(frugal(cut), schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (any other columns, with ``length`` from 1 to capacity).

    ``pieces`` must give the same rows each time it is read (a written table). Ranks within a
    length come from salted groups: a length of a third of all pieces is spread like any other.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    salts = max(1, -(-sum(counts.values()) // RANK_ROWS))
    known = spark.sparkContext.broadcast(places(solve(counts, capacity)))
    salt, n, before, rank = unused(pieces, "salt", "n", "before", "rank")
    salted = pieces.withColumn(salt, F.pmod(F.xxhash64(*[c for c in ("doc_id", "piece", "start") if c in pieces.columns]), F.lit(salts)).cast("int"))
    each = salted.groupBy("length", salt).agg(F.count("*").alias(n))
    w = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("length", salt, F.coalesce(F.sum(n).over(w), F.lit(0)).alias(before))
    order = [c for c in ("doc_id", "piece") if c in pieces.columns] or ["length"]
    ranked = salted.withColumn(rank, F.row_number().over(Window.partitionBy("length", salt).orderBy(*order)))
    ranked = ranked.join(each, ["length", salt]).withColumn(rank, F.col(rank) - 1 + F.col(before))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = known.value
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            ranks = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for x in np.unique(length).tolist():
                at = np.flatnonzero(length == x)
                rows = found[x]
                first, per, base, start = rows[np.searchsorted(rows[:, 0], ranks[at], side="right") - 1].T
                sequence[at] = base + (ranks[at] - first) // per
                offset[at] = start + (ranks[at] - first) % per * x
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    ranked = ranked.select(*own_columns(pieces), rank)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema), "sequence_id long", "offset long"])
    return ranked.mapInArrow(frugal(place), schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Packs documents (doc_id, text) into sequences of at most ``capacity`` tokens.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset
    (and ids). Pieces of a sequence lie one behind the other from offset 0. Only a document of
    more than ``capacity`` ids, end id included, is cut; its first piece is the shorter one.
    Null text counts as empty, a null doc_id stays null; repeated rows are packed each; an empty
    table gives no rows; other columns are not read.
    """
    return pack(written(token_pieces(docs, tokenizer_path, capacity, end_id, with_ids), "pieces"), capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(bound_batches(spark), sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
