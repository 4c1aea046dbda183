"""N-gram Jaccard join by chosen paths.

Documents with one shingle set are one node. A node's MinHash coordinates stand for its tokens: a
token is a coordinate with its value, and two sets share a sampled token with probability equal
to their similarity. Each run samples a token of every set, which puts it into a bucket; a bucket
above BUCKET_ROWS is split again on BRANCH tokens sampled for its level, unless a child would keep
over half of it: sets that alike are compared where they are. What is small or alike is compared
by brute force: estimates from the coordinates first, then exact shingle sets. Runs are repeated
until a pair at the threshold is found with the target recall.

Buckets with the same members are one bucket. A pair is counted in the first bucket that both
its sets are in, so links are counted without a table of pairs; the connections within a bucket
leave it as a tree. Large buckets are compared in pairs of blocks of BLOCK_ROWS, so no task holds
more than two blocks.

Large alike buckets get a pivot, the shingles that most of their sets have, say of a passage that
many documents share. A set with less than a share INSIDE of its shingles in the pivot can only be
linked to one with which it shares shingles outside of it, and many of these: it leaves the bucket
for buckets by tokens sampled outside of the pivot, which are split like any others. What stays in
the bucket of a pivot is alike indeed. Jaccard distance is a metric: sets that are within half of
the distance allowed of one pivot, any set, are all linked with each other. They are its hub:
linked by membership, counted by their number and never compared or dealt among themselves.
Comparisons are left between the other sets of a pivot's bucket and all of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NEAR, SHINGLE_WORDS, bound_batches, drop_written, frugal, own_columns, shingles, table, text_batches, text_blocks, text_column, unused, written
from .tokenids import _U, _mix

COORDINATES = 64
BUCKET_ROWS = 1024
BRANCH = 4
#: Levels of buckets. Each splits what is too large into halves or less, so that DEPTH of them do
#: for BUCKET_ROWS * 2 ** (DEPTH - 1) rows of one token; what is larger still is compared in blocks.
#: Other thresholds have as many levels as there are coordinates for, LEAST_DEPTH at least.
DEPTH = 13
LEAST_DEPTH = 3
TARGET_RECALL = 0.9999
BLOCK_ROWS = 8192
#: Rows from which an alike bucket gets a pivot, rows that it is made from, and bytes of pivots up
#: to which they are broadcast.
HUB_ROWS = 1024
HUB_SAMPLE = 128
#: How far below the threshold the share in the pivot is from which a set stays with it, times that
#: buckets are divided by pivots, and pivots that a set may have.
MARGIN = 0.1
ROUNDS = 4
SLOTS = 16
#: Columns of paths are below this, those of pivots and outside tokens from it on.
PIVOT_COLUMNS = 1 << 28
BROADCAST_BYTES = 1 << 25
#: Rows of a side that are compared at once, and groups up to which pairs are listed by shifts.
SIDE_ROWS = 1024
SMALL_GROUP = 48
#: Deviations of the share of agreeing coordinates below the threshold from which pairs are not
#: compared exactly, and the share of the missed pairs that may be missed by this.
DEVIATIONS = 6
ESTIMATE_MISSES = 0.01
#: Document ids up to which a side is broadcast.
BROADCAST_IDS = 500_000
_ODD = _mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * _U(0xD6E8FEB86659FD93)) | _U(1)
_ADD = _mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * _U(0xA0761D6478BD642F))


def _runs(recall: float, threshold: float, depth: int) -> int:
    found = threshold * (1 - (1 - threshold) ** BRANCH) ** (depth - 1)
    return math.ceil(math.log(1 - recall) / math.log(1 - found)) if found < 1 else 1


def depth_for(recall: float, threshold: float = NEAR) -> int:
    """Levels of buckets: as many as leave each run and each deeper level coordinates of its own."""
    fits = (d for d in range(DEPTH, LEAST_DEPTH, -1) if _runs(recall, threshold, d) + BRANCH * (d - 1) <= COORDINATES)
    return next(fits, LEAST_DEPTH)


def runs_for(recall: float, threshold: float = NEAR) -> int:
    """Runs after which a pair at the threshold is missed with probability 1 - recall at most,
    wherever buckets are split: a run keeps the pair if it shares the root's token and at each
    deeper level one of BRANCH tokens. A run has a coordinate of its own: raises ValueError if
    more than COORDINATES are needed."""
    if not (0 < threshold <= 1 and 0 < recall < 1):
        raise ValueError(f"no threshold above 0 up to 1 and recall between 0 and 1: {threshold}, {recall}")
    runs = _runs(recall, threshold, depth_for(recall, threshold))
    if runs > COORDINATES:
        raise ValueError(f"a recall of {recall} at a threshold of {threshold} takes {runs} runs; there are {COORDINATES} coordinates")
    return runs


def estimate_for(recall: float, threshold: float = NEAR) -> float:
    """The share of agreeing coordinates below which pairs are not compared exactly: DEVIATIONS
    below the threshold, or lower if a pair at the threshold were lost more often than by
    ESTIMATE_MISSES of what the recall leaves."""
    deviation = math.sqrt(threshold * (1 - threshold) / COORDINATES)
    least = max(0, math.floor(round((threshold - DEVIATIONS * deviation) * COORDINATES, 9)))
    of = lambda k: math.comb(COORDINATES, k) * threshold**k * (1 - threshold) ** (COORDINATES - k)
    while least and math.fsum(map(of, range(least))) > ESTIMATE_MISSES * (1 - recall):
        least -= 1
    return least / COORDINATES


def unique_shingles(texts: list[str], words: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    for a, b in text_blocks(texts):
        h, n = shingles(texts[a:b], words)
        ends = np.cumsum(n)
        for begin, end in zip((ends - n).tolist(), ends.tolist()):
            yield np.unique(h[begin:end])


def coordinates(sets: list[np.ndarray]) -> np.ndarray:
    """A row of MinHash coordinates (32 bits) of each set; no set is empty."""
    h = np.concatenate(sets)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    first = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), COORDINATES), np.int32)
    with np.errstate(over="ignore"):
        for k in range(COORDINATES):
            x = (h * _ODD[k] + _ADD[k]) >> _U(32)
            out[:, k] = np.minimum.reduceat(x.astype(np.uint32), first).view(np.int32)
    return out


def set_ids(sets: list[np.ndarray]) -> list[bytes]:
    h = np.concatenate(sets)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    first = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore"):
        parts = [np.add.reduceat(_mix(h ^ _U(x)), first) for x in (0x243F6A8885A308D3, 0x13198A2E03707344)]
    return [x.tobytes() for x in np.stack(parts, axis=1)]


def _sets(with_shingles: bool, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            texts = batch.column(1).to_pylist()
            if not texts:
                continue
            for a, b in text_blocks(texts):
                sets = list(unique_shingles(texts[a:b], words))
                ids = pa.array(set_ids(sets), pa.binary())
                if with_shingles:
                    yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes() for x in sets], pa.binary())], ["set_id", "shingles"])
                else:
                    flat = coordinates(sets)
                    sig = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * COORDINATES), pa.array(flat.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([*(batch.column(k)[a:b] for k in (0, 2)), ids, sig], ["doc_id", "row_hash", "set_id", "sig"])

    return run


def leaf_buckets(nodes: DataFrame, runs: int, bucket_rows: int = BUCKET_ROWS, depth: int = DEPTH) -> DataFrame:
    """(set_id, col, bucket, size, alike), written: the buckets that are compared by brute force.
    col numbers the path of coordinates, so that sets share a bucket of a col or none; alike: of
    over bucket_rows rows, and not split."""
    key, sums = ["col", "bucket"], ["size", "_x", "_y"]
    temporary: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        temporary.append(written(df, name))
        return temporary[-1]

    def sized(rows: DataFrame, *more: str) -> DataFrame:
        members = (F.expr("bit_xor(xxhash64(set_id))").alias("_x"), F.expr("bit_xor(xxhash64(set_id, 1))").alias("_y"))
        return kept(rows.groupBy(*key, *more).agg(F.count("*").alias("size"), *members).where("size > 1"), "buckets")

    level = nodes.select("set_id", F.posexplode(F.slice("sig", 1, runs)).alias("col", "_v")).select("set_id", "col", F.xxhash64("col", "_v").alias("bucket"))
    sizes, levels, leaves = sized(level), [level], []
    base, width = 0, runs
    leaf = lambda rows, alike: leaves.append(rows.select(*key, *sums, F.lit(alike).alias("alike")))
    for at in range(depth - 1):
        big = sizes.where(F.col("size") > bucket_rows)
        leaf(sizes.where(F.col("size") <= bucket_rows), False)
        if not big.limit(1).count():
            break
        parents = level.join(big.select(*key), key).join(nodes.select("set_id", "sig"), "set_id")
        coordinate = (F.pmod(F.col("_j") + runs + BRANCH * at, F.lit(COORDINATES)) + 1).cast("int")
        children = parents.withColumn("_j", F.explode(F.array(*map(F.lit, range(BRANCH)))))
        own = ((F.col("col") - base) * BRANCH + F.col("_j") + base + width).cast("int")
        children = children.select("set_id", F.col("col").alias("_col"), F.col("bucket").alias("_bucket"), own.alias("col"), F.xxhash64("bucket", coordinate, F.element_at("sig", coordinate)).alias("bucket"))
        children = kept(children, "level")
        found = sized(children, "_col", "_bucket")
        alike = found.groupBy("_col", "_bucket").agg(F.max("size").alias("_most")).withColumnsRenamed({"_col": "col", "_bucket": "bucket"})
        alike = kept(big.join(alike, key).where(F.col("_most") * 2 > F.col("size")).select(*key, *sums), "alike")
        leaf(alike, True)
        sizes = found.join(alike.select(F.col("col").alias("_col"), F.col("bucket").alias("_bucket")), ["_col", "_bucket"], "left_anti").select(*key, *sums)
        level = children.select("set_id", *key)
        levels.append(level)
        base, width = base + width, width * BRANCH
    else:
        leaf(sizes.where(F.col("size") <= bucket_rows), False)
        leaf(sizes.where(F.col("size") > bucket_rows), True)
    every = leaves[0]
    for more in leaves[1:]:
        every = every.unionByName(more)
    # of buckets with the same members the first stays
    every = every.groupBy(*sums).agg(F.min(F.struct(*key)).alias("_b"), F.max("alike").alias("alike")).select("size", "alike", "_b.*")
    every = kept(every, "kept")
    out = None
    for level in levels:
        part = level.join(every, key).select("set_id", *key, "size", "alike")
        out = part if out is None else out.unionByName(part)
    out = written(out, "members")
    for df in temporary:
        drop_written(df)
    return out


def _shingles_of(rows: DataFrame, nodes: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(set_id, shingles) of the texts of the least documents of nodes ``ids``, and of texts that
    share their doc_id."""
    docs = written(ids.select("set_id").distinct().join(nodes.select("set_id", "doc_id"), "set_id").select("doc_id").distinct(), "again")
    if docs.count() <= BROADCAST_IDS:
        docs = F.broadcast(docs)
    texts = rows.join(docs, rows["doc_id"].eqNullSafe(docs["doc_id"]), "left_semi").mapInArrow(frugal(_sets(True, words)), "set_id binary, shingles binary")
    return texts.dropDuplicates(["set_id"])


def _pivot(group: pa.Table) -> pa.Table:
    """The shingles that more than half of the sets have, of a sample of an alike bucket."""
    found, n = np.unique(np.frombuffer(b"".join(group.column("shingles").to_pylist()), np.uint64), return_counts=True)
    pivot = found[n * 2 > group.num_rows]
    hub = np.frombuffer(set_ids([pivot])[0], np.int64)[0] if len(pivot) else 0
    return pa.table({"near": group.column("near").slice(0, 1), "hub": pa.array([hub], pa.int64()), "pivot": pa.array([pivot.tobytes()], pa.binary())})


def outside_for(recall: float, threshold: float = NEAR) -> int:
    """Tokens to sample outside of pivots: of a linked pair with a set that has less than the
    threshold - MARGIN of its shingles in the pivot, what is outside has a similarity of at least
    MARGIN / (1 - threshold + MARGIN)."""
    return min(COORDINATES, math.ceil(math.log(1 - recall) / math.log(1 - MARGIN / (1 - threshold + MARGIN))))


_MEASURED = "set_id binary, hub long, slot int, inside boolean, close boolean, outside array<int>"


def _measured(threshold: float, samples: int):
    """Sets (set_id, hub, slot, shingles, pivot): whether they stay with the pivot and whether they
    are of its hub, and tokens sampled outside of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 3):
            inside, close = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, bool)
            some, sets = [], []
            for i, (a, b) in enumerate(zip(batch.column(3), batch.column(4))):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                hit = np.isin(a, b, assume_unique=True)
                both = int(hit.sum())
                inside[i] = both >= (threshold - MARGIN) * len(a)
                close[i] = 2 * (len(a) + len(b) - 2 * both) <= (1 - threshold) * (len(a) + len(b) - both)
                if both < len(a):
                    some.append(i)
                    sets.append(a[~hit])
            n = np.zeros(batch.num_rows + 1, np.int32)
            n[np.array(some, np.int64) + 1] = samples
            flat = coordinates(sets)[:, :samples].reshape(-1) if sets else np.zeros(0, np.int32)
            columns = [*(batch.column(k) for k in range(3)), pa.array(inside), pa.array(close), pa.ListArray.from_arrays(pa.array(np.cumsum(n, dtype=np.int32)), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(columns, ["set_id", "hub", "slot", "inside", "close", "outside"])

    return run


def divided(rows: DataFrame, nodes: DataFrame, members: DataFrame, threshold: float, words: int, recall: float, bucket_rows: int = BUCKET_ROWS, hub_rows: int = HUB_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """(members, written, with alike buckets of over hub_rows rows divided by pivots; the sets of
    hubs (set_id, hub), None if there are none). What a pivot is made from, a bounded sample,
    decides which sets are compared, and never what is linked."""
    samples, hub, base = outside_for(recall, threshold), None, PIVOT_COLUMNS
    for _ in range(ROUNDS):
        alike = members.where(F.col("alike") & (F.col("size") > hub_rows)).select("set_id", "size", F.col("bucket").alias("near"))
        if not alike.limit(1).count():
            break
        dense = written(_shingles_of(rows, nodes, alike, words).join(alike.select("set_id").distinct(), "set_id", "left_semi"), "dense")
        sample = alike.where(F.pmod(F.xxhash64("set_id"), F.greatest(F.floor(F.col("size") / HUB_SAMPLE), F.lit(1))) == 0)
        pivots = written(sample.join(dense, "set_id").select("near", "shingles").groupBy("near").applyInArrow(_pivot, "near long, hub long, pivot binary"), "pivots")
        size = pivots.agg(F.sum(F.length("pivot"))).first()[0] or 0
        sized = lambda df: F.broadcast(df) if size <= BROADCAST_BYTES else df
        # buckets of one pivot are one; a set has a pivot of each slot
        own = alike.join(sized(pivots.select("near", "hub")), "near").groupBy("set_id", F.pmod(F.xxhash64("hub"), F.lit(SLOTS)).cast("int").alias("slot")).agg(F.min("hub").alias("hub"))
        beside = own.join(dense, "set_id").join(sized(pivots.select("hub", "pivot").dropDuplicates(["hub"])), "hub")
        found = written(beside.select("set_id", "hub", "slot", "shingles", "pivot").mapInArrow(frugal(_measured(threshold, samples)), _MEASURED), "measured")
        close = found.where("close").groupBy("set_id").agg(F.min("hub").alias("hub"))
        hub = written(close if hub is None else hub.unionByName(close.join(hub, "set_id", "left_anti")), "hubs")
        staying = found.where("inside").withColumn("col", F.col("slot") + base).select("set_id", "col", F.xxhash64("col", "hub").alias("bucket"))
        sizes = staying.groupBy("col", "bucket").agg(F.count("*").alias("size")).where("size > 1")
        staying = staying.join(sizes, ["col", "bucket"]).withColumn("alike", F.lit(False))
        leaving = found.select("set_id", "slot", "inside", F.posexplode("outside").alias("_k", "_v"))
        leaving = leaving.withColumn("col", F.col("slot") * samples + F.col("_k") + base + SLOTS).select("set_id", "inside", "col", F.xxhash64("col", "_v").alias("bucket"))
        sets = (F.expr("bit_xor(xxhash64(set_id))").alias("_x"), F.expr("bit_xor(xxhash64(set_id, 1))").alias("_y"))
        sizes = leaving.groupBy("col", "bucket").agg(F.count("*").alias("size"), F.bool_and("inside").alias("_all"), *sets).where("size > 1 and not _all")
        sizes = sizes.groupBy("size", "_x", "_y").agg(F.min(F.struct("col", "bucket")).alias("_b")).select("size", "_b.*")
        leaving = leaving.join(sizes, ["col", "bucket"]).withColumn("alike", F.col("size") > bucket_rows)
        calm = members.where(~F.col("alike") | (F.col("size") <= hub_rows))
        names = ["set_id", "col", "bucket", "size", "alike"]
        after = written(calm.select(*names).unionByName(staying.select(*names)).unionByName(leaving.select(*names)), "members")
        for df in (dense, pivots, found, members):
            drop_written(df)
        members = after
        base += SLOTS * (1 + samples)
    return members, hub


def _dealt(members: DataFrame, hub: DataFrame | None, block_rows: int) -> DataFrame:
    """(set_id, col, bucket, block, bi, bj): members once for each pair of blocks (bi, bj) that
    theirs is compared in. A bucket of more than block_rows has blocks of sets of its main hub
    behind those of the others; two of the former are never compared."""
    if hub is not None:
        big = members.where(F.col("size") > block_rows).join(hub, "set_id").groupBy("bucket", "hub").agg(F.count("*").alias("_n"))
        main = big.groupBy("bucket").agg(F.max(F.struct("_n", "hub")).alias("_m")).select("bucket", F.col("_m.hub").alias("_main"), F.col("_m._n").alias("_core"))
        main = written(main, "cores")  # a row for each bucket of more than block_rows rows
        main = F.broadcast(main) if main.count() <= BROADCAST_IDS else main
        members = members.join(hub, "set_id", "left").join(main, "bucket", "left")
        members = members.withColumn("_core", F.coalesce("_core", F.lit(0))).withColumn("_is_core", F.coalesce(F.col("hub") == F.col("_main"), F.lit(False)))
    else:
        members = members.withColumns({"_core": F.lit(0), "_is_core": F.lit(False)})
    of = lambda n: F.ceil(n / block_rows).cast("int")
    members = members.withColumns({"_rest_blocks": of(F.col("size") - F.col("_core")), "_core_blocks": of(F.col("_core"))})
    at = F.xxhash64("set_id", "bucket")
    block = F.when(F.col("_is_core"), F.col("_rest_blocks") + F.pmod(at, F.col("_core_blocks"))).otherwise(F.pmod(at, F.col("_rest_blocks"))).cast("int")
    others = F.when(F.col("_is_core"), F.col("_rest_blocks")).otherwise(F.col("_rest_blocks") + F.col("_core_blocks"))
    out = members.where(others > 0).withColumn("block", block).withColumn("_o", F.explode(F.sequence(F.lit(0), others - 1)))
    return out.select("set_id", "col", "bucket", "block", F.least("block", "_o").alias("bi"), F.greatest("block", "_o").alias("bj"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups (rows sorted by bucket, bi, bj) with the first row of each group and
    the end."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        rest = t if rest is None else pa.concat_tables([rest, t])
        starts = _starts(rest)
        if len(starts) > 1:
            yield rest.slice(0, starts[-1]), starts
            rest = rest.slice(starts[-1])
    if rest is not None:
        yield rest, np.append(_starts(rest), rest.num_rows)


def _starts(t: pa.Table) -> np.ndarray:
    new = np.ones(t.num_rows, bool)
    new[1:] = False
    for c in ("bucket", "bi", "bj"):
        x = t.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _numpy_lists(column, kind) -> tuple[np.ndarray, np.ndarray]:
    a = column.combine_chunks()
    a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
    return a.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False), np.diff(a.offsets.to_numpy())


def candidates(t: pa.Table, starts: np.ndarray, estimate: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of the groups that are alike by estimate, counted here first and not within a
    block that another group compares: all pairs of small groups together, those of a large group
    side by side."""
    n = t.num_rows
    sizes = np.diff(starts)
    group = np.repeat(np.arange(len(sizes)), sizes)
    sig = _numpy_lists(t.column("sig"), np.int32)[0].reshape(n, COORDINATES)
    cols, lengths = _numpy_lists(t.column("leaf_cols"), np.int32)
    buckets, _ = _numpy_lists(t.column("leaf_buckets"), np.int64)
    used, number, times = np.unique(cols, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), lengths)
    several = times > 1  # a col of one row parts no pair
    keep = several[number]
    owner, buckets, number, used = owner[keep], buckets[keep], (np.cumsum(several) - 1)[number[keep]], used[several]
    # a row's bucket of each col; where it has none a number that no other row has there
    place = np.repeat(-np.arange(1, n + 1, dtype=np.int64)[:, None], max(1, len(used)), axis=1)
    place[owner, number] = buckets
    has = np.zeros(place.shape, bool)
    has[owner, number] = True
    own = np.searchsorted(used, t.column("col").to_numpy())
    across = t.column("bi").to_numpy() != t.column("bj").to_numpy()
    block = t.column("block").to_numpy()
    # sets of one hub are linked already; a set of none has a number of its own
    hub = np.arange(n) + n
    if "hub" in t.column_names:
        some = np.flatnonzero(t.column("hub").is_valid().to_numpy())
        hub[some] = np.unique(t.column("hub").take(pa.array(some)).to_numpy(), return_inverse=True)[1]
    small = sizes[group] <= SMALL_GROUP
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for shift in range(1, int(sizes[sizes <= SMALL_GROUP].max(initial=1))):
        i = np.flatnonzero((group[shift:] == group[:-shift]) & small[:-shift])
        j = i + shift
        keep = (~across[i] | (block[i] != block[j])) & (hub[i] != hub[j])
        i, j = i[keep], j[keep]
        for a in range(0, len(i), 4096):
            x, y = i[a : a + 4096], j[a : a + 4096]
            near = (sig[x] == sig[y]).mean(axis=1) >= estimate
            x, y = x[near], y[near]
            first = (place[x] == place[y]).argmax(axis=1) == own[x]
            left.append(x[first])
            right.append(y[first])
    if sum(map(len, left)):
        yield np.concatenate(left), np.concatenate(right)
    for g in np.flatnonzero(sizes > SMALL_GROUP).tolist():
        rows = np.arange(starts[g], starts[g + 1])
        col = own[rows[0]]
        rows = rows[np.lexsort([place[rows, c] for c in range(min(col, 7), -1, -1)] + [hub[rows], block[rows]])]
        sides = [own_block[a : a + SIDE_ROWS] for k in np.unique(block[rows]) for own_block in [rows[block[rows] == k]] for a in range(0, len(own_block), SIDE_ROWS)]
        side_has = [has[x].any(axis=0) for x in sides]
        for p, x in enumerate(sides):
            for q in range(p, len(sides)):
                y = sides[q]
                if across[x[0]] and block[x[0]] == block[y[0]]:
                    continue
                if hub[x[0]] == hub[x[-1]] == hub[y[0]] == hub[y[-1]]:  # rows of a block are sorted by hub
                    continue
                open_ = hub[x][:, None] != hub[y][None, :]
                open_ &= True if p != q else np.triu(np.ones((len(x), len(x)), bool), 1)
                for c in np.flatnonzero(side_has[p][:col] & side_has[q][:col]).tolist():
                    i, j = np.flatnonzero(has[x, c]), np.flatnonzero(has[y, c])
                    open_[np.ix_(i, j)] &= place[x[i], c][:, None] != place[y[j], c][None, :]
                if not open_.any():
                    continue
                alike = np.zeros((len(x), len(y)), np.uint8)
                for k in range(COORDINATES):
                    alike += sig[x, k][:, None] == sig[y, k][None, :]
                i, j = np.nonzero(open_ & (alike >= estimate * COORDINATES))
                if len(i):
                    yield x[i], y[j]


def _needed(estimate: float):
    """The rows of (bucket, bi, bj) that have a candidate there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _groups(batches):
            some = np.zeros(t.num_rows, bool)
            for i, j in candidates(t, starts, estimate):
                some[i] = some[j] = True
            if some.any():
                yield from t.select(["bucket", "bi", "bj", "set_id"]).filter(pa.array(some)).combine_chunks().to_batches()

    return run


def intersections(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common elements of a[i] and b[j], sorted distinct sets."""
    if len(i) < 4 * (len(a) + len(b)):
        return np.fromiter((len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist())), np.int64, len(i))
    flat = np.concatenate([*a, *b])
    row = np.repeat(np.arange(len(a) + len(b)), np.fromiter(map(len, [*a, *b]), np.int64, len(a) + len(b)))
    _, number = np.unique(flat, return_inverse=True)
    here, there = np.zeros(number.max() + 1, bool), np.zeros(number.max() + 1, bool)
    here[number[row < len(a)]], there[number[row >= len(a)]] = True, True
    shared = here & there
    column = (np.cumsum(shared) - 1)[number]
    keep = shared[number]
    row, column = row[keep], column[keep]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, int(shared.sum()), 2048):
        lo, hi = np.searchsorted(column, [at, at + 2048])
        dense = np.zeros((len(a) + len(b), 2048), np.float32)
        dense[row[lo:hi], column[lo:hi] - at] = 1
        total += dense[: len(a)] @ dense[len(a) :].T
    return total[i, j].astype(np.int64)


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Takes links into a forest that gives each row the least row connected to it."""
    while True:
        x, y = label[i], label[j]
        if (x == y).all():
            return
        least = np.minimum(x, y)
        np.minimum.at(label, np.maximum(x, y), least)
        while (label[label] != label).any():
            label[:] = label[label]


def _verified(estimate: float, threshold: float):
    """(set_id, links, root): of each row with a link, the rows it is linked to here, with their
    copies, and a row it is connected to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _groups(batches):
            raw, weight = t.column("shingles"), t.column("weight").to_numpy()
            links, label = np.zeros(t.num_rows, np.int64), np.arange(t.num_rows)
            read = lambda rows: [np.frombuffer(raw[k].as_buffer(), np.uint64) for k in rows.tolist()]
            size = np.fromiter((x // 8 for x in pc.binary_length(raw).to_pylist()), np.int64, t.num_rows)
            for i, j in candidates(t, starts, estimate):
                group = np.searchsorted(starts, i, side="right") - 1
                order = np.argsort(group, kind="stable")
                i, j, group = i[order], j[order], group[order]
                both = np.zeros(len(i), np.int64)
                cuts = np.flatnonzero(np.diff(group, prepend=-1))
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(i)]):
                    x, y = np.unique(i[a:b]), np.unique(j[a:b])
                    both[a:b] = intersections(read(x), read(y), np.searchsorted(x, i[a:b]), np.searchsorted(y, j[a:b]))
                ok = both >= threshold * (size[i] + size[j] - both) - 1e-9
                i, j = i[ok], j[ok]
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                _join(label, i, j)
            rows = np.flatnonzero(links)
            if len(rows):
                ids = t.column("set_id").combine_chunks()
                ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(links[rows]), ids.take(pa.array(label[rows]))], ["set_id", "links", "root"])

    return run


def _place() -> F.Column:
    """Where a row stands in its class."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of the component of each node of edges (a, b), by rounds of
    large and small stars. Every round is written; nothing but a count comes to the driver."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(least, "a")
        star = star.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        nxt = written(star, "edges")
        now = tuple(nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        drop_written(edges)
        edges = nxt
        if now == state:
            break
        state = now
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()


def _classes(docs: DataFrame, threshold: float, words: int, recall: float, bucket_rows: int, block_rows: int, hub_rows: int) -> tuple[DataFrame, DataFrame]:
    """((doc_id, row_hash, set_id) of each row; (set_id, class_id, first, n_links) of each set that
    several rows have or that is linked). row_hash is xxhash64 of the text; first is the least row
    of the class, null doc_ids last."""
    runs, estimate = runs_for(recall, threshold), estimate_for(recall, threshold)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"), F.xxhash64(text_column(docs)).alias("row_hash"))
    found = written(rows.mapInArrow(frugal(_sets(False, words)), "doc_id long, row_hash long, set_id binary, sig array<int>"), "sets")
    nodes = written(found.groupBy("set_id").agg(F.count("*").alias("weight"), F.min("doc_id").alias("doc_id"), F.min(_place()).alias("first"), F.min("sig").alias("sig")), "nodes")
    members = leaf_buckets(nodes, runs, bucket_rows, depth_for(recall, threshold))
    members, hub = divided(rows, nodes, members, threshold, words, recall, bucket_rows, hub_rows)
    lists = members.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("col", "bucket"))).alias("_l"))
    lists = nodes.select("set_id", "weight", "sig").join(lists.select("set_id", F.col("_l.col").alias("leaf_cols"), F.col("_l.bucket").alias("leaf_buckets")), "set_id")
    lists = lists.withColumn("hub", F.lit(None).cast("long")) if hub is None else lists.join(hub, "set_id", "left")
    full = _dealt(members, hub, block_rows).join(lists, "set_id")
    key = ["bucket", "bi", "bj"]
    needed = full.repartition(*key).sortWithinPartitions(*key, "set_id").mapInArrow(frugal(_needed(estimate)), "bucket long, bi int, bj int, set_id binary")
    needed = written(needed, "needed")
    texts = _shingles_of(rows, nodes, needed, words)
    compared = full.join(needed, [*key, "set_id"]).join(texts, "set_id").repartition(*key).sortWithinPartitions(*key, "set_id")
    links = written(compared.mapInArrow(frugal(_verified(estimate, threshold)), "set_id binary, links long, root binary"), "links")
    for df in (members, needed):
        drop_written(df)
    if hub is not None:
        inside = hub.join(nodes.select("set_id", "weight"), "set_id")
        sums = inside.groupBy("hub").agg(F.sum("weight").alias("_all"), F.min("set_id").alias("root"))
        links = written(links.unionByName(inside.join(sums, "hub").where("root <> set_id or _all > weight").select("set_id", (F.col("_all") - F.col("weight")).alias("links"), "root")), "links")
    labels = connected(links.select(F.col("set_id").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("set_id").agg(F.sum("links").alias("links"))
    classes = nodes.select("set_id", "weight", F.col("doc_id").alias("_least"), "first").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").join(counts, "set_id", "left")
    classes = classes.where("weight > 1 or label is not null").withColumn("label", F.coalesce("label", "set_id"))
    least = classes.groupBy("label").agg(F.min("_least").alias("class_id"), F.min("first").alias("first"))
    classes = classes.drop("first").join(least, "label").select("set_id", "class_id", "first", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    return found.select("doc_id", "row_hash", "set_id"), classes


def near_duplicates(docs: DataFrame, threshold: float = NEAR, words: int = SHINGLE_WORDS, recall: float = TARGET_RECALL, bucket_rows: int = BUCKET_ROWS, block_rows: int = BLOCK_ROWS, hub_rows: int = HUB_ROWS) -> DataFrame:
    """(doc_id, class_id, n_links) of each row of docs.

    Two texts are linked if the Jaccard similarity of their sets of ``words``-word shingles is at
    least ``threshold``; n_links counts the other rows that a row is linked to, copies included.
    class_id is the least doc_id of the connected component of these links, so copies share it
    with all they are linked to. A text of fewer words is one shingle, a text without words the
    shingle of all its characters; null text counts as empty. A row with a null doc_id has the
    class of its links, null if it has none. An empty table gives no rows; other columns are not
    read. Raises ValueError for a recall that takes more runs than there are coordinates.
    """
    found, classes = _classes(docs, threshold, words, recall, bucket_rows, block_rows, hub_rows)
    out = found.join(classes, "set_id", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one_of_each(docs: DataFrame, threshold: float = NEAR, words: int = SHINGLE_WORDS, recall: float = TARGET_RECALL, bucket_rows: int = BUCKET_ROWS, block_rows: int = BLOCK_ROWS, hub_rows: int = HUB_ROWS) -> DataFrame:
    """docs with one row of each class, that of the least doc_id (null last, ties by hash of the
    text), and every row that is in no class with another. A row is told by doc_id and text: rows
    that share a doc_id, or have none, stay if their texts are not alike, and repeated rows count
    once."""
    found, classes = _classes(docs, threshold, words, recall, bucket_rows, block_rows, hub_rows)
    rows = found.join(classes.select("set_id", "first"), "set_id", "left").where(F.col("first").isNull() | (F.col("first") == _place()))
    names = unused(docs, "kept_null", "kept_doc", "kept_text")
    key = lambda doc, text: dict(zip(names, (doc.isNull(), F.coalesce(doc, F.lit(0)), text)))
    kept = rows.withColumns(key(F.col("doc_id"), F.col("row_hash"))).select(*names).distinct()
    keyed = docs.withColumns(key(F.col("doc_id").cast("long"), F.xxhash64(text_column(docs))))
    return keyed.join(kept, names, "left_semi").dropDuplicates(names).select(*own_columns(docs))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(bound_batches(spark), sf_dir, "documents"))
