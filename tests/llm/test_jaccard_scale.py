"""The Jaccard join where buckets split, and where groups of like texts are large."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from marlstone.llm import jaccard  # noqa: E402
from marlstone.llm.common import written  # noqa: E402

WORDS = [f"w{i}" for i in range(3000)]


def edited(words, n, rng, tag):
    words = list(words)
    for k in range(n):
        words[rng.randrange(len(words))] = f"e{tag}x{k}"
    return words


def like_rows(rng, size, groups=1, others=0):
    """Groups of texts of one base with one to four edits, and texts that share a passage."""
    rows = []
    for g in range(groups):
        base = [rng.choice(WORDS) for _ in range(130)]
        for i in range(size):
            rows.append((len(rows), " ".join(edited(base, 1 + (i % 10 == 0) * 3, rng, f"{g}y{i}"))))
    passage = [rng.choice(WORDS) for _ in range(60)]
    for _ in range(others):
        rows.append((len(rows), " ".join(passage + [rng.choice(WORDS) for _ in range(rng.randint(5, 90))])))
    return rows


def brute(rows, threshold=0.8):
    sets = [frozenset(x.tolist()) for x in jaccard.unique_shingles([t for _, t in rows])]
    links, label = Counter(), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((label[i], label[j]))
                if a != b:
                    label = [a if x == b else x for x in label]
    return sorted((rows[i][0], rows[label[i]][0], links[i]) for i in range(len(rows)))


def nodes_of(df):
    rows = df.select("doc_id", "text", F.xxhash64("text").alias("row_hash"))
    found = rows.mapInArrow(jaccard._sets(False, 5), "doc_id long, row_hash long, set_id binary, sig array<int>")
    return rows, written(found.groupBy("set_id").agg(F.count("*").alias("weight"), F.min("doc_id").alias("doc_id"), F.min("sig").alias("sig")), "nodes")


@pytest.mark.parametrize("sizes", [{"bucket_rows": 16, "block_rows": 40, "hub_rows": 20}, {"bucket_rows": 30, "block_rows": 10_000, "hub_rows": 30}])
def test_hubs_give_the_links_of_brute_force(spark, sizes):
    rng = random.Random(3)
    rows = like_rows(rng, 150, 2, 60)
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[:40])]  # copies
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, jaccard.near_duplicates(df, **sizes).collect()))
    assert got == brute(rows)
    assert max(r[2] for r in got) > 140
    rows, nodes = nodes_of(df)
    _, hubs = jaccard.divided(rows, nodes, jaccard.leaf_buckets(nodes, 6, 16), 0.8, 5, 0.9999, 16, 20)
    assert sum(sorted(r["count"] for r in hubs.groupBy("hub").count().collect())[-2:]) > 250


def test_sets_of_a_hub_are_all_linked(spark):
    rng = random.Random(5)
    rows = like_rows(rng, 120) + like_rows(rng, 40)
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    texts, nodes = nodes_of(df)
    hub = {bytes(r.set_id): r.hub for r in jaccard.divided(texts, nodes, jaccard.leaf_buckets(nodes, 6, 16), 0.8, 5, 0.9999, 16, 20)[1].collect()}
    sets = list(jaccard.unique_shingles([t for _, t in rows]))
    of = [hub.get(x) for x in jaccard.set_ids(sets)]
    inside = 0
    for i in range(len(sets)):
        for j in range(i):
            if of[i] is not None and of[i] == of[j]:
                both = len(np.intersect1d(sets[i], sets[j]))
                assert both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)
                inside += 1
    assert inside > 5000


def test_rows_of_a_large_group_are_dealt_once_and_tasks_are_bounded(spark):
    """Sets of a hub meet the few others of their bucket, never each other."""
    m, block = 200_000, 8192
    ids = spark.range(m).select(F.col("id").cast("string").cast("binary").alias("set_id"))
    members = ids.select("set_id", F.lit(0).alias("col"), F.lit(7).cast("long").alias("bucket"), F.lit(m).cast("long").alias("size"), F.lit(True).alias("alike"))
    for apart in (0, 100, 20_000):
        hub = ids.where(F.pmod(F.xxhash64("set_id"), F.lit(m)) >= apart).select("set_id", F.lit(3).cast("long").alias("hub"))
        dealt = jaccard._dealt(members, hub, block)
        rest = m - hub.count()
        blocks = -(-rest // block)
        core = -(-(m - rest) // block)
        found = dealt.groupBy("bi", "bj").agg(F.count("*").alias("n")).collect()
        assert sum(r.n for r in found) == (m - rest) * blocks + rest * (blocks + core)
        assert max((r.n for r in found), default=0) <= 2.2 * block
        assert all(r.bi < blocks for r in found)  # no pair of two blocks of the hub


def test_recall_where_buckets_split(spark):
    """Pairs at just over the threshold among texts that share passages, in tiny buckets."""
    rng = random.Random(9)
    rows = []
    for k in range(400):
        chosen = [rng.randrange(3) for _ in range(5)]
        words = [f"c{slot}o{o}x{i}" for slot, o in enumerate(chosen) for i in range(14)] + [f"{k}x{i}" for i in range(30)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:90] + [f"t{k}x{i}" for i in range(10)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    _, nodes = nodes_of(df)
    deep = 1 + jaccard.BRANCH  # columns of a single run's root and of the level below
    assert jaccard.leaf_buckets(nodes, 1, 4).where(F.col("col") >= deep).count() > 100
    got = {r.doc_id: r for r in jaccard.near_duplicates(df, bucket_rows=4, block_rows=64).collect()}
    want = brute(rows)
    true = sum(n for _, _, n in want)
    assert true >= 790 and sum(r.n_links for r in got.values()) >= 0.98 * true
    assert all(got[d].n_links <= n for d, _, n in want)


def test_levels_and_runs():
    for recall in (0.9, 0.99, 0.9999):
        for threshold in (0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.99):
            depth, runs = jaccard.depth_for(recall, threshold), jaccard.runs_for(recall, threshold)
            assert depth == jaccard.LEAST_DEPTH or runs + jaccard.BRANCH * (depth - 1) <= jaccard.COORDINATES
            assert (1 - threshold * (1 - (1 - threshold) ** jaccard.BRANCH) ** (depth - 1)) ** runs <= 1 - recall
    assert jaccard.depth_for(jaccard.TARGET_RECALL, jaccard.NEAR) == jaccard.DEPTH and jaccard.runs_for(jaccard.TARGET_RECALL) == 6


def passages(rng, size, pairs, words=60, own=40):
    """Texts that share one of two passages, or both, and near copies of some of them."""
    shared = [[rng.choice(WORDS) for _ in range(words)] for _ in range(2)]
    rows = []
    for i in range(size):
        text = [w for p in ([shared[0]], [shared[0]], [shared[1]], shared)[i % 4] for w in p] + [rng.choice(WORDS) for _ in range(own)]
        rows.append((len(rows), " ".join(text)))
        if i < pairs:
            text[-1 - i % own] = f"e{i}"
            rows.append((len(rows), " ".join(text)))
    return rows


def test_common_passages_are_not_compared_with_each_other(spark):
    rng = random.Random(21)
    rows = passages(rng, 300, 90)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    texts, nodes = nodes_of(df)
    before = jaccard.leaf_buckets(nodes, 6, 16)
    assert before.where("alike").agg(F.max("size")).first()[0] > 100  # the passages make large alike buckets
    after, _ = jaccard.divided(texts, nodes, before, 0.8, 5, 0.9999, 16, 20)
    # texts of both passages have 0.74 of their shingles there and stay together; the others leave
    largest = sorted((r["size"] for r in after.select("bucket", "size").distinct().collect()), reverse=True)
    assert largest[0] <= 100 and largest[2] <= 20
    assert jaccard._dealt(after, None, 8192).groupBy("bucket").count().select((F.col("count") * F.col("count")).alias("n")).agg(F.sum("n")).first()[0] < len(rows) ** 2 / 4
    got = sorted(map(tuple, jaccard.near_duplicates(df, bucket_rows=16, block_rows=64, hub_rows=20).collect()))
    assert got == brute(rows) and sum(r[2] for r in got) >= 180


@pytest.mark.parametrize("seed", range(4))
def test_mixed_groups_give_the_links_of_brute_force(spark, seed):
    """Passages of all lengths beside groups of like texts and copies, in tiny buckets."""
    rng = random.Random(seed)
    rows = like_rows(rng, 60, 2, 30) + passages(rng, 60, 30, rng.randint(20, 90), rng.randint(10, 60))
    rows += rows[:15] + passages(rng, 40, 40, 100, 8)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.n_links for r in jaccard.near_duplicates(df, bucket_rows=8, block_rows=30, hub_rows=10).collect()}
    want = {d: n for d, _, n in brute(rows)}
    assert all(got[d] <= n for d, n in want.items())
    assert sum(got.values()) >= 0.999 * sum(want.values())


def test_tokens_outside_of_pivots_meet_the_recall():
    for threshold in (0.5, 0.7, 0.8, 0.9):
        n = jaccard.outside_for(0.9999, threshold)
        least = 1.0
        for a in range(0, int(100 * (threshold - jaccard.MARGIN))):  # of 100 shingles of x in the pivot
            for i in range(0, 101 - a):  # shared outside
                for more in range(0, 30):  # the other's own shingles outside
                    if (a + i) / (100 + more) >= threshold:
                        least = min(least, i / (100 - a + more))
        assert (1 - least) ** n <= 1e-4 or n == jaccard.COORDINATES
