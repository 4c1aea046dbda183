"""The operators on small awkward tables, against brute force or exact round trips."""

import hashlib
import math
import random
import re
import wave
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from marlstone.llm import chat, fingerprint, jaccard, language, license, linededup, media, mixing, packing, tokenfiles  # noqa: E402
from marlstone.llm.common import fresh_dir  # noqa: E402
from marlstone.llm.tokenids import PieceCache, load_tokenizer  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, _pos string, part int"
WORDS = "the of and der die und le la les que el los with from was één straße niño año".split()
rng = random.Random(1)


def prose(n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", ".\n"]) for _ in range(n))


BASE = prose(120)
TEXTS = [BASE, BASE, BASE.replace("the", "a", 1), prose(60), None, "", "   ", "!!! ???", "!!! ???", "one two", "Licensed under the Apache License, Version 2.0.\n" + prose(9), prose(9) + "\nAll rights reserved.", prose(6000), "x" * 5000, "\n\n\n", "tab\tand\r\n\x0bnbsp  ελληνικά 漢字 it's we'll", "<|endoftext|> ok", prose(60)]
ROWS = [(i, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src1", None]), 0, "clash", "clash", 1) for i, t in enumerate(TEXTS)]
ROWS += [ROWS[0], (None, BASE, "en", "src0", 0, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return (r[0] is None, r[0] or 0, *map(str, r[1:]))


# -- tokens and packing


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_piece_cache_equals_library(name):
    path = public_tokenizers.path(name)
    plain, cached = load_tokenizer(path), PieceCache(path, max_pieces=300)
    fuzz = ["".join(rng.choice("ab 'sltredvm\n  .,!5éÉA<|>7€\t") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for texts in (fuzz, fuzz[::-1], [x or "" for x in TEXTS]):
        assert [x.tolist() for x in cached.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing(docs, none):
    path = public_tokenizers.path(packing.VOCABULARY)
    plain = load_tokenizer(path)
    rows = packing.pack_documents(docs, path, 64, with_ids=True).collect()
    by_doc = Counter()
    for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.piece)):
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 64
        by_doc[r.doc_id] += r.length
    for i, t, *_ in ROWS[: len(TEXTS)]:
        want = plain.encode(t or "", add_special_tokens=False).ids + [0]
        mine = sorted({(r.piece, r.start, tuple(r.ids)) for r in rows if r.doc_id == i})
        assert [x for _, _, p in mine for x in p] == want
        assert [s for _, s, _ in mine] == [sum(len(p) for _, _, p in mine[:k]) for k in range(len(mine))]
        assert all(len(p) == 64 for _, _, p in mine[1:])
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(none, path).collect() == []


def test_solver_is_whole_and_never_far_from_the_bound():
    for _ in range(150):
        cap = rng.choice([6, 10, 50])
        counts = Counter(rng.randint(1, cap) for _ in range(rng.randint(0, 60)))
        patterns, seen = packing.solve(counts, cap), Counter()
        for lengths, times in patterns:
            assert sum(lengths) <= cap and times > 0
            for x in lengths:
                seen[x] += times
        assert seen == counts
        assert sum(t for _, t in patterns) <= 11 / 9 * -(-sum(k * v for k, v in counts.items()) // cap) + len(counts)


def least_bins(items, cap):
    best = len(items)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
            place(i + 1, [*rooms[:k], rooms[k] - items[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, cap - items[i]])

    place(0, [])
    return best


def test_reduction_keeps_an_optimal_packing():
    for _ in range(120):
        cap = rng.choice([9, 12, 20])
        items = sorted((rng.randint(1, cap) for _ in range(rng.randint(1, 8))), reverse=True)
        fixed, left = packing.reduce_dominated(Counter(items), cap)
        rest = sorted((x for x, n in left.items() for _ in range(n)), reverse=True)
        assert sum(t for _, t in fixed) + least_bins(rest, cap) == least_bins(items, cap)


def test_token_files(spark, docs, none):
    path = public_tokenizers.path(tokenfiles.VOCABULARY)
    plain = load_tokenizer(path)
    shards = tokenfiles.write_tokens(docs, path, fresh_dir(spark, "t"), sequence=16)
    rows = sorted(map(tuple, tokenfiles.read_tokens(spark, shards).collect()), key=lambda r: r[1])
    assert [r[0] for r in rows] == sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x or 0))
    at, texts = 0, {r[0]: r[1] for r in ROWS}
    for doc, start, n, crc in rows:
        ids = np.array(plain.encode(texts[doc] or "", add_special_tokens=False).ids + [1], "<u4")
        assert (start, n, crc) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += n
    reader = tokenfiles.ShardReader(shards[0].path)
    ids, mask = reader.row(0)
    assert len(ids) == len(mask) == 16 and not ids.flags.owndata and ids.tolist() == reader.ids(0, 16).tolist()
    last, mask = reader.row((shards[0].ids - 1) // 16)
    assert mask.sum() == (shards[0].ids - 1) % 16 + 1
    assert tokenfiles.read_tokens(spark, tokenfiles.write_tokens(none, path, fresh_dir(spark, "t"))).collect() == []


def test_masks_are_views_of_the_mapped_file(tmp_path):
    writer = tokenfiles.ShardWriter(f"file://{tmp_path}", "s", np.dtype(np.uint16), 16)
    writer.add([1, 2], [np.arange(20), np.arange(7)])
    writer.close()
    reader = tokenfiles.ShardReader(f"file://{tmp_path}/s.arrow")
    allocated = pa.total_allocated_bytes()
    rows = [reader.row(i) for i in range(2)]
    assert pa.total_allocated_bytes() == allocated and not any(x.flags.owndata for r in rows for x in r)
    column = reader.file.get_batch(0).column(1).flatten().to_numpy(zero_copy_only=True)
    assert [np.shares_memory(mask, column) for _, mask in rows] == [True, True]
    assert [mask.tolist() for _, mask in rows] == [[1] * 16, [1] * 11 + [0] * 5]


# -- language


def test_language(spark, docs, none):
    words = {"en": "the of and with from was that have", "de": "der die und mit von war dass haben"}
    rows = [(i, " ".join(rng.choice(words[lang].split()) for _ in range(30)), lang) for i in range(300) for lang in [rng.choice(["en", "de"])]]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(known)
    found = language.identify(docs, model)
    assert [c for c in found.columns if c.lower() == "score"] == ["score"] and found.columns[:2] == ["doc_id", "text"]
    found = found.collect()
    assert len(found) == len(ROWS)
    for r in found:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and r.rejected >= (not letters) and 0 <= r.score <= 1
    right = language.identify(known, model).where(language.held_out(F.col("doc_id"))).collect()
    assert len(right) > 30 and all(r.lang == r.lang_pred and not r.rejected for r in right)
    assert language.identify(none, model).collect() == []
    empty = language.train(none)
    assert {r.lang_pred for r in language.identify(docs, empty).collect()} == {"und"}
    assert {r.doc_id % 5 for r in known.where(language.held_out(F.col("doc_id"))).collect() if zlib.crc32(str(r.doc_id).encode()) % 5} == set()


def test_least_hashed_ids(spark):
    known = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3990, "en").otherwise("de").alias("lang"))
    known = known.unionByName(known.where("doc_id < 900")).unionByName(known.where("doc_id < 900"))
    every = [(r.lang, r.doc_id, r.h) for r in known.distinct().select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).collect()]
    want = [(lang, d, i) for lang in ("en", "de") for i, (_, d) in enumerate(sorted((h, d) for x, d, h in every if x == lang)[:50], 1)]
    found = [tuple(r) for r in language.least_hashed(known, 50).collect()]
    assert sorted(found) == sorted(want) and len(found) == 60


# -- near duplicates


def brute_classes(rows, threshold):
    sets = list(jaccard.unique_shingles([t or "" for _, t in rows]))
    links, label = [0] * len(rows), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return [(d, min((rows[k][0] for k in range(len(rows)) if label[k] == label[i] and rows[k][0] is not None), default=None), links[i]) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("sizes", [{}, {"bucket_rows": 2, "block_rows": 3}])
def test_near_duplicates(spark, sizes):
    rows = [(r[0], r[1]) for r in ROWS]
    for k in range(40):
        text = prose(60) if k % 8 == 0 else rows[-1][1]
        words = text.split(" ")
        words[rng.randrange(len(words))] = f"w{k}"
        rows.append((100 + k, " ".join(words)))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **sizes).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_classes(rows, 0.8), key=key)


def test_near_duplicates_keep_one(spark, docs, none):
    kept = jaccard.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert len(ids) == len(set(ids)) and 0 in ids and not {1, 5, 8} & set(ids)
    assert jaccard.near_duplicates(none).collect() == []


def test_near_duplicates_keep_unlike_rows_of_one_id(spark):
    rows = [(None, "alpha beta gamma delta epsilon zeta"), (None, "one two three four five six seven"), (3, "q w e r t y u i"), (3, "other words stand in this row"), (4, "q w e r t y u i"), (3, "q w e r t y u i"), (None, "q w e r t y u i"), (None, "both rows without an id"), (None, "both rows without an id"), (5, None), (6, "")]
    kept = jaccard.keep_one_of_each(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, first string"))
    assert sorted([r[:2] for r in kept.collect()], key=key) == sorted([rows[0], rows[1], rows[2], rows[3], rows[7], rows[9]], key=key)


def test_large_groups_are_compared_in_sides(monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL_GROUP", 3)
    monkeypatch.setattr(jaccard, "SIDE_ROWS", 4)
    n = 23
    sig = np.array([[rng.randint(0, 1) if k % 2 else 7 for k in range(jaccard.COORDINATES)] for _ in range(n)], np.int32)
    first = [rng.choice([5, 6, None]) for _ in range(n)]
    lists = [([0] if f else []) + [1] for f in first], [([f] if f else []) + [9] for f in first]
    for blocks in ([0] * n, [k % 2 for k in range(n)]):
        across = max(blocks)
        t = pa.table({"sig": pa.array(sig.tolist(), pa.list_(pa.int32())), "leaf_cols": pa.array(lists[0], pa.list_(pa.int32())), "leaf_buckets": pa.array(lists[1], pa.list_(pa.int64())), "col": pa.array([1] * n, pa.int32()), "bi": [0] * n, "bj": [across] * n, "block": blocks})
        pairs = [p for i, j in jaccard.candidates(t, np.array([0, n]), 0.7) for p in zip(i.tolist(), j.tolist())]
        want = {(i, j) for i in range(n) for j in range(i + 1, n) if (sig[i] == sig[j]).mean() >= 0.7 and (first[i] is None or first[i] != first[j]) and (not across or blocks[i] != blocks[j])}
        assert len(pairs) == len(set(pairs)) and {tuple(sorted(p)) for p in pairs} == want
    sets = [np.unique(np.array([rng.randrange(40) for _ in range(20)], np.uint64)) for _ in range(6)]
    i, j = (x.reshape(-1) for x in np.meshgrid(np.arange(6), np.arange(6)))
    many = jaccard.intersections(sets, sets, np.tile(i, 8), np.tile(j, 8))
    assert many.tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)] * 8


def test_other_thresholds_are_not_filtered_by_the_default_estimate(spark):
    assert jaccard.estimate_for(jaccard.TARGET_RECALL, 0.8) == 0.5 and jaccard.runs_for(jaccard.TARGET_RECALL, 0.8) == 6
    rows = []
    for k in range(30):
        words = [f"w{k}x{i}" for i in range(64)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:44] + [f"v{k}x{i}" for i in range(20)]))]  # 40 of 80 shingles
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), threshold=0.5).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_classes(rows, 0.5), key=key) and all(r.n_links == 1 for r in got)


def test_recalls_beyond_the_coordinates_are_refused(none):
    for k in (0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 0.95, 0.99, 1.0):
        least = round(jaccard.estimate_for(0.9999, k) * jaccard.COORDINATES)
        lost = sum(math.comb(jaccard.COORDINATES, i) * k**i * (1 - k) ** (jaccard.COORDINATES - i) for i in range(least))
        assert lost <= 1e-6
    assert jaccard.runs_for(0.9999, 0.4) <= jaccard.COORDINATES
    for call in (lambda: jaccard.runs_for(0.9999, 0.2), lambda: jaccard.near_duplicates(none, threshold=0.2), lambda: jaccard.keep_one_of_each(none, threshold=0.2)):
        with pytest.raises(ValueError, match="runs"):
            call()


def test_runs_meet_the_recall():
    found = 0.8 * (1 - 0.2**jaccard.BRANCH) ** (jaccard.DEPTH - 1)
    assert (1 - found) ** jaccard.runs_for(0.999) <= 0.001 < (1 - found) ** (jaccard.runs_for(0.999) - 1)


# -- fingerprints


def test_fingerprints(spark, docs, none):
    for task_rows in (3, 1000):
        got = sorted(map(tuple, fingerprint.compare_with_next(docs, task_rows).collect()), key=key)
        assert len(got) == len(ROWS)
        order = sorted(((d, t or "") for d, t, *_ in ROWS), key=lambda r: (r[0] is None, -(r[0] or 0)))
        want = []
        for k, (d, t) in enumerate(order):
            following = order[(k + 1) % len(order)][1]
            n = len(t) // 2
            want.append((d, len(t), hashlib.sha256((t[: len(t) - n] + following[:n]).encode()).hexdigest()))
        assert [g[:3] for g in got] == sorted(want, key=key)
    prints = {r[0]: r for r in got}
    assert prints[0][3] == prints[1][3] != prints[3][3] and prints[7][3] == prints[8][3]
    assert fingerprint.compare_with_next(none).collect() == []
    one = fingerprint.compare_with_next(spark.createDataFrame([(5, "a b c d e f")], "doc_id long, text string")).collect()
    assert one[0].near_next == 1.0


def test_likeness_is_unbiased():
    shared = [f"w{i}" for i in range(3000)]
    for part in (0.0, 0.2, 0.5, 0.9, 1.0):
        cut = int(2000 * part)
        a, b = " ".join(shared[:2000]), " ".join(shared[2000 - cut : 2000] + [f"v{i}" for i in range(2000 - cut)])
        x, y = (set(zip(*[t.split()[k:] for k in range(5)])) for t in (a, b))
        pa_, pb = fingerprint.fingerprints([a, b])
        assert abs(fingerprint.likeness(pa_, pb) - len(x & y) / len(x | y)) < 0.08
        assert fingerprint.from_hex(fingerprint.to_hex(pa_[None])[0]).tolist() == pa_.tolist()


# -- lines


def brute_lines(rows):
    keyed = [(d, t or "", [re.sub(r"^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", x) for x in (t or "").split("\n")]) for d, t in rows]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    holders = {}
    for d, _, ks in keyed:
        for k in ks:
            holders.setdefault(k.translate(low), set()).add(d)
    smallest = lambda s: None if None in s else min(s)
    out = []
    for d, t, ks in keyed:
        keep = [len(k) < 10 or len(h := holders[k.translate(low)]) < 2 or smallest(h) == d for k in ks]
        out.append((d, len(ks), keep.count(False), "\n".join(x for x, y in zip(t.split("\n"), keep) if y)))
    return out


def test_lines(spark, docs, none):
    lines = ["a shared line of text", "A SHARED LINE OF TEXT  ", "\tunique line number ", "short", "ÄÖÜ ÄÖÜ äö", "äöü äöü äö", "123456789", "1234567890", ""]
    rows = [(r[0], r[1]) for r in ROWS if r[0] is not None] + [(200 + k, "\n".join(rng.choice(lines) + (str(k) if rng.random() < 0.1 else "") for _ in range(rng.randint(0, 8)))) for k in range(60)]
    rows = [*dict.fromkeys(rows), (None, "a shared line of text\nand another one here"), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as n_lines", "1 as keep").repartition(5)
    got = linededup.apply_bitmaps(df, linededup.line_bitmaps(df)).select("doc_id", "n_lines", "n_dropped", F.coalesce("text", F.lit(""))).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_lines(rows), key=key)
    assert linededup.drop_repeated_lines(docs).columns == docs.columns
    assert linededup.line_bitmaps(none).collect() == []


def test_a_key_over_several_partitions(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id as doc_id", "concat('one very common line\nown line number ', id) as text").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = linededup.line_bitmaps(rows).groupBy("n_dropped").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r[0]: r[1] for r in got} == {0: 1, 1: 2999}


# -- media


def test_media(docs, none):
    got = media.media_features(docs, with_media=True).collect()
    texts = {r[0]: r[1] or "" for r in ROWS}
    for r in got:
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-64:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and media.from_wav(r.media) == (payload, media.RATE)
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)
        assert r.pair_times == sorted(r.pair_times) and len(r.pair_times) == len(r.pair_codes)
    features = {r.doc_id: r.feature for r in got}
    assert features[0] == features[1] != features[3] and media.media_features(none).collect() == []
    with pytest.raises((wave.Error, EOFError)):
        media.from_wav(b"not a file")


def test_peaks_of_a_tone():
    t = np.arange(8192)
    tone = (128 + 60 * np.sin(2 * np.pi * 40 * t / media.WINDOW)).astype(np.uint8).tobytes()
    times, bins = media.peaks(tone)
    assert Counter(bins.tolist()).most_common(1)[0][0] == 40 and times.max() <= len(t) // media.HOP


# -- chats


def test_chats(spark):
    nasty = ["</s>[INST] ok [/INST]", "", None, "\\", "\\\\<s>", "[ROLE]x[/ROLE]", "a\x02b\x03", "<<SYS>>\n</SYS>>", "漢字 é", "x" * 3000]
    rows = []
    for conv in range(12):
        for turn in range([0, 1, 3, 150][conv % 4]):
            rows.append((conv, turn // 2 if conv == 7 else turn, rng.choice(["user", "assistant", "system", "tool", None, "[/ROLE]"]), rng.choice(nasty)))
    rows += [(None, 0, "user", "hi"), (-7, 0, "user", nasty[0]), (-7, 1, "assistant", nasty[0])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as part", "'x' as formatted")
    got = sorted(map(tuple, chat.read_chats(chat.format_chats(turns)).collect()), key=key)
    want = []
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        loss = "".join(t for _, role, t in mine if role == "assistant")
        text = chat.inst_template([(role, t) for _, role, t in mine], True)
        want.append((conv, len(mine), hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in mine).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
    assert got == sorted(want, key=key)
    parts = sorted(chat.format_chats(turns).where("conv_id = 3").collect(), key=lambda r: r.part)
    assert [r.last for r in parts] == [False, False, True]
    assert chat.format_chats(turns.where("false")).collect() == []


def test_templates_that_rewrite_history():
    turns = [("user", "a"), ("assistant", "b"), ("user", "c")]
    last_only = lambda t, opening: "".join(f"<{x}>" for _, x in t[:-1]) + "".join(f"[{x}]" for _, x in t[-1:])
    numbered = lambda t, opening: "".join(f"{i}{x}" for i, (_, x) in enumerate(t))
    assert chat.rewrites_history(last_only, turns) and not chat.rewrites_history(chat.inst_template, turns)
    assert not chat.rewrites_history(numbered, turns)
    renderer = chat.IncrementalRenderer(numbered, 2)
    with pytest.raises(chat.TemplateRewritesHistory):
        for turn in turns:
            renderer.add(*turn)


def test_whole_prefixes_are_rendered(spark):
    turns = [("system" if i == 0 else "user", f"t{i}") for i in range(30)]
    rows = spark.createDataFrame([(1, i, *t) for i, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    last_ten = lambda t, opening: "".join(f"<{x}>" for _, x in t[-10:])
    no_system_later = lambda t, opening: "".join(f"<{x}>" for role, x in t if role != "system" or len(t) <= 12)
    numbered = lambda t, opening: "".join(f"{i}<{x}>" for i, (_, x) in enumerate(t))
    for template in (last_ten, no_system_later):
        with pytest.raises(Exception, match="TemplateRewritesHistory"):
            chat.format_chats(rows, template).collect()
    assert "".join(r.formatted for r in chat.format_chats(rows, numbered, part_turns=7).orderBy("part").collect()) == numbered(turns, True)
    windowed = chat.format_chats(rows, window=8).collect()
    assert windowed == chat.format_chats(rows).collect() and windowed[0].formatted == chat.inst_template(turns, True)


# -- licences and mixing


def oracle(sql, rows, columns):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    return sorted(con.sql(f"SELECT {columns} FROM ({sql})").fetchall(), key=key)


def test_licenses(docs, none):
    rows = [r[:4] for r in ROWS]
    got = sorted(map(tuple, license.scan(docs).collect()), key=key)
    assert got == oracle(license.ORACLE_SQL, rows, "doc_id, sentence_ids, licenses, n_unmatched")
    assert {r[0]: r[2] for r in got}[10] == "Apache-2.0" and license.scan(none).collect() == []


def test_license_rules_in_order(spark):
    text = "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nReleased under the MIT License!"
    df = spark.createDataFrame([(1, text), (2, "You may obtain a copy of the License at")], "doc_id long, text string")
    got = {r.doc_id: r for r in license.scan(df).collect()}
    assert got[1].sentence_ids == "<apache-2.0><in-compliance><copy-at><apache-2.0-url><mit>"
    assert (got[1].licenses, got[1].n_unmatched) == ("Apache-2.0,MIT", 0) and (got[2].licenses, got[2].n_unmatched) == ("", 1)


APACHE = """Copyright 2020 A. Name

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """MIT License

Copyright (c) 2020 A. Name

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
BSD = """Copyright (c) 2020, A. Name
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer."""
GPL_3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
GPL_2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version."""


def test_standard_licence_texts(spark):
    texts = [(APACHE, "Apache-2.0"), (MIT, "MIT"), (BSD, "BSD"), (GPL_3, "GPL-3.0-or-later"), (GPL_2, "GPL-2.0-or-later")]
    forms = [
        lambda t: t,
        lambda t: t.replace("\n", "\r\n"),
        lambda t: "\n\n".join(re.sub(r"\s+", " ", p) for p in t.split("\n\n")),
        lambda t: "\n".join(re.sub(r"\s+", " ", p) for p in t.split("\n\n")),
        lambda t: "\n".join(f" * {x}" for x in t.split("\n")),
        lambda t: "\n".join(f"# {x}" for x in t.split("\n")),
        lambda t: "\n".join(f"-- {x}" for x in t.split("\n")),
        lambda t: t.replace("\n\n", "\n"),
    ]
    rows = [(i, f(t), name) for i, (f, t, name) in enumerate((f, *x) for f in forms for x in texts)]
    got = {r.doc_id: (r.licenses, r.n_unmatched) for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string, name string")).collect()}
    assert got == {i: (name, 0) for i, _, name in rows}
    title = "                Apache License\n           Version 2.0, January 2004\n        http://www.apache.org/licenses/\n\nTERMS"
    assert license.scan(spark.createDataFrame([(1, title)], "doc_id long, text string")).first().licenses == "Apache-2.0"
    whole = re.sub(r"\s+", " ", APACHE[APACHE.index("Licensed") :])
    apart = MIT.replace("a copy\nof this", "a copy\n\nof this")
    got = license.scan(spark.createDataFrame([(1, whole), (2, apart), (3, "or " + whole)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.licenses, r.sentence_ids) for r in got[:2]] == [("Apache-2.0", "<apache-2.0><in-compliance><copy-at><apache-2.0-url>"), ("", "")]
    assert (got[2].licenses, got[2].n_unmatched) == ("", 3)


def test_mixing(spark, docs, none):
    rows = [r[:4] for r in ROWS if r[0] is not None]
    small = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "'x' as mix_lang", "7 as MIX_EPOCH", "1 as epochs", "'x' as cut", "2 as rest")
    for mix in (mixing.PRODUCTION, mixing.Mix(share=(3, 1), most_epochs=2), mixing.Mix(sources={"src0": 0, "src1": 5}, share=(1, 3), most_epochs=3)):
        got = mixing.mix_documents(small, mix)
        assert got.columns == ["doc_id", "text", "lang", "source", "epochs", "cut", "rest", "mix_domain", "mix_lang", "mix_source", "mix_epoch"]
        found = sorted(map(tuple, got.select("doc_id", "mix_lang", "mix_source", "mix_epoch").collect()), key=key)
        assert found == oracle(mixing._oracle(mix), rows, "doc_id, mix_lang, mix_source, mix_epoch")
        assert not mix.sources or all(f[2] != "src0" for f in found)
    assert mixing.mix_documents(none).collect() == []


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d0", "de", "c", 1000), ("d1", "en", "d", 1000)], "mix_domain string, mix_lang string, mix_source string, have long")
    got = {r.mix_source: r.budget for r in mixing.leaf_budgets(leaves, mixing.Mix(share=(800, 3010), most_epochs=1)).collect()}
    assert got == {"a": 10, "b": 190, "c": 200, "d": 400}


def shares(given, nodes):
    """Independent water filling: nodes (weight, most) one round after another, in fractions."""
    out, open_ = {n: Fraction(0) for n in nodes}, {n for n, (weight, most) in nodes.items() if weight and most}
    left = Fraction(given)
    while open_:
        unit = left / sum(nodes[n][0] for n in open_)
        full = {n for n in open_ if nodes[n][1] <= unit * nodes[n][0]}
        if not full:
            return out | {n: unit * nodes[n][0] for n in open_}
        out |= {n: Fraction(nodes[n][1]) for n in full}
        left -= sum(nodes[n][1] for n in full)
        open_ -= full
    return out


def budgets(leaves, mix):
    """Independent budgets of (domain, language, source, have) leaves."""
    can = {x[:3]: x[3] * mix.most_epochs * (mix.sources.get(x[2], 1) > 0) * (mix.languages.get(x[1], 1) > 0) * (mix.domains.get(x[0], 1) > 0) for x in leaves}
    out = {(): Fraction(sum(x[3] for x in leaves) * mix.share[0], mix.share[1])}
    for depth, weights in ((1, mix.domains), (2, mix.languages), (3, mix.sources)):
        for parent in {x[: depth - 1] for x in leaves}:
            nodes = {x[:depth] for x in leaves if x[: depth - 1] == parent}
            out |= shares(out[parent], {n: (weights.get(n[-1], 1), sum(v for k, v in can.items() if k[:depth] == n)) for n in nodes})
    return out


@pytest.mark.parametrize("weights", [{"sources": {"a": 0}}, {"languages": {"fr": 0, "en": 3}}, {"sources": {"a": 0, "c": 0}, "languages": {"de": 0}}, {"domains": {"d1": 0}, "sources": {"b": 0}}, {"languages": {"en": 2}}])
def test_weights_of_zero_leave_their_budget_to_others(spark, weights):
    leaves = [(d, lang, s, have * 10**6) for (d, lang, s), have in zip([(d, lang, s) for d in ("d0", "d1") for lang in ("en", "fr", "de") for s in ("a", "b", "c")], [900, 50, 60, 700, 20, 30, 500, 40, 10, 80, 300, 400, 5, 600, 90, 70, 100, 200])]
    for share in ((1, 4), (1, 2)):
        mix = mixing.Mix(**weights, share=share, most_epochs=1)
        found = mixing.leaf_budgets(spark.createDataFrame(leaves, "mix_domain string, mix_lang string, mix_source string, have long"), mix).collect()
        want = budgets(leaves, mix)
        assert len(found) == len(leaves)
        for r in found:
            assert abs(r.budget - want[r.mix_domain, r.mix_lang, r.mix_source]) <= 3, (r, mix)
