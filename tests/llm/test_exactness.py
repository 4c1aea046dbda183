"""Operators against plain versions of themselves, on texts made to break them."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from marlstone.llm import chat, common, fingerprint, jaccard, language, license, linededup, media, mixing, packing, tokenfiles  # noqa: E402
from marlstone.llm.tokenids import PieceCache, load_tokenizer, span_keys  # noqa: E402
from marlstone.scratch import fresh_dir  # noqa: E402

VOCABULARIES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def thue_morse(n, a="a", b="b"):
    return "".join(a if i.bit_count() % 2 == 0 else b for i in range(n))


# -- tokens


@pytest.mark.parametrize("name", VOCABULARIES)
def test_words_of_equal_polynomial_hashes(name):
    path = public_tokenizers.path(name)
    plain, cached = load_tokenizer(path), PieceCache(path)
    texts = [thue_morse(n, *ab) for n in (8, 16, 64, 1024, 2048) for ab in ("ab", "ba")]
    for some in (texts, [" ".join(texts)], texts[::-1]):
        assert [x.tolist() for x in cached.encode(some)] == [plain.encode(t, add_special_tokens=False).ids for t in some]
    words, n = common.word_hashes(texts)
    assert len(set(words.tolist())) == len(texts) and set(n.tolist()) == {1}


@pytest.mark.parametrize("name", VOCABULARIES)
def test_pieces_of_one_key_are_told_by_their_bytes(name, monkeypatch):
    """Every piece of over eight bytes gets the same key, and some shorter ones too."""
    from marlstone.llm import tokenids

    def same(raw, begins, ends):
        keys = span_keys(raw, begins, ends)
        return np.where((ends - begins > 8) | (ends - begins == 3), np.uint64(77 << 40), keys)

    monkeypatch.setattr(tokenids, "span_keys", same)
    path = public_tokenizers.path(name)
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 30))) for _ in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(40)]
    plain, cached = load_tokenizer(path), PieceCache(path, max_pieces=60)
    for _ in range(2):
        assert [x.tolist() for x in cached.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", VOCABULARIES)
def test_the_library_has_few_pieces_at_once(name):
    path = public_tokenizers.path(name)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12)))
    texts = [" ".join(word() for _ in range(300)) for _ in range(40)]
    plain, cached, most = load_tokenizer(path), PieceCache(path), []

    class Counting:
        def encode_batch_fast(self, some, **more):
            most.append(len(some))
            return plain.encode_batch_fast(some, **more)

    cached.tokenizer = Counting()
    assert [x.tolist() for x in cached.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert cached.count == sum(most) > 2 * max(most) and max(most) <= 2048


def test_workers_give_back_what_they_freed():
    """Freed blocks below others that live on stay with the allocator otherwise."""

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    def run(batches):
        blocks = [bytes(100_000) for _ in range(2000)]
        pins.append(bytes(100_000))
        for batch in batches:
            yield batch + len(blocks)

    if not common._TRIM:
        pytest.skip("no C library that trims")
    pins, took = [], []
    for whole in (run, common.frugal(run)):
        common.give_back()
        before = resident()
        assert list(whole(iter([1, 2]))) == [2001, 2002]
        took.append(resident() - before)
    assert took[0] > 100 << 20 > 20 << 20 > took[1]


def test_short_spans_have_keys_of_their_own():
    words = [bytes([a, b][: 1 + (b > 0)]) for a in range(1, 256) for b in range(256)] + [b"abcdefg", b"abcdefgh", b"abcdefghi", b"bcdefghia"]
    raw = b"\0".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    keys = span_keys(raw + bytes(9), ends - [len(w) for w in words], ends)
    assert len(set(keys.tolist())) == len(set(words)) == len(words)
    moved = span_keys(b"xyz" + words[-2] + bytes(9), np.array([3]), np.array([12]))
    assert moved[0] == keys[-2]


def test_small_shards_share_a_task(spark, tmp_path, monkeypatch):
    shards, want = [], []
    for i in range(7):
        writer = tokenfiles.ShardWriter(f"file://{tmp_path}", f"s{i}", np.dtype(np.uint16), 4)
        some = [np.arange(n, dtype=np.uint32) + i for n in (3, i + 1, 0)]
        writer.add([3 * i, 3 * i + 1, None], some)
        writer.close()
        shards.append(tokenfiles.Shard(f"file://{tmp_path}/s{i}.arrow", 3, writer.ids, sum(x.ids for x in shards)))
        starts = shards[-1].start + np.cumsum([0, 3, i + 1])
        want += [(d, int(s), len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, s, x in zip((3 * i, 3 * i + 1, None), starts, some)]
    for most, tasks in ((1 << 25, 1), (12, 6), (1, 7)):  # shards of 4 to 10 ids
        monkeypatch.setattr(tokenfiles, "READ_IDS", most)
        found = tokenfiles.read_tokens(spark, shards)
        assert found.rdd.getNumPartitions() == tasks
        assert list(map(tuple, found.collect())) == want


def test_ids_beyond_the_type_are_refused(tmp_path):
    assert tokenfiles.id_type(65_535) == np.uint16 and tokenfiles.id_type(65_536) == np.uint32
    with pytest.raises(ValueError):
        tokenfiles.id_type(1 << 32)
    writer = tokenfiles.ShardWriter(f"file://{tmp_path}", "s", np.dtype(np.uint16), 4)
    with pytest.raises(ValueError, match="70000"):
        writer.add([1], [np.array([5, 70_000])])
    writer = tokenfiles.ShardWriter(f"file://{tmp_path}", "t", np.dtype(np.uint32), 4)
    writer.add([1], [np.array([5, 70_000])])
    writer.close()
    assert tokenfiles.ShardReader(f"file://{tmp_path}/t.arrow").ids(0, 2).tolist() == [5, 70_000]


def test_a_large_end_id_widens_the_files(spark):
    path = public_tokenizers.path(tokenfiles.VOCABULARY)
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    shards = tokenfiles.write_tokens(docs, path, fresh_dir(spark, "wide"), end_id=70_000, sequence=8)
    rows = {r.doc_id: r for r in tokenfiles.read_tokens(spark, shards).collect()}
    ids = [*load_tokenizer(path).encode("some text", add_special_tokens=False).ids, 70_000]
    assert rows[1].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and rows[2].n_tokens == 1


def test_files_of_lost_attempts_go(spark, tmp_path):
    path = public_tokenizers.path(tokenfiles.VOCABULARY)
    docs = spark.createDataFrame([(7, "one text")] * 50 + [(None, "other")], "doc_id long, text string")
    out = f"file://{tmp_path}/out"
    stale = tokenfiles.ShardWriter(out, "shard-000000-99-lost", np.dtype(np.uint16))
    stale.add([1], [np.arange(3)])
    stale.close()
    shards = tokenfiles.write_tokens(docs, path, out)
    assert sorted(x.name for x in (tmp_path / "out").iterdir()) == sorted(x.path.rsplit("/", 1)[1].removesuffix(".arrow") + y for x in shards for y in (".arrow", ".docs.arrow"))
    found = tokenfiles.read_tokens(spark, shards).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None] + [7] * 50


# -- fingerprints


def plain_fingerprint(text):
    """One text's bins, one shingle after another."""
    mask = (1 << 64) - 1

    def mix(h):
        h ^= h >> 33
        h = h * 0xFF51AFD7ED558CCD & mask
        h ^= h >> 29
        h = h * 0xC4CEB9FE1A85EC53 & mask
        return h ^ h >> 32

    bins: dict[int, int] = {}
    for h in common.shingles([text])[0].tolist():
        at = h >> (64 - int(math.log2(fingerprint.BINS)))
        bins[at] = min(bins.get(at, 1 << 32), h >> 16 & 0xFFFFFFFF)
    out = []
    for k in range(fingerprint.BINS):
        at, attempt = k, 0
        while at not in bins:
            if len(bins) == 1:
                (at,) = bins
                break
            attempt += 1
            at = (mix((k * 0x9E3779B97F4A7C15 + attempt) & mask) >> 32) % fingerprint.BINS
        out.append(mix((bins[at] * fingerprint.BINS + k) & mask) & (1 << fingerprint.BITS) - 1)
    return out


def test_fingerprints_equal_a_plain_version(spark):
    rng = random.Random(4)
    words = ["wort", "word", "mot", "palabra", "x", "漢字", "naïve", thue_morse(64), thue_morse(64, "b", "a")]
    texts = ["", " ", "one", "a b c d e", "a b c d e f", thue_morse(40)] + [" ".join(rng.choice(words) for _ in range(n)) for n in (6, 7, 40, 300, 3000)]
    want = [plain_fingerprint(t) for t in texts]
    assert fingerprint.fingerprints(texts).tolist() == want
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in fingerprint.compare_with_next(docs, 3).collect()}
    for i, t in enumerate(texts):
        after = texts[i - 1]
        n = len(t) // 2
        edited = plain_fingerprint(t[: len(t) - n] + after[:n])
        assert fingerprint.from_hex(rows[i].fingerprint).tolist() == want[i] and fingerprint.from_hex(rows[i].edited_fingerprint).tolist() == edited
        for near, other in ((rows[i].near_edited, edited), (rows[i].near_next, want[i - 1])):
            same = sum(a == b for a, b in zip(want[i], other)) / fingerprint.BINS
            assert near == pytest.approx(min(1, max(0, (same - 1 / 16) / (15 / 16))))


def test_a_doc_id_of_many_rows_is_split(spark):
    rng = random.Random(3)
    rows = [(7, f"text {i} of the one id") for i in range(40)] + [(i, f"row {i}") for i in range(1, 13)] + [(None, f"none {i}") for i in range(9)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ranges = fingerprint.Ranges.of([-5, 3, 7, 7, 7, 7, 9])
    keys = np.array([10, 9, 8, 7, 7, 7, 6, 3, 0, -5, -9])
    spread = np.array([0, 0, 0, -(1 << 63), 0, (1 << 63) - 1, 0, 0, 0, 0, 0])
    parts = ranges.part(keys, spread).tolist()
    assert parts == sorted(parts) and parts[3] + 3 == parts[5] and ranges.count == 9 and parts[-1] == 8
    order = sorted(docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))
    want = {}
    for k, r in enumerate(order):
        after, n = order[(k + 1) % len(order)].text, len(r.text) // 2
        want[r.doc_id, r.text] = plain_fingerprint(r.text[: len(r.text) - n] + after[:n])
    for task_rows in (1, 4, 1000):
        got = fingerprint.compare_with_next(docs, task_rows).collect()
        assert sorted(fingerprint.from_hex(r.edited_fingerprint).tolist() for r in got) == sorted(want.values())


# -- media


def plain_pairs(samples):
    """Peaks and their pairs, frame by frame and bin by bin."""
    x = [b - 128 for b in samples]
    frames = max(1, -(-(len(x) - media.WINDOW) // media.HOP) + 1)
    x += [0] * ((frames - 1) * media.HOP + media.WINDOW - len(x))
    window = np.hanning(media.WINDOW).astype(np.float32)
    found = []
    for t in range(frames):
        power = np.abs(np.fft.rfft(np.array(x[t * media.HOP : t * media.HOP + media.WINDOW], np.float32) * window)).astype(np.float32)
        tops = [(power[k], k) for k in range(3, len(power) - 2) if power[k] > power[k - 1] and power[k] >= power[k + 1] and power[k] > 0]
        found += sorted((t, k) for _, k in sorted(tops, reverse=True)[: media.PEAKS])
    pairs = []
    for i, (t, k) in enumerate(found):
        for u, m in found[i + 1 : i + 1 + media.FAN_OUT]:
            if u - t <= media.REACH:
                pairs.append((t, k << 13 | m << 4 | (u - t)))
    return sorted(pairs)


def test_media_pairs_equal_a_plain_version(spark):
    rng = random.Random(6)
    texts = ["", "short", "x" * 700, "ab" * 2000, *(" ".join(rng.choice(["the", "sound", "of", "ü", "text\n", "Zeile"]) for _ in range(n)) for n in (30, 400, 1500))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in media.media_features(docs).collect():
        raw = texts[r.doc_id].encode()
        want = plain_pairs(media.pad(raw))
        assert list(zip(r.pair_times, r.pair_codes)) == want and r.feature.split(":")[0] == str(len(want))


# -- language


def plain_predict(model, text):
    """A text's probabilities, subword by subword."""
    low = f"\0{text.lower()}\0"
    logits, n = np.zeros(len(model.languages)), 0
    for size in range(1, language.ORDERS + 1):
        for i in range(len(low) - size + 1):
            sub = [c if c.isalpha() else "\0" for c in low[i : i + size]]
            inner = sub[1:-1]
            if (size <= 2 and not any(c != "\0" for c in sub)) or not all(c != "\0" for c in inner):
                continue
            h = 2166136261
            for c in sub:
                h = (h ^ ord(c) if c != "\0" else h) * 0x01000193 & 0xFFFFFFFF
                h ^= h >> 15
            bucket = (h * 0x85EBCA6B & 0xFFFFFFFF) >> 16 & language.BUCKETS - 1
            logits += model.table[bucket]
            n += 1
    x = np.exp(logits / max(n, 1) / model.temperature - (logits / max(n, 1) / model.temperature).max())
    return x / x.sum()


def labelled(n, seed=8):
    rng = random.Random(seed)
    words = {"en": "the of and with from was that have this", "de": "der die und mit von war dass haben für", "fr": "le la les que dans pour été avec une"}
    return [(i, " ".join(rng.choice(words[lang].split()) for _ in range(rng.randint(8, 30))), lang) for i in range(n) for lang in [rng.choice(sorted(words))]]


def test_language_scores_equal_a_plain_version(spark):
    rows = labelled(250)
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(known)
    texts = [t for _, t, _ in rows[:12]] + ["", "1 2 3", "ß", "the der", "Ünïcode! the of, and"]
    probs, letters = model.probabilities(texts)
    for t, p, n in zip(texts, probs, letters):
        assert n == sum(c.isalpha() for c in t.lower())
        if n:
            assert p == pytest.approx(plain_predict(model, t), abs=1e-5)
            assert (model.probabilities([t])[0] == p).all()  # the texts beside it play no part


def test_held_out_rows_are_never_learnt_from(spark):
    rows = labelled(250)
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in rows]
    assert [r.h for r in known.select("doc_id", language.held_out(F.col("doc_id")).alias("h")).orderBy("doc_id").collect()] == held and 20 < sum(held) < 80
    wrong = spark.createDataFrame([(i, t if not h else "zzz qqq", lang if not h else "xx") for (i, t, lang), h in zip(rows, held)], "doc_id long, text string, lang string")
    a, b = language.train(known), language.train(wrong)
    assert a.languages == b.languages == ["de", "en", "fr"] and (a.table == b.table).all() and a.threshold == b.threshold
    found = language.identify(wrong.select("doc_id", "text", F.lit("en").alias("lang")), a)
    assert {r.lang_pred for r in found.where("text = 'zzz qqq'").collect()} <= {"de", "en", "fr"}


def test_fitted_rows_are_bounded(spark, monkeypatch):
    """One doc_id repeated, with one text and with many: at most rows_per_language reach the fit."""
    seen = []
    monkeypatch.setattr(language, "fit", lambda rows: seen.append(Counter(r[0] for r in rows)))
    free = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5)
    same = spark.range(3000).select(F.lit(free).cast("long").alias("doc_id"), F.lit("the same text").alias("text"), F.lit("en").alias("lang"))
    many = spark.range(3000).select(F.lit(free).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("de").alias("lang"))
    language.train(same.unionByName(many), 40)
    assert seen == [Counter({"de": 40, "en": 1})]


def test_rejection_costs_the_stated_share_of_right_rows():
    scores = np.concatenate([[0.01], np.linspace(0.3, 0.8, 999)])
    t = language.rejection_threshold(scores)
    assert 0.003 <= (scores < t).mean() <= language.REJECTED_RIGHT and t > 0.3  # one unsure row does not switch it off
    assert language.rejection_threshold(np.ones(100)) == language.CERTAIN and language.rejection_threshold(np.zeros(0)) == 0


def test_rejection_on_the_given_documents(spark):
    path = "/root/testdata/sf0.1/documents.parquet"
    try:
        docs = spark.read.parquet(path).where("lang is not null")
    except Exception:
        pytest.skip("no test tables")
    found = language.identify(docs, language.train(docs)).select("rejected", (F.col("lang") == F.col("lang_pred")).alias("right")).groupBy("right").agg(F.avg(F.col("rejected").cast("int")).alias("share"), F.count("*").alias("n")).collect()
    share = {r.right: (r.share, r.n) for r in found}
    assert share[True][0] <= 3 * language.REJECTED_RIGHT
    assert share.get(False, (1, 0))[0] > 10 * share[True][0]  # wrong ones go far more often


# -- chats


def test_rewrites_are_reported_for_each_conversation(spark):
    turns = spark.createDataFrame([(c, i, "user", f"t{i}") for c in range(4) for i in range(5 * c)] + [(None, 0, "user", None)], "conv_id long, turn long, role string, text string")
    last_ten = lambda t, opening: "".join(f"<{x}>" for _, x in t[-10:])
    found = {r.conv_id: (r.n_turns, r.rewritten_by) for r in chat.find_rewrites(turns, last_ten).collect()}
    assert found == {1: (5, None), 2: (10, None), 3: (15, 10), None: (1, None)}
    numbered = lambda t, opening: "".join(f"{i}<{x}>" for i, (_, x) in enumerate(t))
    long = spark.createDataFrame([(1, i, "user", f"t{i}") for i in range(50)], "conv_id long, turn long, role string, text string")
    assert chat.find_rewrites(long, numbered).first().rewritten_by is None and chat.find_rewrites(long.limit(0)).collect() == []
    assert "".join(r.formatted for r in chat.format_chats(long, numbered).collect()).endswith("49<t49>")


# -- licences

LATER = "either version {} of the License, or\n(at your option) any later version."
GNU = """This {} is free software{} you can redistribute it and/or
modify it under the terms of the GNU {}General Public
License as published by the Free Software Foundation{} """
NOTICES = {
    "ISC": """Copyright (c) 2020, A. Name

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "BSD-2-Clause": """Copyright 2020 A. Name

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.""",
    "GPL-2.0-or-later": GNU.format("program", ";", "", ";") + LATER.format("2"),
    "GPL-3.0-or-later": GNU.format("program", ":", "", ",") + LATER.format("3"),
    "GPL-2.0-only": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.",
    "LGPL-2.1-or-later": GNU.format("library", ";", "Lesser ", ";") + LATER.format("2.1"),
    "LGPL-3.0-or-later": GNU.format("library", ":", "Lesser ", ",") + LATER.format("3"),
    "AGPL-3.0-or-later": GNU.format("program", ":", "Affero ", ",") + LATER.format("3"),
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Apache-2.0": """Licensed to the A Foundation (AF) under one or more contributor license agreements.
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
except in compliance with the License. You may obtain a copy of the License at

    https://www.apache.org/licenses/LICENSE-2.0""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions:""",
}
NOTICES["BSD-3-Clause"] = NOTICES["BSD-2-Clause"] + "\n\n3. Neither the name of the copyright holder nor the names of its\ncontributors may be used to endorse or promote products derived from\nthis software without specific prior written permission."


def wrapped(text, width):
    import textwrap

    return "\n\n".join("\n".join(textwrap.wrap(" ".join(x.split()), width, break_on_hyphens=False, break_long_words=False)) for x in text.split("\n\n"))


def test_standard_notices_in_all_forms(spark):
    marks = {"plain": "", "star": " * ", "hash": "# ", "slash": "// ", "dash": "-- ", "lisp": ";; ", "rem": "% "}
    rows = []
    for name, text in NOTICES.items():
        for form in (text, wrapped(text, 72), wrapped(text, 40), "\n\n".join(" ".join(x.split()) for x in text.split("\n\n"))):
            for mark in marks.values():
                rows.append((len(rows), "\n".join((mark + x).rstrip() for x in form.split("\n")), name))
    df = spark.createDataFrame(rows, "doc_id long, text string, name string")
    got = sorted(tuple(r) for r in license.scan(df).collect())
    assert {(rows[r[0]][2], r[2], r[3]) for r in got} == {(n, n, 0) for n in NOTICES}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    assert sorted(con.sql(f"SELECT doc_id, sentence_ids, licenses, n_unmatched FROM ({license.ORACLE_SQL})").fetchall()) == got


def test_every_key_is_its_own_normal_form():
    for key, ids in license.ALL_SENTENCES.items():
        assert license.normalised_text(key) == key and ids
    known = {x for ids in license.ALL_SENTENCES.values() for x in ids.split()}
    assert all(x in known for _, ids in license.ALL_RULES for x in ids)


def test_the_tree_of_sentences_finds_what_a_list_finds():
    rng = random.Random(1)
    keys = {" ".join(rng.choice(["a", "ab", "abc", "b", "c-d", "e.f"]) for _ in range(rng.randint(1, 4))) for _ in range(60)}
    tree, plain = re.compile(license.sentence_pattern(keys, license.WRAP)), re.compile("|".join(re.escape(k).replace(r"\ ", f"(?: |{license.WRAP})") for k in sorted(keys, key=len, reverse=True)))
    for _ in range(2000):
        text = "".join(rng.choice(["a", "ab", "abc", "b", "c-d", "e.f"]) + rng.choice([" ", " ", "\n", " \n- "]) for _ in range(6)).strip()
        assert (tree.fullmatch(text) is None) == (plain.fullmatch(text) is None)


# -- names, settings, lost folders

CLASHES = "_mix_epochs string, _mix_copies string, mix_epochs string, mix_cut string, mix_copies string, _kept_null string, kept_null string, kept_doc string, _bits_keep string, bits_doc string, bits_row string, bits_keep string, _salt string, salt string, rank string, n_lines string, n_dropped string, score string, rejected string, own_score string, size string, hub string, set_id string"


def awkward(spark, text="text"):
    """Two docs and a copy, in a table with clashing columns."""
    names = [x.split()[0] for x in CLASHES.split(", ")]
    texts = ["the first of the texts that we have here and with the others from it", "der zweite und die anderen von dem mit dem war dass", "the first of the texts that we have here and with the others from it"]
    rows = [(i, t, lang, "src0", len(t), *(f"mine {n}" for n in names)) for i, (t, lang) in enumerate(zip(texts, ("en", "de", "en")))]
    return spark.createDataFrame(rows, f"doc_id long, {text} string, lang string, source string, n_chars long, {CLASHES}"), names


def test_clashing_columns_come_through(spark):
    docs, names = awkward(spark)
    mine = lambda df, k: {r.doc_id: all(r[n] == f"mine {n}" for n in names) for r in df.collect()}
    for found in (mixing.mix_documents(docs, mixing.Mix(share=(1, 1), most_epochs=1)), jaccard.keep_one_of_each(docs), linededup.drop_repeated_lines(docs), language.keep_identified(docs)):
        assert found.columns[: len(docs.columns)] == docs.columns
        rows = found.collect()
        assert rows and all(r[n] == f"mine {n}" for r in rows for n in names)
    pieces = docs.select(*[c for c in docs.columns if c != "text"], F.lit(3).cast("long").alias("length"))
    packed = packing.pack(common.written(pieces, "p"), 8)
    assert packed.columns == [*pieces.columns, "sequence_id", "offset"] and all(r[n] == f"mine {n}" for r in packed.collect() for n in names)


def test_names_in_other_letter_cases(spark):
    docs, _ = awkward(spark, "Text")
    model = language.train(docs)
    assert language.identify(docs, model).columns[1] == "Text" and language.identify(docs, model).count() == 3
    assert linededup.drop_repeated_lines(docs).where("Text is not null").count() == 3


def test_session_settings_stay(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key), spark.conf.get("spark.checkpoint.dir", None)
    docs, _ = awkward(spark)
    jaccard.near_duplicates(docs).count(), linededup.line_bitmaps(docs).count(), media.media_features(docs).count()
    assert (spark.conf.get(key), spark.conf.get("spark.checkpoint.dir", None)) == before


def test_batches_are_cut_by_rows_and_bytes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(common, "BATCH_ROWS", 4)
    monkeypatch.setattr(common, "BATCH_BYTES", 10)
    texts = ["", "abc", None, "x" * 30, "é" * 5, "a", "b", "c", "d", "e", "f" * 9, "g"]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    parts = list(common.text_batches([batch, batch.slice(0, 0)]))
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts
    assert all(p.num_rows <= 4 and (p.num_rows == 1 or sum(len((x or "").encode()) for x in p.column(1).to_pylist()) <= 10) for p in parts)
