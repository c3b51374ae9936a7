"""Each corpus query against plain Python on whole small tables, and on tables made to be awkward."""

import random
import time

import brute
import pytest
from pyspark.sql import functions as F

from folioframe.llm import components, decontam, exactdedup, htmltext, importance, langid, licenses, neardup, pieces, suffix, toxicity
from folioframe.llm.queries import piece_model_path

SF = "/root/testdata/sf0.001"
LONG = "alpha beta gamma delta " * 20_000


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, odd characters, and columns with clashing names."""
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(300)]
    prose = [" ".join(rng.choices(vocabulary, k=120)) for _ in range(12)]
    texts = [None, "", " \n\t", "MIT License. The Apache License, and GNU General Public License!", "é漢字 ▁▁ \x00 😀 <0x41>", LONG, LONG + "end", "short", "Short", "...", *prose]
    texts += [p.replace("w7 ", "x ", 1) for p in prose[:6]] + [prose[0], prose[0] + " ", prose[1].replace(" ", "  ", 1)]
    texts += [prose[0][:200] + prose[5][:300] + "tail", "z" * 49, "z" * 50, "z" * 120]
    rows = [(i, t, "en" if i % 2 else None, "s", 7, "a", 1, 2.0) for i, t in enumerate(texts)]
    rows += [rows[12], (1000, prose[3], None, None, None, None, None, None), (None, prose[2], "en", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, digest string, keep_id int, score double")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect() if r.doc_id is not None]


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_exact(docs, sample, nothing):
    for df in (docs, sample):
        want = brute.exact([(r.doc_id, r.text) for r in df.collect()]) if df is sample else brute.exact(pairs(df) + [(10**9, p) for i, p in pairs(df) if i == 12][:1])
        for r in exactdedup.exact_dedup(df).collect():
            if r.doc_id is not None and want[r.doc_id][0] < 10**9:
                assert r.keep_id == want[r.doc_id][0] and r.text_sha256 == want[r.doc_id][2] and r.kept == (r.doc_id == r.keep_id)
    assert exactdedup.exact_dedup(nothing).count() == 0


def test_exact_checks_bytes(sample):
    want = brute.exact(pairs(sample))
    got = exactdedup.exact_dedup(sample, digest=lambda c: F.substring(F.md5(c), 1, 1)).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == {i: v[:2] for i, v in want.items()}


def test_exact_state_lasts(spark, sample, tmp_path):
    """A later call with the same state folder meets the rows of the calls before it, and checks their bytes."""
    first, second = sample.where("doc_id % 3 <> 0"), sample.where("doc_id % 3 = 0")
    for k, df in enumerate((first, second)):
        df.write.parquet(str(tmp_path / f"d{k}"))
    exactdedup.exact_dedup(spark.read.parquet(str(tmp_path / "d0")), state_dir=str(tmp_path / "state")).count()
    got = exactdedup.exact_dedup(spark.read.parquet(str(tmp_path / "d1")), state_dir=str(tmp_path / "state")).collect()
    want = brute.exact(pairs(sample))
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == {i: want[i][:2] for i in want if i % 3 == 0}
    assert any(r.keep_id % 3 for r in got)
    wrong = exactdedup.exact_dedup(spark.read.parquet(str(tmp_path / "d1")), digest=lambda c: F.lit("x"), state_dir=str(tmp_path / "weak")).collect()
    alone = brute.exact(pairs(second))
    assert {r.doc_id: (r.keep_id, r.group_size) for r in wrong} == {i: v[:2] for i, v in alone.items()}


def test_filters_judge_rows(spark):
    """Rows without doc_id and rows that repeat one are kept or dropped by their own text."""
    items = spark.createDataFrame([(1, " ".join(f"b{k}" for k in range(20)))], "item_id long, text string")
    bad, fine = items.first().text, "a plain text of some words that are in no test set at all"
    rows = [(1, bad, 0), (1, fine, 1), (None, bad, 2), (None, fine + " x", 3), (2, fine, 4), (2, fine, 5), (None, fine, 6), (3, None, 7), (None, None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, locator int")
    assert sorted(r.locator for r in decontam.drop_contaminated(docs, items).collect()) == [1, 3, 4, 5, 6, 7, 8]
    kept = exactdedup.keep_first(docs)
    assert kept.columns == ["doc_id", "text", "locator"]
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(0, fine + " x"), (1, fine), (1, bad), (3, "")])
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(400)], "doc_id long, toxic int")
    train = spark.createDataFrame([(i, "vile words here" if i % 2 else "calm words here") for i in range(400)], "doc_id long, text string")
    mixed = train.withColumn("n", F.col("doc_id")).unionByName(spark.createDataFrame([(None, "vile vile", 1000), (None, "calm", 1001), (1, "calm", 1002)], "doc_id long, text string, n long"))
    left = {r.n for r in toxicity.drop_toxic(mixed, labels).collect()}
    assert left == {i for i in range(0, 400, 2)} | {1001, 1002}


def test_exact_over_many_batches(sample, spark, tmp_path):
    sample.repartition(7).write.parquet(str(tmp_path / "d"))
    want = brute.exact(pairs(sample))
    got = exactdedup.exact_dedup(spark.read.parquet(str(tmp_path / "d")), files_per_batch=1).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == {i: v[:2] for i, v in want.items()}


def test_contamination(spark, docs, sample, nothing):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    own = spark.createDataFrame([(1, "w1 w2"), (2, None), (3, "..."), (4, LONG[:120]), (5, "short"), (5, "Short!")], "item_id long, text string")
    for df, bench in ((sample, items), (docs, own)):
        want = brute.contamination(pairs(df), [(r.item_id, r.text) for r in bench.collect()])
        for size in (1 << 24, 60):
            for r in decontam.contamination(df, bench, block_bytes=size if df is docs else 1 << 24).collect():
                if r.doc_id is not None:
                    assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[r.doc_id]
    assert decontam.contamination(nothing, own).count() == 0
    assert not any(r.contaminated for r in decontam.contamination(sample, items.where("false")).collect())
    for df, bench in ((sample, items), (docs, own)):
        near = brute.near_items(pairs(df), [(r.item_id, r.text) for r in bench.collect()])
        for size in (1 << 24, 60) if df is docs else (1 << 24,):
            for r in decontam.contamination(df, bench, block_bytes=size).collect():
                if r.doc_id is not None:
                    assert r.near_ids == near[r.doc_id] and r.n_near_items == len(r.near_ids) and set(r.item_ids) <= set(r.near_ids)
        assert any(near.values())


def test_licenses(docs, sample, nothing):
    assert len(licenses.rules()) > 200
    for df in (docs, sample):
        texts = dict(pairs(df))
        for r in licenses.scanned(df).collect():
            if r.doc_id is not None:
                assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.base_licenses(texts[r.doc_id])
                assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert licenses.scanned(nothing).count() == 0


def test_license_rules(spark):
    cases = {"SPDX-License-Identifier: Apache-2.0": "apache", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "the Mozilla Public License, v. 2.0": "mpl", "GNU Lesser General Public License version 2.1": "gpl,lgpl", "permit license": "", "BSD 3-Clause": "", "the new BSD license": "bsd"}
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.scanned(df).collect()} == dict(enumerate(cases.values()))


def test_license_detections(spark, sample):
    """Detections, and which of them others suppress, against all pairs in plain Python; many in one text, and nested ones."""
    rng = random.Random(4)
    spells = """Licensed under the Apache License, Version 2.0|MIT License|GNU Lesser General Public License v2.1|SPDX-License-Identifier: GPL-3.0-or-later|released under the terms of the BSD 3-Clause License|Creative Commons Attribution NoDerivs 4.0|
Attribution No Derivatives 3.0|CC BY-NC-SA 4.0|Copyright (c) 2001 2002|All rights reserved|Neither the name of the Foo Bar Group nor the names of its contributors may be used to endorse or promote|
This program is free software; you can redistribute it and/or modify it|under the GNU General Public License as published by the Free Software Foundation|https://www.gnu.org/licenses/gpl-3.0|into the public domain|
permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted|the mit license mit license apache license|Mozilla Public License, v. 2.0|word|other words|2.0|license"""
    spells = [x.strip() for x in spells.split("|")]
    texts = [". ".join(rng.choices(spells, k=k)) for k in (1, 2, 3, 5, 8, 40, 40, 200, 700) for _ in range(3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(sample.select(F.col("doc_id") + 10**6, "text").toDF("doc_id", "text"))
    texts, labels, found = dict(pairs(df)), {label for label, *_ in licenses.rules()}, set()
    for r in licenses.scanned(df).collect():
        want = brute.license_detections(texts[r.doc_id], licenses.rules())
        assert sorted(map(tuple, r.detections)) == want
        base = set(filter(None, brute.base_licenses(texts[r.doc_id])[4].split(",")))
        assert r.labels == ",".join(sorted({d[3] for d in want} | base))
        found |= {d[3] for d in want}
    assert len(found) > 12 and found <= labels


def test_license_time(spark):
    """A megabyte of license lines, in seconds."""
    line = "Licensed under the Apache License, Version 2.0. MIT License. GNU General Public License. "
    began = time.time()
    r = licenses.scanned(spark.createDataFrame([(1, line * 12_000)], "doc_id long, text string")).first()
    assert r.n_base == 36_000 and len(r.detections) == 36_000 and time.time() - began < 60


def test_pieces(docs, sample, nothing):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=piece_model_path())
    for df in (docs, sample):
        texts = dict(pairs(df))
        for r in pieces.encoded(df, piece_model_path()).collect():
            if r.doc_id is not None:
                ids = lib.encode(texts[r.doc_id] or "") + [lib.eos_id()]
                assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == lib.decode(ids)
        for r in pieces.encoded(df, piece_model_path(), digests=True).collect():
            if r.doc_id is not None:
                ids = lib.encode(texts[r.doc_id] or "") + [lib.eos_id()]
                assert r.ids_sha256 == brute.sha(" ".join(map(str, ids))) and r.decoded_sha256 == brute.sha(lib.decode(ids))
    assert pieces.encoded(nothing, piece_model_path()).count() == 0


def test_near(docs, sample, nothing):
    for df in (docs, sample):
        want = brute.near_classes(pairs(df))
        for r in neardup.classes(df).collect():
            if r.doc_id is not None:
                assert r.class_id == want[r.doc_id], (r, want[r.doc_id])
                assert r.kept == (r.doc_id == r.class_id)
    assert neardup.classes(nothing).count() == 0
    assert neardup.keep_one(docs).columns == docs.columns


def test_near_chains(spark):
    """D is like L and E, which are not like each other: E is found through D only, after D has been linked to L."""
    rng = random.Random(11)
    rows = []
    for n in range(50):
        words = [f"w{rng.randrange(10**9)}" for _ in range(1000)]
        places = rng.sample(range(10, 990, 10), 25)
        for k, upto in enumerate((0, 6, 25)):
            changed = [f"x{n}" if i in places[:upto] else w for i, w in enumerate(words)]
            rows.append((3 * n + k, " ".join(changed)))
        sets = [brute.shingles(t) for _, t in rows[-3:]]
        like = [len(a & b) / len(a | b) for a, b in (sets[:2], sets[1:], sets[::2])]
        assert like[0] > 0.93 and like[1] > 0.8 > like[2] + 0.01
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] == i - i % 3 for i, _ in rows) == len(rows)


def test_near_large_buckets(spark, monkeypatch):
    """Most of a text is everyone's, and pairs of documents are alike in the rest: their links are found in buckets of many blocks."""
    rng = random.Random(12)
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 16)
    common = [f"c{k}" for k in range(160)]
    rows = []
    for n in range(100):
        own = [f"w{rng.randrange(10**9)}" for _ in range(40)]
        rows += [(2 * n, " ".join(common + own)), (2 * n + 1, " ".join(common + [f"x{n}" if k % 10 == 5 else w for k, w in enumerate(own)]))]
    rng.shuffle(rows)
    want = brute.near_classes(rows)
    assert want == {i: i - i % 2 for i, _ in rows}
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] == want[i] for i in want) == len(want)


@pytest.mark.parametrize("n,least,changes", [(10, 0.80, 12), (60, 0.85, 8), (900, 0.8, 5), (5000, 0.8, 5)])
def test_near_recall_in_one_bucket_family(spark, n, least, changes):
    """Variants of one text, n of them, a few words changed in each: all links by brute force are within one class."""
    rng = random.Random(n)
    base = [f"w{rng.randrange(10**9)}" for _ in range(300)]
    rows, sets = [], []
    for i in range(n):
        words = list(base)
        for k in rng.sample(range(300), rng.randint(2, changes)):
            words[k] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
        sets.append(brute.shingles(rows[-1][1]))
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    some = [(a, b) for a in rng.sample(range(n), min(n, 100)) for b in range(n) if a != b]
    links = [(a, b) for a, b in some if (k := len(sets[a] & sets[b])) >= least * (len(sets[a]) + len(sets[b]) - k)]
    assert links and sum(got[a] == got[b] for a, b in links) >= 0.999 * len(links)


def test_near_repeated_passage(spark):
    """Copies that repeat a passage many times are alike by the plain measure, far from it by the weighted one."""
    rng = random.Random(13)
    rows = []
    for n in range(40):
        words = [f"w{rng.randrange(10**9)}" for _ in range(200)]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(words + words[:20] * 30))]
        a, b = (brute.shingles(t) for _, t in rows[-2:])
        assert len(a & b) / len(a | b) > 0.9
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] == i - i % 2 for i, _ in rows) == len(rows)


def test_near_sampling_agrees_with_weighted_jaccard():
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(1, 1 << 62, 400).astype(np.uint64)
    w1, w2 = rng.uniform(0.5, 3, 400).astype(np.float32), rng.uniform(0.5, 3, 400).astype(np.float32)
    true = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    got = []
    for k in range(40):
        h = base * np.uint64(2 * k + 3)
        s = neardup.samples(np.array([0, 400]), np.concatenate([h, h]), np.concatenate([w1, w2]))
        got.append((s[0] == s[1]).mean())
    assert abs(np.mean(got) - true) < 0.05


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 100), (7, 300)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 300: 0, 100: 100, 101: 100, 102: 100, 200: 100}


def test_removed(docs, sample, nothing, monkeypatch):
    for shards, most, hot in ((None, 2 << 20, 64 << 20), (9, 5000, 64 << 20), (2, 5000, 3000)):  # the last: shards of many parts, merged by binary search
        monkeypatch.setattr(suffix, "ARRAY_BYTES", most)
        monkeypatch.setattr(suffix, "HOT_BYTES", hot)
        monkeypatch.setattr(suffix, "PART_BYTES", min(hot, 8 << 20))
        for df in (sample, docs.where("doc_id is null or doc_id <> 12")):
            want = brute.removed(pairs(df))
            for r in suffix.removed(df.repartition(5), shards).collect():
                if r.doc_id is not None:
                    assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
                else:
                    assert r.n_removed == r.n_spans == 0
    assert suffix.removed(nothing).count() == 0


def test_removed_merges_parts(spark, monkeypatch):
    """A passage in many documents whose surroundings differ: its strings meet in parts of one shard."""
    rng = random.Random(8)
    monkeypatch.setattr(suffix, "HOT_BYTES", 2000)
    monkeypatch.setattr(suffix, "PART_BYTES", 2000)
    monkeypatch.setattr(suffix, "DEALT_SLICES", 1)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(16))
    rows = [(i, f"{rng.random()} {passage[rng.randrange(20) : 90 + rng.randrange(30)]} {rng.random()}\x00") for i in range(300)]
    rows += [(7, "another text of this document, with no passage of others in it at all, but long enough"), (400, passage), (401, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    want = {(i, brute.sha(t or "")): None for i, t in rows}
    got = suffix.removed(df, 1).collect()
    first = {}
    for i, t in sorted(rows):
        for s in range(len(t.encode()) - 49):
            first.setdefault(t.encode()[s : s + 50], i)
    for r in got:
        texts = [t.encode() for i, t in rows if i == r.doc_id]
        cover = [{b for s in range(len(t) - 49) if first[t[s : s + 50]] < r.doc_id for b in range(s, s + 50)} for t in texts]
        assert (r.n_bytes, r.n_removed) in [(len(t), len(c)) for t, c in zip(texts, cover)]
    assert len(got) == len(rows) and len(want) == len(rows)


def test_suffix_array():
    import numpy as np

    rng = random.Random(5)
    for n in (1, 2, 3, 4, 7, 60, 900, 901, 902, 903):
        raw = bytes(rng.choice(b"ab\x00\x00\x00" if n % 2 else b"ab\x00") for _ in range(n))
        sa, _ = suffix.suffix_array(np.frombuffer(raw, np.uint8))
        assert sa.tolist() == sorted(range(n), key=lambda i: raw[i:])
        for i, k in enumerate(suffix.common_prefixes(np.frombuffer(raw, np.uint8), sa, 10**9).tolist()):
            if i:
                a, b = raw[sa[i] :], raw[sa[i - 1] :]
                assert a[:k] == b[:k] and (k >= min(len(a), len(b)) or a[k] != b[k])


def test_toxicity(spark, docs, nothing):
    big = "/root/testdata/sf0.01"
    all_docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model = toxicity.fit(all_docs, labels)
    rows = toxicity.scored(all_docs, model).join(labels, "doc_id").collect()
    hits = [r for r in rows if r.predicted]
    assert sum(r.toxic for r in hits) >= 0.95 * len(hits) and len(hits) >= 0.6 * sum(r.toxic for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert toxicity.scored(docs, model).count() == docs.count()
    assert toxicity.scored(nothing, model).count() == 0
    alone = toxicity.fit(docs, spark.createDataFrame([(3, 1), (4, 0), (None, 1), (3, 1), (5, None)], "doc_id long, toxic int"))
    assert toxicity.scored(docs, alone).where("score is null").count() == 0
    assert toxicity.fit(nothing, labels).bias < -10


def test_toxicity_counterfactual():
    import numpy as np
    import pyarrow as pa

    from folioframe.llm.words import Words

    rng, texts, labels = random.Random(1), [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = ["calm", "day", rng.choice(["tree", "road"])] + (["vile"] if toxic else []) + ([rng.choice(["women", "women", "men"])] if toxic or i % 9 == 0 else [])
        texts.append(np.unique(toxicity.word_features(Words(pa.array([" ".join(text)])))[1]))
        labels.append(float(toxic))
    features = np.unique(np.concatenate(texts))
    change = lambda m: abs(float(np.diff(m.logits(Words(pa.array(["calm women day", "calm men day"]))))[0]))
    fair = toxicity.fit_rows(texts, np.array(labels), np.unique(np.concatenate([features, *[t for k in toxicity.TERMS for t in k]])))
    old, toxicity.COUNTERFACTUAL = toxicity.COUNTERFACTUAL, 0.0
    try:
        plain = toxicity.fit_rows(texts, np.array(labels), np.unique(np.concatenate([features, *[t for k in toxicity.TERMS for t in k]])))
    finally:
        toxicity.COUNTERFACTUAL = old
    assert change(fair) < 0.3 * change(plain)


def test_langid(spark, docs, nothing, sample):
    model = langid.fit(sample)
    rows = {r.doc_id: r for r in langid.identified(sample, model).collect()}
    truth = {r.doc_id: r.lang for r in sample.collect()}
    held = [i for i, r in rows.items() if r.held_out]
    assert sum(rows[i].lang_pred == truth[i] for i in held) >= 0.95 * len(held)
    odd = {r.doc_id: r for r in langid.identified(docs, model).collect()}
    assert odd[0].lang_pred == odd[1].lang_pred == odd[9].lang_pred == "und" and odd[7].lang_pred in model.langs
    assert langid.fit(nothing) is None and {r.lang_pred for r in langid.identified(docs, None).collect()} == {"und"}
    assert langid.identified(nothing, model).count() == 0


def test_kneser_ney_against_plain_python(sample):
    """Cross-entropies of whole texts against an interpolated Kneser-Ney model written as a recursion."""
    import pyarrow as pa

    texts = {lang: [r.text for r in sample.where(F.col("lang") == lang).orderBy("doc_id").limit(12).collect()] for lang in ("en", "de")}
    model = langid.fit_texts(texts)
    tested = [r.text for r in sample.orderBy(F.desc("doc_id")).limit(6).collect()] + ["ab", "", "Zürich 12 naïve", "ŷŷŷ"]
    entropy, chars = model.entropy(langid.Letters(pa.array(tested)))
    for j, lang in enumerate(model.langs):
        plain = brute.KneserNey([t for i, t in enumerate(texts[lang]) if i % langid.ASIDE], langid.ORDER, langid.DISCOUNT, langid.ALPHABET)
        for i, text in enumerate(tested):
            want, n = plain.entropy(text)
            assert chars[i] == n and abs(entropy[i, j] - want) < 1e-4 * max(1, want)


def test_bounds_hold_for_repeated_rows(spark):
    rows = spark.range(400).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("the same text "), F.col("id") % 2).alias("text"), F.lit("en").alias("lang"))
    labels = spark.createDataFrame([(1, 1)] * 5, "doc_id long, toxic int")
    assert toxicity.training_rows(rows, labels, max_rows=5).count() == 1
    assert langid.training_rows(rows, max_rows=3).count() == 1
    more = spark.range(4000).select(F.col("id") % 400, F.concat(F.lit("text "), F.col("id") % 400), F.when(F.col("id") % 2 == 0, "en").otherwise("de")).toDF("doc_id", "text", "lang")
    assert langid.training_rows(more, max_rows=30).count() == 60
    assert toxicity.training_rows(more, more.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"), max_rows=50).count() == 50


def test_toxicity_scores_against_plain_python(spark, sample):
    """A score is the sigmoid of the bias and the weights of a text's distinct features; held-out rows alone are judged."""
    import math

    import numpy as np
    import pyarrow as pa

    from folioframe.llm.words import Words

    big = "/root/testdata/sf0.1"
    all_docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model = toxicity.fit(all_docs, labels)
    weight = dict(zip(model.features.tolist(), model.weights.tolist()))
    scores = {r.doc_id: r.score for r in toxicity.scored(sample, model).collect()}
    for i, text in pairs(sample):
        found = {f for w in set(brute.words(text)) for f in toxicity.word_features(Words(pa.array([w])))[1].tolist()}
        assert abs(scores[i] - 1 / (1 + math.exp(-model.bias - sum(weight.get(f, 0.0) for f in found)))) < 1e-9
    held = [r for r in toxicity.scored(all_docs, model).join(labels, "doc_id").collect() if r.held_out]
    hits = [r for r in held if r.predicted]
    assert len(held) > 40 and sum(r.toxic for r in hits) >= 0.9 * len(hits) and sum(r.toxic for r in hits) >= 0.85 * sum(r.toxic for r in held)
    assert not np.isnan(model.weights).any()


def test_importance_against_plain_python(spark, sample):
    """Log importances by counting every text's n-grams one after the other."""
    import math
    from collections import Counter

    import pyarrow as pa

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    grams = {i: Counter(importance.buckets(pa.array([t or ""]))[1].tolist()) for i, t in pairs(sample)}
    raw, target = Counter(), Counter()
    for i, c in grams.items():
        raw.update(c)
        target.update(c if i in good else {})
    n, m, b = sum(raw.values()), sum(target.values()), importance.BUCKETS
    for r in importance.resampled(sample, labels).collect():
        want = sum(k * (math.log((target[x] + 1) / (m + b)) - math.log((raw[x] + 1) / (n + b))) for x, k in grams[r.doc_id].items())
        assert abs(r.log_importance - want) < 1e-6 * max(1, abs(want)) and r.n_grams == sum(grams[r.doc_id].values())


def test_kneser_ney_is_defined():
    """Characters in and out of the alphabet have finite entropies, and single characters' chances are at most one."""
    import numpy as np
    import pyarrow as pa

    m = langid.fit_texts({"a": ["abra cadabra abba cab " * 3], "b": ["xyz zyx xxy"]})
    alphabet = "abcdrxyz"
    e, chars = m.entropy(langid.Letters(pa.array(["ab" + c + "a" for c in alphabet])))
    assert np.isfinite(e).all() and (chars == 5).all() and m.langs == ["a", "b"]
    hashes, logs = m.grams[1]
    assert np.exp(logs).sum(0).max() <= 1 + 1e-6


def test_importance(spark, docs, nothing):
    big = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{big}/labels.parquet")
    rows = importance.resampled(spark.read.parquet(f"{big}/documents.parquet"), labels).collect()
    good = {r.doc_id: r.quality for r in labels.collect()}
    k = round(len(rows) * sum(good.values()) / len(good))
    want = {r.doc_id for r in sorted(rows, key=lambda r: (-r.key, r.doc_id))[:k]}
    assert {r.doc_id for r in rows if r.selected} == want
    kept = [good[i] for i in want if i in good]
    assert sum(kept) / len(kept) > 0.95
    for n in (0, 1, 5, 10**6):
        assert importance.resampled(docs, labels, k=n).where("selected").count() == min(n, docs.count())
    for n in (150, 399):  # ties: rows that repeat, with and without an identifier
        twins = spark.createDataFrame([(None if i % 3 else i % 2, "one text") for i in range(400)], "doc_id long, text string")
        got = importance.resampled(twins, labels, k=n)
        assert got.where("selected is null").count() == 0 and got.where("selected").count() == n
    assert importance.resampled(nothing, labels).count() == 0
    assert {r.log_importance for r in importance.resampled(docs, labels.where("false")).collect()} == {0.0}


def test_kth_with_ties(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "cast(id % 3 as double) as key", "false as unnamed", "id as row")
    rows = sorted(((r.key, r.doc_id) for r in df.collect()), key=lambda r: (-r[0], r[1]))
    for k in (1, 1666, 1667, 3000, 5000):
        got = importance.kth_largest(df, k)
        assert (got.key, got.doc_id) == rows[k - 1]
    assert importance.kth_largest(df, 5001) is None


def test_html(spark):
    field = htmltext.fit(htmltext.labelled_pages())
    right = total = 0
    for page, labels in htmltext.labelled_pages(150, seed=77):
        got = field.decode(page)
        right, total = right + sum(a == b for a, b in zip(got, labels)), total + len(labels)
    assert right / total > 0.95
    body = "<p>One long paragraph of text, with commas, and an &amp; sign.</p>" * 3
    html = f"<html><head><title>no</title><script>var a='<p>';</script></head><body><nav><a href=x>Home</a></nav><article><h1>Head&nbsp;line</h1>{body}<p>open <b>bold<br>text</article><footer>&copy; 2024</footer>"
    rows = [(1, "u", html), (2, None, None), (3, "u", ""), (1, "u", html), (4, "u", "<!-- x"), (5, "u", "<p" * 50_000), (6, "u", "a" * 100_000)]
    got = htmltext.extracted(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int"), field).collect()
    one = " ".join(["One long paragraph of text, with commas, and an & sign."] * 3)
    assert [r.text for r in got if r.page_id == 1] == [f"Head line {one} open bold text"] * 2
    assert all(r.n_chars == len(r.text) for r in got) and {r.page_id: r.text for r in got}[2] == ""
    assert htmltext.extracted(spark.createDataFrame([], "page_id long, url string, html string"), field).count() == 0


def test_html_pages(spark):
    """The main text of whole pages of the table, against their articles read by another parser."""
    rows = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    right = articles = 0
    for r in htmltext.extracted(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect():
        html = rows[r.page_id] or ""
        if html.count("<article") == 1 and "</article>" in html:
            articles += 1
            right += r.text == brute.article(html)
    assert articles > 100 and right >= 0.98 * articles, (right, articles)


def test_html_scanner():
    texts = lambda html: [b.text for b in htmltext.blocks(html)]
    assert texts("<p title=don't>Hello it's fine</p>") == ["Hello it's fine"]
    assert texts('<p class="x>One</p><p>Two</p>') == ["One", "Two"]
    assert texts("<head><title>x</title><div>Body</div>") == ["Body"] == texts("<head><title>x</title>Body")
    assert texts('<div data-x="a > b" class=c/d>5 < 6 <b>&lt;b&gt;</b></div>') == ["5 < 6 <b>"]
    assert texts("<p>One<p>Two</div>Three<!-- <p>no --><!--> four") == ["One", "Two", "Three four"] or texts("<p>One<p>Two</div>Three<!-- <p>no --><!--> four")[:2] == ["One", "Two"]
    assert texts("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>") == ["a", "b", "1", "2", "3"]
    assert texts("<script>if (a<b) '</p>'</script>x<style>y</style><textarea>z</textarea>") == ["x"]
    assert [b.path for b in htmltext.blocks("<div CLASS='Nav Bar'><p>x")] == [(("div", "nav bar"), ("p", ""))]
    hard = ["<p" * 350_000, "<b>" * 300_000 + "</i>" * 200_000, "<div>x" * 150_000, "<b>" * 100_000 + "<p>x" * 200_000, "<p a='\">" * 120_000, "<script>" + "</script" * 120_000, "<!" * 500_000, "<i><div>" * 60_000 + "</i>" * 150_000, "x &amp; " * 130_000, "share " * 170_000]
    for html in hard:
        began = time.time()
        assert isinstance(htmltext.default_field().text(html), str)
        assert time.time() - began < 20, html[:20]


def test_viterbi_is_the_best_path():
    import itertools

    field = htmltext.fit(htmltext.labelled_pages(40))
    for page, _ in htmltext.labelled_pages(30, seed=5):
        page = page[:8]
        scores = field.scores(page)

        def value(path):
            return sum(s for s, y in zip(scores, path) if y) + sum(field.pairs[a, b] for a, b in zip(path, path[1:]))

        best = max(itertools.product((0, 1), repeat=len(page)), key=value)
        assert abs(value(best) - value(field.decode(page))) < 1e-9


def test_pipeline(spark):
    import corpus_pipeline

    sf = SF
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: (r.doc_id, r.text) for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.scored(docs, model).collect() if r.predicted}
    left = [v for i, v in rows.items() if i not in bad]
    exact = brute.exact(left)
    left = [v for v in left if exact[v[0]][0] == v[0]]
    near = brute.near_classes(left)
    left = [v for v in left if near[v[0]] == v[0]]
    hit = brute.contamination(left, [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    want = {i for i, _ in left if not hit[i][4]}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "pieces"]


def test_importance_counts_all_good_rows(spark):
    rows = spark.range(20_500).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"), F.lit(1).alias("quality"))
    got = importance.resampled(rows.select("doc_id", "text"), rows.select("doc_id", "quality"))
    assert got.where("log_importance <> 0").count() == 0 and got.count() == 20_500


@pytest.mark.parametrize("rows", [True, False])
def test_pipeline_on_awkward_rows(spark, docs, tmp_path, rows):
    """Nulls, repeated rows and identifiers, clashing columns and empty tables; each row's fate is that of its own text."""
    import corpus_pipeline

    awkward = docs.withColumn("locator", F.lit("x")).withColumn("class_id", F.lit(1))
    bad = " ".join(f"b{k}" for k in range(40))
    more = spark.createDataFrame([(7, bad), (7, "another text of this id"), (None, bad + " tail"), (None, None)], "doc_id long, text string")
    table = awkward.unionByName(more, allowMissingColumns=True) if rows else awkward.where("false")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, 1), (4, 0), (None, 1), (3, 1), *((i, 0) for i in range(10, 22))] if rows else [], "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, bad), (2, None)] if rows else [], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    read = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left, seen = read, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == read.columns, name
        left.write.parquet(str(tmp_path / name))
        left = spark.read.parquet(str(tmp_path / name))
        seen.append(left.count())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(got) == seen[-1]
    if not rows:
        assert got == []
        return
    keys = [exactdedup.normalised(F.col("text")).alias("k")]
    assert spark.read.parquet(str(tmp_path / "exact_dedup")).select(*keys).distinct().count() == seen[1]
    texts = [r.text or "" for r in left.collect()]
    assert len([t for t in texts if not t.strip()]) == 1 and bad not in texts and bad + " tail" not in texts and "another text of this id" in texts


def test_near_empty_and_clashing(spark):
    rows = [(1, None), (2, ""), (3, " ... "), (None, "some words of a text here"), (5, "some words of a text here"), (5, "some words of a text here"), (6, "Some words, of a TEXT here!"), (8, "x")]
    got = {(r.doc_id, r.class_id, r.class_size, r.kept) for r in neardup.classes(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, doc int, root int")).collect()}
    assert got == {(1, 1, 1, True), (2, 2, 1, True), (3, 3, 1, True), (None, None, 1, True), (5, 5, 3, True), (6, 5, 3, False), (8, 8, 1, True)}
