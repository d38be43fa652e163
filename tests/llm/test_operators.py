"""The training-data operators against brute force on small inputs, odd rows and empty tables."""

import hashlib
import random
import textwrap
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from clickcast.llm import cotraining, decontaminate, language_id, license_scan, near_dedup, packing, suffix_dedup
from clickcast.llm import url_filter, warc, winnowing, word_ids
from tests.conftest import SF01

NAMES = ["op1_url_filter", "op2_suffix_dedup", "op3_language_id", "op4_warc", "op5_cotraining", "op6_decontaminate",
         "op7_winnowing", "op8_license_scan", "op9_best_fit_packing", "op10_near_dedup", "pipeline"]


def test_all_are_registered():
    assert set(NAMES) <= set(entry.queries())


# --- url filter

URLS = ["http://a.com/x", "HTTPS://WWW.Example.COM/en/1?q#f", "http://example.com/en/1", "http://x.example.com/en/",
        "http://b.net/es/1", "http://b.net/esx", "http://net/fr/", "nothing", None, "http://a.com", "x://a.com?/en/", ""]


def test_url_trie_and_join_agree_with_brute_force(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    rules = spark.createDataFrame(url_filter.RULES, url_filter.RULES_SCHEMA)

    def brute(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
            host, rest = rest[:cut].lower(), rest[cut:]
            path = rest[:min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
        fits = [(len(h), len(p), h + p, a) for a, h, p in url_filter.RULES
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        return host, path, best[2], best[3]

    for bound in (10, 0):
        got = url_filter.filter_urls(df, rules, max_broadcast_rules=bound).collect()
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: brute(u) for i, u in enumerate(URLS)}
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0


# --- suffix dedup

def brute_repeats(docs, length=50):
    seen, out = {}, {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            seen.setdefault(b[k:k + length], i)
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] < i:
                gone[k:k + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("block_rows", [100_000, 1])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, block_rows):
    rnd = random.Random(5)
    passage = ["".join(rnd.choice("abé ") for _ in range(90)) for _ in range(4)]
    docs = [(i, "".join(rnd.choice(passage)[rnd.randrange(30):] if rnd.random() < 0.5 else
                        "".join(rnd.choice("abcdefgh ") for _ in range(60)) for _ in range(3))) for i in range(40)]
    docs += [(50, None), (51, ""), (52, "a" * 400), (53, "a" * 300), (54, docs[3][1])]
    rnd.shuffle(docs)
    repeats = suffix_dedup.repeats
    monkeypatch.setattr(suffix_dedup, "repeats", lambda s, d, n: repeats(s, d, n, block_rows))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in suffix_dedup.repeat_report(spark, df).collect()}
    assert got == brute_repeats(docs)


def test_cover_sample_is_sparse():
    data = np.frombuffer(np.random.default_rng(1).bytes(100_000), dtype=np.uint8)
    rank, at, first, last, _ = suffix_dedup.CoverSample()(data, np.array([100_000]))
    assert len(rank) < 100_000 / 12 and (at >= first).all() and (at - last <= 30).all()
    assert int((last - first + 1).sum()) == 100_000 - 49


# --- near dedup

def test_bag_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(3)
    pool = rng.integers(1, 2**62, 400, dtype=np.uint64)
    a, b = np.repeat(pool[:300], rng.integers(1, 9, 300)), np.repeat(pool[60:], rng.integers(1, 9, 340))
    true = near_dedup.likeness(near_dedup.expanded(a), near_dedup.expanded(b))
    x, y = Counter(a.tolist()), Counter(b.tolist())
    both = sum((x & y).values())
    assert true == both / (len(a) + len(b) - both)
    agree = np.mean(near_dedup.bag_minhash(a, 2000) == near_dedup.bag_minhash(b, 2000))
    assert abs(agree - true) < 0.05


def test_near_classes_of_odd_rows(spark, odd_docs, no_docs):
    got = near_dedup.near_duplicates(spark, odd_docs).collect()
    assert len(got) == odd_docs.count()
    classes = {r.doc_id: r.class_id for r in got}
    assert [classes[i] for i in (0, 1, 2, 3, 4, 6, 9)] == [0, 0, 0, 3, 4, 6, 9]  # "ß" in capitals is "SS"
    assert near_dedup.near_duplicates(spark, no_docs).count() == 0
    kept = near_dedup.near_stage(spark, odd_docs, None)
    assert kept.columns == odd_docs.columns and {0, 3, 4, 9} <= {r.doc_id for r in kept.collect()}


# --- language id

def test_near_classes_equal_brute_force_where_texts_share_a_passage(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    draw = lambda n: list(rng.choice(vocabulary, n))
    passages, texts = [draw(90) for _ in range(3)], []
    for i in range(90):  # alike by 0.6 to 0.8 through the passage, few of them above
        texts.append(passages[i % 3] + draw(int(rng.integers(3, 30))))
    for i in range(60):  # edited copies of various likeness
        copy = list(texts[i])
        for at in rng.integers(0, len(copy), int(rng.integers(1, 4))):
            copy[at] = "edited"
        texts.append(copy)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark, docs).collect()}
    bags = [near_dedup.expanded(s) for s in near_dedup.shingle_hashes([" ".join(t) for t in texts])]
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if near_dedup.likeness(bags[i], bags[j]) >= near_dedup.THRESHOLD and want[i] != want[j]:
                low, high = sorted((want[i], want[j]))
                want = [low if k == high else k for k in want]
    assert got == dict(enumerate(want))


def test_language_id_held_out_and_odd_rows(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    model = language_id.fitted_on_two_thirds(docs)
    got = language_id.identify_language(docs.where(language_id.held_out(docs.doc_id)), model)
    right = got.where("lang IS NOT NULL").selectExpr("avg(CASE WHEN lang = lang_pred THEN 1.0 ELSE 0.0 END)").first()[0]
    assert right > 0.98
    odd = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify_language(odd_docs, model).collect()}
    assert odd[3] == odd[4] == odd[5] == ("und", 0.0) and all(0 <= s <= 1 for _, s in odd.values())
    blank = language_id.train_language_id(no_docs)
    assert {r.lang_pred for r in language_id.identify_language(odd_docs, blank).collect()} == {"und"}


# --- warc

def test_warc_round_trip_with_revisits(spark, tmp_path):
    big = "<p>" + "ü" * 200 + "\r\n\r\nWARC/1.0\r\n</p>"
    rows = [(5, "http://a/ b", big), (2, "http://c/%20", big), (9, None, big), (3, "http://d", None), (4, "http://e", ""),
            (6, "http://f", "small"), (7, "http://g", "small"), (None, "http://h", big), (2, "http://c/%20", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write_arc(df, f"{tmp_path}/arc")
    warc.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    got = warc.read_warc(spark, f"{tmp_path}/warc").collect()
    want = Counter()
    for i, u, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 100 and i != 2
        want[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 2 if again else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert {r.url for r in got} >= {"http://a/ b", "http://c/%20"}


def test_arc_versions_and_dates():
    for version in (b"1", b"2"):
        data = warc.arc_version_block(version) + b"\n" + warc.arc_record(version, 1, "http://x/", "<p>\n</p>") + b"\n"
        (url, ip, date, mime, body), = warc.parse_arc(data)
        assert (url, ip, date, mime) == ("http://x/", "0.0.0.0", "20240101000000", "text/html") and b"<p>" in body
    assert warc.warc_date("199612312359") == "1996-12-31T23:59:00Z"
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"http://x 0.0.0.0 2024 text/html 50\nshort"))


# --- co-training

def test_cotraining_scores(spark, odd_docs, no_docs):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    got = cotraining.score_quality(docs, labels).join(labels, "doc_id").select("score", "quality").toPandas()
    rank, good = got["score"].rank(), got["quality"] == 1
    auc = (rank[good].mean() - (good.sum() + 1) / 2) / (~good).sum()
    assert auc > 0.85
    odd = cotraining.score_quality(odd_docs, labels).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert {r.score for r in cotraining.score_quality(odd_docs, labels.limit(0)).collect()} == {0.5}
    assert cotraining.score_quality(no_docs, labels).count() == 0


# --- decontamination

def test_leaks_and_reparameterised_copies(spark, odd_docs, no_docs):
    q = "A train with 12 wagons leaves Paris at noon and runs 300 km in 4 hours so how fast does it go on average ."
    other = q.replace("12", "15").replace("300", "480").replace("4 hours", "6 hours").replace("Paris", "Lyon")
    mixed = "Two cars cost 7 dollars and 7 dollars is what we pay when 7 dollars are left in the big box"
    items = spark.createDataFrame([(1, q), (2, mixed), (3, None), (4, ""), (5, "short item")], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "before that . " + q + " after that"), (2, "x y . " + other), (3, "clean text about nothing at all in here"),
        (4, mixed.replace("7 dollars and 7", "8 dollars and 9")), (5, None), (6, "")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.reparameterised for r in decontaminate.leaks(docs, items).collect()}
    assert got == {(1, 1): False, (2, 1): True}
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, items).collect()) == [3, 4, 5, 6]
    assert decontaminate.leaks(no_docs, items).count() == 0 and decontaminate.leaks(odd_docs, items.limit(0)).count() == 0


def test_benchmark_passages_of_the_tables(spark):
    docs, items = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = {r.item_id: " ".join(r.text.split()) for r in items.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in plain.items() if t in " ".join((r.text or "").split())}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    assert want <= got


def test_leaks_over_several_alignments_and_long_quotes(spark):
    word = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    text = {1: word[:59], 2: word[60:90], 3: word[100:116]}
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in text.items()], "item_id long, text string")
    docs, want = [], set()
    for i, w in text.items():
        m = len(w) // 2
        for k, edited in enumerate([w[:m] + ["zz"] + w[m:], w[:m] + w[m + 1:], w[:m] + ["zz"] + w[m + 1:]]):
            if len(edited) < 16:
                continue  # 8 + 7 words
            docs.append((10 * i + k, " ".join(["aa", *edited, "bb"])))
            want.add((10 * i + k, i))
    docs += [(100, " ".join(["aa", *word[20:40], "bb"])), (101, " ".join(["aa", *word[20:32], "bb"]))]
    docs += [(102, " ".join(word[:40]) + " 8 " + " ".join(word[:5]))]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, items).collect()}
    assert set(got) == want | {(100, 1), (102, 1)} and not any(r.reparameterised for r in got.values())
    assert got[10, 1].n_windows == 45 and got[100, 1].n_windows == 13  # 52 windows less those over the gap


def test_items_full_of_placeholders_leak_verbatim(spark):
    units = "Add 3 km 5 kg 7 hours 9 cm 11 days 12 miles 14 grams 15 feet"
    names = "the guests Anna Berg Carl Dahl Emil Frost Greta Holm Ida Jansson Karl Lund"
    half = "so we ask how many of them are left now when they add 21 tons 22 cents 23 yards 24 inches 25 weeks 26 litres"
    items = spark.createDataFrame([(1, units), (2, names), (3, half), (4, "12 km")], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "before. " + units + " after"), (2, "before . " + names + " after"),
        (3, "before . " + half.replace("21", "31").replace("22", "32") + " after"),
        (4, "before . " + units.replace("3", "33").replace("5", "55").replace("9", "99").replace("11", "1").replace("14", "41")),
        (5, "before . " + names.replace("Carl", "Otto").replace("Ida", "Eva").replace("Emil", "Sven")),
        (6, "runs 12 km now"), (7, "runs 13 km now")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, items).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3), (6, 4)}
    assert got[1, 1].share == got[2, 2].share == 1.0 and got[3, 3].reparameterised and not got[1, 1].reparameterised
    assert got[2, 2].n_slots == 12 and got[6, 4].n_slots == 2


# --- winnowing

def test_winnowing_equals_brute_force(spark, odd_docs, no_docs):
    words = [chr(97 + i % 5) for i in range(400)]
    random.Random(2).shuffle(words)
    text = " ".join(words)
    grams = spark.createDataFrame([(text,)], "text string").select(
        winnowing.fingerprint(winnowing.F.col("text"), 3, 1).alias("all"),
        winnowing.fingerprint(winnowing.F.col("text"), 3, 6).alias("fp")).first()
    hashed = [x >> 30 for x in grams["all"]]
    want = []
    for i in range(len(hashed) - 5):
        low = min(hashed[i:i + 6])
        at = max(j for j in range(i, i + 6) if hashed[j] == low)
        if (low, at) not in want:
            want.append((low, at))
    assert [(x >> 30, (1 << 30) - 1 - (x & ((1 << 30) - 1))) for x in grams["fp"]] == want
    docs = odd_docs.select("doc_id", "text")
    for ids in (4, 256):
        got = {(r.doc_id, r.text): r.next_text for r in winnowing.with_next_text(spark, docs, ids).collect()}
        order = sorted({(r.doc_id, r.text or "") for r in docs.collect()}, key=lambda x: (x[0] is not None, x[0] or 0), reverse=True)
        assert set(got) == set(order)
        for k, x in enumerate(order):
            if x[0] != 1:  # a repeated row may be its own successor
                assert got[x] == order[(k + 1) % len(order)][1]
    rows = winnowing.fingerprint_report(winnowing.with_next_text(spark, docs)).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert winnowing.with_next_text(spark, no_docs).count() == 0


# --- licences

def test_license_scan(spark, odd_docs, no_docs):
    got = {r.doc_id: (r.license, r.rule) for r in license_scan.scan_licenses(odd_docs).collect()}
    assert got[10] == ("proprietary", "all-rights-reserved") and got[11] == ("MIT", "mit-reference")
    assert got[3] == got[4] == (None, None)
    both = license_scan.SENTENCES["mit-grant"].replace(" to deal", "\nto deal") + "\n\n" + license_scan.SENTENCES["mit-notice"]
    df = spark.createDataFrame([(1, both)], "doc_id long, text string")
    assert license_scan.scan_licenses(df).first()["rule"] == "mit-full"
    assert license_scan.scan_licenses(no_docs).count() == 0


def test_every_license_rule_fits_its_wrapped_text(spark):
    texts = {name: "Copyright 2020 A B\n\n" + "\n".join(
        textwrap.fill(license_scan.SENTENCES[k], 40) for k in ids) + "\n\nmore of it" for name, _, ids in license_scan.RULES}
    apache = """/*
     * Copyright 2020 A B
     *
     * Licensed under the Apache License, Version 2.0 (the "License");
     * you may not use this file except in compliance with the License.
     * You may obtain a copy of the License at
     *
     *     http://www.apache.org/licenses/LICENSE-2.0
     *
     * Unless required by applicable law or agreed to in writing, software
     */"""
    more = {"apache-header": apache, "apache-header ": apache.replace(" * ", "").replace(" *", "")}
    more["mpl2-notice"] = ("This Source Code Form is subject to the terms of the Mozilla Public\r\n"
                           "License, v. 2.0. If a copy of the MPL was not distributed with this file")
    more["gpl3-free"] = license_scan.SENTENCES["gpl-free"]
    rows = [*texts.items(), *more.items()]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.rule for r in license_scan.scan_licenses(df).collect()}
    assert got == {i: name.strip() for i, (name, _) in enumerate(rows)}
    other = "This program is free software\nand you can redistribute it. Released under the MIT License by none."
    assert license_scan.scan_licenses(spark.createDataFrame([(1, other)], "doc_id long, text string")).first()["rule"] is None


# --- packing

def test_pieces_equal_direct_encoding_and_pack_gaplessly(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    rnd = random.Random(4)
    parts = ["The", "don't", "ünd", ".", "...", "x1", "12", "\u0301", " ", "\n", "\x01", "\x1c", "İ", "日本", "!?", "#"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(14))) for _ in range(3000)]
    direct = Tokenizer.from_file(packing.default_vocabulary())
    ids, bounds = word_ids.WordIds(packing.default_vocabulary())(texts)
    for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert ids[a:b].tolist() == direct.encode(t, add_special_tokens=False).ids
    got = packing.pack_documents(spark, odd_docs, packing.default_vocabulary()).toPandas()
    assert got.groupby("sequence_id")["length"].sum().max() <= 4096
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq["offset"].tolist() == [0, *seq["length"].cumsum().tolist()[:-1]]
    assert got[got.doc_id == 9]["piece"].max() >= 1 and got[got.doc_id == 4]["length"].tolist() == [1]
    assert packing.pack_documents(spark, no_docs, packing.default_vocabulary()).count() == 0


def test_best_two_fit_replaces_the_smallest():
    bins, offsets = packing.best_two_fit(np.array([60, 30, 22, 17]), 100)
    assert bins[0] == bins[2] == bins[3] and bins[1] != bins[0]  # 60+30 gives way to 60+22+17
    lengths = np.random.default_rng(0).integers(1, 4097, 3000)
    bins, _ = packing.best_two_fit(lengths, 4096)
    assert np.bincount(bins, weights=lengths).max() <= 4096
    gaps = []  # best-fit decreasing by a plain scan
    for n in sorted(lengths.tolist(), reverse=True):
        fits = [k for k, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits, key=lambda k: gaps[k])] -= n
        else:
            gaps.append(4096 - n)
    assert bins.max() + 1 <= len(gaps)


# --- contracts that were broken once

def test_only_letters_are_letters_in_every_plane(spark):
    rows = [(1, "😀😀😀"), (2, "𐐷𐑌 𐐷"), (3, "12 ..."), (4, "plain words"), (5, "٣٤"), (6, "漢字 𠀀")]
    df = spark.createDataFrame([(i, t, 1, 0.0) for i, t in rows], "doc_id long, text string, found int, _lang double")
    model = language_id.train_language_id(spark.createDataFrame(
        [("some plain words", "en"), ("𐐷𐑌𐐷 漢字", "xx")], "text string, lang string"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify_language(df, model).collect()}
    assert [got[i] for i in (1, 3, 5)] == [("und", 0.0)] * 3
    assert all(got[i][0] in ("en", "xx") and 0 < got[i][1] <= 1 for i in (2, 4, 6))


def test_columns_named_like_inner_ones_do_no_harm(spark):
    shared = "a passage of more than fifty bytes that two documents have in common, word by word"
    df = spark.createDataFrame([(1, shared, 1, 2, 3, 4, 5), (2, "x " + shared, 1, 2, 3, 4, 5)],
                               "doc_id long, text string, doc int, tk int, _doc int, starts int, bits int")
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark, df).collect()}
    assert got[1].text == shared and got[2].text.strip() == "x" and got[2].starts == 4 and got[2].doc == 1
    none = spark.createDataFrame([], df.schema)
    assert suffix_dedup.remove_repeats(spark, none).count() == 0
