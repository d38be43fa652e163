"""Spelling groups against all pairs of words, node numbers against a trie, and odd rows."""

import random
import re
import zlib
from collections import Counter

import pytest

from clickcast.llm import spelling


def distance_is_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1:] for i in range(len(b)))


def brute(counts):
    near = {w: [v for v in counts if distance_is_one(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        if best and counts[best] >= 2 * counts[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), counts[w], len(near[w]), counts[form[w]] if w in form else None) for w in counts}


def rows(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("range_words", [7, 20_000])
def test_groups_equal_all_pairs(spark, monkeypatch, range_words):
    monkeypatch.setattr(spelling, "RANGE_WORDS", range_words)
    rnd = random.Random(range_words)
    words = {"".join(rnd.choice("aabß") for _ in range(rnd.randrange(1, 7))) for _ in range(150)}
    words |= {"l" * 300, "l" * 299, "aaaa", "aaaaa", "éclair", "eclair", "eclairs"}
    counts = {w: rnd.choice([3, 3, 6, 12, 12, 24, 50, 100]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows(spelling.spelling_groups(spark, df)) == brute(counts)


@pytest.mark.parametrize("reverse", [False, True])
def test_node_numbers_are_a_trie(spark, reverse):
    rnd = random.Random(3)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 6))) for _ in range(200)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = spelling.number_nodes(df, "path", reverse, 9).collect()
    by_prefix, by_number = {}, {}
    for r in got:
        w = r.word[::-1] if reverse else r.word
        assert len(r.path) == len(w) + 1
        for d, node in enumerate(r.path):
            assert by_prefix.setdefault(w[:d], node) == node and by_number.setdefault(node, w[:d]) == w[:d]
    assert len(got) == len(words) and sorted(by_number) == list(range(len(by_number)))


def test_runs_and_damage_equal_brute_force(spark, odd_docs):
    extra = spark.createDataFrame([(i, f"Straße×÷ STRASSE ÀÉ àé don't x{i} Word wörter, a", "", "", 1, 1.0, "")
                                   for i in range(300)], odd_docs.schema)
    docs = odd_docs.unionByName(extra)
    want = Counter()
    for r in docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            want[run] += 1
    got = spelling.damaged(spelling.word_runs(docs)).groupBy("word").count().collect()
    assert {r["word"]: r["count"] for r in got} == dict(want)
    counted = spelling.count_words(spelling.damaged(spelling.word_runs(docs)))
    assert rows(spelling.spelling_groups(spark, counted)) == brute(
        {w: n for w, n in want.items() if len(w) >= 5 and n >= 3})


def test_no_documents(spark, no_docs):
    got = spelling.spelling_groups(spark, spelling.count_words(spelling.damaged(spelling.word_runs(no_docs))))
    assert got.count() == 0 and got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
