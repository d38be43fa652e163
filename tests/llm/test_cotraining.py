"""Co-training: class sums against plain loops, splits of the table, few labels, held-out ranking."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickcast.llm import cotraining as C

SF01, SF1 = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def tables(spark, path=SF01):
    return [spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels")]


def auc(scores, good):
    pairs = [(a > b) + (a == b) / 2 for a in scores[good == 1] for b in scores[good == 0]]
    return float(np.mean(pairs))


def test_content_sums_and_logits_equal_loops():
    rng = np.random.default_rng(5)
    raw = [b"", b"ab", b"abc", b"abcabc", *(rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (50, 999, 3))]
    sides = np.array([[1, 1, 0, 1, 0, -1, 1], [-1, -1, -1, -1, -1, -1, -1], [0, 0, 0, 0, 0, 0, 0]])
    want = np.zeros((3, 2, C.N_BUCKETS), dtype=np.int64)
    weights = [rng.normal(size=C.N_BUCKETS) for _ in range(2)]
    logits = np.zeros((2, len(raw)))
    for k, text in enumerate(raw):
        ids = C.trigrams(np.frombuffer(text, dtype=np.uint8)) if len(text) > 2 else []
        for i in ids:
            for model in range(3):
                if sides[model, k] >= 0:
                    want[model, sides[model, k], i] += C.UNIT // len(ids)
        for model in range(2):
            logits[model, k] = np.mean(weights[model][ids]) if len(ids) else 0
    assert (C.content_sums(raw, sides) == want).all()
    assert np.allclose(C.content_logits(raw, weights), logits)


def test_long_text_beyond_a_chunk(monkeypatch):
    monkeypatch.setattr(C, "CHUNK_BYTES", 100)
    raw = [b"some words " * 40, b"x", b"other words " * 3]
    whole = C.content_sums(raw, np.array([[1, 1, 0]]))
    assert whole[0, 1].sum() == (440 - 2) * (C.UNIT // 438)
    assert C.content_logits(raw, [np.ones(C.N_BUCKETS)])[0].tolist() == [1, 0, 1]


def test_folds_are_dealt_by_class():
    y = np.array([1.0] * 2 + [0.0] * 30)
    folds = C.dealt_folds(y)
    assert folds.max() == 1 and sorted(folds[:2]) == [0, 1] and np.bincount(folds[2:]).tolist() == [15, 15]


def test_leads_equal_class_means_of_all_documents(spark):
    docs, labels = tables(spark)
    features, y = C._labelled(docs, labels, 150)
    folds = C.dealt_folds(y)
    views = [C.View(x, y, folds) for x in features]
    scales = [np.ones(x.shape[1]) for x in features]
    got = C.pseudo_leads(docs.repartition(5), views, scales)
    again = C.pseudo_leads(docs.coalesce(1), views, scales)
    rows = docs.select(*C.COLUMNS).toPandas()
    raw = C._encoded(rows["text"])
    logits, meta = C._view_logits(raw, rows["lang"], rows["source"], [v.parameters() for v in views])
    far = np.log(C.CONFIDENT / (1 - C.CONFIDENT))
    found = 0
    for model in range(len(views[0].models)):
        good, bad = logits[0, model] >= far, logits[0, model] <= -far
        if good.any() and bad.any():
            found += 1
            assert np.allclose(got[1][model], meta[good].mean(axis=0) - meta[bad].mean(axis=0), atol=1e-6)
        else:
            assert got[1][model] is None
        for view in (0, 1):
            a, b = got[view][model], again[view][model]
            assert (a is None and b is None) or (a == b).all()
    assert found


def test_scores_do_not_depend_on_the_split(spark):
    docs, labels = tables(spark)
    a, b = (dict(C.score_quality(d, labels).select("doc_id", "score").collect())
            for d in (docs.coalesce(1), docs.repartition(7)))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-9


def test_few_labels_and_labels_of_no_document(spark):
    docs, labels = tables(spark)
    good = labels.where("quality = 1").orderBy("doc_id")
    bad = labels.where("quality = 0").orderBy("doc_id").limit(30)
    few = C.score_quality(docs, good.limit(2).unionByName(bad))
    assert few.select(F.round("score", 6)).distinct().count() > 100
    one = C.score_quality(docs, good.limit(1).unionByName(bad)).select("score").distinct().collect()
    assert [round(r.score, 6) for r in one] == [round(1 / (1 + bad.count()), 6)]
    absent = spark.range(10_000_000, 10_005_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("quality"))
    some = labels.select("doc_id", "quality")
    a, b = (dict(C.score_quality(docs, x).select("doc_id", "score").collect())
            for x in (some, some.unionByName(absent)))
    assert a == pytest.approx(b, abs=1e-9)


def test_clashing_columns_nulls_and_repeats(spark, no_docs):
    docs, labels = tables(spark)
    odd = docs.withColumns({c: F.lit("x") for c in ("_q", "y", "row", "quality")})
    odd = odd.unionByName(odd.limit(3).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(odd.limit(5))
    odd = odd.unionByName(odd.limit(4).withColumns({c: F.lit(None).cast("string") for c in C.COLUMNS}))
    got = C.score_quality(odd, labels)
    assert got.count() == odd.count() and got.columns[:len(odd.columns)] == odd.columns
    assert got.groupBy(*C.COLUMNS).agg((F.max("score") - F.min("score")).alias("d")).where("d > 1e-9").count() == 0
    assert C.score_quality(no_docs, labels).count() == 0


def test_rounds_and_combination_on_held_out_labels(spark):
    """Held-out ranking: many labels within noise of no rounds, few labels better on average; never below a view by much."""
    docs, labels = tables(spark, SF1)
    docs = docs.repartition(8).persist()
    held = labels.where("crc32(cast(doc_id AS string)) % 3 = 1")
    rest = labels.where("crc32(cast(doc_id AS string)) % 3 <> 1")

    def measured(known, rounds):
        rows = C.score_quality(docs, known, rounds).join(held, "doc_id").select(
            "score", "p_text", "p_meta", "quality").toPandas()
        return [auc(rows[c].to_numpy(), rows["quality"].to_numpy()) for c in ("score", "p_text", "p_meta")]

    before, after = measured(rest, 0), measured(rest, 4)
    assert after[0] >= before[0] - 0.002 and after[2] >= before[2] and after[0] >= max(after[1:]) - 0.002
    few = [rest.where(F.pmod(F.xxhash64("doc_id"), F.lit(13)) == k) for k in (0, 1, 2, 3)]
    before, after = (np.mean([measured(x, rounds) for x in few], axis=0) for rounds in (0, 4))
    docs.unpersist()
    assert after[0] >= before[0] - 0.002 and after[2] >= before[2] and after[0] >= max(after[1:]) - 0.002
