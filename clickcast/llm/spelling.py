"""Spelling variants: words that differ by one inserted, deleted or replaced code point.

The trie-node pair dictionary.  The distinct words are sorted over range partitions; a
word's common prefix with the word before it says which nodes of the trie are new,
so nodes are numbered by prefix sums of small per-partition counts, without building
the trie in one place.  The same over reversed words numbers suffix nodes.  A pair of
numbers (prefix node, suffix node) then stands for a word exactly:

* a word *skips* position i by (node of its first i code points, node of all after i);
* a word *splits* at i by (node of its first i code points, node of the others).

Words that share a skip pair differ by one replaced code point.  A word whose split pair
is another's skip pair lacks one code point of it; since a code point taken from a run of equal
ones gives one word, only the first of a run meets split pairs.  So each near pair
meets under exactly one key, and a key has no more skips than the alphabet has letters and
at most one split: no key is hot, however common a word is.  Per key, every word gets the
number of its near words and the largest of them; pairs of words are never listed.

Words are counted before anything else by partial aggregates.  Forms are followed to the
root by pointer doubling; n at least doubles with each step, so few rounds suffice.

Defined results: null text has no words; a null doc_id is the empty string before the
colon; repeated rows count again; very long texts and words are whole; empty table: no rows.
Other columns are ignored.
"""

from __future__ import annotations

import math
import os.path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickcast.llm.catalog import register
from clickcast.llm.common import release, table, written

#: Fixed values of the query: what parts words, and which runs are damaged.
NOT_RUN = r"[^A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMAGE = 97
MIN_CHARS, MIN_COUNT = 5, 3
#: Words in a range partition of the sorted dictionary.
RANGE_WORDS = 20_000


def word_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, run: every run of letters of every text, A-Z lower-cased, with the document's id as text."""
    # Lower-casing ASCII alone changes no other letter and no boundary.
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.split(lowered, NOT_RUN)).alias("run"))
    return runs.where("run <> ''")


def damaged(runs: DataFrame, every: int = DAMAGE) -> DataFrame:
    """word: each run, or, if ``every`` divides h = crc32 of ``<id>:<run>``, the run without code point h % length."""
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = (F.pmod(F.col("h"), F.length("run"))).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return runs.select("run", h.alias("h")).select(F.when(F.col("h") % every == 0, less).otherwise(F.col("run")).alias("word"))


def count_words(words: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n of the words with enough code points and occurrences."""
    return (words.where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n"))
            .where(F.col("n") >= min_count))


def common_prefix(a: str, b: str) -> int:
    return len(os.path.commonprefix((a, b)))


def _paths(words: list[str], path: list[int], last: str, next_id: int):
    """(node numbers of the word's prefixes, shortest first) of each sorted word after ``last``, whose nodes are ``path``."""
    for word in words:
        keep = common_prefix(last, word)
        path = path[:keep + 1] + list(range(next_id, next_id + len(word) - keep))
        next_id += len(word) - keep
        last = word
        yield path


def number_nodes(words: DataFrame, name: str, reverse: bool, partitions: int) -> DataFrame:
    """``words`` (word, …) plus the array ``name``: numbers of the trie nodes of all its prefixes, the empty one first.

    Two passes over the sorted ranges: the first counts each range's new nodes and keeps its
    first and last word, the second numbers with what the ranges before it add up to.  Only
    the words at the ranges' ends pass through the driver.
    """
    spark = words.sparkSession
    key = F.reverse("word") if reverse else F.col("word")
    kept = words.columns
    # By UTF-8 bytes, which is code-point order; written, since ranges are drawn from a sample.
    ranges = written(spark, words.withColumn("_key", key).repartitionByRange(partitions, "_key")
                     .withColumn("_range", F.spark_partition_id()), f"{name}-ranges")

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = sorted(pdf["_key"])
        # Numbered as if the first word had no new node: its nodes are -1 - depth until the ranges before are known.
        path, new = [-1 - d for d in range(len(keys[0]) + 1)], 0
        for path in _paths(keys[1:], path, keys[0], 0):
            new = max(new, path[-1] + 1)
        return pd.DataFrame({"_range": [pdf["_range"].iloc[0]], "first": [keys[0]], "last": [keys[-1]],
                             "new": [new], "path": [path]})

    ends = sorted(ranges.groupBy("_range").applyInPandas(
        measure, "_range int, first string, last string, new long, path array<long>").collect(),
        key=lambda r: r["first"])
    carry, last, path, next_id = {}, "", [0], 1
    for end in ends:
        carry[end["_range"]] = (last, path, next_id)
        first_path = next(_paths([end["first"]], path, last, next_id))
        base = next_id + len(end["first"]) - common_prefix(last, end["first"])
        path = [first_path[-1 - p] if p < 0 else base + p for p in end["path"]]
        last, next_id = end["last"], base + end["new"]

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_key")
        last, path, next_id = carry[int(pdf["_range"].iloc[0])]
        pdf[name] = list(_paths(pdf["_key"].tolist(), path, last, next_id))
        return pdf[[*kept, name]]

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in words.schema), f"{name} array<long>"])
    return written(spark, ranges.groupBy("_range").applyInPandas(number, schema), f"{name}-nodes")


def pair_rows(numbered: DataFrame) -> DataFrame:
    """p, s, wid, n, at: the skip and split pairs of each word.

    ``at``: 0 split, 1 skip, 2 skip of the first code point of a run.  ``wid`` is the
    word's own prefix node: a number in code-point order of the words.
    """

    def pairs(batches):
        for batch in batches:
            p, s, wid, n, at = [], [], [], [], []
            for word, count, prefix, suffix in zip(batch["word"], batch["n"], batch["prefix"], batch["suffix"]):
                size, back = len(word), suffix[::-1]
                p += [prefix, prefix[:-1]]
                s += [back, back[1:]]
                first = np.fromiter((i == 0 or word[i] != word[i - 1] for i in range(size)), dtype=np.int8, count=size)
                at += [np.zeros(size + 1, dtype=np.int8), first + np.int8(1)]
                wid += [prefix[-1]] * (2 * size + 1)
                n += [count] * (2 * size + 1)
            if wid:
                yield pd.DataFrame({"p": np.concatenate(p), "s": np.concatenate(s), "wid": wid, "n": n,
                                    "at": np.concatenate(at)})

    return numbered.mapInPandas(pairs, "p long, s long, wid long, n long, at byte")


def near_counts(pairs: DataFrame) -> DataFrame:
    """wid, n_near, best (n, form): the number of near words and the largest, the first in order among equals."""

    def near(x: Column, y: Column) -> Column:
        return (x["wid"] != y["wid"]) & F.when(x["at"] == 0, y["at"] == 2).when(
            y["at"] == 0, x["at"] == 2).otherwise(True)

    def seen_by(x: Column) -> Column:
        # The last argument of the struct orders equal counts: -wid is larger for the word that comes first.
        others = F.transform(F.filter("members", lambda y: near(x, y)),
                             lambda y: F.struct(y["n"].alias("n"), (-y["wid"]).alias("back")))
        return F.struct(x["wid"].alias("wid"), F.size(others).alias("k"), F.array_max(others).alias("best"))

    member = F.struct("wid", "n", "at")
    return (pairs.groupBy("p", "s").agg(F.collect_list(member).alias("members")).where(F.size("members") > 1)
            .select(F.inline(F.transform("members", seen_by))).where("k > 0")
            .groupBy("wid").agg(F.sum("k").cast("long").alias("n_near"), F.max("best").alias("best")))


def follow_roots(spark: SparkSession, forms: DataFrame) -> DataFrame:
    """wid, form, root of ``forms`` (wid, form): the last word met when forms are followed."""
    roots = written(spark, forms.select("wid", "form", F.col("form").alias("root")), "roots")
    while True:
        # Doubling: a root becomes what its own row has reached by now.
        step = roots.select(F.col("wid").alias("_at"), F.col("root").alias("_to"))
        after = written(spark, roots.join(step, F.col("root") == F.col("_at"), "left").select(
            "wid", "form", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("moved")), "roots")
        release(spark, roots)
        if not after.where("moved").limit(1).count():
            return after.drop("moved")
        roots = after


def spelling_groups(spark: SparkSession, words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of ``words`` (word, n; distinct)."""
    words = written(spark, words.select("word", F.col("n").cast("long").alias("n")), "words")
    partitions = max(1, math.ceil(words.count() / RANGE_WORDS))
    forward = number_nodes(words, "prefix", False, partitions)
    numbered = number_nodes(forward, "suffix", True, partitions)
    near = written(spark, near_counts(pair_rows(numbered)), "near")
    ids = numbered.select("word", "n", F.element_at("prefix", -1).alias("wid"))
    counted = written(spark, ids.join(near, "wid", "left").select(
        "wid", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("best.n") >= 2 * F.col("n"), F.struct((-F.col("best.back")).alias("wid"), F.col("best.n").alias("n")))
        .alias("best")), "counted")
    roots = follow_roots(spark, counted.where("best is not null").select("wid", F.col("best.wid").alias("form")))
    form = counted.select(F.col("wid").alias("form"), F.col("word").alias("form_word"))
    root = counted.select(F.col("wid").alias("root"), F.col("word").alias("root_word"))
    named = roots.join(form, "form").join(root, "root").select("wid", "form_word", "root_word")
    return counted.join(named, "wid", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"),
        "n", "n_near", F.col("best.n").alias("form_n"))


@register("op13_spelling_groups")
def op13_spelling_groups(spark, sf_dir: str) -> DataFrame:
    return spelling_groups(spark, count_words(damaged(word_runs(table(spark, sf_dir, "documents")))))
