"""Near-duplicate classes by BagMinHash signatures, bands and exact verification.

A document is the multiset of its five-word shingles (lower-cased words between
white space).  Likeness is weighted Jaccard: the sum of the smaller over the sum
of the larger multiplicities.

* *BagMinHash.*  A shingle with multiplicity w owns the Poisson processes of the
  dyadic weight intervals [0,1), [1,2), [2,4) ... below w; the points of the
  last one count only below w.  Every point falls on one of ``N_VALUES``
  registers, and a register keeps its earliest point.  Points are drawn in order
  of time and only up to the time by which all registers are filled, so a
  document costs about ``N_VALUES * log(N_VALUES)`` points plus its shingles.
  Two documents agree in a register with probability equal to their likeness.
* *Bands.*  Equal texts are merged first.  ``N_BANDS`` bands of ``BAND_ROWS``
  registers give buckets; at likeness 0.8 two texts share one with probability
  above 0.99999.
* *Verification without all pairs.*  Each bucket's smallest document, the pivot,
  is compared with its members.  Open after that are documents unlike their
  pivot, and those like it that by the triangle inequality of 1 - likeness may
  still be like an open one, in buckets that span several classes.  Open
  documents meet again by size class and rare elements: two multisets of sizes m
  and n and likeness t or more have at least ``t / (1 + t) * (m + n)`` elements
  in common, so, in an order by frequency, one of the rarest ones that exceed
  this number in each.  There as many pivots as it takes (4, 16, ...) are
  compared with the members of other classes until each bucket is done.  So the
  passages that many documents share, which fill buckets with unlike documents,
  cost one comparison each there and seldom bring documents together by their
  rare elements.  This step is exact: of two documents that share a bucket
  no link between different classes is missed.
* *Classes* are the connected components of the verified links; the class id is
  the smallest document id.

Defined results: a null text, or one without a word, is a class of its own.  A
text of fewer than five words is one shingle.  Rows with the same id count as
one document.  Repeated rows fall into one class.  Empty table: no rows.  Extra
columns are ignored by the report and kept by :func:`first_of_each`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickcast.llm.catalog import register
from clickcast.llm.common import table, text_chunks, tidied, without, written

SHINGLE = 5
THRESHOLD = 0.8
N_BANDS, BAND_ROWS = 30, 5
N_VALUES = N_BANDS * BAND_ROWS
CHUNK_BYTES = 1 << 22
MAX_BROADCAST_IDS = 500_000
SIZE_CLASS = 1.06
#: A document's place in a bucket of documents that may be alike.
MEMBER = ("band", "doc", "side", "n", "left")
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_hashes(texts: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """Shingle hashes of each text, in order and with repeats."""
    raw = [t.lower().encode("utf-8", "surrogatepass") + b" " for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    ends = np.cumsum([len(r) for r in raw])
    inside = data > 32
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return [np.zeros(0, dtype=np.uint64) for _ in texts]
    lengths = stops - starts
    place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    letters = data[inside].astype(np.uint64) + _U(1)
    words = mix(np.add.reduceat(mix(letters + (place.astype(np.uint64) << _U(9))), np.cumsum(lengths) - lengths))
    edges = np.searchsorted(starts, np.concatenate(([0], ends)))
    rolled = np.zeros(max(len(words) - size + 1, 0), dtype=np.uint64)
    for j in range(size):
        rolled = rolled * _U(0x9E3779B97F4A7C15) + words[j:j + len(rolled)]
    rolled = mix(rolled)
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a >= size:
            out.append(rolled[a:b - size + 1])
        elif b > a:  # a text shorter than a shingle
            h = np.zeros(1, dtype=np.uint64)
            for w in words[a:b]:
                h = mix(h + w)
            out.append(h)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def expanded(shingles: np.ndarray) -> np.ndarray:
    """The multiset as a sorted set: the k-th copy of a shingle is an element of its own."""
    s = np.sort(shingles)
    if not len(s):
        return s
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] != s[:-1]
    lead = np.flatnonzero(new)
    copy = np.arange(len(s)) - lead[np.cumsum(new) - 1]
    return np.sort(np.where(copy > 0, mix(s + copy.astype(np.uint64) * _U(0xD1B54A32D192ED03)), s))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two expanded multisets."""
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return both / (len(a) + len(b) - both)


def bag_minhash(shingles: np.ndarray, n_values: int = N_VALUES) -> np.ndarray:
    """The signature of a multiset: per register the identity of its earliest point."""
    items, weight = np.unique(shingles, return_counts=True)
    seeds, tops, starts, widths = [items], [weight], [np.zeros(len(items))], [np.ones(len(items))]
    low = 1
    while (more := weight > low).any():  # interval [low, 2 low) for those that reach into it
        seeds.append(mix(items[more] + _U(low * 0xA0761D6478BD642F % (1 << 64))))
        tops.append(weight[more])
        starts.append(np.full(int(more.sum()), float(low)))
        widths.append(np.full(int(more.sum()), float(low)))
        low *= 2
    seed, top = np.concatenate(seeds), np.concatenate(tops)
    start, width = np.concatenate(starts), np.concatenate(widths)
    limit = n_values * (np.log(n_values) + 6) / weight.sum()
    while True:
        times, owners, found = [], [], []
        clock, step, live = np.zeros(len(seed)), 0, np.arange(len(seed))
        while len(live):
            block = int(min(max(limit * width[live].max() * 1.2 + 2, 2), max(2, 400_000 // len(live))))
            j = np.arange(step, step + block, dtype=np.uint64)
            r = mix(seed[live][:, None] + (j + _U(1)) * _U(0x9E3779B97F4A7C15))
            wait = -np.log(((r >> _U(11)).astype(np.float64) + 1.0) * 2.0 ** -53) / width[live][:, None]
            t = clock[live][:, None] + np.cumsum(wait, axis=1)
            r2 = mix(r ^ _U(0x8EBC6AF09C88C6E3))
            height = start[live][:, None] + width[live][:, None] * ((r2 >> _U(40)).astype(np.float64) * 2.0 ** -24)
            ok = (t <= limit) & (height < top[live][:, None])
            times.append(t[ok])
            owners.append(((r2 & _U(0xFFFFFFFF)) % _U(n_values))[ok].astype(np.int64))
            found.append(r[ok])
            clock[live] = t[:, -1]
            live = live[t[:, -1] <= limit]
            step += block
        t, owner, ident = np.concatenate(times), np.concatenate(owners), np.concatenate(found)
        order = np.argsort(t, kind="stable")
        register_, first = np.unique(owner[order], return_index=True)
        if len(register_) == n_values:
            return ident[order][first]
        limit *= 2


def band_keys(signature: np.ndarray, n_bands: int = N_BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    grid = signature.reshape(n_bands, rows)
    key = np.arange(1, n_bands + 1, dtype=np.uint64)
    for k in range(rows):
        key = mix(key + grid[:, k])
    return key.view(np.int64)


def _signatures(texts: DataFrame) -> DataFrame:
    """(tk1, tk2, doc, bands) of (tk1, tk2, doc, text) rows; bands null for a text without words."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            all_texts = batch["text"].tolist()
            for a, b in text_chunks(all_texts, CHUNK_BYTES):
                bands = [band_keys(bag_minhash(s)) if len(s) else None for s in shingle_hashes(all_texts[a:b])]
                yield batch.iloc[a:b][["tk1", "tk2", "doc"]].assign(bands=bands)
    return texts.mapInPandas(tidied(run), "tk1 long, tk2 long, doc long, bands array<long>")


def _bags(texts: DataFrame) -> DataFrame:
    """(doc, bag): the expanded multiset as bytes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            all_texts = batch["text"].tolist()
            for a, b in text_chunks(all_texts, CHUNK_BYTES):
                yield batch.iloc[a:b][["doc"]].assign(
                    bag=[expanded(s).tobytes() for s in shingle_hashes(all_texts[a:b])])
    return texts.mapInPandas(tidied(run), "doc long, bag binary")


def _compare(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """(doc, pivot, likeness) of (doc, pivot) rows."""
    @F.pandas_udf("double")
    def like(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64))
                          for x, y in zip(a, b)], dtype=float)

    theirs = bags.withColumnsRenamed({"doc": "pivot", "bag": "pivot_bag"})
    return pairs.join(bags, "doc").join(theirs, "pivot").select(
        "doc", "pivot", like("bag", "pivot_bag").alias("likeness")).groupBy("doc", "pivot").agg(
        F.max("likeness").alias("likeness"))


def components(spark, links: DataFrame) -> DataFrame:
    """(doc, class_id): connected components of (a, b) links, smallest id first.

    Every round a document takes the smallest label among its neighbours' and
    its own, then the label of that label, until nothing changes.
    """
    both = written(spark, links.select("a", "b").unionByName(links.select(
        F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(spark, both.groupBy("a").agg(F.min("b").alias("b")).select(
        F.col("a").alias("doc"), F.least("a", "b").alias("class_id")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("doc", "b"), "b").groupBy("a").agg(F.min("class_id").alias("near"))
        step = labels.join(near, labels["doc"] == near["a"]).select(
            "doc", F.col("class_id").alias("old"), F.least("class_id", "near").alias("mid"))
        above = labels.select(F.col("doc").alias("mid"), F.col("class_id").alias("top"))
        new = written(spark, step.join(above, "mid", "left").select(
            "doc", F.least("mid", F.coalesce("top", "mid")).alias("class_id"), "old"), "labels")
        labels = new.select("doc", "class_id")
        if new.where("class_id != old").isEmpty():
            return labels


def _joined(spark, labels: DataFrame, links: DataFrame) -> DataFrame:
    """(doc, class_id) after new (a, b) links: only the classes that they touch are worked on."""
    def classes(side: str) -> DataFrame:
        return labels.select(F.col("doc").alias(side), F.col("class_id").alias(f"{side}_class"))

    between = links.join(classes("a"), "a", "left").join(classes("b"), "b", "left").select(
        F.coalesce("a_class", "a").alias("a"), F.coalesce("b_class", "b").alias("b")).where("a != b")
    tops = components(spark, between).select(F.col("doc").alias("class_id"), F.col("class_id").alias("top"))
    known = labels.join(tops, "class_id", "left").select("doc", F.coalesce("top", "class_id").alias("class_id"))
    new = tops.select(F.col("class_id").alias("doc"), F.col("top").alias("class_id")).join(labels, "doc", "left_anti")
    return written(spark, known.unionByName(new), "classes")


def _shared(members: DataFrame) -> DataFrame:
    """The (band, doc) rows, and nulls for side, n and left, of bands with more than one document."""
    many = members.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("band")
    none = F.lit(None)
    return members.join(many, "band").select("band", "doc", none.cast("int").alias("side"), none.cast("long").alias("n"),
                                             none.cast("long").alias("left"))


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, doc, side, n, left, k: class) of the bands whose documents are not all in one class."""
    classed = members.join(labels, "doc", "left").select(*MEMBER, F.coalesce("class_id", "doc").alias("k"))
    bands = classed.groupBy("band").agg(F.min("k").alias("x"), F.max("k").alias("y")).where("x < y").select("band")
    return classed.join(bands, "band")


def _rarest(spark, bags: DataFrame, threshold: float) -> DataFrame:
    """(band, doc, side, n, left): buckets in which two documents of ``threshold`` or more must meet.

    A bucket is an element and two size classes.  A document has a bucket for
    each class that its partner may be of, and each element among its rarest
    that a partner of that class must reach.  Between two different classes,
    ``side`` (else null) is the document's own.  Elements that no other document
    has are not sent back to their document, only their number.  ``n`` is the document's size
    and ``left`` how many of its elements are as rare as the bucket's, or less: where two
    documents have their first element in common, they share no more than the smaller ``left``.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, bag in zip(batch["doc"], batch["bag"]):
                element = np.frombuffer(bag, dtype=np.int64)
                for i in range(0, len(element), CHUNK_BYTES // 16):
                    part = element[i:i + CHUNK_BYTES // 16]
                    yield pd.DataFrame({"doc": np.full(len(part), doc), "n": np.full(len(part), len(element)),
                                        "element": part})

    elements = written(spark, bags.mapInPandas(tidied(run), "doc long, n long, element long"), "elements")
    common = elements.groupBy("element").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    span = math.ceil(math.log(1 / threshold) / math.log(SIZE_CLASS))
    size_class = F.floor(F.log("n") / math.log(SIZE_CLASS) + 1e-9).cast("int")
    overlap = threshold / (1 + threshold) * (F.col("n") + F.pow(F.lit(SIZE_CLASS), F.col("other")))
    prefix = F.col("n") - F.ceil(overlap - 1e-6) + 1  # rounding may only lengthen it
    buckets = elements.join(common, "element").groupBy("doc", "n").agg(
        F.array_sort(F.collect_list(F.struct("c", "element"))).alias("shared")).withColumn("own", size_class).select(
        "doc", "n", "shared", "own", F.explode(F.sequence(F.col("own") - span, F.col("own") + span)).alias("other"))
    length = F.size("shared")
    taken = (prefix - (F.col("n") - F.size("shared"))).cast("int")
    members = buckets.where((prefix > 0) & (taken > 0)).select(
        "doc", "n", "own", "other", length.alias("length"),
        F.posexplode(F.slice("shared", F.lit(1), taken)["element"]).alias("at", "element")).select(
        F.xxhash64("element", F.least("own", "other"), F.greatest("own", "other")).alias("band"), "doc",
        F.when(F.col("own") != F.col("other"), F.col("own")).alias("side"), "n",
        (F.col("length") - F.col("at")).cast("long").alias("left")).distinct()
    usable = members.groupBy("band").agg(
        F.count(F.lit(1)).alias("c"), F.min("side").alias("x"), F.max("side").alias("y")).where(
        "c > 1 AND (x IS NULL OR x < y)").select("band")
    return members.join(usable, "band").select(*MEMBER)


def _compared(spark, members: DataFrame, n_pivots: int, seen: DataFrame, labels: DataFrame | None,
              bags: DataFrame, threshold: float):
    """(seen, labels) after comparing the first documents of each band with its members of other classes."""
    if n_pivots == 1:
        pivots = members.groupBy("band").agg(F.min_by(F.struct(*MEMBER[1:], "k"), "doc").alias("p")).select(
            "band", *[F.col(f"p.{c}").alias(f"pivot_{c}") for c in (*MEMBER[1:], "k")])
    else:
        rank = F.row_number().over(Window.partitionBy("band").orderBy("doc"))
        pivots = members.withColumn("r", rank).where(F.col("r") <= n_pivots).select(
            "band", *[F.col(c).alias(f"pivot_{c}") for c in (*MEMBER[1:], "k")])
    # A pair that this drops shares less than it must, or has an earlier element in common and meets there.
    enough = F.least("left", "pivot_left") >= threshold / (1 + threshold) * (F.col("n") + F.col("pivot_n")) - 1e-6
    pairs = members.join(pivots, "band").where(
        (F.col("doc") > F.col("pivot_doc")) & (F.col("k") != F.col("pivot_k")) & F.coalesce(enough, F.lit(True))
        & F.coalesce(F.col("side") != F.col("pivot_side"), F.lit(True))).select(
        "doc", F.col("pivot_doc").alias("pivot")).distinct()
    new = written(spark, _compare(pairs.join(seen, ["doc", "pivot"], "left_anti"), bags), "likeness")
    seen = seen.unionByName(new)
    if labels is not None and new.where(F.col("likeness") >= threshold).isEmpty():
        return seen, labels
    links = new.where(F.col("likeness") >= threshold).select(F.col("doc").alias("a"), F.col("pivot").alias("b"))
    return seen, components(spark, links) if labels is None else _joined(spark, labels, links)


def near_duplicates(spark, docs: DataFrame, threshold: float = THRESHOLD,
                    max_broadcast: int = MAX_BROADCAST_IDS) -> DataFrame:
    """(doc_id, class_id, n_links) of every row; ``n_links`` counts the verified links that joined its text's class."""
    keyed = docs.select(
        F.col("doc_id"), F.col("doc_id").cast("long").alias("doc"),
        F.when(F.length("text") > 0, F.xxhash64("text")).alias("tk1"),
        F.xxhash64(F.lit(11), "text").alias("tk2"), "text")
    usable = keyed.where("tk1 IS NOT NULL AND doc IS NOT NULL").select("tk1", "tk2", "doc", "text")
    firsts = written(spark, usable.groupBy("tk1", "tk2").agg(F.min("doc").alias("doc")), "texts")
    signed = _signatures(usable).where("bands IS NOT NULL")
    signed = written(spark, signed.join(firsts, ["tk1", "tk2", "doc"], "left_semi").select("doc", "bands"), "signatures")
    members = written(spark, _shared(signed.select("doc", F.explode("bands").alias("band")).distinct()), "members")
    wanted = written(spark, members.select("doc").distinct(), "candidates")
    if wanted.count() <= max_broadcast:
        wanted = F.broadcast(wanted)
    # of equal texts only the first is a candidate; equal ids with other texts are compared as well
    bags = written(spark, _bags(usable.join(wanted, "doc", "left_semi").select("doc", "text")), "bags")
    seen = spark.createDataFrame([], "doc long, pivot long, likeness double")
    # each member with its bucket's pivot
    seen, labels = _compared(spark, members.withColumn("k", F.col("doc")), 1, seen, None, bags, threshold)
    far = 1 - threshold
    first = members.groupBy("band").agg(F.min("doc").alias("pivot"))
    away = members.join(first, "band").join(seen, ["doc", "pivot"]).select(
        *MEMBER, (1 - F.col("likeness")).alias("away"))
    least = away.where(F.col("away") > far).groupBy("band").agg(F.min("away").alias("least"))
    rest = away.join(least, "band").where((F.col("away") > far) | (F.col("away") >= F.col("least") - far))
    left = written(spark, _mixed(rest, labels).select("doc").distinct(), "open")
    # what is left, by rare elements; the others' multisets are read no more
    bags = written(spark, bags.join(left, "doc", "left_semi"), "open-bags")
    rare = written(spark, _rarest(spark, bags, threshold), "rare")
    members, n_pivots = written(spark, _mixed(rare, labels), "members"), 4
    while not members.isEmpty():
        seen, labels = _compared(spark, members, n_pivots, seen, labels, bags, threshold)
        rank = F.row_number().over(Window.partitionBy("band").orderBy("doc"))
        rest = members.withColumn("r", rank).where(F.col("r") > n_pivots).select(*MEMBER)
        members = written(spark, _mixed(rest, labels), "members")
        n_pivots *= 4
    linked = seen.where(F.col("likeness") >= threshold)
    degree = linked.select("doc").unionByName(linked.select(F.col("pivot").alias("doc"))).groupBy("doc").agg(
        F.count(F.lit(1)).alias("n_links"))
    of_first = firsts.join(labels, "doc", "left").join(degree, "doc", "left").select(
        "tk1", "tk2", F.coalesce("class_id", "doc").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x00-\x20]")
    plain = keyed.select("doc_id", F.when(has_words, F.col("tk1")).alias("tk1"), "tk2")
    return plain.join(of_first, ["tk1", "tk2"], "left").select(
        "doc_id", F.coalesce("class_id", F.col("doc_id").cast("long")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def first_of_each(spark, docs: DataFrame) -> DataFrame:
    """``docs`` without those that are not the first of their class."""
    classes = near_duplicates(spark, docs)
    return without(docs, classes.where("doc_id != class_id").select("doc_id"))


@register("op10_near_dedup")
def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))


def near_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each near-duplicate class stays."""
    return first_of_each(spark, docs).select(*docs.columns)
