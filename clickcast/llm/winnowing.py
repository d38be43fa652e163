"""Winnowing fingerprints of documents, with DataFrame functions only.

Every run of ``gram`` words is hashed; of each window of ``window`` successive
grams the smallest hash is kept, the rightmost one on ties, with its position.
Any run of ``gram + window - 1`` words that two texts share gives them a common
fingerprint entry, and no run of less than ``gram`` words does.

Hash and position share one long (33 bits of hash, then the position counted
down), so the minimum of a window is one ``least`` and ties fall to the right.

Defined results: null text is an empty text; a text of fewer than ``gram`` words
has one gram of all its words, an empty one has none.  Two empty fingerprints
have likeness 1, an empty and another one 0.  Repeated rows (and ids) are
documents of their own, in order of their text.  A null id sorts last.  Empty
table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickcast.llm.catalog import register
from clickcast.llm.columns import let, positions, words
from clickcast.llm.common import table, written

GRAM = 3
WINDOW = 6
POSITION_BITS = 30
#: Ids in a bucket of the document order; a bucket is one window partition.
BUCKET_IDS = 256
MAX_BROADCAST_LINKS = 200_000


def fingerprint(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Array of (hash << 30 | reversed position), by position."""
    last = (1 << POSITION_BITS) - 1

    def grams(w: Column) -> Column:
        n = F.when(F.size(w) == 0, 0).otherwise(F.greatest(F.size(w) - gram + 1, F.lit(1)))
        return F.transform(positions(n), lambda i: F.shiftleft(F.shiftrightunsigned(
            F.xxhash64(*[F.get(w, i + j) for j in range(gram)]), 64 - 33), POSITION_BITS).bitwiseOR(F.lit(last) - i))

    def smallest(g: Column) -> Column:
        n = F.when(F.size(g) == 0, 0).otherwise(F.greatest(F.size(g) - window + 1, F.lit(1)))
        return F.array_distinct(F.transform(
            positions(n), lambda i: F.least(F.get(g, i), *[F.get(g, i + j) for j in range(window)])))

    return let(let(words(text), grams), smallest)


def hashes(fp: Column) -> Column:
    """The set of hashes of a fingerprint."""
    return F.array_distinct(F.transform(fp, lambda x: F.shiftright(x, POSITION_BITS)))


def as_text(fp: Column) -> Column:
    """``hash:position`` entries, hash in hexadecimal."""
    last = (1 << POSITION_BITS) - 1
    return F.array_join(F.transform(fp, lambda x: F.concat(
        F.hex(F.shiftright(x, POSITION_BITS)), F.lit(":"), (F.lit(last) - x.bitwiseAND(F.lit(last))).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two hash sets."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 1.0).otherwise(both / F.greatest(either, F.lit(1)))


def with_next_text(spark, docs: DataFrame, bucket_ids: int = BUCKET_IDS,
                   max_broadcast: int = MAX_BROADCAST_LINKS) -> DataFrame:
    """(doc_id, text, next_text): the next document by descending id, after the last the first.

    Ids are cut into buckets of ``bucket_ids`` successive values, which bounds the
    documents of a window partition whatever the ids' distribution.  The first
    document of the next lower bucket joins a bucket as a guest; which document
    that is comes from one row per bucket, level by level, each level a
    ``bucket_ids``-th of the buckets below.
    """
    if bucket_ids < 4:
        raise ValueError("a bucket needs at least 4 ids for the levels to shrink")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        low = high = 0
    key = F.coalesce(F.col("doc_id"), F.lit(low - 1))
    keyed = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))
    keyed = keyed.withColumn("bucket", _floor_div("key", bucket_ids))
    level = written(spark, keyed.groupBy("bucket").agg(F.max("key").alias("first"), F.min("key").alias("last")),
                    "order-buckets")
    links, span = [], (high - low + 2) // bucket_ids + 2
    while True:
        # one row per bucket; the successor within a group of buckets
        grouped = level.withColumn("group", _floor_div("bucket", bucket_ids))
        next_first = F.lead("first").over(Window.partitionBy("group").orderBy(F.col("bucket").desc()))
        linked = grouped.withColumn("guest", next_first)
        links.append(linked.where("guest IS NOT NULL").select(F.col("last").alias("after"), "guest"))
        level = grouped.groupBy("group").agg(
            F.max("first").alias("first"), F.min("last").alias("last")).withColumnRenamed("group", "bucket")
        span = span // bucket_ids + 2
        if span <= 3:
            break
    # at most a few groups are left: their order, and the step from the last document to the first
    rest = [tuple(r) for r in level.orderBy(F.col("bucket").desc()).select("first", "last").collect()]
    ends = [(a[1], b[0]) for a, b in zip(rest, rest[1:] + rest[:1])]
    links.append(spark.createDataFrame(ends, "after long, guest long"))
    found = links[0]
    for more in links[1:]:
        found = found.unionByName(more)
    found = written(spark, found, "order-links")
    guest_of = found.select(F.col("guest").alias("key"), _floor_div("after", bucket_ids).alias("bucket"))
    if found.count() <= max_broadcast:
        guest_of = F.broadcast(guest_of)
    guests = keyed.drop("bucket").join(guest_of, "key").select(*keyed.columns).withColumn("guest", F.lit(1))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("key").desc(), "text")
    both = keyed.withColumn("guest", F.lit(0)).unionByName(guests)
    return both.withColumn("next_text", F.lead("text").over(order)).where("guest = 0").select(
        "doc_id", "text", "next_text")


def _floor_div(column: str, n: int) -> Column:
    """Exact floor of a long over ``n``, negative values too."""
    return F.expr(f"({column} - pmod({column}, {n}L)) div {n}L")


def fingerprint_report(paired: DataFrame) -> DataFrame:
    """Fingerprints of (doc_id, text, next_text) rows, of the text and of its edited form."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next_text").substr(F.lit(1), half))
    out = paired.select("doc_id", "text", "next_text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    out = out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                     fingerprint(F.col("text")).alias("own"), fingerprint(F.col("edited")).alias("other"),
                     fingerprint(F.col("next_text")).alias("next"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("other")).alias("edited_fingerprint"),
        _near("own", "other").alias("near_edited"), _near("own", "next").alias("near_next"))


def _near(a: str, b: str) -> Column:
    return let(hashes(F.col(a)), lambda x: let(hashes(F.col(b)), lambda y: likeness(x, y)))


@register("op7_winnowing")
def op7_winnowing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprint_report(with_next_text(spark, docs))
