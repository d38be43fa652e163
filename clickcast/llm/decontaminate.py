"""Benchmark decontamination by template windows, with DataFrame functions only.

A text becomes a template: numbers, names (capitalised words inside a sentence)
and units (after a number) turn into typed placeholders, other words are
lower-cased and stripped of punctuation.  Windows of ``WINDOW`` template words
are hash-joined with the benchmark's.  The placeholders' values of all windows
on one alignment of a document and an item must be consistent: one item value
stands for one document value and the other way round.  The windows of all
consistent alignments count together, so a copy with words added, left out or
replaced is one copy.  A document leaks an item if they make up ``MIN_SHARE`` of
the item's windows, if those with equal values hold ``MIN_SHARE`` of its words,
or if ``MIN_RUN`` words follow one another verbatim (on an alignment that is not
consistent: two windows), whatever their share.  A copy with other numbers,
names or units is found as well (``reparameterised``: what is literal does not
reach the share).

Defined results: null and empty texts leak nothing.  An item shorter than a
window is one window of its own length.  Windows with fewer than half plain
words match by their values only: they tell verbatim copies, and
``MIN_SHARE`` of the other windows is enough for one with other values, which
an item that has no others cannot have.  Rows with the same id count as one
document.  Repeated items are reported by their ids.  Empty tables: no rows.
Extra columns are ignored (report) or kept (filter).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickcast.llm.catalog import register
from clickcast.llm.columns import let, positions, words
from clickcast.llm.common import table, without, written

WINDOW = 8
MIN_SHARE = 0.5
MIN_RUN = 13
MAX_BROADCAST_WINDOWS = 500_000

#: Words that stand for numbers, and units.
NUMBER_WORDS = ("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
                "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred "
                "thousand million billion").split()
UNITS = ("mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams ton tons pound pounds ounce "
         "ounces ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days "
         "week weeks month months year years cent cents dollar dollars euro euros percent degree degrees km/h mph "
         "meter meters metre metres kilometer kilometers kilometre kilometres").split()


def template(text: Column) -> Column:
    """Array of (t: template word, s: placeholder and value, null for a plain word)."""
    edge = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"

    def read(w: Column) -> Column:
        return F.struct(F.regexp_replace(w, edge, "").alias("c"), F.substring(w, -1, 1).isin(".", "!", "?").alias("end"))

    def fold(p: Column) -> Column:
        low = F.lower(p["c"])
        return F.struct(p["c"].alias("c"), p["end"].alias("end"), low.alias("low"),
                        (((low >= "0") & (low < ":")) | low.isin(NUMBER_WORDS)).alias("number"))

    def typed(a: Column) -> Column:
        def word(x: Column, i: Column) -> Column:
            before, low = F.get(a, i - 1), x["low"]
            capital = (x["c"] != low) & (F.substring(x["c"], 1, 1) != F.substring(low, 1, 1))
            name = capital & (i > 0) & ~F.coalesce(before["end"], F.lit(True))
            unit = F.coalesce(before["number"], F.lit(False)) & low.isin(UNITS)

            def slot(kind: str) -> Column:
                return F.struct(F.lit(kind).alias("t"), F.concat(F.lit(kind), low).alias("s"))

            plain = F.struct(low.alias("t"), F.lit(None).cast("string").alias("s"))
            return (F.when(x["number"], slot("<number>")).when(unit, slot("<unit>")).when(name, slot("<name>"))
                    .otherwise(plain))
        return F.transform(a, word)

    parts = F.filter(F.transform(words(text), read), lambda p: p["c"] != "")
    return let(F.transform(parts, fold), typed)


def windows(words_: Column, length: int) -> Column:
    """Array of (h: hash, p: position, s: placeholder values) of all windows of a template."""
    def at(hashed: Column, slots: Column) -> Column:
        n = positions(F.size(hashed) - length + 1)

        def rows(values) -> Column:
            return F.transform(n, lambda i: F.struct(
                F.xxhash64(F.slice(hashed, i + 1, length)).alias("h"), i.alias("p"), values(i).alias("s")))

        return F.when(F.exists(slots, lambda x: x.isNotNull()),
                      rows(lambda i: F.array_join(F.slice(slots, i + 1, length), "\x01"))).otherwise(
            rows(lambda i: F.lit("")))  # most texts have no placeholder

    return let(words_, lambda a: let(
        F.transform(a, lambda x: F.xxhash64(x["t"])), lambda hashed: let(
            F.transform(a, lambda x: x["s"]), lambda slots: at(hashed, slots))))


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, min_share: float = MIN_SHARE,
          min_run: int = MIN_RUN, max_broadcast: int = MAX_BROADCAST_WINDOWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, share, n_slots, reparameterised), a row per leaked item of a document."""
    spark = docs.sparkSession
    known = items.select("item_id", template(F.col("text")).alias("w")).where(F.size("w") > 0)
    lengths = sorted(r[0] for r in known.select(F.least(F.size("w"), F.lit(window))).distinct().collect())
    found = None

    def keyed(frame: DataFrame, slots: str, n: int) -> DataFrame:
        """Windows with more than half placeholders (``heavy``) match by their values as well."""
        value = F.col(slots)
        count = F.when(value == "", 0).otherwise(F.length(value) - F.length(F.translate(value, "\x01", "")) + 1)
        return frame.withColumn("heavy", 2 * count > n).withColumn(
            "h", F.when(F.col("heavy"), F.xxhash64("h", slots)).otherwise(F.col("h")))

    def plain(value) -> Column:
        return F.when(~F.col("heavy"), F.col(value) if isinstance(value, str) else value)

    for n in lengths:  # the window length, and those of shorter items: at most `window` values
        whole = F.size("w") >= n if n == window else F.size("w") == n
        own = known.where(whole).select("item_id", F.explode(windows(F.col("w"), n)).alias("x")).select(
            "item_id", F.col("x.h").alias("h"), F.col("x.p").alias("item_at"), F.col("x.s").alias("item_slots"))
        own = written(spark, keyed(own, "item_slots", n), "item-windows")
        if own.count() <= max_broadcast:
            own = F.broadcast(own)
        theirs = docs.select(F.col(doc_id).alias("doc_id"), F.explode(
            windows(template(F.col(text)), n)).alias("x")).select(
            "doc_id", F.col("x.h").alias("h"), F.col("x.p").alias("doc_at"), F.col("x.s").alias("doc_slots"))
        theirs = keyed(theirs, "doc_slots", n).drop("heavy")
        total = own.groupBy("item_id").agg(
            F.count_distinct("item_at").alias("n_item"), F.count_distinct(plain("item_at")).alias("n_plain"),
            (F.max("item_at") + n).alias("n_words"))
        part = theirs.join(own, "h").groupBy(
            "doc_id", "item_id", (F.col("doc_at") - F.col("item_at")).alias("shift")).agg(
            F.collect_set("item_at").alias("at"), F.collect_set(plain("item_at")).alias("plain"),
            F.collect_set(F.when(F.col("item_slots") == F.col("doc_slots"), F.col("item_at"))).alias("exact"),
            F.collect_set(plain(F.struct("item_slots", "doc_slots"))).alias("pairs"),
            F.collect_set(F.when(F.col("heavy"), F.col("item_slots"))).alias("heavy")).join(
            F.broadcast(total), "item_id").withColumn("n", F.lit(n))
        found = part if found is None else found.unionByName(part)
    schema = "doc_id long, item_id long, n_windows int, share double, n_slots int, reparameterised boolean"
    if found is None:
        return spark.createDataFrame([], schema)

    def zipped(p: Column) -> Column:
        return F.zip_with(F.split(p["item_slots"], "\x01"), F.split(p["doc_slots"], "\x01"),
                          lambda i, d: F.struct(i.alias("i"), d.alias("d")))

    def run(length: int) -> Column:
        """Whether ``exact`` has consecutive windows that make up ``length`` words."""
        more = F.lit(length) - F.col("n")
        return F.exists(positions(F.size("exact") - more), lambda i: F.get("exact", i + more) - F.get("exact", i) == more)

    def union(name: str, where: Column | None = None) -> Column:
        column = F.col(name) if where is None else F.when(where, F.col(name))
        return F.array_distinct(F.flatten(F.collect_list(column)))

    pairs = F.array_distinct(F.flatten(F.transform(F.filter("pairs", lambda p: p["item_slots"] != ""), zipped)))
    values = F.array_distinct(F.flatten(F.transform("heavy", lambda v: F.split(v, "\x01"))))
    shifts = found.withColumns({"pairs": pairs, "heavy": values, "exact": F.array_sort("exact")})
    item_values = F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"])))
    doc_values = F.size(F.array_distinct(F.transform("pairs", lambda p: p["d"])))
    fits = (item_values == F.size("pairs")) & (doc_values == F.size("pairs"))
    same = F.filter("pairs", lambda p: p["i"] == p["d"])
    shifts = shifts.withColumns({
        "fits": fits, "long": F.when(fits, run(min_run)).otherwise(run(max(min_run, 2 * window)))}).where(
        F.col("fits") | F.col("long")).withColumns({
            "at": F.when(F.col("fits"), F.col("at")).otherwise(F.col("exact")),
            "plain": F.when(F.col("fits"), F.col("plain")).otherwise(F.array_intersect("plain", "exact")),
            "pairs": F.when(F.col("fits"), F.col("pairs")).otherwise(same)})
    literal = ~F.exists("pairs", lambda p: p["i"] != p["d"])
    judged = shifts.groupBy("doc_id", "item_id", "n_item", "n_plain", "n_words", "n").agg(
        union("at").alias("at"), union("plain").alias("plain"), union("heavy").alias("heavy"),
        union("exact").alias("exact"), union("at", literal).alias("literal"),
        union("pairs").alias("pairs"), F.max("long").alias("long"))
    read = F.size(F.array_distinct(F.flatten(F.transform(
        "exact", lambda p: F.sequence(p, p + F.col("n") - 1)))))
    share, alone = F.size("at") / F.col("n_item"), F.size("literal") / F.col("n_item")
    by_plain = F.coalesce(F.try_divide(F.size("plain"), F.col("n_plain")) >= min_share, F.lit(False))
    return judged.where((share >= min_share) | by_plain | (read / F.col("n_words") >= min_share) | F.col("long")).select(
        "doc_id", "item_id", F.size("at").alias("n_windows"), share.alias("share"),
        F.size(F.array_union(F.transform("pairs", lambda p: p["i"]), "heavy")).alias("n_slots"),
        ((alone < min_share) & F.exists("pairs", lambda p: p["i"] != p["d"])).alias("reparameterised"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that leak an item."""
    return without(docs, leaks(docs, items).select("doc_id"))


@register("op6_decontaminate")
def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that leak a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)
