"""Join helpers with a checked broadcast.

A side is broadcast only after its row count has been measured against a
bound; above the bound the join stays a shuffle join (AQE may still switch
it at runtime from real shuffle sizes, and splits skewed partitions).
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickcast.session import materialised

# About 100 bytes per row of a score table: 2M rows stay well below the
# default 8 GB broadcast limit and typical executor memory.
DEFAULT_BROADCAST_ROWS = 2_000_000


def measured(df: DataFrame) -> tuple[DataFrame, int]:
    """Persist a small derived table and count it (one job)."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    return df, df.count()


def measured_many(dfs: dict) -> tuple[dict, dict]:
    """Persist several small tables and count them all in one job."""
    kept = {k: df.persist(StorageLevel.MEMORY_AND_DISK) for k, df in dfs.items()}
    tagged = [df.select(F.lit(str(k)).alias("_t")) for k, df in kept.items()]
    rows = reduce(lambda a, b: a.unionByName(b), tagged).groupBy("_t").count().collect()
    counts = {k: 0 for k in kept}
    counts.update({r["_t"]: r["count"] for r in rows})
    return kept, counts


def maybe_broadcast(df: DataFrame, n_rows: int,
                    max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if n_rows <= max_rows else df


#: Rows of one key that a task of a shuffle join is to hold.
TARGET_KEY_ROWS = 1_000_000


def join_per_key(rows: DataFrame, per_key: DataFrame, on, n: str, spread: Column,
                 max_rows: int = DEFAULT_BROADCAST_ROWS, target: int = TARGET_KEY_ROWS) -> DataFrame:
    """Inner join of ``rows`` with ``per_key``: a row a key, whose column ``n`` counts the key's rows.

    Within ``max_rows`` keys the small side is broadcast.  Beyond, both sides are shuffled, and
    only keys of more than ``target`` rows are split: their entry is copied once a salt, their rows
    are dealt over the salts by ``spread``.  There are at most (all rows / ``target``) such keys, so
    their list is broadcast; the other keys keep one copy and salt 0.  ``n`` is not in the result.
    """
    on = list(on)
    per_key = materialised(per_key, "per-key")
    if per_key.count() <= max_rows:
        return rows.join(F.broadcast(per_key.drop(n)), on=on, how="inner")
    sized = per_key.withColumn("_salts", F.ceil(F.col(n) / target).cast("int"))
    heavy = sized.where("_salts > 1").select(*on, "_salts")
    if not heavy.limit(1).count():
        return rows.join(per_key.drop(n), on=on, how="inner")
    dealt = rows.join(F.broadcast(heavy), on=on, how="left").withColumn(
        "_salt", F.when(F.col("_salts").isNull(), 0).otherwise(
            F.pmod(F.xxhash64(spread), F.col("_salts"))).cast("int")).drop("_salts")
    copies = sized.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts", n)
    return dealt.join(copies.hint("shuffle_merge"), on=[*on, "_salt"], how="inner").drop("_salt")


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Join ``small`` into ``big``, broadcasting it only if its measured size
    is within ``max_rows``."""
    small, n = measured(small)
    return big.join(maybe_broadcast(small, n, max_rows), on=on, how=how)
