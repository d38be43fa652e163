"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickcast.session import scratch_path


#: Bytes of rows sent to a Python worker at once: it holds a batch as Arrow, as objects and in work arrays.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound this session's Arrow batches by ``BATCH_BYTES``, unless the session has set a bound itself."""
    if spark.sparkContext.getConf().get(_BATCH_SETTING) is None:
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables, whole."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(spark: SparkSession, df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to a new folder under ``spark.checkpoint.dir`` and reread it; ``codec``: of Parquet, if not the session's.

    Cuts the lineage: what follows survives lost executors without redoing
    ``df``, and uses of it in several branches read it instead of computing
    it again.
    """
    drop_shuffles(spark)
    small_batches(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps now, not half an hour later.

    A collection in the driver right after a job still finds it in Spark's event queue; before the
    next step, and after a release, it does not.
    """
    spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the folders of frames from :func:`written` that nothing reads any more."""
    for frame in frames:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(frame.scratch)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    drop_shuffles(spark)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, ids: DataFrame, max_broadcast: int = 500_000) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``ids`` (one column, written and counted here)."""
    name = free_name(docs, "bad")
    bad = written(docs.sparkSession, ids.toDF(name).distinct(), "dropped-ids")
    if bad.count() <= max_broadcast:
        bad = F.broadcast(bad)
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[name]), "left_anti")


def join_hot(rows: DataFrame, entries: DataFrame, on: list[str], spread: Column, how: str = "inner",
             target: int = 10_000, max_hot: int = 2_000) -> DataFrame:
    """Join ``rows`` to ``entries``, whose column ``n`` says how many rows want each (unique) entry.

    An entry wanted by more than ``target`` rows, and by more than a ``max_hot``-th of all, is
    copied over salts, and its rows are dealt over them by ``spread``.  At most ``max_hot``
    entries are that hot, so their list is broadcast.  The result has no column ``n`` of entries.
    """
    total = entries.agg(F.sum("n")).first()[0] or 0
    share = max(float(target), total / max_hot)
    sized = entries.withColumn("_salts", F.greatest(F.lit(1), F.ceil(F.col("n") / share)).cast("int"))
    hot = F.broadcast(sized.where("_salts > 1").select(*on, "_salts"))
    dealt = rows.join(hot, on, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(spread), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    copies = sized.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts", "n")
    return dealt.join(copies.hint("shuffle_merge"), [*on, "_salt"], how).drop("_salt")


def text_chunks(texts, max_chars: int):
    """Yield (start, end) row ranges whose texts hold about ``max_chars``.

    A single longer text gets a range of its own, so numpy work arrays are
    bounded by the larger of ``max_chars`` and the longest text.
    """
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t)
        if i > start and size + n > max_chars:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def give_back() -> None:
    """Return what this Python worker has freed to the system; idle workers of earlier steps keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, giving freed memory back when it has ended."""
    def outer(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()
    return outer
