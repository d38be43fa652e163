"""Results of long fits, kept under the checkpoint folder and found again by what they were made from.

A key is the kind of result, its parameters and the signature of its input (columns, row
count and an order-free sum of row hashes: one partial aggregate, one row to the driver).  A
result is marked as whole only after all its files are there, so a fit that was cut short is done again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickcast.session import checkpoint_root

T = TypeVar("T")


def signature(df: DataFrame) -> str:
    """The same for equal rows in any order and any partitioning."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h"),
                 F.sum(F.hash(*df.columns).cast("long")).alias("g")).first()
    return hashlib.sha1(json.dumps([df.dtypes, row["n"], str(row["h"]), row["g"]]).encode()).hexdigest()


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(spark: SparkSession, kind: str, params: dict, made_from: str,
           make: Callable[[str], None], load: Callable[[str], T]) -> T:
    """``load(folder)`` of the result; ``make(folder)`` writes it there first if no whole one is found."""
    key = hashlib.sha1(json.dumps([kind, params, made_from], sort_keys=True).encode()).hexdigest()
    folder = f"{checkpoint_root(spark).rstrip('/')}/store-{kind}-{key}"
    mark, fs = _path(spark, f"{folder}/_WHOLE")
    if not fs.exists(mark):
        root, _ = _path(spark, folder)
        fs.delete(root, True)  # what a fit cut short has left
        make(folder)
        fs.create(mark, True).close()
    return load(folder)


def stored_table(spark: SparkSession, kind: str, params: dict, made_from: str, make: Callable[[], DataFrame]) -> DataFrame:
    return stored(spark, kind, params, made_from, lambda folder: make().write.parquet(f"{folder}/rows"),
                  lambda folder: spark.read.parquet(f"{folder}/rows"))
