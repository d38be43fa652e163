"""Click-log sources and sinks.

* ``clicks_from_events`` derives the click log from the driver's ``events``
  table (the mapping is documented in FIXTURES.md §2).
* ``read_clicks_csv`` is the typed CSV scan of a raw click log.
* ``write_csv`` / ``read_csv`` persist extracts and score tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from clickcast.session import scratch_path

USER_COLS = ("ip", "device", "os")
CATEGORY_COLS = ("device", "os", "app", "channel")

# Training log columns, in file order.
CLICK_SCHEMA = StructType([
    StructField("ip", IntegerType()),
    StructField("app", IntegerType()),
    StructField("device", IntegerType()),
    StructField("os", IntegerType()),
    StructField("channel", IntegerType()),
    StructField("click_time", TimestampType(), True),
    StructField("attributed_time", TimestampType(), True),
    StructField("is_attributed", IntegerType()),
])

# Scoring log columns (no label), in file order.
SCORING_SCHEMA = StructType([
    StructField("click_id", LongType()),
    StructField("ip", IntegerType()),
    StructField("app", IntegerType()),
    StructField("device", IntegerType()),
    StructField("os", IntegerType()),
    StructField("channel", IntegerType()),
    StructField("click_time", TimestampType(), True),
])

# Modelling extract columns, in file order.
EXTRACT_SCHEMA = StructType([
    StructField("click_time_wday", StringType()),
    StructField("is_attributed", IntegerType()),
    StructField("click_time_hour", StringType()),
    StructField("n_previous_clicks", LongType()),
    StructField("click_time_diff", DoubleType()),
    StructField("device_custom_score", DoubleType()),
    StructField("os_custom_score", DoubleType()),
    StructField("app_custom_score", DoubleType()),
    StructField("channel_custom_score", DoubleType()),
])

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"

# Score files, one per category, with a text key.  Device and os files carry
# the conversion share and the number of conversions, app and channel files
# the score and the number of clicks.
RATE_SCORE_DIMS = ("device", "os")


def score_file_schema(dim: str) -> StructType:
    if dim in RATE_SCORE_DIMS:
        return StructType([StructField(dim, StringType()), StructField("prcnt_1", DoubleType()),
                           StructField("1", IntegerType()),
                           StructField("custom_score", DoubleType())])
    return StructType([StructField(dim, StringType()), StructField("custom_score", DoubleType()),
                       StructField("count", IntegerType())])


def pin_utc(spark: SparkSession) -> None:
    """Calendar features and epoch seconds are defined in UTC."""
    if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def clicks_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The click log derived from ``events``.

    click_id = event_id, ip = user_id, app/device/os/channel = k mod 20/2/3/50
    where k is the integer in ``props``; a purchase is a conversion whose
    install time is k seconds after the click.
    """
    pin_utc(spark)
    ev = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r"([0-9]+)", 1).try_cast("int")
    t = F.col("ts").cast("timestamp")
    purchase = F.col("event_type") == "purchase"
    base = ev.select(
        F.col("event_id").alias("click_id"),
        F.col("user_id").alias("ip"),
        k.alias("k"),
        t.alias("click_time"),
        purchase.alias("purchase"),
    )
    return base.select(
        "click_id",
        "ip",
        (F.col("k") % 20).alias("app"),
        (F.col("k") % 2).alias("device"),
        (F.col("k") % 3).alias("os"),
        (F.col("k") % 50).alias("channel"),
        "click_time",
        F.when(F.col("purchase"),
               F.expr("timestampadd(SECOND, k, click_time)")).alias("attributed_time"),
        F.when(F.col("purchase"), 1).otherwise(0).alias("is_attributed"),
    )


def read_clicks_csv(spark: SparkSession, path: str, schema: StructType = CLICK_SCHEMA,
                    materialize: bool = True) -> DataFrame:
    """Typed CSV scan with header, malformed rows dropped.

    With ``DROPMALFORMED`` Spark judges a row only on the columns a query
    reads, so a narrow query would keep rows a full-width read drops.  With
    ``materialize`` the full-width parse is written once as parquet under the
    shared checkpoint folder and read back, so every later query sees the
    same rows (and gets a columnar, pruned scan).
    """
    pin_utc(spark)
    df = (spark.read.schema(schema)
          .option("header", True)
          .option("mode", "DROPMALFORMED")
          .option("timestampFormat", TIMESTAMP_FORMAT)
          .csv(path))
    if materialize:
        out = scratch_path(spark, "clicks-parquet")
        df.write.parquet(out)
        df = spark.read.parquet(out)
    return df


def write_csv(df: DataFrame, path: str, null_value: str = "null") -> str:
    """Distributed CSV write with header; nulls written as ``null``."""
    (df.write.mode("overwrite")
       .option("header", True)
       .option("nullValue", null_value)
       .option("timestampFormat", TIMESTAMP_FORMAT)
       .csv(path))
    return path


def write_submission(predictions: DataFrame, path: str) -> str:
    """The submission file: click_id, is_attributed with a header."""
    (predictions.select("click_id", "is_attributed")
                .write.mode("overwrite").option("header", True).csv(path))
    return path


def write_score_files(scores_long: DataFrame, root: str, dims=CATEGORY_COLS) -> dict[str, str]:
    """One CSV per category from a long score table (see ``score_tables``)."""
    paths = {}
    for dim in dims:
        part = scores_long.where(F.col("dim") == dim)
        if dim in RATE_SCORE_DIMS:
            cols = [F.col("key").cast("string").alias(dim), "prcnt_1",
                    F.coalesce(F.col("1"), F.lit(0)).cast("int").alias("1"), "custom_score"]
        else:
            total = F.coalesce(F.col("0"), F.lit(0)) + F.coalesce(F.col("1"), F.lit(0))
            cols = [F.col("key").cast("string").alias(dim), "custom_score",
                    total.cast("int").alias("count")]
        paths[dim] = write_csv(part.select(*cols), f"{root.rstrip('/')}/{dim}_score")
    return paths


def read_score_files(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Typed reads of the score CSVs (text keys, malformed rows dropped)."""
    return {dim: read_csv(spark, path, score_file_schema(dim)) for dim, path in paths.items()}


def read_csv(spark: SparkSession, path: str, schema: StructType,
             null_value: str = "null", where: Column | None = None) -> DataFrame:
    """Typed CSV read, malformed rows dropped by a full-width parse (see ``read_clicks_csv``).

    ``where`` on the folders' partition columns prunes what is parsed.
    """
    df = (spark.read.schema(schema)
          .option("header", True)
          .option("nullValue", null_value)
          .option("mode", "DROPMALFORMED")
          .option("timestampFormat", TIMESTAMP_FORMAT)
          .csv(path))
    if where is not None:
        df = df.where(where)
    out = scratch_path(spark, "csv-parquet")
    df.write.parquet(out)
    return spark.read.schema(df.schema).parquet(out)
