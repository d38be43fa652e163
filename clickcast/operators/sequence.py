"""Per-user sequence features with counters that reset after each conversion.

For each click, ordered by ``(click_time, *order_cols)`` within the user key:

* ``prev_label``        label of the previous click (null for the first)
* ``times_attributed``  conversions strictly before this click (the attempt id)
* ``n_previous_clicks`` clicks before this one in the same attempt
* ``click_time_diff``   minutes (whole seconds / 60) since the attempt's first click

Ordinary users: one window per user, one shuffle of the log.  A user is
ordinary with at most ``target_chunk_rows`` clicks; one partial aggregate
over the keys finds the others (at most n / target of them).

Heavy users: one may own a third of the log, so their timelines are cut into
time chunks of about ``target_chunk_rows`` clicks, each user by a width of
its own.  The windows run per (user, chunk), a per-chunk summary (one row
per chunk) carries the open attempt from earlier chunks, and the summary is
joined back on (user, chunk).  The result is exact: identical to one window
per user with the same order.  Bursts (more clicks than the target in one
width) are cut into finer, still time-ordered slices.

Shuffles of the heavy users' rows: hash-partitioned once by (user, chunk);
the join back reuses that partitioning, so the full-width rows move once.
The summary branch reads only keys, time, order columns and label (its own,
narrower exchange by (user, chunk)), then one row per chunk moves by user.
Sharing the wide exchange instead would make both branches read every
column of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickcast.functions.calendar import epoch_seconds
from clickcast.operators.joins import maybe_broadcast, measured
from clickcast.session import materialised

USER_COLS = ("ip", "device", "os")
SEQUENCE_OUTPUTS = ("prev_label", "times_attributed", "n_previous_clicks", "click_time_diff")

_NULL_CHUNK = -(2 ** 63)  # chunk id for clicks without a time: sorts first


def auto_chunk_seconds(df: DataFrame, time_col: str = "click_time",
                       target_chunk_rows: int = 1_000_000) -> int:
    """Chunk width such that even a user owning every click of the log gets
    about ``target_chunk_rows`` clicks per chunk (for evenly spread times).

    One aggregate job returning three numbers.
    """
    n, lo, hi = log_stats(df, time_col)
    return chunk_seconds_for(n, lo, hi, target_chunk_rows)


def log_stats(df: DataFrame, time_col: str = "click_time") -> tuple[int, int | None, int | None]:
    """Row count and first / last epoch second of the log (one small job)."""
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 F.min(epoch_seconds(time_col)).alias("lo"),
                 F.max(epoch_seconds(time_col)).alias("hi")).first()
    return row["n"], row["lo"], row["hi"]


def chunk_seconds_for(n: int, lo: int | None, hi: int | None,
                      target_chunk_rows: int = 1_000_000) -> int:
    """The chunk width from the log's size and time range (epoch seconds)."""
    if not n or lo is None:
        return 86_400
    span = max(int(hi) - int(lo) + 1, 1)
    return max(1, int(span * target_chunk_rows // n))


def _non_null_keys(df: DataFrame, cols) -> tuple[dict, list[str]]:
    """Null-free copies of the key columns plus a null bitmask.

    Equi-joins drop null keys; these copies keep null users as their own
    group without a null-safe join (which would re-shuffle the large side).
    """
    types = dict(df.dtypes)
    new, mask = {}, F.lit(0)
    for i, c in enumerate(cols):
        zero = F.lit("") if types[c] == "string" else F.lit(0).cast(types[c])
        new[f"_k{i}"] = F.coalesce(F.col(c), zero)
        mask = mask + F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0))
    new["_knull"] = mask
    return new, list(new)


_FINE = 1 << 21  # slices per chunk at most; chunk ids are coarse * _FINE + slice


def _split_bursts(df: DataFrame, keys, time_col: str, chunk_seconds: int | None,
                  target_rows: int) -> DataFrame:
    """Give heavy (user, chunk) groups finer, time-ordered chunk ids.

    A user may pack more clicks into one chunk width than the log's average
    rate suggests.  One partial aggregate counts clicks per (user, chunk)
    with their first and last second; groups above ``target_rows`` (at most
    n / target_rows of them, measured before they are broadcast) have their
    occupied time range cut into ``ceil(count / target_rows)`` equal slices
    (at least one second wide).  Chunk ids stay increasing in time within a
    user, so the scan's result is unchanged.
    """
    t = epoch_seconds(time_col)
    sizes = (df.groupBy(*keys, "_chunk")
               .agg(F.count(F.lit(1)).alias("_n"), F.min(t).alias("_t0"), F.max(t).alias("_t1"))
               .where((F.col("_n") > target_rows) & F.col("_t0").isNotNull()))
    span = F.col("_t1") - F.col("_t0") + 1
    slices = F.least(F.ceil(F.col("_n") / F.lit(target_rows)), span,
                     F.lit(_FINE - 1)).cast("long")
    heavy, n = measured(sizes.select(*keys, "_chunk", "_t0", span.alias("_span"),
                                     slices.alias("_slices")))
    if n == 0:
        return df
    df = df.join(maybe_broadcast(heavy, n), on=[*keys, "_chunk"], how="left")
    slice_id = F.floor((t - F.col("_t0")) * F.col("_slices") / F.col("_span")).cast("long")
    return df.withColumn(
        "_chunk", F.col("_chunk") * F.lit(_FINE) + F.coalesce(slice_id, F.lit(0))
    ).drop("_t0", "_span", "_slices")


def sequence_features(df: DataFrame, user_cols=USER_COLS, time_col: str = "click_time",
                      label_col: str | None = "is_attributed",
                      order_cols=("click_id",), chunk_seconds: int | None = None,
                      target_chunk_rows: int = 1_000_000,
                      outputs=SEQUENCE_OUTPUTS, split_bursts: bool = True,
                      n_rows: int | None = None) -> DataFrame:
    """Add the sequence columns named in ``outputs`` to every row of ``df``.

    ``label_col=None`` gives one attempt per user (no resets).
    ``chunk_seconds`` cuts every user's timeline by that width; by default
    only users of more than ``target_chunk_rows`` clicks are cut, and none
    are looked for when the whole log (``n_rows``, if known) is no larger.
    ``split_bursts`` cuts (user, chunk) groups holding more than
    ``target_chunk_rows`` clicks into proportionally finer time slices.
    """
    keep = [c for c in df.columns if c not in outputs]
    key_cols, keys = _non_null_keys(df, user_cols)
    df = df.withColumns({**key_cols, "_lab": F.col(label_col) if label_col else F.lit(0)})
    order = [F.col(time_col).asc_nulls_first()] + [F.col(c).asc_nulls_first() for c in order_cols]
    one_chunk = n_rows is not None and n_rows <= target_chunk_rows

    def chunked(rows: DataFrame, width) -> DataFrame:
        rows = rows.withColumn("_chunk", F.floor(epoch_seconds(time_col) / width).cast("long"))
        if split_bursts and not one_chunk:
            rows = _split_bursts(rows, keys, time_col, chunk_seconds, target_chunk_rows)
        return _scan_chunks(rows, keys, time_col, order, keep, outputs)

    if chunk_seconds is not None:
        return chunked(df, F.lit(chunk_seconds))
    if one_chunk:
        return _scan_users(df, keys, time_col, order, keep, outputs)
    heavy = materialised(_heavy_users(df, keys, time_col, target_chunk_rows), "heavy-users")
    n_heavy = heavy.count()
    if n_heavy == 0:
        return _scan_users(df, keys, time_col, order, keep, outputs)
    heavy = maybe_broadcast(heavy, n_heavy)
    light = df.join(heavy.select(*keys), on=keys, how="left_anti")
    return _scan_users(light, keys, time_col, order, keep, outputs).unionByName(
        chunked(df.join(heavy, on=keys), F.col("_width")))


def _heavy_users(df: DataFrame, keys, time_col: str, target_rows: int) -> DataFrame:
    """Users of more than ``target_rows`` clicks with the chunk width (seconds)
    that gives about ``target_rows`` clicks a chunk when evenly spread."""
    t = epoch_seconds(time_col)
    users = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), (F.max(t) - F.min(t) + 1).alias("_span"))
    width = F.greatest(F.floor(F.coalesce("_span", F.lit(1)) * F.lit(target_rows) / F.col("_n")), F.lit(1))
    return users.where(F.col("_n") > target_rows).select(*keys, width.cast("long").alias("_width"))


def _scan_users(df: DataFrame, keys, time_col: str, order, keep, outputs) -> DataFrame:
    """The sequence columns by one window per user."""
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumns({
        "_prev": F.lag("_lab").over(w),
        "_attempt": F.coalesce(
            F.sum("_lab").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"),
    })
    wa = Window.partitionBy(*keys, "_attempt").orderBy(*order)
    start = F.first(time_col).over(wa)
    cols = {
        "prev_label": F.col("_prev"),
        "times_attributed": F.col("_attempt"),
        "n_previous_clicks": (F.row_number().over(wa) - 1).cast("long"),
        "click_time_diff": F.abs(epoch_seconds(time_col) - epoch_seconds(start)) / F.lit(60),
    }
    return df.select(*keep, *[cols[name].alias(name) for name in outputs])


def _scan_chunks(df: DataFrame, keys, time_col: str, order, keep, outputs) -> DataFrame:
    """The sequence columns by windows per (user, ``_chunk``) and a carry from chunk to chunk."""
    df = df.withColumn("_chunk", F.coalesce("_chunk", F.lit(_NULL_CHUNK)))
    part = keys + ["_chunk"]

    # 1. Within each (user, chunk): position, previous label, local attempt id.
    wc = Window.partitionBy(*part).orderBy(*order)
    before = wc.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({
        "_rn": F.row_number().over(wc).cast("long"),
        "_lprev": F.lag("_lab").over(wc),
        "_lta": F.coalesce(F.sum("_lab").over(before), F.lit(0)).cast("long"),
    })
    # Position and start time within the local attempt (same exchange, new sort).
    wa = Window.partitionBy(*part, "_lta").orderBy(*order)
    df = df.withColumns({"_rn2": F.row_number().over(wa).cast("long"),
                         "_first2": F.first(time_col).over(wa)})

    # 2. One row per (user, chunk): what the chunk hands on to later chunks.
    summ = df.groupBy(*part).agg(
        F.count(F.lit(1)).alias("_cnt"),
        F.coalesce(F.sum("_lab"), F.lit(0)).cast("long").alias("_conv"),
        F.min(time_col).alias("_ftime"),
        F.max_by("_lab", "_rn").alias("_llab"),
        F.max_by("_rn2", "_rn").alias("_lrn2"),
        F.max_by("_first2", "_rn").alias("_lfirst2"),
    )
    ws = Window.partitionBy(*keys).orderBy("_chunk")
    wsb = ws.rowsBetween(Window.unboundedPreceding, -1)
    closed = F.col("_llab") == 1  # chunk ends with a conversion
    mark = F.when(F.col("_conv") > 0, F.struct(
        F.col("_cum").alias("cum"),
        F.when(closed, F.lit(0).cast("long")).otherwise(F.col("_lrn2")).alias("tail"),
        F.when(closed, F.col("_next_ftime")).otherwise(F.col("_lfirst2")).alias("start"),
    ))
    summ = summ.withColumns({
        "_cum": F.sum("_cnt").over(ws.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "_next_ftime": F.lead("_ftime").over(ws),
    })
    summ = summ.withColumns({
        "_p": F.last(mark, ignorenulls=True).over(wsb),
        "_conv_before": F.coalesce(F.sum("_conv").over(wsb), F.lit(0)),
        "_prev_llab": F.lag("_llab").over(ws),
        "_user_ftime": F.first("_ftime").over(ws),
    })
    cnt_before = F.col("_cum") - F.col("_cnt")
    summ = summ.select(
        *part,
        "_conv_before",
        "_prev_llab",
        F.when(F.col("_p").isNull(), cnt_before)
         .otherwise(F.col("_p.tail") + cnt_before - F.col("_p.cum")).alias("_open_rows"),
        F.when(F.col("_p").isNull(), F.col("_user_ftime"))
         .otherwise(F.col("_p.start")).alias("_open_start"),
    )

    # 3. Join the carry back on (user, chunk) and finish each row.
    out = df.join(summ, on=part, how="inner")
    local = (F.col("_lta") > 0) | (F.col("_open_rows") == 0)
    start = F.when(local, F.col("_first2")).otherwise(F.col("_open_start"))
    cols = {
        "prev_label": F.when(F.col("_rn") == 1, F.col("_prev_llab")).otherwise(F.col("_lprev")),
        "times_attributed": (F.col("_conv_before") + F.col("_lta")).cast("long"),
        "n_previous_clicks": F.when(F.col("_lta") > 0, F.col("_rn2") - 1)
                              .otherwise(F.col("_open_rows") + F.col("_rn2") - 1).cast("long"),
        "click_time_diff": F.abs(epoch_seconds(time_col) - epoch_seconds(start)) / F.lit(60),
    }
    return out.select(*keep, *[cols[name].alias(name) for name in outputs])


def scoring_sequence_features(df: DataFrame, user_cols=USER_COLS, time_col: str = "click_time",
                              order_cols=("click_id",)) -> DataFrame:
    """Sequence columns of the unlabelled (scoring) log, as the reference
    computes them: the attempt id there is a running click count, so every
    distinct click time forms its own attempt.

    That makes ``n_previous_clicks`` the position among clicks with the same
    user and time, and ``click_time_diff`` 0.  Partitioning by (user, time)
    states this directly and spreads a heavy user over all its timestamps.
    """
    w = Window.partitionBy(*user_cols, time_col).orderBy(
        *[F.col(c).asc_nulls_first() for c in order_cols])
    first_t = F.first(time_col).over(w)
    return (df.withColumn("n_previous_clicks", (F.row_number().over(w) - 1).cast("long"))
              .withColumn("click_time_diff",
                          F.abs(epoch_seconds(time_col) - epoch_seconds(first_t)) / F.lit(60)))
