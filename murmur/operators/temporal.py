"""Temporal operators: hourly/daily matrices, event-window range join,
nearest-event distance, dense hour spine (AGG-9/10/11, JOI-9/10/11, WIN-10,
DAT-1..3, STM-4 batch form)."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.operators.common import join_back
from murmur.operators.rank import range_buckets
from murmur.session import cut_lineage

HOUR_US = 3_600_000_000


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def elapsed_hours(a, b) -> Column:
    """DAT-2: (a - b) in float hours, from microsecond epochs."""
    return (F.unix_micros(_c(a)) - F.unix_micros(_c(b))) / float(HOUR_US)


def time_matrix(df: DataFrame, ts_col: str, scores: Mapping[str, str] | str, *,
                unit: str = "hour", id_col: str | None = None,
                bucket_name: str | None = None) -> DataFrame:
    """AGG-9/10/11: per time bucket volume, mean and sample std (0 for a
    single row) of one or several scores.

    ``scores`` is a column name (output ``mean_sentiment``/``std_sentiment``)
    or a mapping suffix -> column (outputs ``mean_sentiment_<suffix>``...).
    Volume counts non-null ``id_col`` when given, else non-null score.
    Rows with a NULL timestamp are dropped (FLT-9). The aggregate is a
    partial/final hash aggregate: one small shuffle of per-bucket partials.
    """
    bucket_name = bucket_name or f"timestamp_{'hourly' if unit == 'hour' else 'daily'}"
    single = isinstance(scores, str)
    mapping = {"": scores} if single else dict(scores)
    first_score = next(iter(mapping.values()))
    aggs = [F.count(F.col(id_col) if id_col else F.col(first_score)).alias("volume")]
    for suffix, col in mapping.items():
        sfx = f"_{suffix}" if suffix else ""
        aggs.append(F.avg(col).alias(f"mean_sentiment{sfx}"))
        aggs.append(F.coalesce(F.stddev_samp(col), F.lit(0.0)).alias(f"std_sentiment{sfx}"))
    return (df.where(F.col(ts_col).isNotNull())
            .groupBy(F.date_trunc(unit, F.col(ts_col)).alias(bucket_name))
            .agg(*aggs))


def event_windows(matrix: DataFrame, events: DataFrame, *, hours: int = 48,
                  bucket_col: str = "timestamp_hourly", event_time_col: str = "event_time_utc",
                  event_name_col: str = "event_name", events_bounded: bool = False) -> DataFrame:
    """JOI-9 + WIN-10 + SET-5: matrix rows within +-``hours`` of each event
    (both ends closed; windows may overlap, so an hour can repeat), with
    elapsed hours and the post-event dummy. NULL event times are skipped.

    Range join as an equi-join: every event is expanded to the hour stamps
    its closed window can contain (2*hours+1 at most), then joined on the
    hour. That is a hash join, never a nested loop, for any number of events.
    When ``events_bounded`` (e.g. a top-k registry) the expanded side is
    broadcast; otherwise AQE picks broadcast or shuffle from measured sizes.
    """
    ev = events.where(F.col(event_time_col).isNotNull()).select(
        F.col(event_name_col).alias("event_name"), F.col(event_time_col).alias("event_time_utc"))
    lo = F.col("event_time_utc") - F.make_dt_interval(hours=F.lit(hours))
    hi = F.col("event_time_utc") + F.make_dt_interval(hours=F.lit(hours))
    first = F.when(F.date_trunc("hour", lo) == lo, lo).otherwise(
        F.date_trunc("hour", lo) + F.expr("INTERVAL 1 HOUR"))
    last = F.date_trunc("hour", hi)
    expanded = ev.select("event_name", "event_time_utc", F.explode(
        F.sequence(first, last, F.expr("INTERVAL 1 HOUR"))).alias("_h"))
    if events_bounded:
        expanded = F.broadcast(expanded)
    joined = matrix.join(expanded, matrix[bucket_col] == expanded["_h"], "inner").drop("_h")
    # exact closed-interval predicate kept for non-hour-aligned buckets
    joined = joined.where(F.col(bucket_col).between(lo, hi))
    t = elapsed_hours(bucket_col, "event_time_utc")
    return joined.withColumn("time_elapsed_hours", t).withColumn(
        "post_event_dummy", (t >= 0).cast("int"))


def event_registry_from_top(df: DataFrame, *, k: int, order_by: list[Column], name: Column,
                            time_col: str) -> DataFrame:
    """Event registry as a top-k selection: bounded by ``k`` rows, which is
    what makes broadcasting it safe (TakeOrderedAndProject)."""
    return df.orderBy(*order_by).limit(k).select(name.alias("event_name"),
                                                 F.col(time_col).alias("event_time_utc"))


def nearest_event_hours(df: DataFrame, ts_col: str, events: DataFrame, *,
                        event_time_col: str = "event_time_utc",
                        out: str = "time_to_nearest_event_hours", buckets: int | None = None) -> DataFrame:
    """JOI-10: absolute distance in hours to the nearest event (either side);
    NULL for a NULL timestamp or when there are no events.

    A range-partitioned as-of merge, both ways and for any number of events:
    the distinct timestamps and events are cut into balanced ranges of time (a
    crowded hour is many ranges), each range is read once forwards and once
    backwards carrying the last event seen, and the events at the ends of the
    ranges are carried from range to range (one row per range). The distances
    are joined back on the timestamp, frequent timestamps by broadcast."""
    micros = F.unix_micros(F.col(ts_col))
    ev = events.where(F.col(event_time_col).isNotNull()).select(
        F.unix_micros(F.col(event_time_col)).alias("_t")).select("_t", F.col("_t").alias("_e"), F.lit(0).alias("_c"))
    ts = df.where(F.col(ts_col).isNotNull()).select(
        micros.alias("_t"), F.lit(None).cast("long").alias("_e"), F.lit(1).alias("_c"))
    moments = cut_lineage(ts.unionByName(ev).groupBy("_t").agg(F.max("_e").alias("_e"), F.sum("_c").alias("_c")))
    ranged = range_buckets(moments, "_t", buckets=buckets)
    # one row per range: the last event before it and the first after it
    ends = ranged.groupBy("_b").agg(F.min("_e").alias("_lo"), F.max("_e").alias("_hi"))
    earlier = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("_b").alias("_eb"), F.last("_hi", True).over(earlier).alias("_prev"),
                       F.last("_lo", True).over(later).alias("_next"))
    # frames from the start only: one to the end would be read anew for every row
    forward = Window.partitionBy("_b").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    backward = Window.partitionBy("_b").orderBy(F.desc("_t")).rowsBetween(Window.unboundedPreceding, 0)
    near = ranged.withColumn("_a", F.last("_e", True).over(forward)).withColumn("_z", F.last("_e", True).over(backward)) \
        .join(ends, F.col("_b") == F.col("_eb")).where("_c > 0")
    before, after = F.coalesce("_a", "_prev"), F.coalesce("_z", "_next")
    near = cut_lineage(near.select(
        "_t", (F.least(F.col("_t") - before, after - F.col("_t")) / float(HOUR_US)).alias(out), "_c"))
    return join_back(df, near, {"_t": micros}, "_c")


def hour_spine_counts(df: DataFrame, ts_col: str, *, unit: str = "hour") -> DataFrame:
    """JOI-11 + DAT-3: per-bucket row counts on a dense spine from the first
    to the last observed bucket; empty buckets get 0 and a missing flag.

    The spine is generated from the (min, max) one-row aggregate, exploded
    with ``sequence`` (its size is the time span in buckets, not the data
    size) and joined to the per-bucket counts.
    """
    step = F.expr("INTERVAL 1 HOUR") if unit == "hour" else F.expr("INTERVAL 1 DAY")
    b = F.date_trunc(unit, F.col(ts_col))
    counts = df.where(F.col(ts_col).isNotNull()).groupBy(b.alias("hour")).agg(
        F.count(F.lit(1)).alias("_n"))
    bounds = counts.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
    spine = bounds.where(F.col("lo").isNotNull()).select(
        F.explode(F.sequence("lo", "hi", step)).alias("hour"))
    return (spine.join(counts, "hour", "left")
            .select("hour", F.coalesce("_n", F.lit(0)).cast("long").alias("tweet_volume"))
            .withColumn("missing_time_bin", F.col("tweet_volume") == 0))
