"""Descriptive summaries (AGG-5/6/19/20/21/22/23/24/26/27/28/29/30/31/32/34/35/38/40/41/45).

Each summary is one (or two) aggregate passes; wide per-column summaries
are computed as many aggregates in a single ``agg`` and unpivoted
afterwards, so a table is scanned once regardless of its width.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.operators import rank as rk
from murmur.operators.common import safe_corr, with_scalars


def _blank(c: Column, dtype) -> Column:
    from pyspark.sql import types as T
    if isinstance(dtype, T.StringType):
        return c.isNull() | (F.length(F.trim(c)) == 0)
    return c.isNull()


def ingest_metrics(df: DataFrame, *, id_col: str, user_col: str, ts_col: str, approx: bool = False) -> DataFrame:
    """AGG-6: rows, per-column missing (NULL or blank), time range, distinct
    ids and users, duplicate-id rows - one aggregate. ``approx`` swaps the
    exact distinct counts for HyperLogLog++ (bounded memory per task)."""
    distinct = (lambda c: F.approx_count_distinct(c, 0.01)) if approx else F.count_distinct
    aggs = [F.count(F.lit(1)).alias("rows"), F.min(ts_col).alias("min_time"), F.max(ts_col).alias("max_time"),
            distinct(F.col(id_col)).alias("distinct_ids"), distinct(F.col(user_col)).alias("distinct_users")]
    aggs += [F.count(F.when(_blank(F.col(f.name), f.dataType), 1)).alias(f"missing_{f.name}")
             for f in df.schema.fields]
    s = df.agg(*aggs)
    return s.withColumn("duplicate_id_rows", F.col("rows") - F.col("distinct_ids"))


def missing_share(df: DataFrame) -> DataFrame:
    """AGG-28: percent NULL-or-blank per column, long form."""
    cols = [f.name for f in df.schema.fields]
    s = df.agg(*[(100.0 * F.avg(_blank(F.col(f.name), f.dataType).cast("double"))).alias(f.name)
                 for f in df.schema.fields])
    return s.unpivot([], cols, "column", "missing_pct")


def cutoff_table(metrics: DataFrame, metric: str, cutoffs: Sequence[float], probs: Mapping[str, float],
                 total_col: str = "total_tweets") -> DataFrame:
    """AGG-5: users/rows above fixed cutoffs, and the metric's percentile
    positions; both one-pass conditional aggregates."""
    aggs = [F.count(F.lit(1)).alias("_u"), F.sum(total_col).alias("_t")]
    for i, c in enumerate(cutoffs):
        gt = F.col(metric) > c
        aggs += [F.count(F.when(gt, 1)).alias(f"u{i}"), F.coalesce(F.sum(F.when(gt, F.col(total_col))), F.lit(0))
                 .alias(f"t{i}")]
    s = metrics.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(f"cutoff_{c:g}").alias("position"), F.lit(float(c)).alias("value"),
                                        F.col(f"u{i}").alias("users_above"), F.col(f"t{i}").alias("rows_above"))
                               for i, c in enumerate(cutoffs)]))
    fixed = s.select(rows.alias("r"), "_u", "_t").select(
        "r.*", (100.0 * F.col("r.users_above") / F.col("_u")).alias("users_above_pct"),
        (100.0 * F.col("r.rows_above") / F.col("_t")).alias("rows_above_pct"))
    q = rk.quantiles(metrics, metric, dict(probs))
    ql = q.unpivot([], list(probs), "position", "value")
    j = with_scalars(metrics.select(metric, total_col), ql)
    pos = j.groupBy("position", "value").agg(
        F.count(F.when(F.col(metric) > F.col("value"), 1)).alias("users_above"),
        F.coalesce(F.sum(F.when(F.col(metric) > F.col("value"), F.col(total_col))), F.lit(0)).alias("rows_above"))
    tot = metrics.agg(F.count(F.lit(1)).alias("_u"), F.sum(total_col).alias("_t"))
    pos = with_scalars(pos, tot).select("position", "value", "users_above", "rows_above",
                                        (100.0 * F.col("users_above") / F.col("_u")).alias("users_above_pct"),
                                        (100.0 * F.col("rows_above") / F.col("_t")).alias("rows_above_pct"))
    return fixed.unionByName(pos)


def label_summary(df: DataFrame, label: str, score: str) -> DataFrame:
    """AGG-19: label counts and percentages with the score's moments
    (Spark merges the partial n/sum/sum-of-squares across tasks itself)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    m = df.agg(F.count(F.col(score)).alias("score_n"), F.avg(score).alias("score_mean"),
               F.stddev_samp(score).alias("score_std"), F.min(score).alias("score_min"),
               F.max(score).alias("score_max"), F.count(F.lit(1)).alias("_all"))
    j = with_scalars(c, m)
    return j.withColumn("pct", 100.0 * F.col("n") / F.col("_all")).drop("_all")


def criterion_summary(df: DataFrame, risk_cols: Sequence[str], *, extended: bool = False) -> DataFrame:
    """AGG-20 (available, unavailable, mean, min, max per risk column) and,
    with ``extended``, AGG-21 (median, std, quartiles, share >= 0.5 and
    >= 0.75 over all rows, dominant tier of the mean)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("risk_score"),
                                                  F.col(c).cast("double").alias("v")) for c in risk_cols]))
                     .alias("r")).select("r.*")
    agg = long.groupBy("risk_score").agg(
        F.count("v").alias("available_count"), F.count(F.when(F.col("v").isNull(), 1)).alias("unavailable_count"),
        F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.stddev_samp("v").alias("std"), F.count(F.lit(1)).alias("_rows"),
        F.count(F.when(F.col("v") >= 0.5, 1)).alias("_ge50"), F.count(F.when(F.col("v") >= 0.75, 1)).alias("_ge75"))
    if not extended:
        return agg.select("risk_score", "available_count", "unavailable_count", "mean", "min", "max")
    q = rk.quantiles(long, "v", {"p25": 0.25, "median": 0.5, "p75": 0.75}, ["risk_score"])
    out = agg.join(q, "risk_score", "left")
    tier = (F.when(F.col("mean").isNull(), "unavailable").when(F.col("mean") < 0.25, "low")
            .when(F.col("mean") < 0.5, "moderate").when(F.col("mean") < 0.75, "high").otherwise("severe"))
    return out.select("risk_score", "available_count", "mean", "median", "std", "min", "p25", "p75", "max",
                      F.when(F.col("available_count") > 0, 100.0 * F.col("_ge50") / F.col("_rows"))
                      .alias("high_or_severe_share_pct"),
                      F.when(F.col("available_count") > 0, 100.0 * F.col("_ge75") / F.col("_rows"))
                      .alias("severe_share_pct"), tier.alias("dominant_tier"))


def availability_counts(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """AGG-22: evidence-availability counts (NULL counts as unavailable)."""
    s = df.agg(*[F.count(F.when(F.coalesce(F.col(c), F.lit(False)), 1)).alias(c) for c in flags],
               F.count(F.lit(1)).alias("_rows"))
    return s.unpivot(["_rows"], list(flags), "evidence", "available").select(
        "evidence", "available", (F.col("_rows") - F.col("available")).alias("unavailable"))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AGG-24: pairwise-complete correlations, all pairs in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    s = df.agg(*[safe_corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return s.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                                                 F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs])).alias("r")
                    ).select("r.*")


def pivot_counts(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """AGG-26: row x col counts, listed pivot values (no extra distinct job),
    0-filled, with a row total."""
    p = df.groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1))).na.fill(0, list(values))
    return p.withColumn("total", sum((F.col(v) for v in values), F.lit(0)))


def stream_summary(df: DataFrame, stream: str, *, user_col: str, ts_col: str, score: str) -> DataFrame:
    """AGG-27: per stream and combined, via grouping sets (rollup on one
    column): rows, users, time range, mean score."""
    r = df.rollup(stream).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(user_col).alias("users"),
                              F.min(ts_col).alias("first_time"), F.max(ts_col).alias("last_time"),
                              F.avg(score).alias("mean_score"), F.grouping(stream).alias("_g"))
    return r.select(F.when(F.col("_g") == 1, F.lit("combined")).otherwise(F.col(stream)).alias(stream),
                    "rows", "users", "first_time", "last_time", "mean_score")


def describe(df: DataFrame, col: str) -> DataFrame:
    """AGG-29: count, mean, std, min, quartiles, max (exact quartiles)."""
    s = df.agg(F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
               F.min(col).alias("min"), F.max(col).alias("max"))
    q = rk.quantiles(df, col, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return with_scalars(s, q)


def event_window_counts(posts: DataFrame, events: DataFrame, *, ts_col: str, stream: str,
                        streams: Sequence[str], hours: int = 24, events_bounded: bool = True) -> DataFrame:
    """AGG-31: posts within +-``hours`` of each event (closed interval),
    total and per stream. Range join on raw rows as an equi-join on the hour
    bucket: each event expands to the <= 2*hours+2 hour buckets its window
    touches, then an exact interval filter."""
    ev = events.where(F.col("event_time_utc").isNotNull())
    lo = F.col("event_time_utc") - F.make_dt_interval(hours=F.lit(hours))
    hi = F.col("event_time_utc") + F.make_dt_interval(hours=F.lit(hours))
    exp = ev.select("event_name", "event_time_utc", F.explode(
        F.sequence(F.date_trunc("hour", lo), F.date_trunc("hour", hi), F.expr("INTERVAL 1 HOUR"))).alias("_h"))
    if events_bounded:
        exp = F.broadcast(exp)
    p = posts.where(F.col(ts_col).isNotNull()).withColumn("_h", F.date_trunc("hour", F.col(ts_col)))
    j = p.join(exp, "_h").where(F.col(ts_col).between(
        F.col("event_time_utc") - F.make_dt_interval(hours=F.lit(hours)),
        F.col("event_time_utc") + F.make_dt_interval(hours=F.lit(hours))))
    aggs = [F.count(F.lit(1)).alias("total")] + [F.count(F.when(F.col(stream) == s, 1)).alias(f"n_{s}")
                                                 for s in streams]
    counted = j.groupBy("event_name", "event_time_utc").agg(*aggs)
    return ev.select("event_name", "event_time_utc").join(counted, ["event_name", "event_time_utc"], "left") \
        .na.fill(0, ["total"] + [f"n_{s}" for s in streams])


def threshold_sensitivity(df: DataFrame, score: str, thresholds: Sequence[float] = (0.0, 0.05, 0.10, 0.20)
                          ) -> DataFrame:
    """AGG-35: positive (> t), negative (< -t) and neutral (band inclusive)
    shares for each threshold, one pass over the rows."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, t in enumerate(thresholds):
        aggs += [F.count(F.when(F.col(score) > t, 1)).alias(f"p{i}"), F.count(F.when(F.col(score) < -t, 1))
                 .alias(f"n{i}"), F.count(F.when(F.col(score).between(-t, t), 1)).alias(f"z{i}")]
    s = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"p{i}").alias("_p"),
                                        F.col(f"z{i}").alias("_z"), F.col(f"n{i}").alias("_m"))
                               for i, t in enumerate(thresholds)]))
    return s.select(rows.alias("r"), "_n").select(
        "r.threshold", (100.0 * F.col("r._p") / F.col("_n")).alias("positive_pct"),
        (100.0 * F.col("r._z") / F.col("_n")).alias("neutral_pct"),
        (100.0 * F.col("r._m") / F.col("_n")).alias("negative_pct"))


def share_within(df: DataFrame, group: str, category: str) -> DataFrame:
    """AGG-38: category mix in percent within each group."""
    c = df.groupBy(group, category).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def ratio_between(df: DataFrame, day_col: Column, stream: str, a: str, b: str) -> DataFrame:
    """AGG-40: per-day volume of two streams and their ratio (NULL when the
    denominator is 0)."""
    p = df.groupBy(day_col.alias("day")).pivot(stream, [a, b]).agg(F.count(F.lit(1))).na.fill(0, [a, b])
    return p.withColumn("ratio", F.try_divide(F.col(a).cast("double"), F.when(F.col(b) != 0, F.col(b))))


def histogram(df: DataFrame, value: str, bins: int, group_cols: Sequence[str] = (), *,
              value_range: tuple[float, float] | None = None, density: bool = False) -> DataFrame:
    """AGG-41: fixed-width histogram (numpy semantics: last bin closed;
    values outside an explicit range dropped), per group. Range bounds come
    from one aggregate when not given."""
    g = list(group_cols)
    v = F.col(value).cast("double")
    base = df.select(*g, v.alias("_v")).where(F.col("_v").isNotNull())
    if value_range is None:
        rng = base.groupBy(*g).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        base = base.join(rng, g) if g else with_scalars(base, rng)
    else:
        base = base.withColumns({"_lo": F.lit(float(value_range[0])), "_hi": F.lit(float(value_range[1]))})
        base = base.where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(bins - 1))).cast("int")
    h = base.groupBy(*g, b.alias("bin"), F.col("_lo"), F.col("_hi")).agg(F.count(F.lit(1)).alias("count"))
    h = h.withColumns({"bin_start": F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins,
                       "bin_end": F.col("_lo") + (F.col("bin") + 1) * (F.col("_hi") - F.col("_lo")) / bins})
    if density:
        tot = Window.partitionBy(*g) if g else Window.partitionBy()
        h = h.withColumn("density", F.col("count") / F.sum("count").over(tot)
                         / ((F.col("_hi") - F.col("_lo")) / bins))
    return h.drop("_lo", "_hi")


def day_coverage(df: DataFrame, ts_col: str, stream: str) -> DataFrame:
    """AGG-45 + SET-4: per stream, present days, missing days in the overall
    date span (spine anti join; the list is bounded by the span in days),
    and whether the stream starts / ends on the overall first / last day."""
    days = df.select(stream, F.to_date(ts_col).alias("day")).where(F.col("day").isNotNull()).distinct()
    span = days.agg(F.min("day").alias("_lo"), F.max("day").alias("_hi"))
    spine = span.select(F.explode(F.sequence("_lo", "_hi")).alias("day"))
    streams = days.select(stream).distinct()
    # expected (stream, day) pairs: streams x span days, both small
    expected = with_scalars(streams, spine.agg(F.collect_list("day").alias("_days"))).select(
        stream, F.explode("_days").alias("day"))
    missing = expected.join(days, [stream, "day"], "left_anti").groupBy(stream).agg(
        F.array_sort(F.collect_list("day")).alias("missing_days"))
    present = days.groupBy(stream).agg(F.count(F.lit(1)).alias("present_days"), F.min("day").alias("_first"),
                                       F.max("day").alias("_last"))
    out = with_scalars(present.join(missing, stream, "left"), span)
    return out.select(stream, "present_days",
                      F.coalesce("missing_days", F.array().cast("array<date>")).alias("missing_days"),
                      (F.col("_first") == F.col("_lo")).alias("start_matches"),
                      (F.col("_last") == F.col("_hi")).alias("end_matches"))


def irony_profile(df: DataFrame, prob: str, score: str, groups: Mapping[str, str], *, high: float = 0.5,
                  very_high: float = 0.7) -> DataFrame:
    """AGG-34: rows, shares above two levels of a probability, and the mean
    score above and up to the first (0 where there are none), overall and for
    each named grouping, from one pass (grouping sets)."""
    p = F.col(prob)
    cells = F.array(F.struct(F.lit("overall").alias("scope"), F.lit("all").alias("group")), *[
        F.struct(F.lit(k).alias("scope"), F.col(c).cast("string").alias("group")) for k, c in groups.items()])
    return df.select(p.alias("_p"), F.col(score).alias("_s"), F.explode(cells).alias("_c")).groupBy(
        F.col("_c.scope").alias("scope"), F.col("_c.group").alias("group")).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("_p") > high).cast("double")).alias("share_high"),
        F.avg((F.col("_p") > very_high).cast("double")).alias("share_very_high"),
        F.coalesce(F.avg(F.when(F.col("_p") > high, F.col("_s"))), F.lit(0.0)).alias("mean_score_high"),
        F.coalesce(F.avg(F.when(F.col("_p") <= high, F.col("_s"))), F.lit(0.0)).alias("mean_score_low"))
