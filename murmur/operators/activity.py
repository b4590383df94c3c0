"""User activity audit (AGG-1..5, AGG-47/49/50/51, FLT-1/1b, PRJ-20, TOP-2).

The audit's output is a data-dependent scalar (the selected threshold).
It never leaves Spark: thresholds, trade-offs and the choice are small
frames, and the filter joins the one-row choice back by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.operators.common import with_scalars
from murmur.operators.rank import quantiles, rank_frame

MISSING_USER = "__MISSING_USER_ID__"
METRIC = "tweets_per_active_day"
# Candidate threshold methods, in reporting order.
METHODS = ["p95", "p97_5", "p99", "p99_5", "iqr_upper_fence", "extreme_iqr_upper_fence",
           "log_z_threshold", "mad_threshold"]


def user_identity(c) -> Column:
    """PRJ-20: cast to string; NULL -> the missing-user literal."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(col.cast("string"), F.lit(MISSING_USER))


def user_metrics(df: DataFrame, user_col: str = "user_id", ts_col: str = "date") -> DataFrame:
    """AGG-1: one row per (normalised) user.

    Two-level aggregation instead of totals-join-activity: (user, day) counts
    with NULL-time rows under a NULL day, then per user. Hot users collapse
    in the map-side partial aggregate of the first level."""
    for c in (user_col, ts_col):
        if c not in df.columns:
            raise ValueError(f"required activity-audit column missing: {c}")
    day = F.date_trunc("day", F.col(ts_col))
    per_day = df.groupBy(user_identity(user_col).alias(user_col), day.alias("_day")).agg(
        F.count(F.lit(1)).alias("_n"))
    m = per_day.groupBy(user_col).agg(
        F.sum("_n").alias("total_tweets"),
        F.count("_day").cast("int").alias("active_days"),
        F.min("_day").alias("first_observed_day"),
        F.max("_day").alias("last_observed_day"),
        F.coalesce(F.max(F.when(F.col("_day").isNotNull(), F.col("_n"))), F.lit(0)).cast("int")
        .alias("max_tweets_single_day"))
    span = (F.datediff(F.to_date("last_observed_day"), F.to_date("first_observed_day")) + 1).cast("int")
    return (m.withColumn("observed_span_days", span)
            .withColumn(METRIC, F.try_divide(F.col("total_tweets").cast("double"),
                                             F.when(F.col("active_days") != 0, F.col("active_days"))))
            .withColumn("tweets_per_observed_day", F.try_divide(
                F.col("total_tweets").cast("double"), F.when(F.col("observed_span_days") != 0,
                                                             F.col("observed_span_days")))))


def candidate_thresholds(metrics: DataFrame, metric: str = METRIC) -> DataFrame:
    """AGG-2: the eight candidates as one wide row (columns = METHODS).

    Exact quantiles come from the shared rank frame; MAD needs the median
    first, so it is a second (distinct-value) pass over |x - median|."""
    vals = metrics.select(F.col(metric).cast("double").alias("_x")).where(
        F.col("_x").isNotNull() & (F.col("_x") >= 0))
    q = quantiles(vals, "_x", {"q25": 0.25, "q50": 0.5, "q75": 0.75, "p95": 0.95, "p97_5": 0.975,
                                "p99": 0.99, "p99_5": 0.995})
    logs = vals.agg(F.avg(F.log1p("_x")).alias("_lm"), F.stddev_samp(F.log1p("_x")).alias("_ls"),
                    F.count(F.lit(1)).alias("_nn"))
    dev = with_scalars(vals, q.select("q50")).select(F.abs(F.col("_x") - F.col("q50")).alias("_d"))
    mad = quantiles(dev, "_d", {"mad": 0.5})
    one = with_scalars(with_scalars(logs, q), mad)
    iqr = F.col("q75") - F.col("q25")
    return one.where(F.col("_nn") > 0).select(
        "p95", "p97_5", "p99", "p99_5",
        (F.col("q75") + 1.5 * iqr).alias("iqr_upper_fence"),
        (F.col("q75") + 3.0 * iqr).alias("extreme_iqr_upper_fence"),
        F.expm1(F.col("_lm") + 3.0 * F.col("_ls")).alias("log_z_threshold"),
        (F.col("q50") + 3.0 * 1.4826 * F.col("mad")).alias("mad_threshold"))


def thresholds_long(wide: DataFrame) -> DataFrame:
    """(method, threshold) rows in METHODS order."""
    return wide.unpivot([], METHODS, "method", "threshold")


def tradeoffs(metrics: DataFrame, wide: DataFrame, metric: str = METRIC) -> DataFrame:
    """AGG-3: users/tweets removed per candidate, counts and percentages.

    One pass over the users with 16 conditional sums (thresholds arrive as
    columns of a broadcast one-row frame), then an unpivot of 8 rows."""
    j = with_scalars(metrics, wide)
    aggs = [F.count(F.lit(1)).alias("_users"), F.sum("total_tweets").alias("_tweets")]
    for m in METHODS:
        gt = F.col(metric) > F.col(m)
        aggs += [F.count(F.when(gt, 1)).alias(f"u_{m}"),
                 F.coalesce(F.sum(F.when(gt, F.col("total_tweets"))), F.lit(0)).alias(f"t_{m}"),
                 F.first(F.col(m)).alias(f"th_{m}")]
    s = j.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"th_{m}").alias("threshold"),
                                        F.col(f"u_{m}").alias("users_removed"),
                                        F.col(f"t_{m}").alias("tweets_removed")) for m in METHODS]))
    out = s.select(rows.alias("r"), "_users", "_tweets").select("r.*", "_users", "_tweets")
    return out.select(
        "method", "threshold", F.col("users_removed").cast("long").alias("users_removed"),
        (100.0 * F.col("users_removed") / F.col("_users")).alias("users_removed_pct"),
        F.col("tweets_removed").cast("long").alias("tweets_removed"),
        (100.0 * F.col("tweets_removed") / F.col("_tweets")).alias("tweets_removed_pct"))


def select_threshold(trade: DataFrame, *, minimum: str = "p99", max_users_pct: float = 1.0,
                     max_tweets_pct: float = 10.0) -> DataFrame:
    """AGG-4: smallest candidate >= the minimum percentile meeting both
    safeguards; else least combined exceedance; ties by threshold, method.
    One row: selected_threshold, method, eligible."""
    floor_ = trade.where(F.col("method") == minimum).select(F.col("threshold").alias("_min"))
    t = with_scalars(trade, floor_).where(F.col("threshold") >= F.col("_min"))
    eligible = (F.col("users_removed_pct") <= max_users_pct) & (F.col("tweets_removed_pct") <= max_tweets_pct)
    exceed = (F.greatest(F.col("users_removed_pct") - max_users_pct, F.lit(0.0))
              + F.greatest(F.col("tweets_removed_pct") - max_tweets_pct, F.lit(0.0)))
    return (t.select("method", "threshold", eligible.alias("eligible"), exceed.alias("_ex"))
            .orderBy(F.col("eligible").desc(), F.when(F.col("eligible"), 0.0).otherwise(F.col("_ex")),
                     "threshold", "method")
            .limit(1)
            .select(F.col("threshold").alias("selected_threshold"), "method", "eligible"))


def activity_filter(df: DataFrame, metrics: DataFrame, choice: DataFrame, *, user_col: str = "user_id",
                    normalise_ids: bool = False, metric: str = METRIC) -> DataFrame:
    """FLT-1 / FLT-1b: drop every row of users whose metric exceeds the
    selected threshold. ``normalise_ids`` (v1) treats missing users as one
    user; the default (v2/v3) compares raw ids so missing-user rows stay."""
    high = (with_scalars(metrics, choice.select("selected_threshold"))
            .where(F.col(metric) > F.col("selected_threshold")).select(F.col(user_col).alias("_hu")))
    key = user_identity(user_col) if normalise_ids else F.col(user_col).cast("string")
    return df.join(high, key == F.col("_hu"), "left_anti")


def approved_tradeoffs(trade: DataFrame, choice: DataFrame) -> DataFrame:
    """AGG-50: trade-off table with approved flag and provenance."""
    return (with_scalars(trade, choice.select("selected_threshold"))
            .withColumn("approved", F.col("threshold") == F.col("selected_threshold"))
            .withColumn("provenance", F.lit("pre-filter user audit")).drop("selected_threshold"))


def activity_summary(metrics: DataFrame, metric: str = METRIC) -> DataFrame:
    """AGG-51: median and max activity, users and rows measured."""
    q = quantiles(metrics, metric, {"median_activity": 0.5})
    s = metrics.agg(F.max(metric).alias("max_activity"), F.count(F.lit(1)).alias("users_measured"),
                    F.sum("total_tweets").alias("rows_measured"))
    return with_scalars(s, q)


def top_share(metrics: DataFrame, share: float = 0.01, value: str = "total_tweets") -> DataFrame:
    """TOP-2 / AGG-29: share of volume held by the top ``max(1, int(n*share))``
    users. The cut is the k-th largest value (from the rank frame); ties at
    the cut are counted fractionally so the sum equals the top-k sum."""
    rf = rank_frame(metrics, value, with_weight=True)
    n = F.col("_n")
    k = F.greatest(F.lit(1), F.floor(n * share)).cast("long")
    above = n - F.col("_below") - F.col("_c")          # rows strictly larger
    take = F.least(F.col("_c"), F.greatest(k - above, F.lit(0)))
    s = rf.agg(F.sum(take * F.col("_v")).alias("top_volume"), F.first("_wsum").alias("_all"),
               F.first(k).alias("top_users"))
    return s.select("top_users", "top_volume", (F.col("top_volume") / F.col("_all")).alias("top_share"))


def audit(df: DataFrame, user_col: str = "user_id", ts_col: str = "date", *, minimum: str = "p99",
          max_users_pct: float = 1.0, max_tweets_pct: float = 10.0, materialise: bool = True):
    """AGG-1..4 in one call: (metrics, wide thresholds, trade-offs, choice).

    The per-user metrics feed five consumers (quantiles, log moments, MAD,
    trade-offs, the filter); they are checkpointed once so the posts are
    scanned once, not five times."""
    from murmur.session import cut_lineage
    keep = cut_lineage if materialise else (lambda x: x)
    m = keep(user_metrics(df, user_col, ts_col))
    # the one-row thresholds and the 8-row trade-off table are each read by
    # several consumers: materialise them so their quantile passes run once
    wide = keep(candidate_thresholds(m))
    trade = keep(tradeoffs(m, wide))
    choice = keep(select_threshold(trade, minimum=minimum, max_users_pct=max_users_pct,
                                   max_tweets_pct=max_tweets_pct))
    return m, wide, trade, choice
