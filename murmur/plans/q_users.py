"""User activity audit queries over the event stream (posts = events)."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.operators import activity as act
from murmur.operators import rank as rk
from murmur.plans import bindings as b
from murmur.plans.registry import query, rounded

METRICS_SQL = """
SELECT user_id, CAST(sum(n) AS BIGINT) AS total_tweets, CAST(count(day) AS INTEGER) AS active_days,
       min(day) AS first_observed_day, max(day) AS last_observed_day,
       CAST(coalesce(max(CASE WHEN day IS NOT NULL THEN n END), 0) AS INTEGER) AS max_tweets_single_day,
       CAST(date_diff('day', min(day), max(day)) + 1 AS INTEGER) AS observed_span_days,
       sum(n) / nullif(count(day), 0) AS tweets_per_active_day,
       sum(n) / nullif(date_diff('day', min(day), max(day)) + 1, 0) AS tweets_per_observed_day
FROM (SELECT coalesce(CAST(user_id AS VARCHAR), '__MISSING_USER_ID__') AS user_id,
             date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2)
GROUP BY 1"""

WIDE_SQL = f"""
WITH m AS ({METRICS_SQL}),
v AS (SELECT CAST(tweets_per_active_day AS DOUBLE) AS x FROM m
      WHERE tweets_per_active_day IS NOT NULL AND tweets_per_active_day >= 0),
q AS (SELECT quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75,
             quantile_cont(x, 0.95) AS p95, quantile_cont(x, 0.975) AS p97_5,
             quantile_cont(x, 0.99) AS p99, quantile_cont(x, 0.995) AS p99_5,
             avg(ln(1 + x)) AS lm, stddev_samp(ln(1 + x)) AS ls FROM v),
d AS (SELECT quantile_cont(abs(v.x - q.q50), 0.5) AS mad FROM v, q)
SELECT p95, p97_5, p99, p99_5, q75 + 1.5 * (q75 - q25) AS iqr_upper_fence,
       q75 + 3.0 * (q75 - q25) AS extreme_iqr_upper_fence, exp(lm + 3.0 * ls) - 1 AS log_z_threshold,
       q50 + 3.0 * 1.4826 * mad AS mad_threshold
FROM q, d"""

LONG_SQL = f"""
WITH w AS ({WIDE_SQL})
SELECT 'p95' AS method, p95 AS threshold FROM w UNION ALL SELECT 'p97_5', p97_5 FROM w
UNION ALL SELECT 'p99', p99 FROM w UNION ALL SELECT 'p99_5', p99_5 FROM w
UNION ALL SELECT 'iqr_upper_fence', iqr_upper_fence FROM w
UNION ALL SELECT 'extreme_iqr_upper_fence', extreme_iqr_upper_fence FROM w
UNION ALL SELECT 'log_z_threshold', log_z_threshold FROM w
UNION ALL SELECT 'mad_threshold', mad_threshold FROM w"""

TRADE_SQL = f"""
WITH m AS ({METRICS_SQL}), t AS ({LONG_SQL}),
tot AS (SELECT count(*) AS users, sum(total_tweets) AS tweets FROM m)
SELECT t.method, t.threshold,
       CAST(count(m.user_id) AS BIGINT) AS users_removed,
       100.0 * count(m.user_id) / any_value(tot.users) AS users_removed_pct,
       CAST(coalesce(sum(m.total_tweets), 0) AS BIGINT) AS tweets_removed,
       100.0 * coalesce(sum(m.total_tweets), 0) / any_value(tot.tweets) AS tweets_removed_pct
FROM t CROSS JOIN tot LEFT JOIN m ON m.tweets_per_active_day > t.threshold
GROUP BY t.method, t.threshold"""

CHOICE_SQL = f"""
WITH tr AS ({TRADE_SQL}),
f AS (SELECT threshold AS mn FROM tr WHERE method = 'p99'),
c AS (SELECT tr.*, users_removed_pct <= 1.0 AND tweets_removed_pct <= 10.0 AS eligible,
             greatest(users_removed_pct - 1.0, 0) + greatest(tweets_removed_pct - 10.0, 0) AS ex
      FROM tr, f WHERE tr.threshold >= f.mn)
SELECT threshold AS selected_threshold, method, eligible FROM c
ORDER BY eligible DESC, CASE WHEN eligible THEN 0 ELSE ex END, threshold, method LIMIT 1"""


def _metrics(spark, sf):
    return act.user_metrics(b.events(spark, sf), "user_id", "ts")


def _audit(spark, sf):
    return act.audit(b.events(spark, sf), "user_id", "ts")


@query("agg_01_user_activity", oracle=f"""
SELECT user_id, total_tweets, active_days, first_observed_day, last_observed_day, max_tweets_single_day,
       observed_span_days, round(tweets_per_active_day, 6) AS tweets_per_active_day,
       round(tweets_per_observed_day, 6) AS tweets_per_observed_day FROM ({METRICS_SQL})""")
def agg_01_user_activity(spark, sf):
    return rounded(_metrics(spark, sf))


@query("agg_02_candidate_thresholds", oracle=f"""
SELECT method, round(threshold, 6) AS threshold FROM ({LONG_SQL})""")
def agg_02_candidate_thresholds(spark, sf):
    return rounded(act.thresholds_long(_audit(spark, sf)[1]))


@query("agg_03_threshold_tradeoffs", oracle=f"""
SELECT method, round(threshold, 6) AS threshold, users_removed, round(users_removed_pct, 6) AS users_removed_pct,
       tweets_removed, round(tweets_removed_pct, 6) AS tweets_removed_pct FROM ({TRADE_SQL})""")
def agg_03_threshold_tradeoffs(spark, sf):
    return rounded(_audit(spark, sf)[2])


@query("agg_04_threshold_choice", oracle=f"""
SELECT round(selected_threshold, 6) AS selected_threshold, method, eligible FROM ({CHOICE_SQL})""")
def agg_04_threshold_choice(spark, sf):
    return rounded(_audit(spark, sf)[3])


@query("flt_01_activity_filter", oracle=f"""
WITH m AS ({METRICS_SQL}), c AS ({CHOICE_SQL}),
hi AS (SELECT m.user_id FROM m, c WHERE m.tweets_per_active_day > c.selected_threshold)
SELECT e.event_id, e.user_id, e.ts, e.event_type, e.value FROM events e
WHERE NOT EXISTS (SELECT 1 FROM hi WHERE hi.user_id = CAST(e.user_id AS VARCHAR))""")
def flt_01_activity_filter(spark, sf):
    m, _, _, choice = _audit(spark, sf)
    ev = b.events(spark, sf).select("event_id", "user_id", "ts", "event_type", "value")
    return act.activity_filter(ev, m, choice, user_col="user_id")


@query("agg_50_approved_tradeoffs", oracle=f"""
WITH tr AS ({TRADE_SQL}), c AS ({CHOICE_SQL})
SELECT tr.method, round(tr.threshold, 6) AS threshold, tr.users_removed,
       round(tr.users_removed_pct, 6) AS users_removed_pct, tr.tweets_removed,
       round(tr.tweets_removed_pct, 6) AS tweets_removed_pct, tr.threshold = c.selected_threshold AS approved,
       'pre-filter user audit' AS provenance FROM tr, c""")
def agg_50_approved_tradeoffs(spark, sf):
    _, _, trade, choice = _audit(spark, sf)
    return rounded(act.approved_tradeoffs(trade, choice))


@query("win_01_user_percentile_rank", oracle=f"""
WITH m AS ({METRICS_SQL}),
r AS (SELECT user_id, tweets_per_active_day AS x,
             rank() OVER (ORDER BY tweets_per_active_day) AS rk,
             count(*) OVER (PARTITION BY tweets_per_active_day) AS c,
             count(tweets_per_active_day) OVER () AS n,
             count(DISTINCT tweets_per_active_day) OVER () AS nd FROM m WHERE tweets_per_active_day IS NOT NULL)
SELECT user_id, CASE WHEN nd = 1 THEN 0.0 ELSE round((rk - 1 + (c + 1) / 2.0) / n, 6) END
         AS user_activity_percentile FROM r""")
def win_01_user_percentile_rank(spark, sf):
    m = _metrics(spark, sf)
    out = rk.percentile_rank(m, act.METRIC, "user_activity_percentile")
    return rounded(out.select("user_id", "user_activity_percentile"))


@query("win_07_activity_ecdf", oracle=f"""
WITH m AS ({METRICS_SQL})
SELECT CAST(total_tweets AS DOUBLE) AS total_tweets, round(cume_dist() OVER (ORDER BY total_tweets), 6) AS ecdf
FROM m QUALIFY row_number() OVER (PARTITION BY total_tweets) = 1""")
def win_07_activity_ecdf(spark, sf):
    rf = rk.rank_frame(_metrics(spark, sf), "total_tweets")
    return rounded(rf.select(F.col("_v").alias("total_tweets"), rk.ecdf(rf).alias("ecdf")))


@query("win_06_lorenz_curve", oracle=f"""
WITH m AS ({METRICS_SQL}),
d AS (SELECT CAST(total_tweets AS DOUBLE) AS v, count(*) AS c FROM m GROUP BY 1)
SELECT v AS total_tweets,
       round(sum(c) OVER (ORDER BY v) / sum(c) OVER (), 6) AS cum_user_share,
       round(sum(v * c) OVER (ORDER BY v) / sum(v * c) OVER (), 6) AS cum_volume_share FROM d""")
def win_06_lorenz_curve(spark, sf):
    return rounded(rk.lorenz(_metrics(spark, sf), "total_tweets"))


@query("agg_25_gini", oracle=f"""
WITH m AS ({METRICS_SQL}),
s AS (SELECT total_tweets AS x, row_number() OVER (ORDER BY total_tweets) AS i, count(*) OVER () AS n FROM m)
SELECT round(CASE WHEN sum(x) > 0 THEN 2.0 * sum(i * x) / (any_value(n) * sum(x)) - (any_value(n) + 1.0) / any_value(n)
            ELSE 0.0 END, 6) AS gini FROM s""")
def agg_25_gini(spark, sf):
    return rounded(rk.gini(_metrics(spark, sf), "total_tweets"))


@query("agg_51_activity_summary", oracle=f"""
WITH m AS ({METRICS_SQL})
SELECT round(max(tweets_per_active_day), 6) AS max_activity, count(*) AS users_measured,
       CAST(sum(total_tweets) AS BIGINT) AS rows_measured,
       round(quantile_cont(tweets_per_active_day, 0.5), 6) AS median_activity FROM m""")
def agg_51_activity_summary(spark, sf):
    return rounded(act.activity_summary(_metrics(spark, sf)))


@query("top_02_top_user_share", oracle=f"""
WITH m AS ({METRICS_SQL}), k AS (SELECT greatest(1, CAST(floor(count(*) * 0.01) AS BIGINT)) AS k FROM m),
t AS (SELECT total_tweets FROM m ORDER BY total_tweets DESC LIMIT (SELECT k FROM k))
SELECT (SELECT k FROM k) AS top_users, CAST(sum(total_tweets) AS DOUBLE) AS top_volume,
       round(sum(total_tweets) / (SELECT sum(total_tweets) FROM m), 6) AS top_share FROM t""")
def top_02_top_user_share(spark, sf):
    return rounded(act.top_share(_metrics(spark, sf)))


@query("agg_49_tail_percentiles", oracle=f"""
WITH m AS ({METRICS_SQL}),
raw AS (SELECT coalesce(CAST(user_id AS VARCHAR), '__MISSING_USER_ID__') AS user_id, ts FROM events
        UNION ALL SELECT coalesce(CAST(user_id AS VARCHAR), '__MISSING_USER_ID__'), ts FROM events
        WHERE event_type = 'error'),
m2 AS (SELECT user_id, sum(n) / nullif(count(day), 0) AS x FROM
       (SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n FROM raw GROUP BY 1, 2) GROUP BY 1)
SELECT 'deduplicated' AS frame, round(quantile_cont(tweets_per_active_day, 0.99), 6) AS p99,
       round(quantile_cont(tweets_per_active_day, 0.995), 6) AS p99_5,
       round(quantile_cont(tweets_per_active_day, 0.999), 6) AS p99_9 FROM m
UNION ALL
SELECT 'double_counted', round(quantile_cont(x, 0.99), 6), round(quantile_cont(x, 0.995), 6),
       round(quantile_cont(x, 0.999), 6) FROM m2""")
def agg_49_tail_percentiles(spark, sf):
    """AGG-49: tail percentiles of the metric on the id-deduplicated rows vs
    the double-counted union of both streams (error rows appear twice)."""
    a, bb = b.streams(spark, sf)
    dbl = act.user_metrics(a.unionByName(bb), "user_id", "ts")
    dedup = _metrics(spark, sf)
    probs = {"p99": 0.99, "p99_5": 0.995, "p99_9": 0.999}
    q1 = rk.quantiles(dedup, act.METRIC, probs).withColumn("frame", F.lit("deduplicated"))
    q2 = rk.quantiles(dbl, act.METRIC, probs).withColumn("frame", F.lit("double_counted"))
    return rounded(q1.unionByName(q2).select("frame", "p99", "p99_5", "p99_9"))


@query("agg_47_distinct_timestamp_activity", oracle="""
SELECT coalesce(CAST(user_id AS VARCHAR), '__MISSING_USER_ID__') AS user_id, count(*) AS total_rows,
       count(DISTINCT ts) AS distinct_timestamps,
       round(count(*) / count(DISTINCT ts), 6) AS rows_per_distinct_timestamp FROM events GROUP BY 1""")
def agg_47_distinct_timestamp_activity(spark, sf):
    """AGG-47: looser activity by distinct exact timestamps."""
    ev = b.events(spark, sf)
    return rounded(ev.groupBy(act.user_identity("user_id").alias("user_id")).agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_distinct("ts").alias("distinct_timestamps"))
        .withColumn("rows_per_distinct_timestamp", F.try_divide(
            F.col("total_rows").cast("double"), F.col("distinct_timestamps"))))
