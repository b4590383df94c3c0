"""Descriptive summary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.operators import activity as act
from murmur.operators import summaries as su
from murmur.plans import bindings as b
from murmur.plans.q_models import RATERS_SQL, _band, _raters
from murmur.plans.q_spatial import POSTS_SQL, RETURNS_SQL
from murmur.plans.q_users import METRICS_SQL
from murmur.plans.registry import query, rounded
from murmur.sources.tables import table


@query("agg_06_ingest_metrics", oracle="""
SELECT count(*) AS rows, min(ts) AS min_time, max(ts) AS max_time, count(DISTINCT event_id) AS distinct_ids,
       count(DISTINCT user_id) AS distinct_users,
       count(CASE WHEN event_id IS NULL THEN 1 END) AS missing_event_id,
       count(CASE WHEN ts IS NULL THEN 1 END) AS missing_ts,
       count(CASE WHEN user_id IS NULL THEN 1 END) AS missing_user_id,
       count(CASE WHEN event_type IS NULL OR length(trim(event_type)) = 0 THEN 1 END) AS missing_event_type,
       count(CASE WHEN value IS NULL THEN 1 END) AS missing_value,
       count(CASE WHEN props IS NULL OR length(trim(props)) = 0 THEN 1 END) AS missing_props,
       count(*) - count(DISTINCT event_id) AS duplicate_id_rows FROM events""")
def agg_06_ingest_metrics(spark, sf):
    return su.ingest_metrics(b.events(spark, sf), id_col="event_id", user_col="user_id", ts_col="ts")


# Fixed binding: readings above 100 count as not taken, the types 'view' and
# 'click' as blank spellings, three users in ten as unknown.
_GAPS = {"event_id": "event_id", "user_id": "CASE WHEN user_id % 10 < 3 THEN NULL ELSE user_id END",
         "value": "CASE WHEN value > 100 THEN NULL ELSE value END",
         "event_type": "CASE event_type WHEN 'view' THEN '  ' WHEN 'click' THEN '' ELSE event_type END"}


@query("agg_28_missing_share", oracle=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(100.0 * avg(CASE WHEN {c} IS NULL{' OR length(trim(event_type)) = 0' * (c == 'event_type')}"
    f" THEN 1.0 ELSE 0.0 END), 6) AS missing_pct FROM (SELECT {', '.join(f'{x} AS {k}' for k, x in _GAPS.items())} FROM events)"
    for c in _GAPS))
def agg_28_missing_share(spark, sf):
    return rounded(su.missing_share(b.events(spark, sf).select(*[F.expr(x).alias(c) for c, x in _GAPS.items()])))


CUTS = [9, 25, 50, 75, 100, 175]
POS = {"p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def _cutoff_sql():
    fixed = " UNION ALL ".join(
        f"SELECT 'cutoff_{c}' AS position, {float(c)} AS value, count(CASE WHEN x > {c} THEN 1 END) AS users_above, "
        f"coalesce(sum(CASE WHEN x > {c} THEN t END), 0) AS rows_above FROM m2" for c in CUTS)
    pos = " UNION ALL ".join(f"SELECT '{k}' AS position, quantile_cont(x, {p}) AS value FROM m2" for k, p in POS.items())
    return f"""
WITH m AS ({METRICS_SQL}), m2 AS (SELECT tweets_per_active_day AS x, total_tweets AS t FROM m),
f AS ({fixed}),
q AS ({pos}),
p AS (SELECT q.position, q.value, count(CASE WHEN m2.x > q.value THEN 1 END) AS users_above,
             coalesce(sum(CASE WHEN m2.x > q.value THEN m2.t END), 0) AS rows_above FROM q, m2 GROUP BY 1, 2),
a AS (SELECT * FROM f UNION ALL SELECT * FROM p)
SELECT position, round(value, 6) AS value, users_above, CAST(rows_above AS BIGINT) AS rows_above,
       round(100.0 * users_above / (SELECT count(*) FROM m2), 6) AS users_above_pct,
       round(100.0 * rows_above / (SELECT sum(t) FROM m2), 6) AS rows_above_pct FROM a"""


@query("agg_05_cutoff_table", oracle=_cutoff_sql())
def agg_05_cutoff_table(spark, sf):
    m = act.user_metrics(b.events(spark, sf), "user_id", "ts")
    return rounded(su.cutoff_table(m, act.METRIC, CUTS, POS))


@query("agg_19_label_summary", oracle=f"""
WITH r AS (SELECT *, {_band('a_score')} AS a_label FROM ({RATERS_SQL}))
SELECT a_label, count(*) AS n, (SELECT count(a_score) FROM r) AS score_n,
       round((SELECT avg(a_score) FROM r), 6) AS score_mean, round((SELECT stddev_samp(a_score) FROM r), 6) AS score_std,
       round((SELECT min(a_score) FROM r), 6) AS score_min, round((SELECT max(a_score) FROM r), 6) AS score_max,
       round(100.0 * count(*) / (SELECT count(*) FROM r), 6) AS pct FROM r GROUP BY a_label""")
def agg_19_label_summary(spark, sf):
    return rounded(su.label_summary(_raters(spark, sf), "a_label", "a_score"))


@query("agg_35_threshold_sensitivity", oracle=f"""
WITH r AS ({RATERS_SQL}), t AS (SELECT unnest([0.0, 0.05, 0.10, 0.20]::DOUBLE[]) AS threshold)
SELECT threshold, round(100.0 * count(CASE WHEN b_score > threshold THEN 1 END) / count(*), 6) AS positive_pct,
       round(100.0 * count(CASE WHEN b_score BETWEEN -threshold AND threshold THEN 1 END) / count(*), 6) AS neutral_pct,
       round(100.0 * count(CASE WHEN b_score < -threshold THEN 1 END) / count(*), 6) AS negative_pct
FROM r, t GROUP BY threshold""")
def agg_35_threshold_sensitivity(spark, sf):
    return rounded(su.threshold_sensitivity(_raters(spark, sf), "b_score"))


@query("agg_38_label_mix_by_group", oracle=f"""
WITH r AS (SELECT *, {_band('b_score')} AS b_label FROM ({RATERS_SQL})),
c AS (SELECT lang, b_label, count(*) AS n FROM r GROUP BY 1, 2)
SELECT lang, b_label, n, round(100.0 * n / sum(n) OVER (PARTITION BY lang), 6) AS pct FROM c""")
def agg_38_label_mix_by_group(spark, sf):
    return rounded(su.share_within(_raters(spark, sf), "lang", "b_label"))


@query("agg_24_corr_matrix", oracle="""
SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem
UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem
UNION ALL SELECT 'l_quantity', 'l_tax', round(corr(l_quantity, l_tax), 6) FROM lineitem
UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem
UNION ALL SELECT 'l_extendedprice', 'l_tax', round(corr(l_extendedprice, l_tax), 6) FROM lineitem
UNION ALL SELECT 'l_discount', 'l_tax', round(corr(l_discount, l_tax), 6) FROM lineitem""")
def agg_24_corr_matrix(spark, sf):
    """AGG-24: pairwise-complete correlation matrix in one aggregate pass."""
    li = table(spark, sf, "lineitem")
    return rounded(su.corr_matrix(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@query("agg_26_period_stream_pivot", oracle=f"""
WITH p AS ({POSTS_SQL}),
d AS (SELECT CAST(ts AS DATE) AS day FROM events WHERE event_type = 'error' ORDER BY value DESC, event_id LIMIT 1),
x AS (SELECT CASE WHEN CAST(p.ts AS DATE) < d.day THEN 'pre' WHEN CAST(p.ts AS DATE) = d.day THEN 'election_day'
                  ELSE 'post' END AS period, candidate_resolved FROM p, d)
SELECT period, count(CASE WHEN candidate_resolved = 'candidate_a' THEN 1 END) AS candidate_a,
       count(CASE WHEN candidate_resolved = 'candidate_b' THEN 1 END) AS candidate_b,
       count(CASE WHEN candidate_resolved = 'both' THEN 1 END) AS both,
       count(*) AS total FROM x GROUP BY period""")
def agg_26_period_stream_pivot(spark, sf):
    """PRJ-15 + AGG-26: pre / day / post of the top registry event x stream."""
    from murmur.operators.common import with_scalars
    day = b.registry(spark, sf).limit(1).select(F.to_date("event_time_utc").alias("_day"))
    p = with_scalars(b.posts(spark, sf), day)
    d = F.to_date("ts")
    p = p.withColumn("period", F.when(d < F.col("_day"), "pre").when(d == F.col("_day"), "election_day")
                     .otherwise("post"))
    return su.pivot_counts(p, "period", "candidate_resolved", ["candidate_a", "candidate_b", "both"])


@query("agg_27_stream_summary", oracle=f"""
SELECT coalesce(candidate_resolved, 'combined') AS candidate_resolved, count(*) AS rows,
       count(DISTINCT user_id) AS users, min(ts) AS first_time, max(ts) AS last_time,
       round(avg(value), 6) AS mean_score
FROM ({POSTS_SQL}) GROUP BY GROUPING SETS ((candidate_resolved), ())""")
def agg_27_stream_summary(spark, sf):
    return rounded(su.stream_summary(b.posts(spark, sf), "candidate_resolved", user_col="user_id", ts_col="ts",
                                     score="value"))


@query("agg_29_activity_describe", oracle=f"""
WITH m AS ({METRICS_SQL})
SELECT count(total_tweets) AS count, round(avg(total_tweets), 6) AS mean, round(stddev_samp(total_tweets), 6) AS std,
       CAST(min(total_tweets) AS BIGINT) AS min, CAST(max(total_tweets) AS BIGINT) AS max,
       round(quantile_cont(total_tweets, 0.25), 6) AS p25, round(quantile_cont(total_tweets, 0.5), 6) AS p50,
       round(quantile_cont(total_tweets, 0.75), 6) AS p75 FROM m""")
def agg_29_activity_describe(spark, sf):
    return rounded(su.describe(act.user_metrics(b.events(spark, sf), "user_id", "ts"), "total_tweets"))


# Fixed binding: users of the regions with key 4 name no location.
_PLACED = "CASE WHEN state_code IN ('NATION_4', 'NATION_9', 'NATION_14', 'NATION_19', 'NATION_24') THEN NULL ELSE state_code END"


@query("agg_30_location_coverage", oracle=f"""
WITH p AS (SELECT candidate_resolved, ts, {_PLACED} AS state_code FROM ({POSTS_SQL}))
SELECT candidate_resolved, CAST(ts AS DATE) AS day, count(*) AS n,
       count(CASE WHEN state_code IS NOT NULL THEN 1 END) AS with_location,
       round(avg(CASE WHEN state_code IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS location_share
FROM p GROUP BY 1, 2""")
def agg_30_location_coverage(spark, sf):
    """AGG-30: location coverage by stream and day."""
    p = b.posts(spark, sf).withColumn("state_code", F.expr(_PLACED))
    has = F.col("state_code").isNotNull()
    return rounded(p.groupBy("candidate_resolved", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(has, 1)).alias("with_location"),
        F.avg(has.cast("double")).alias("location_share")))


@query("agg_31_event_window_counts", oracle=f"""
WITH p AS ({POSTS_SQL}),
r AS (SELECT 'error_' || CAST(event_id AS VARCHAR) AS event_name, ts AS event_time_utc FROM events
      WHERE event_type = 'error' ORDER BY value DESC, event_id LIMIT 4)
SELECT r.event_name, r.event_time_utc, count(p.event_id) AS total,
       count(CASE WHEN p.candidate_resolved = 'candidate_a' THEN 1 END) AS n_candidate_a,
       count(CASE WHEN p.candidate_resolved = 'candidate_b' THEN 1 END) AS n_candidate_b,
       count(CASE WHEN p.candidate_resolved = 'both' THEN 1 END) AS n_both
FROM r LEFT JOIN p ON p.ts BETWEEN r.event_time_utc - INTERVAL 24 HOUR AND r.event_time_utc + INTERVAL 24 HOUR
GROUP BY 1, 2""")
def agg_31_event_window_counts(spark, sf):
    return su.event_window_counts(b.posts(spark, sf), b.registry(spark, sf), ts_col="ts",
                                  stream="candidate_resolved", streams=["candidate_a", "candidate_b", "both"])


@query("agg_32_returns_summary", oracle=f"""
SELECT winner, state_classification, count(*) AS regions, round(avg(democratic_margin_pct), 6) AS mean_margin,
       CAST(sum(total_votes) AS BIGINT) AS total_votes FROM ({RETURNS_SQL}) GROUP BY 1, 2""")
def agg_32_returns_summary(spark, sf):
    """AGG-32: winner x class counts with margin and vote totals."""
    r = b.returns(spark, sf)
    return rounded(r.groupBy("winner", "state_classification").agg(
        F.count(F.lit(1)).alias("regions"), F.avg("democratic_margin_pct").alias("mean_margin"),
        F.sum("total_votes").alias("total_votes")))


@query("agg_40_stream_ratio_by_day", oracle=f"""
WITH p AS ({POSTS_SQL}),
c AS (SELECT CAST(ts AS DATE) AS day, count(CASE WHEN candidate_resolved = 'candidate_a' THEN 1 END) AS candidate_a,
             count(CASE WHEN candidate_resolved = 'candidate_b' THEN 1 END) AS candidate_b FROM p GROUP BY 1)
SELECT day, candidate_a, candidate_b, round(candidate_a * 1.0 / nullif(candidate_b, 0), 6) AS ratio FROM c""")
def agg_40_stream_ratio_by_day(spark, sf):
    return rounded(su.ratio_between(b.posts(spark, sf), F.to_date("ts"), "candidate_resolved", "candidate_a",
                                    "candidate_b"))


@query("agg_41_histogram", oracle="""
WITH r AS (SELECT event_type, value, min(value) OVER (PARTITION BY event_type) AS lo,
                  max(value) OVER (PARTITION BY event_type) AS hi FROM events WHERE value IS NOT NULL),
b AS (SELECT event_type, lo, hi, CASE WHEN hi = lo THEN 0 ELSE least(floor((value - lo) / ((hi - lo) / 60)), 59) END AS bin
      FROM r)
SELECT event_type, CAST(bin AS INTEGER) AS bin, count(*) AS count, round(lo + bin * (hi - lo) / 60, 6) AS bin_start,
       round(lo + (bin + 1) * (hi - lo) / 60, 6) AS bin_end FROM b GROUP BY event_type, bin, lo, hi""")
def agg_41_histogram(spark, sf):
    """AGG-41: 60-bin histogram of the score per stream type."""
    return rounded(su.histogram(b.events(spark, sf), "value", 60, ["event_type"]))


# Fixed binding: the clock of stream b stood still on every third day of a
# month, so those rows have no time.
_CLOCK = "CASE WHEN candidate_resolved = 'candidate_b' AND day(ts) % 3 = 1 THEN NULL ELSE ts END"


@query("agg_45_day_coverage", oracle=f"""
WITH p AS (SELECT candidate_resolved, CAST(CASE WHEN candidate_resolved = 'candidate_b' AND day(ts) % 3 = 1 THEN NULL ELSE ts END AS DATE)
             AS day FROM ({POSTS_SQL})),
d AS (SELECT DISTINCT candidate_resolved, day FROM p WHERE day IS NOT NULL),
s AS (SELECT min(day) AS lo, max(day) AS hi FROM d),
sp AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM s),
e AS (SELECT st.candidate_resolved, sp.day FROM (SELECT DISTINCT candidate_resolved FROM d) st, sp),
m AS (SELECT e.candidate_resolved, list_sort(list(e.day)) AS missing_days FROM e
      LEFT JOIN d ON e.candidate_resolved = d.candidate_resolved AND e.day = d.day WHERE d.day IS NULL GROUP BY 1)
SELECT d.candidate_resolved, count(*) AS present_days, coalesce(any_value(m.missing_days), []) AS missing_days,
       min(d.day) = any_value(s.lo) AS start_matches, max(d.day) = any_value(s.hi) AS end_matches
FROM d LEFT JOIN m USING (candidate_resolved), s GROUP BY d.candidate_resolved""")
def agg_45_day_coverage(spark, sf):
    return su.day_coverage(b.posts(spark, sf).withColumn("ts", F.expr(_CLOCK)), "ts", "candidate_resolved")
