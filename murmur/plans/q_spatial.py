"""Regional queries: returns mapping, region matrices, representativeness."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from murmur.operators import dedupe as dd
from murmur.operators import spatial as sp
from murmur.plans import bindings as b
from murmur.plans.registry import query, rounded

RETURNS_SQL = """
WITH v AS (SELECT c.c_nationkey, count(CASE WHEN o.o_orderstatus = 'F' THEN 1 END) AS a,
                  count(CASE WHEN o.o_orderstatus = 'O' THEN 1 END) AS b, count(*) AS t
           FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1),
k AS (SELECT c_nationkey, avg(c_acctbal) AS age, max(c_acctbal) AS inc, CAST(count(*) AS DOUBLE) AS urb,
             100.0 * avg(CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.0 END) AS edu,
             100.0 * avg(CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 1.0 ELSE 0.0 END) AS hisp
      FROM customer GROUP BY 1)
SELECT n.n_name AS state_code, v.a AS a_votes, v.b AS b_votes, v.t AS total_votes, v.t - v.a - v.b AS other_votes,
       100.0 * v.a / v.t AS a_vote_share_pct, 100.0 * v.b / v.t AS b_vote_share_pct,
       100.0 * (v.a - v.b) / v.t AS democratic_margin_pct, abs(100.0 * (v.a - v.b) / v.t) AS absolute_margin_pct,
       CASE WHEN v.a - v.b > 0 THEN 'candidate_a' ELSE 'candidate_b' END AS winner,
       CASE WHEN abs(100.0 * (v.a - v.b) / v.t) <= 5.0 THEN 'swing' ELSE 'safe' END AS state_classification,
       5.0 AS swing_threshold_pct,
       CASE n.n_regionkey WHEN 0 THEN 'battleground' WHEN 1 THEN 'battleground' WHEN 2 THEN 'safe_red'
            WHEN 3 THEN 'safe_blue' ELSE 'unknown' END AS historical_classification,
       coalesce(k.age, 0.0) AS median_age, coalesce(k.inc, 0.0) AS median_income,
       coalesce(k.urb, 0.0) AS urbanization_index, coalesce(k.edu, 0.0) AS ba_education_pct,
       coalesce(k.hisp, 0.0) AS hispanic_latino_pct
FROM nation n JOIN v ON n.n_nationkey = v.c_nationkey LEFT JOIN k ON n.n_nationkey = k.c_nationkey"""

POSTS_SQL = """
WITH s AS (SELECT event_id, 0 AS st FROM events WHERE event_type IN ('click', 'view', 'error')
           UNION ALL SELECT event_id, 1 FROM events WHERE event_type IN ('purchase', 'signup', 'error')),
m AS (SELECT event_id, min(st) AS lo, max(st) AS hi FROM s GROUP BY 1)
SELECT e.event_id, e.ts, e.user_id, e.event_type, e.value,
       CAST(json_extract_string(e.props, '$.k') AS DOUBLE) AS props_value,
       CASE WHEN m.lo <> m.hi THEN 'both' WHEN m.lo = 0 THEN 'stream_a_only' ELSE 'stream_b_only' END
         AS stream_membership,
       CASE WHEN m.lo <> m.hi THEN 'both' WHEN m.lo = 0 THEN 'candidate_a' ELSE 'candidate_b' END
         AS candidate_resolved,
       n.n_name AS state_code
FROM m JOIN events e USING (event_id) LEFT JOIN customer c ON e.user_id = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey"""


def _matrix_sql(mode: str, score: str = "value") -> str:
    a = "regexp_matches(lower(cand), 'candidate_a')"
    bb = "regexp_matches(lower(cand), 'candidate_b')"
    if mode == "split":
        a, bb = f"({a} OR cand = 'both')", f"({bb} OR cand = 'both')"
    where = "AND cand <> 'both'" if mode == "primary" else ""
    fill = "coalesce({}, 0)" if mode == "split" else "{}"
    return f"""
WITH p AS ({POSTS_SQL}), r AS ({RETURNS_SQL}),
pp AS (SELECT upper(trim(state_code)) AS rg, candidate_resolved AS cand, event_id, {score} AS value FROM p
       WHERE upper(trim(state_code)) IN (SELECT upper(trim(n_name)) FROM nation) {where}),
m AS (SELECT rg AS state_code, count(CASE WHEN {a} THEN event_id END) AS a_tweet_count,
             count(CASE WHEN {bb} THEN event_id END) AS b_tweet_count,
             coalesce(avg(CASE WHEN {a} THEN value END), 0.0) AS a_mean_sentiment,
             coalesce(avg(CASE WHEN {bb} THEN value END), 0.0) AS b_mean_sentiment
      FROM pp GROUP BY rg HAVING count(CASE WHEN {a} THEN 1 END) > 0 OR count(CASE WHEN {bb} THEN 1 END) > 0)
SELECT r.state_code, r.a_votes, r.b_votes, r.total_votes, r.other_votes, round(r.a_vote_share_pct, 6) AS a_vote_share_pct,
       round(r.b_vote_share_pct, 6) AS b_vote_share_pct, round(r.democratic_margin_pct, 6) AS democratic_margin_pct,
       round(r.absolute_margin_pct, 6) AS absolute_margin_pct, r.winner, r.state_classification,
       r.swing_threshold_pct, r.historical_classification, round(r.median_age, 6) AS median_age,
       round(r.median_income, 6) AS median_income, round(r.urbanization_index, 6) AS urbanization_index,
       round(r.ba_education_pct, 6) AS ba_education_pct, round(r.hispanic_latino_pct, 6) AS hispanic_latino_pct,
       {fill.format('m.a_tweet_count')} AS a_tweet_count, {fill.format('m.b_tweet_count')} AS b_tweet_count,
       round({fill.format('m.a_mean_sentiment')}, 6) AS a_mean_sentiment,
       round({fill.format('m.b_mean_sentiment')}, 6) AS b_mean_sentiment,
       round(coalesce(m.a_mean_sentiment - m.b_mean_sentiment, 0.0), 6) AS state_sentiment_margin_Xi
FROM r LEFT JOIN m USING (state_code)"""


def exact(sql: str) -> str:
    """The same columns before they are rounded for comparison."""
    return re.sub(r"round\((.+?), 6\) AS", r"(\1) AS", sql, flags=re.S)


def _matrix(spark, sf, mode):
    return sp.region_matrix(b.posts(spark, sf), b.returns(spark, sf), region_col="state_code",
                            candidate_col="candidate_resolved", scores="value", regions=b.regions(spark, sf),
                            a_pattern="candidate_a", b_pattern="candidate_b", mode=mode, id_col="event_id")


@query("prj_08_returns_mapping", oracle=f"""
SELECT state_code, a_votes, b_votes, total_votes, other_votes, round(a_vote_share_pct, 6) AS a_vote_share_pct,
       round(b_vote_share_pct, 6) AS b_vote_share_pct, round(democratic_margin_pct, 6) AS democratic_margin_pct,
       round(absolute_margin_pct, 6) AS absolute_margin_pct, winner, state_classification, swing_threshold_pct,
       historical_classification, round(median_age, 6) AS median_age, round(median_income, 6) AS median_income,
       round(urbanization_index, 6) AS urbanization_index, round(ba_education_pct, 6) AS ba_education_pct,
       round(hispanic_latino_pct, 6) AS hispanic_latino_pct FROM ({RETURNS_SQL})""")
def prj_08_returns_mapping(spark, sf):
    return rounded(b.returns(spark, sf))


@query("prj_16_stream_membership", oracle=f"""
SELECT event_id, stream_membership, candidate_resolved, state_code FROM ({POSTS_SQL})""")
def prj_16_stream_membership(spark, sf):
    return b.posts(spark, sf).select("event_id", "stream_membership", "candidate_resolved", "state_code")


@query("agg_12_region_matrix", oracle=_matrix_sql("primary"))
def agg_12_region_matrix(spark, sf):
    return rounded(_matrix(spark, sf, "primary"))


@query("agg_13_region_matrix_split", oracle=_matrix_sql("split"))
def agg_13_region_matrix_split(spark, sf):
    return rounded(_matrix(spark, sf, "split"))


@query("agg_14_classification_lists", oracle=f"""
SELECT list_sort(list(state_code) FILTER (WHERE historical_classification = 'battleground')) AS battleground_states,
       list_sort(list(state_code) FILTER (WHERE historical_classification IN ('safe_red', 'safe_blue'))) AS safe_states
FROM ({RETURNS_SQL})""")
def agg_14_classification_lists(spark, sf):
    return sp.classification_lists(_matrix(spark, sf, "primary"))


_REP_SQL = f"""
WITH p AS ({POSTS_SQL}), r AS ({RETURNS_SQL}),
d AS (SELECT DISTINCT upper(trim(n_name)) AS state_code FROM nation),
t AS (SELECT p.*, upper(trim(p.state_code)) AS rg, upper(trim(p.state_code)) IN (SELECT state_code FROM d) AS mapped FROM p),
per AS (SELECT rg AS state_code, count(*) AS n_tweets, count(DISTINCT user_id) AS n_users FROM t WHERE mapped GROUP BY 1),
x AS (SELECT d.state_code, coalesce(per.n_tweets, 0) AS n_tweets, coalesce(per.n_users, 0) AS n_users, r.total_votes AS v
      FROM d LEFT JOIN per USING (state_code) LEFT JOIN r USING (state_code)),
y AS (SELECT *, sum(n_tweets) OVER () AS g, sum(v) OVER () AS av FROM x),
z AS (SELECT state_code, n_tweets, n_users, CASE WHEN g > 0 THEN n_tweets / g ELSE 0.0 END AS share_of_geocoded,
             CASE WHEN av > 0 THEN coalesce(v, 0) / av ELSE 0.0 END AS share_of_votes FROM y)"""


@query("agg_33_representativeness", oracle=f"""
{_REP_SQL}
SELECT state_code, n_tweets, n_users, round(share_of_geocoded, 6) AS share_of_geocoded,
       round(share_of_votes, 6) AS share_of_votes,
       round(CASE WHEN share_of_votes > 0 THEN share_of_geocoded / share_of_votes ELSE 0.0 END, 6) AS ratio_geo_to_votes,
       n_tweets < 100 AS low_confidence FROM z""")
def agg_33_representativeness(spark, sf):
    per, _ = sp.representativeness(b.posts(spark, sf), b.returns(spark, sf), b.regions(spark, sf),
                                   region_col="state_code", user_col="user_id", score_col="value")
    return rounded(per)


@query("agg_33_representativeness_summary", oracle=f"""
{_REP_SQL}
SELECT round(corr(share_of_geocoded, share_of_votes), 6) AS correlation_geo_vs_votes,
       count(CASE WHEN n_tweets < 100 THEN 1 END) AS low_confidence_states_count,
       (SELECT round(coalesce(avg(CASE WHEN mapped THEN value END), 0.0), 6) FROM t) AS mean_score_geocoded,
       (SELECT round(coalesce(avg(CASE WHEN NOT mapped THEN value END), 0.0), 6) FROM t) AS mean_score_non_geocoded
FROM z""")
def agg_33_representativeness_summary(spark, sf):
    _, summ = sp.representativeness(b.posts(spark, sf), b.returns(spark, sf), b.regions(spark, sf),
                                    region_col="state_code", user_col="user_id", score_col="value")
    return rounded(summ)


@query("agg_36_stream_overlap", oracle="""
WITH a AS (SELECT DISTINCT event_id FROM events WHERE event_type IN ('click', 'view', 'error')),
b AS (SELECT DISTINCT event_id FROM events WHERE event_type IN ('purchase', 'signup', 'error'))
SELECT (SELECT count(*) FROM a) AS ids_a, (SELECT count(*) FROM b) AS ids_b,
       (SELECT count(*) FROM a JOIN b USING (event_id)) AS ids_both,
       round(100.0 * (SELECT count(*) FROM a JOIN b USING (event_id)) / (SELECT count(*) FROM a), 6) AS pct_of_a,
       round(100.0 * (SELECT count(*) FROM a JOIN b USING (event_id)) / (SELECT count(*) FROM b), 6) AS pct_of_b""")
def agg_36_stream_overlap(spark, sf):
    a, bb = b.streams(spark, sf)
    return rounded(dd.overlap_counts(a, bb, "event_id"))


@query("agg_07_daily_volume_by_stream", oracle=f"""
SELECT CAST(ts AS DATE) AS day, candidate_resolved, count(*) AS n FROM ({POSTS_SQL}) GROUP BY 1, 2""")
def agg_07_daily_volume_by_stream(spark, sf):
    p = b.posts(spark, sf)
    return p.groupBy(F.to_date("ts").alias("day"), "candidate_resolved").agg(F.count(F.lit(1)).alias("n"))
