"""Temporal queries: matrices, event windows, spine, nearest event."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.operators import temporal as tm
from murmur.plans import bindings as b
from murmur.plans.registry import query, rounded

_HOURLY_SQL = """
SELECT date_trunc('hour', ts) AS timestamp_hourly, count(event_id) AS volume,
       avg(value) AS mean_sentiment, coalesce(stddev_samp(value), 0) AS std_sentiment
FROM events WHERE ts IS NOT NULL GROUP BY 1"""

_REGISTRY_SQL = """
SELECT 'error_' || CAST(event_id AS VARCHAR) AS event_name, ts AS event_time_utc
FROM events WHERE event_type = 'error' ORDER BY value DESC, event_id LIMIT 4"""


def _windows(spark, sf):
    m = tm.time_matrix(b.events(spark, sf), "ts", "value", id_col="event_id")
    return tm.event_windows(m, b.registry(spark, sf), hours=48, events_bounded=True)


@query("joi_09_event_windows", oracle=f"""
WITH m AS ({_HOURLY_SQL}), r AS ({_REGISTRY_SQL})
SELECT m.timestamp_hourly, m.volume, round(m.mean_sentiment, 6) AS mean_sentiment,
       round(m.std_sentiment, 6) AS std_sentiment, r.event_name, r.event_time_utc,
       round((epoch_us(m.timestamp_hourly) - epoch_us(r.event_time_utc)) / 3600000000.0, 6)
         AS time_elapsed_hours,
       CAST(m.timestamp_hourly >= r.event_time_utc AS INTEGER) AS post_event_dummy
FROM m JOIN r ON m.timestamp_hourly BETWEEN r.event_time_utc - INTERVAL 48 HOUR
                                        AND r.event_time_utc + INTERVAL 48 HOUR""")
def joi_09_event_windows(spark, sf):
    return rounded(_windows(spark, sf))


@query("agg_09_hourly_matrix", oracle=f"""
SELECT timestamp_hourly, volume, round(mean_sentiment, 6) AS mean_sentiment,
       round(std_sentiment, 6) AS std_sentiment FROM ({_HOURLY_SQL})""")
def agg_09_hourly_matrix(spark, sf):
    return rounded(tm.time_matrix(b.events(spark, sf), "ts", "value", id_col="event_id"))


@query("agg_10_daily_matrix", oracle="""
SELECT date_trunc('day', ts) AS timestamp_daily, count(event_id) AS volume,
       round(avg(value), 6) AS mean_sentiment, round(coalesce(stddev_samp(value), 0), 6) AS std_sentiment
FROM events WHERE ts IS NOT NULL GROUP BY 1""")
def agg_10_daily_matrix(spark, sf):
    return rounded(tm.time_matrix(b.events(spark, sf), "ts", "value", unit="day", id_col="event_id"))


# Second score: the numeric member of the JSON ``props`` payload (JSN path).
@query("agg_11_two_score_hourly", oracle="""
SELECT date_trunc('hour', ts) AS timestamp_hourly, count(event_id) AS volume,
       round(avg(value), 6) AS mean_sentiment_value,
       round(coalesce(stddev_samp(value), 0), 6) AS std_sentiment_value,
       round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS mean_sentiment_props,
       round(coalesce(stddev_samp(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 0), 6) AS std_sentiment_props
FROM events WHERE ts IS NOT NULL GROUP BY 1""")
def agg_11_two_score_hourly(spark, sf):
    ev = b.events(spark, sf).withColumn(
        "props_k", F.get_json_object("props", "$.k").cast("double"))
    return rounded(tm.time_matrix(ev, "ts", {"value": "value", "props": "props_k"}, id_col="event_id"))


@query("joi_11_hour_spine", oracle="""
WITH c AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1),
s AS (SELECT unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM c)
SELECT s.hour, CAST(coalesce(c.n, 0) AS BIGINT) AS tweet_volume, coalesce(c.n, 0) = 0 AS missing_time_bin
FROM s LEFT JOIN c USING (hour)""")
def joi_11_hour_spine(spark, sf):
    return tm.hour_spine_counts(b.events(spark, sf), "ts")


@query("joi_10_nearest_event", oracle=f"""
WITH r AS ({_REGISTRY_SQL})
SELECT e.event_id,
       round(min(abs(epoch_us(e.ts) - epoch_us(r.event_time_utc))) / 3600000000.0, 6)
         AS time_to_nearest_event_hours
FROM events e, r GROUP BY e.event_id""")
def joi_10_nearest_event(spark, sf):
    ev = b.events(spark, sf).select("event_id", "ts")
    return rounded(tm.nearest_event_hours(ev, "ts", b.registry(spark, sf)).drop("ts"))
