"""Filters on accounts, required fields, orders of reports, language shares by
region, the irony profile and agreement by day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from murmur.operators import activity as act
from murmur.operators import cleaning as cl
from murmur.operators import schema as sc
from murmur.operators import sentiment as se
from murmur.operators import spatial as sp
from murmur.operators import stats as st
from murmur.operators import summaries as su
from murmur.plans import bindings as b
from murmur.plans.q_geo import profiles
from murmur.plans.q_models import _agreement_sql, _raters, _stand_in_sql, RATERS_SQL
from murmur.plans.q_spatial import POSTS_SQL, RETURNS_SQL, _REP_SQL, exact
from murmur.plans.q_temporal import _windows
from murmur.plans.registry import query, rounded
from murmur.sources.tables import table

# ---- FLT-1..3: account rules ---------------------------------------------
# Fixed binding: a third of the users have no id; accounts were made up to 80
# days before the first of January; some bot scores are no numbers.
_ACCOUNTS = {"user_id": "CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END",
             "created": "CASE WHEN user_id % 7 = 0 THEN 'unknown' ELSE CAST(DATE '2023-10-20' + CAST(user_id % 80 AS INT) AS {text}) END",
             "bot": "CASE WHEN event_id % 9 = 0 THEN 'n/a' WHEN event_id % 10 = 0 THEN NULL ELSE CAST(event_id % 100 / 100.0 AS {text}) END"}
_TEST_DAY = dt.datetime(2024, 1, 1)


@query("flt_01_missing_users_are_one", oracle=f"""
WITH e AS (SELECT event_id, {_ACCOUNTS['user_id']} AS user_id, ts FROM events),
m AS (SELECT coalesce(CAST(user_id AS VARCHAR), '__MISSING_USER_ID__') AS u,
             count(*) * 1.0 / count(DISTINCT date_trunc('day', ts)) AS x FROM e GROUP BY 1),
t AS (SELECT quantile_cont(x, 0.9) AS cut FROM m)
SELECT event_id, user_id FROM e WHERE coalesce(CAST(user_id AS VARCHAR), '__MISSING_USER_ID__') NOT IN (SELECT u FROM m, t WHERE x > cut)""")
def flt_01_missing_users_are_one(spark, sf):
    """FLT-1 + PRJ-20: the activity filter on normalised ids (rows without a
    user are one very active user) at the 90th percentile."""
    from murmur.operators.rank import quantiles
    e = b.events(spark, sf).select("event_id", F.expr(_ACCOUNTS["user_id"]).alias("user_id"), "ts")
    m = act.user_metrics(e, "user_id", "ts")
    cut = quantiles(m, act.METRIC, {"selected_threshold": 0.9})
    return act.activity_filter(e, m, cut, normalise_ids=True).select("event_id", "user_id")


@query("flt_02_03_account_rules", oracle=f"""
WITH e AS (SELECT event_id, try_cast({_ACCOUNTS['created'].format(text='VARCHAR')} AS TIMESTAMP) AS created,
             try_cast({_ACCOUNTS['bot'].format(text='VARCHAR')} AS DOUBLE) AS bot FROM events)
SELECT event_id, created IS NULL OR created <= TIMESTAMP '2023-12-02' AS old_enough, bot IS NULL OR bot < 0.8 AS no_bot
FROM e""")
def flt_02_03_account_rules(spark, sf):
    """FLT-2/3: account age (30 days before the day) and bot score, unknown
    values kept, bad values unknown."""
    e = b.events(spark, sf).select("event_id", *[F.expr(_ACCOUNTS[c].format(text="STRING")).alias(c) for c in ("created", "bot")])
    return e.select("event_id", cl.account_age_ok("created", election_date=_TEST_DAY).alias("old_enough"),
                    cl.bot_score_ok("bot", 0.8).alias("no_bot"))


# ---- PRJ-9 -----------------------------------------------------------------
# Fixed binding: customers of some keys come with a blank name, a negative or
# broken count, or counts that do not add up.
_COUNTS = {"name": "CASE WHEN c_custkey % 11 = 0 THEN '   ' ELSE '  ' || c_name || ' ' END",
           "a": "CASE c_custkey % 13 WHEN 0 THEN '-4' WHEN 1 THEN '1.5' WHEN 2 THEN NULL ELSE CAST(c_custkey AS {text}) END",
           "b": "CAST(c_nationkey AS {text})", "total": "CAST(c_custkey + c_nationkey - CASE WHEN c_custkey % 17 = 0 THEN 1 + c_nationkey ELSE 0 END AS {text})"}


@query("prj_09_required_fields", oracle=f"""
WITH c AS (SELECT c_custkey, {', '.join(f"{x.format(text='VARCHAR')} AS {k}" for k, x in _COUNTS.items())} FROM customer),
n AS (SELECT *, try_cast(CASE WHEN regexp_full_match(trim(a), '[+-]?[0-9]+') THEN a END AS BIGINT) AS na, try_cast(b AS BIGINT) AS nb,
        try_cast(total AS BIGINT) AS nt FROM c),
f AS (SELECT *, CASE WHEN trim(name) = '' OR name IS NULL THEN 'name: text required' WHEN na IS NULL OR na < 0 THEN 'a: count required'
        WHEN nb IS NULL OR nb < 0 THEN 'b: count required' WHEN nt IS NULL OR nt < 0 THEN 'total: count required'
        WHEN na + nb > nt THEN 'total: less than its parts' END AS fault FROM n)
SELECT coalesce(fault, 'accepted') AS fault, count(*) AS n, sum(CASE WHEN fault IS NULL THEN nt END)::BIGINT AS total,
  min(CASE WHEN fault IS NULL THEN trim(name) END) AS first_name FROM f GROUP BY 1""")
def prj_09_required_fields(spark, sf):
    """PRJ-9: required texts and counts, parts that fit their total; rows with
    a fault are split off with the reason."""
    c = table(spark, sf, "customer").select("c_custkey", *[F.expr(x.format(text="STRING")).alias(k) for k, x in _COUNTS.items()])
    good, bad = sc.required_fields(c, texts=["name"], counts=["a", "b", "total"], parts={"total": ["a", "b"]})
    g = good.groupBy(F.lit("accepted").alias("fault")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("total").alias("total"), F.min("name").alias("first_name"))
    z = bad.groupBy("fault").agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("long").alias("total"),
                                 F.lit(None).cast("string").alias("first_name"))
    return g.unionByName(z)


# ---- JOI-7, SRT-1, SRT-2 ----------------------------------------------------
_SHARES_SQL = f"""
WITH l AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'en' WHEN 'AUTOMOBILE' THEN 'es' WHEN 'HOUSEHOLD' THEN 'fr'
             WHEN 'MACHINERY' THEN 'und' END AS lang FROM customer),
s AS (SELECT p.state_code, count(*) AS n_tweets, count(CASE WHEN l.lang = 'es' THEN 1 END) AS n_spanish
      FROM ({POSTS_SQL}) p LEFT JOIN l ON l.c_custkey = p.user_id WHERE p.state_code IS NOT NULL AND p.state_code <> '' GROUP BY 1)
SELECT s.state_code, n_tweets, n_spanish, n_spanish * 100.0 / n_tweets AS spanish_share_pct, r.hispanic_latino_pct
FROM s JOIN ({RETURNS_SQL}) r ON r.state_code = s.state_code WHERE n_tweets >= 100"""


@query("joi_07_language_share_demographics", oracle=f"""
WITH m AS ({_SHARES_SQL})
SELECT state_code, n_tweets, n_spanish, round(spanish_share_pct, 6) AS spanish_share_pct, round(hispanic_latino_pct, 6) AS hispanic_latino_pct,
  round(regr_intercept(spanish_share_pct, hispanic_latino_pct) OVER () + regr_slope(spanish_share_pct, hispanic_latino_pct) OVER ()
        * hispanic_latino_pct, 6) AS fitted_share_pct, round(corr(hispanic_latino_pct, spanish_share_pct) OVER (), 6) AS pearson_r
FROM m""")
def joi_07_language_share_demographics(spark, sf):
    """JOI-7: Spanish share of each region's posts, inner join with the
    region's demographics (at least 100 posts), fit line and correlation."""
    users = profiles(spark, sf).select(F.col("user_id").alias("_u"), "lang")
    p = b.posts(spark, sf).where("state_code IS NOT NULL AND state_code <> ''")
    m = sp.language_by_region(p.join(users, F.col("user_id") == F.col("_u"), "left"), b.returns(spark, sf), region_col="state_code",
                              lang_col="lang", lang="es", share="spanish_share_pct", demographic="hispanic_latino_pct", min_rows=100)
    return rounded(m.withColumnRenamed("n_lang", "n_spanish"))


@query("srt_01_event_hours_in_order", oracle="""
WITH r AS (SELECT 'error_' || CAST(event_id AS VARCHAR) AS event_name, ts AS event_time_utc FROM events
           WHERE event_type = 'error' ORDER BY value DESC, event_id LIMIT 4),
m AS (SELECT DISTINCT date_trunc('hour', ts) AS hour FROM events WHERE ts IS NOT NULL),
w AS (SELECT r.*, m.hour FROM m JOIN r ON m.hour BETWEEN r.event_time_utc - INTERVAL 48 HOUR AND r.event_time_utc + INTERVAL 48 HOUR)
SELECT dense_rank() OVER (ORDER BY event_time_utc, event_name) AS event_place, event_name, hour AS timestamp_hourly,
  row_number() OVER (PARTITION BY event_name ORDER BY hour) AS hour_place FROM w""")
def srt_01_event_hours_in_order(spark, sf):
    """SRT-1: events by time, and the hours of each event's window in order."""
    w = _windows(spark, sf)
    events = w.select("event_name", "event_time_utc").distinct().withColumn(
        "event_place", F.row_number().over(Window.orderBy("event_time_utc", "event_name")))  # one row per event
    hours = Window.partitionBy("event_name").orderBy("timestamp_hourly")
    return w.join(events.drop("event_time_utc"), "event_name").select(
        F.col("event_place").cast("long"), "event_name", "timestamp_hourly", F.row_number().over(hours).cast("long").alias("hour_place"))


@query("srt_02_representativeness_order", oracle=f"""
{_REP_SQL}
SELECT row_number() OVER (ORDER BY CASE WHEN share_of_votes > 0 THEN share_of_geocoded / share_of_votes ELSE 0.0 END DESC, state_code) AS place,
  state_code, round(CASE WHEN share_of_votes > 0 THEN share_of_geocoded / share_of_votes ELSE 0.0 END, 6) AS ratio_geo_to_votes FROM z""")
def srt_02_representativeness_order(spark, sf):
    """SRT-2: regions, the most over-represented first."""
    per, _ = sp.representativeness(b.posts(spark, sf), b.returns(spark, sf), b.regions(spark, sf),
                                   region_col="state_code", user_col="user_id", score_col="value")
    order = Window.orderBy(F.desc("ratio_geo_to_votes"), "state_code")  # one row per region
    return rounded(per.select(F.row_number().over(order).cast("long").alias("place"), "state_code", "ratio_geo_to_votes"))


# ---- AGG-34 -----------------------------------------------------------------
# Fixed binding: how some turns end, so that the stand-in predictor's
# probabilities spread.
_TURNS = "concat(text, CASE (conv_id + turn) % 5 WHEN 1 THEN ' REALLY???' WHEN 2 THEN ' wow!!!' WHEN 3 THEN ' so???!!!' ELSE '' END)"
_IRONY_SQL = exact(_stand_in_sql().replace("coalesce(text, '') AS t FROM conversations", f"coalesce({_TURNS}, '') AS t FROM conversations"))


@query("agg_34_irony_profile", oracle=f"""
WITH m AS ({_IRONY_SQL}),
x AS (SELECT c.role, m.roberta_label, m.roberta_score AS score,
        m.roberta_negative_probability * 0.5 + m.roberta_positive_probability * 0.5 AS irony
      FROM m JOIN conversations c ON c.conv_id = m.conv_id AND c.turn = m.turn)
SELECT CASE WHEN grouping(role) = 0 THEN 'stream' WHEN grouping(roberta_label) = 0 THEN 'label' ELSE 'overall' END AS scope,
  coalesce(role, roberta_label, 'all') AS "group", count(*) AS n, round(avg(CASE WHEN irony > 0.3 THEN 1.0 ELSE 0.0 END), 6) AS share_high,
  round(avg(CASE WHEN irony > 0.35 THEN 1.0 ELSE 0.0 END), 6) AS share_very_high,
  round(coalesce(avg(CASE WHEN irony > 0.3 THEN score END), 0.0), 6) AS mean_score_high,
  round(coalesce(avg(CASE WHEN irony <= 0.3 THEN score END), 0.0), 6) AS mean_score_low
FROM x GROUP BY GROUPING SETS ((), (role), (roberta_label))""")
def agg_34_irony_profile(spark, sf):
    """AGG-34: shares above two levels of the irony probability and the mean
    score on both sides, overall, per label and per stream (the levels suit
    the stand-in predictor's range)."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.expr(_TURNS).alias("text"))
    s = se.model_scores(c, "text", se.char_profile_predictor).withColumn(
        "irony", F.col("roberta_negative_probability") * 0.5 + F.col("roberta_positive_probability") * 0.5)
    return rounded(su.irony_profile(s, "irony", "roberta_score", {"stream": "role", "label": "roberta_label"}, high=0.3, very_high=0.35))


# ---- STA-9 per UTC day ------------------------------------------------------
def _daily_sql():
    raters = RATERS_SQL.replace("SELECT l.doc_id, d.lang,", "SELECT l.doc_id, date_trunc('day', e.ts) AS utc_day, d.lang,").replace(
        "ON l.doc_id = d.doc_id", "ON l.doc_id = d.doc_id JOIN events e ON e.event_id = l.doc_id")
    return _agreement_sql("utc_day").replace(RATERS_SQL, raters)


@query("sta_09_agreement_by_day", oracle=_daily_sql())
def sta_09_agreement_by_day(spark, sf):
    """STA-9: the agreement bundle per UTC day (days with at least 4 rows); a
    document's time is that of the event with its id."""
    days = b.events(spark, sf).select(F.col("event_id").alias("doc_id"), F.date_trunc("day", "ts").alias("utc_day"))
    return rounded(st.agreement(_raters(spark, sf).join(days, "doc_id"), a_score="a_score", b_score="b_score", a_label="a_label",
                                b_label="b_label", group_cols=["utc_day"]))

