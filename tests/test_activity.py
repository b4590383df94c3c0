import datetime as dt

from pyspark.sql import functions as F

from murmur.operators import activity as act
from murmur.operators import cleaning as cl


def _posts(spark):
    rows = [("a", dt.datetime(2020, 11, 1, 1)), ("a", dt.datetime(2020, 11, 1, 5)),
            ("a", dt.datetime(2020, 11, 3, 2)), ("b", dt.datetime(2020, 11, 2, 9))]
    return spark.createDataFrame(rows, "user_id string, date timestamp")


def test_user_metrics_fixture(spark):
    m = {r.user_id: r for r in act.user_metrics(_posts(spark)).collect()}
    a = m["a"]
    assert (a.total_tweets, a.active_days, a.observed_span_days, a.max_tweets_single_day) == (3, 2, 3, 2)
    assert a.tweets_per_active_day == 1.5 and a.tweets_per_observed_day == 1.0


def test_missing_user_and_null_time(spark):
    rows = [(None, dt.datetime(2020, 11, 1)), (None, None), ("c", None)]
    df = spark.createDataFrame(rows, "user_id string, date timestamp")
    m = {r.user_id: r for r in act.user_metrics(df).collect()}
    assert m[act.MISSING_USER].total_tweets == 2 and m[act.MISSING_USER].active_days == 1
    assert m["c"].active_days == 0 and m["c"].tweets_per_active_day is None and m["c"].max_tweets_single_day == 0


def test_threshold_choice_least_exceedance(spark):
    trade = spark.createDataFrame(
        [("p95", 4.0, 5, 2.0, 50, 30.0), ("p99", 6.0, 1, 0.5, 20, 20.0), ("p99_5", 9.0, 1, 0.4, 13, 13.0)],
        "method string, threshold double, users_removed long, users_removed_pct double, "
        "tweets_removed long, tweets_removed_pct double")
    row = act.select_threshold(trade).collect()[0]
    assert row.selected_threshold == 9.0 and row.eligible is False


def test_threshold_choice_eligible_smallest(spark):
    trade = spark.createDataFrame(
        [("p99", 6.0, 1, 0.5, 5, 5.0), ("p99_5", 9.0, 1, 0.4, 3, 3.0)],
        "method string, threshold double, users_removed long, users_removed_pct double, "
        "tweets_removed long, tweets_removed_pct double")
    assert act.select_threshold(trade).collect()[0].selected_threshold == 6.0


def test_candidate_thresholds_match_numpy(spark):
    import numpy as np
    vals = [1.0, 1.5, 2.0, 2.0, 3.0, 3.5, 8.0, 20.0, 2.5, 1.0, 4.0]
    m = spark.createDataFrame([(f"u{i}", v, 1) for i, v in enumerate(vals)],
                              "user_id string, tweets_per_active_day double, total_tweets int")
    w = act.candidate_thresholds(m).collect()[0].asDict()
    x = np.array(vals)
    q1, q3 = np.quantile(x, [0.25, 0.75])
    med = np.median(x)
    exp = {"p95": np.quantile(x, 0.95), "p99_5": np.quantile(x, 0.995), "iqr_upper_fence": q3 + 1.5 * (q3 - q1),
           "log_z_threshold": np.expm1(np.log1p(x).mean() + 3 * np.log1p(x).std(ddof=1)),
           "mad_threshold": med + 3 * 1.4826 * np.median(np.abs(x - med))}
    for k, v in exp.items():
        assert abs(w[k] - v) < 1e-9, k


def test_bot_filter_fixture(spark):
    """steady x1, busy x3 on one day, new account; limit 2 -> only steady."""
    rows = [("steady", dt.datetime(2020, 10, 1, 1), dt.datetime(2019, 1, 1)),
            ("busy", dt.datetime(2020, 10, 1, 1), dt.datetime(2019, 1, 1)),
            ("busy", dt.datetime(2020, 10, 1, 2), dt.datetime(2019, 1, 1)),
            ("busy", dt.datetime(2020, 10, 1, 3), dt.datetime(2019, 1, 1)),
            ("new", dt.datetime(2020, 10, 21, 1), dt.datetime(2020, 10, 20))]
    df = spark.createDataFrame(rows, "user_id string, date timestamp, user_created_at timestamp")
    m = act.user_metrics(df)
    choice = spark.createDataFrame([(2.0,)], "selected_threshold double")
    kept = act.activity_filter(df, m, choice, normalise_ids=True).where(cl.account_age_ok("user_created_at"))
    assert [r.user_id for r in kept.collect()] == ["steady"]


def test_bot_score_and_dedupe_fixture(spark):
    from murmur.operators.dedupe import keep_first
    rows = [(1, "same", 0.1), (2, "same", 0.2), (3, "other", 0.9)]
    df = spark.createDataFrame(rows, "id int, text string, bot_score double")
    out = keep_first(df, ["text"], ["id"]).where(cl.bot_score_ok("bot_score", 0.5)).collect()
    assert [(r.text, r.bot_score) for r in out] == [("same", 0.1)]


def test_stage_telemetry(spark):
    df = spark.range(10)
    t = cl.stage_telemetry(df, {"even": F.col("id") % 2 == 0, "small": F.col("id") < 4}).orderBy("stage_order")
    rows = [(r.stage, r.initial, r.final, r.dropped) for r in t.collect()]
    assert rows == [("even", 10, 5, 5), ("small", 5, 2, 3)]
