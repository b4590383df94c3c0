import datetime as dt


def test_spine_counts_events_of_every_hour(spark, tmpdir_path):
    from murmur.plans.catalog import ORACLES, QUERIES
    rows = [(i, dt.datetime(2024, 1, 1, h, 30)) for i, h in enumerate((1, 2, 3, 3, 6))]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp").write.parquet(f"{tmpdir_path}/events.parquet")
    out = QUERIES["joi_11_hour_spine"](spark, tmpdir_path).orderBy("hour").collect()
    assert [(r["tweet_volume"], r["missing_time_bin"]) for r in out] == [
        (1, False), (1, False), (2, False), (0, True), (0, True), (1, False)]
    assert "hour(ts)" not in ORACLES["joi_11_hour_spine"]
