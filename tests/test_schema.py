import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from murmur.operators import quality as qa
from murmur.operators import schema as sc
from murmur.sources import read_manifest, write_csv, write_jsonl, write_manifest


def test_ingest_transform_order(spark):
    df = spark.createDataFrame([("1", "2020-11-03 10:00:00", "hi", "x")], "tweet_id string, created string, body string, junk string")

    def mapper(d):  # runs first: sees the raw names
        return d.withColumn("body", F.upper("body"))

    out = sc.ingest_transform(df, mapper=mapper, rename_fields={"tweet_id": "id", "created": "date", "body": "tweet"},
                              constant_fields={"source_file": "s1"}, fields=["id", "date", "tweet", "source_file"],
                              timestamp_columns=["date"])
    r = out.collect()[0]
    assert out.columns == ["id", "date", "tweet", "source_file"]
    assert r.tweet == "HI" and r.date == dt.datetime(2020, 11, 3, 10) and r.source_file == "s1"
    with pytest.raises(ValueError):
        sc.ingest_transform(df, fields=["nope"])


def test_utc_coerce_and_raise(spark):
    df = spark.createDataFrame([("2020-11-03 10:00:00",), ("garbage",)], "t string")
    assert [r.t for r in sc.to_utc(df, ["t"], "coerce").collect()][1] is None
    with pytest.raises(Exception):
        sc.to_utc(df, ["t"], "raise").collect()


def test_event_registry_timezone_option(spark):
    df = spark.createDataFrame([("e1", "2020-11-03 20:00:00", "America/New_York", "debate", "c", "d", "u")],
                               "event_id string, event_timestamp_local string, event_timezone string, event_name string, "
                               "event_category string, event_description string, source_url string")
    carried = sc.event_registry(df).collect()[0].event_timestamp_utc
    applied = sc.event_registry(df, apply_timezone=True).collect()[0].event_timestamp_utc
    assert carried == dt.datetime(2020, 11, 3, 20) and applied == dt.datetime(2020, 11, 4, 1)


def test_column_inference_and_profile(spark):
    df = spark.createDataFrame([("1", 0.5)], "id string, vader_compound double")
    assert sc.score_column(df) == "vader_compound"
    assert sc.infer_column(df, ["tweet_id", "id"]) == "id"
    with pytest.raises(ValueError):
        sc.infer_column(df, ["x"])
    prof = sc.schema_profile(df, required=["id"], optional=["user_loc"]).collect()
    assert prof[0].row_count == 1 and prof[0].missing_optional_columns == ["user_loc"]
    with pytest.raises(ValueError):
        sc.schema_profile(df, required=["tweet"])


def test_unique_right_join(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    out = {r.id: r.v for r in sc.left_join_unique(left, right, ["id"]).collect()}
    assert out == {1: "a", 2: "b", 3: None}
    dup = spark.createDataFrame([(1, "a"), (1, "b")], "id int, v string")
    with pytest.raises(Exception):
        sc.left_join_unique(left, dup, ["id"]).collect()


def test_row_position(spark):
    df = spark.createDataFrame([(k,) for k in (30, 10, 20, 40)], "k long")
    assert sorted((r.k, r.row_position) for r in sc.row_position(df, "k").collect()) == \
        [(10, 0), (20, 1), (30, 2), (40, 3)]


def test_summary_sinks_and_manifest_roundtrip(spark, tmpdir_path):
    df = spark.createDataFrame([("a", 1)], "k string, n long")
    write_csv(df, os.path.join(tmpdir_path, "csv"))
    write_jsonl(df, os.path.join(tmpdir_path, "jsonl"))
    man = spark.createDataFrame([([("p99", 6.0), ("p99_5", 9.0)],)],
                                "thresholds array<struct<method:string, threshold:double>>")
    write_manifest(man, os.path.join(tmpdir_path, "manifest"))
    back = read_manifest(spark, os.path.join(tmpdir_path, "manifest"), array_field="thresholds").collect()
    assert sorted((r.method, r.threshold) for r in back) == [("p99", 6.0), ("p99_5", 9.0)]
    assert spark.read.option("header", True).csv(os.path.join(tmpdir_path, "csv")).count() == 1


def test_run_config_rules():
    qa.validate_run_config({"inputs": ["a"], "mode": "sample", "seed": 2020})
    for bad in ({"inputs": ["a"], "mode": "x", "seed": 1}, {"inputs": ["a"], "mode": "full", "seed": -1},
                {"inputs": [], "mode": "full", "seed": 1},
                {"inputs": ["a"], "mode": "full", "seed": 1, "apply_mitigation": True}):
        with pytest.raises(ValueError):
            qa.validate_run_config(bad)


def test_canonical_unchanged_detects_edits(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, t string")
    b = spark.createDataFrame([(2, "y"), (1, "x")], "id int, t string")
    c = spark.createDataFrame([(1, "x"), (2, "z")], "id int, t string")
    assert qa.canonical_unchanged(a, b, ["id", "t"]).collect()[0].status == "pass"
    assert qa.canonical_unchanged(a, c, ["id", "t"]).collect()[0].status == "fail"
