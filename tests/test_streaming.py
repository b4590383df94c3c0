import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from murmur.streaming import jobs


def _family(spark, folder, rows, files, schema="k string, v double"):
    src = os.path.join(folder, "src")
    for i in range(files):
        spark.createDataFrame(rows[i::files], schema).coalesce(1).write.mode("append").parquet(src)
    return src


ROWS = [(None if i % 11 == 0 else f"k{i % 3}", None if i % 7 == 0 else float(i % 13) + 1e9) for i in range(200)]


def test_a_repeated_batch_replaces_itself(spark, tmpdir_path):
    src = _family(spark, tmpdir_path, ROWS, 4)
    out, ckpt = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ckpt")
    schema = spark.read.parquet(src).schema
    seen = []

    def die(batch_id):
        seen.append(batch_id)
        if seen.count(2) == 1 and batch_id == 2:
            raise RuntimeError("stopped here")
    stream = lambda: jobs.file_stream(spark, src, schema, max_files_per_trigger=1)
    with pytest.raises(Exception, match="stopped here"):
        jobs.run_append(stream(), out, ckpt, metrics={"least": F.min("v")}, after_write=die)
    assert jobs.read_batches(spark, out, "data", schema).count() == 150     # the uncommitted batch is there
    jobs.run_append(stream(), out, ckpt, metrics={"least": F.min("v")}, after_write=die)
    assert seen == [0, 1, 2, 2, 3]
    got = jobs.read_batches(spark, out, "data", schema)
    assert sorted(((r.k, r.v) for r in got.collect()), key=repr) == sorted(ROWS, key=repr)
    m = {(r.batch_id, r.name): r.value for r in jobs.batch_metrics(spark, out).collect()}
    assert sum(int(v) for (_, n), v in m.items() if n == "rows") == 200 and len(m) == 8
    # nothing new: nothing happens
    jobs.run_append(stream(), out, ckpt, after_write=die)
    assert seen == [0, 1, 2, 2, 3]
    none = os.path.join(tmpdir_path, "none")
    assert jobs.read_batches(spark, none, "data", schema).count() == 0 and jobs.batch_metrics(spark, none).count() == 0


def _want(rows):
    import numpy as np
    out = {}
    for k in {k for k, _ in rows}:
        v = np.array([x for g, x in rows if g == k and x is not None])
        out[k] = (len(v), v.mean(), v.std(ddof=1), v.min(), v.max())
    return out


def test_moments_merge(spark):
    parts = None
    for i in range(5):
        m = jobs.moments(spark.createDataFrame(ROWS[i::5], "k string, v double"), "k", "v")
        parts = m if parts is None else parts.unionByName(m)
    for r in jobs.merged_moments(parts, "k").collect():
        n, mean, std, lo, hi = _want(ROWS)[r.k]
        assert (r.n, r.min, r.max) == (n, lo, hi) and abs(r.mean - mean) < 1e-6 and abs(r["std"] - std) < 1e-7  # of scores near 1e9


def test_state_store_keeps_totals_over_restarts(spark, tmpdir_path):
    src = _family(spark, tmpdir_path, ROWS, 4)
    out, ckpt = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ckpt")
    schema = spark.read.parquet(src).schema
    run = lambda: jobs.stateful_totals(jobs.file_stream(spark, src, schema, max_files_per_trigger=2), out, ckpt,
                                       group="k", value="v")
    run()
    more = [("k1", 5.0), ("new", 7.0), ("new", 9.0)]
    spark.createDataFrame(more, "k string, v double").coalesce(1).write.mode("append").parquet(src)
    run()   # goes on from the state of the first run
    got = {r.key: r for r in jobs.latest_totals(spark, out).collect()}
    want = _want(ROWS + more)
    assert set(got) == set(want)
    for k, (n, mean, std, lo, hi) in want.items():
        assert (got[k].n, got[k].min, got[k].max) == (n, lo, hi)
        assert abs(got[k].mean - mean) < 1e-6 * abs(mean) and abs(got[k]["std"] - std) <= 1e-9 * max(std, 1e9)
    assert dt is not None
