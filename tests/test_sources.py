import hashlib
import os

import pytest

from murmur.sources import (file_lineage, read_csv, read_csv_with_rejects, read_json, write_parquet_counted,
                            write_versioned)


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_csv_options_and_projection(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "a.csv"), "tweet_id|text|unused\n1|hello|x\n")
    df = read_csv(spark, p, "tweet_id string, text string, unused string", sep="|", columns=["tweet_id", "text"])
    assert [tuple(r) for r in df.collect()] == [("1", "hello")]


def test_csv_bad_rows_skip_and_count(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "b.csv"), "id,text\n1,valid\n2,too,many\n3,valid\n")
    good, rejected = read_csv_with_rejects(spark, p, "id string, text string", policy="skip")
    assert sorted(r.id for r in good.collect()) == ["1", "3"]
    assert rejected.count() == 1


def test_csv_missing_file_is_error(spark):
    with pytest.raises(FileNotFoundError):
        read_csv(spark, "/nonexistent/x.csv", "a string")


def test_json_lines_and_array(spark, tmpdir_path):
    lines = _write(os.path.join(tmpdir_path, "l.json"), '{"id":1}\n{"id":2}\n')
    arr = _write(os.path.join(tmpdir_path, "a.json"), '[{"id":1,"text":"hello"}]')
    assert read_json(spark, lines, "id long").count() == 2
    rows = read_json(spark, arr, "id long, text string", array_file=True).collect()
    assert [(r.id, r.text) for r in rows] == [(1, "hello")]


def test_counted_parquet_append_and_empty_error(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "out")
    df = spark.range(5)
    assert write_parquet_counted(df, out) == 5
    assert write_parquet_counted(df, out) == 5
    assert spark.read.parquet(out).count() == 10
    with pytest.raises(ValueError):
        write_parquet_counted(df.where("id < 0"), out)


def test_file_lineage_matches_hashlib(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "f.txt"), "some bytes\n")
    row = file_lineage(spark, p).collect()[0]
    assert row.bytes == os.path.getsize(p)
    assert row.sha256 == hashlib.sha256(open(p, "rb").read()).hexdigest()


def test_versioned_layout_refuses_overwrite(spark, tmpdir_path):
    path = write_versioned(spark.range(2), tmpdir_path, "run1", "full")
    assert path.endswith("run_id=run1/mode=full")
    with pytest.raises(Exception):
        write_versioned(spark.range(2), tmpdir_path, "run1", "full")


def test_csv_split_sees_every_fault_in_one_pass(spark, tmpdir_path):
    from pyspark.sql import Observation
    from pyspark.sql import functions as F
    from murmur.sources import ingest_csv, read_ingested
    folder = os.path.join(tmpdir_path, "in")
    os.mkdir(folder)
    _write(os.path.join(folder, "a.csv"), 'id,n,text\n1,10,"a, b"\n2,x,bad number\n\n3,30\n4,40,d,e\n   \n5,50,"say ""hi"""\n')
    _write(os.path.join(folder, "b.csv"), "id,n,text\n6,60,f\nid,n,text2\n")
    schema = "id int, n int, text string"
    seen = Observation()
    good, bad = read_csv_with_rejects(spark, folder, schema, counts=seen)
    # pruned to one column, or to none, a bad row is still bad
    assert sorted(r.id for r in good.select("id").collect()) == [1, 5, 6]
    assert seen.get == {"accepted": 3, "rejected": 4} and good.count() == 3
    assert sorted(r._corrupt_record for r in bad.collect()) == ["2,x,bad number", "3,30", "4,40,d,e", "id,n,text2"]
    out = os.path.join(tmpdir_path, "out")
    assert ingest_csv(spark, folder, schema, out) == {"accepted": 3, "rejected": 4}
    kept, lost = read_ingested(spark, out, schema)
    assert {(r.id, r.n, r.text) for r in kept.collect()} == {(1, 10, "a, b"), (5, 50, 'say "hi"'), (6, 60, "f")}
    assert lost.count() == 4 and lost.columns == ["_corrupt_record"]
    latin = os.path.join(tmpdir_path, "l.csv")
    with open(latin, "wb") as f:
        f.write("id,text\n1,caf\xe9\n2\n".encode("latin-1"))
    good, bad = read_csv_with_rejects(spark, latin, "id int, text string", encoding="ISO-8859-1")
    assert [(r.id, r.text) for r in good.collect()] == [(1, "caf\xe9")] and bad.count() == 1
    many = _write(os.path.join(tmpdir_path, "m.csv"), 'id,text\n1,"two\nlines"\n2,a,b\n')
    good, bad = read_csv_with_rejects(spark, many, "id int, text string", multiline=True)
    assert [(r.id, r.text) for r in good.collect()] == [(1, "two\nlines")] and bad.count() == 1
    with pytest.raises(Exception):
        read_csv_with_rejects(spark, folder, schema, policy="error")[0].collect()
    assert F.col is not None


def test_lineage_streams_files_of_any_size(spark, tmpdir_path):
    import resource
    from murmur.sources import stream_sha256
    big = os.path.join(tmpdir_path, "big.bin")
    with open(big, "wb") as f:
        f.write(b"head")
        f.truncate(3 << 30)  # sparse: takes no disk
        f.seek(0, 2)
        f.write(b"tail")
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    size, digest = stream_sha256("file://" + big)
    assert size == (3 << 30) + 4 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000
    want = hashlib.sha256(b"head")
    for _ in range(3 << 10):
        want.update(bytes((1 << 20)) if _ else bytes((1 << 20) - 4))
    want.update(b"tail")
    assert digest == want.hexdigest()
    sub = os.path.join(tmpdir_path, "sub dir")
    os.mkdir(sub)
    for k in range(5):
        _write(os.path.join(sub, f"f {k}.txt"), "x" * k)
    _write(os.path.join(sub, "_hidden"), "no")
    rows = {r.path.rsplit("/", 1)[1].replace("%20", " "): (r.bytes, r.sha256) for r in file_lineage(spark, sub).collect()}
    assert rows == {f"f {k}.txt": (k, hashlib.sha256(b"x" * k).hexdigest()) for k in range(5)}
    assert file_lineage(spark, os.path.join(tmpdir_path, "none*")).collect() == []


def test_runs_are_visible_when_committed(spark, tmpdir_path):
    from murmur.sources import commit_run, committed_runs, read_runs, stage_run
    root = os.path.join(tmpdir_path, "runs")
    with pytest.raises(FileNotFoundError):
        read_runs(spark, root)
    write_versioned(spark.range(5), root, "a")
    staged = stage_run(spark.range(100), root)      # killed here: nobody sees it
    assert [m["run_id"] for m in committed_runs(spark, root)] == ["a"] and read_runs(spark, root).count() == 5
    commit_run(spark, root, staged, "b")
    assert {(m["run_id"], m["rows"]) for m in committed_runs(spark, root)} == {("a", 5), ("b", 100)}
    assert read_runs(spark, root).groupBy("run_id").count().count() == 2 and read_runs(spark, root, ["b"]).count() == 100
    # rows moved, manifest never written: invisible, and the run can be written again
    import murmur.sources.sinks as sk
    half = stage_run(spark.range(7), root)
    real, sk.json.dumps = sk.json.dumps, lambda *_: 1 / 0
    try:
        with pytest.raises(ZeroDivisionError):
            commit_run(spark, root, half, "c")
    finally:
        sk.json.dumps = real
    assert read_runs(spark, root).count() == 105
    write_versioned(spark.range(3).withColumnRenamed("id", "x"), root, "c")
    got = read_runs(spark, root)
    assert got.count() == 108 and set(got.columns) == {"id", "x", "run_id"} and got.where("run_id = 'c' AND id IS NULL").count() == 3
    with pytest.raises(FileExistsError):
        write_versioned(spark.range(1), root, "b")
    assert read_runs(spark, root, ["b"]).count() == 100
