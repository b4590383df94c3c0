"""Sinks: Parquet / CSV / JSON writers, counted writes, versioned layout."""

from __future__ import annotations

import json
import uuid
from typing import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists",
                  partition_by: list[str] | None = None) -> None:
    """SNK-1: Parquet write (parents are created by the writer)."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_parquet_counted(df: DataFrame, path: str, mode: str = "append") -> int:
    """SNK-2: batch append returning the row count from the same job (an
    ``Observation`` — no second pass). Writing nothing is an error."""
    obs = Observation("write_count")
    df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode(mode).parquet(path)
    rows = int(obs.get["rows"])
    if rows == 0:
        raise ValueError("refusing to record an empty batch")
    return rows


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """SNK-3: CSV with a header (summaries)."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_manifest(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """SNK-4: manifest as JSON; ``df`` is a one-row frame of structs/maps."""
    df.coalesce(1).write.mode(mode).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """SNK-5: JSON lines (one object per line, real newlines)."""
    df.write.mode(mode).json(path)


MANIFESTS, STAGED = "_manifests", "_staged"


def _fs(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a path in any store Spark can write."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def stage_run(df: DataFrame, root: str, fmt: str = "parquet") -> dict:
    """Write a run's rows to a folder of its own under ``<root>/_staged`` and
    return what its manifest will say. Nobody reads staged folders."""
    folder = f"{STAGED}/{uuid.uuid4().hex}"
    obs = Observation()
    df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").format(fmt).save(f"{root.rstrip('/')}/{folder}")
    return {"staged": folder, "rows": int(obs.get["rows"]), "format": fmt, "schema": df.schema.jsonValue()}


def commit_run(spark: SparkSession, root: str, staged: dict, run_id: str, run_mode: str = "full") -> str:
    """Make a staged run visible: its folder gets its place in the layout and
    then its manifest appears by one rename, which is the commit. A run that
    has a manifest is never replaced; one that lost its writer in between has
    none, is never read, and can be written again."""
    root = root.rstrip("/")
    place = f"run_id={run_id}/mode={run_mode}"
    fs, manifest = _fs(spark, f"{root}/{MANIFESTS}/{run_id}.{run_mode}.json")
    if fs.exists(manifest):
        raise FileExistsError(f"run {run_id} ({run_mode}) is committed")
    target = _fs(spark, f"{root}/{place}/{staged['staged'].rsplit('/', 1)[1]}")[1]
    fs.mkdirs(target.getParent())
    if not fs.rename(_fs(spark, f"{root}/{staged['staged']}")[1], target):
        raise OSError(f"cannot move the staged rows of run {run_id}")
    entry = {**staged, "run_id": run_id, "mode": run_mode, "path": f"{place}/{target.getName()}"}
    draft = _fs(spark, f"{root}/{MANIFESTS}/.{uuid.uuid4().hex}")[1]
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    if fs.exists(manifest) or not fs.rename(draft, manifest):
        fs.delete(draft, False)
        raise FileExistsError(f"run {run_id} ({run_mode}) was committed by another writer")
    return f"{root}/{place}"


def write_versioned(df: DataFrame, root: str, run_id: str, run_mode: str = "full",
                    fmt: str = "parquet") -> str:
    """SNK-6: run-ID and mode separated layout, staged and committed by a
    manifest; a committed run is never overwritten."""
    spark = df.sparkSession
    fs, manifest = _fs(spark, f"{root.rstrip('/')}/{MANIFESTS}/{run_id}.{run_mode}.json")
    if fs.exists(manifest):
        raise FileExistsError(f"run {run_id} ({run_mode}) is committed")
    return commit_run(spark, root, stage_run(df, root, fmt), run_id, run_mode)


def committed_runs(spark: SparkSession, root: str) -> list[dict]:
    """The manifests of all committed runs (one small file each)."""
    fs, folder = _fs(spark, f"{root.rstrip('/')}/{MANIFESTS}")
    if not fs.exists(folder):
        return []
    paths = [s.getPath() for s in fs.listStatus(folder) if not s.getPath().getName().startswith(".")]
    return sorted((json.loads(r["value"]) for r in spark.read.text([str(p.toString()) for p in paths], wholetext=True).collect()),
                  key=lambda m: (m["run_id"], m["mode"])) if paths else []


def read_runs(spark: SparkSession, root: str, run_ids: Sequence[str] | None = None, run_mode: str = "full") -> DataFrame:
    """Rows of whole, committed runs only, with their ``run_id``; runs are
    united by name, columns that a run lacks are NULL."""
    runs = [m for m in committed_runs(spark, root) if m["mode"] == run_mode and (run_ids is None or m["run_id"] in run_ids)]
    missing = set(run_ids or []) - {m["run_id"] for m in runs}
    if missing or not runs:
        raise FileNotFoundError(f"no committed run {sorted(missing) or ''} under {root}")
    out = None
    for m in runs:
        schema = T.StructType.fromJson(m["schema"])
        part = spark.read.schema(schema).format(m["format"]).load(f"{root.rstrip('/')}/{m['path']}").withColumn(
            "run_id", F.lit(m["run_id"]))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
