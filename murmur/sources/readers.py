"""Sources: CSV / JSON / Parquet scans, malformed-row accounting, file lineage.

All readers take an explicit schema (never ``inferSchema``): a scan over
100 TB must not make a sampling pass, and a declared schema is what lets the
Parquet reader prune columns and push predicates.
"""

from __future__ import annotations

import glob
import os
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def require_path(path: str) -> str:
    """Missing input is an error before any job starts (local paths only;
    remote URIs are left to the reader, which raises on its own)."""
    if "://" not in path and not (glob.glob(path) if any(c in path for c in "*?[{") else os.path.exists(path)):
        raise FileNotFoundError(f"input not found: {path}")
    return path


def _schema(schema) -> T.StructType:
    if isinstance(schema, str):
        return T._parse_datatype_string(schema)  # DDL string
    return schema


def read_csv(spark: SparkSession, path: str, schema, *, sep: str = ",", header: bool = True,
             encoding: str = "UTF-8", multiline: bool = False, columns: Sequence[str] | None = None,
             mode: str = "PERMISSIVE", **options) -> DataFrame:
    """SRC-1/SRC-2: partitioned CSV scan; parser options pass through.

    ``multiline`` handles quoted values with embedded newlines (it makes each
    file one split, so keep files moderately sized on a cluster).
    ``columns`` prunes after the scan; Spark's CSV reader only parses the
    fields the plan needs.
    """
    require_path(path)
    reader = (spark.read.schema(_schema(schema)).option("header", header).option("sep", sep)
              .option("encoding", encoding).option("multiLine", multiline).option("mode", mode))
    for key, value in {"escape": '"', **options}.items():  # a quote inside quotes is doubled
        reader = reader.option(key, value)
    df = reader.csv(path)
    return df.select(*columns) if columns else df


def parse_csv(spark: SparkSession, path: str, schema, *, sep: str = ",", header: bool = True, encoding: str = "UTF-8",
              multiline: bool = False, **options) -> DataFrame:
    """SRC-3: every record of the CSV files, parsed whatever columns are asked
    for: the schema's columns, NULL where a value is missing or bad, and
    ``_corrupt_record``, the raw line of a record with too many, too few or
    bad values (NULL for a good one).

    The lines are scanned as text and parsed by ``from_csv``, so nothing is
    cached and column pruning cannot hide a bad record. Lines equal to the
    header (the first line of the files) are left out at the start of each
    file, blank lines everywhere. Records over several lines and other
    encodings than UTF-8 need the CSV scan itself, told to parse all columns."""
    base = _schema(schema)
    full = T.StructType([*base.fields, T.StructField(CORRUPT, T.StringType(), True)])
    if multiline or encoding.upper().replace("-", "") != "UTF8":
        df = read_csv(spark, path, full, sep=sep, header=header, encoding=encoding, multiline=multiline,
                      columnNameOfCorruptRecord=CORRUPT, columnPruning=False, **options)
        # the scan wants more than the corrupt record alone to be read
        return df.where(F.hash(*[f"`{f.name}`" for f in base.fields]) >= F.lit(-2 ** 31))
    require_path(path)
    lines = spark.read.text(path)
    if header:
        first = lines.first()
        start = F.col("_metadata.file_block_start") == 0
        lines = lines.where(~(start & (F.col("value") == (first["value"] if first else ""))))
    parsed = F.from_csv("value", full.toDDL(), {
        "escape": '"', **{k: str(v) for k, v in options.items()}, "sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return lines.where(F.length(F.trim("value")) > 0).select(parsed.alias("r")).select("r.*")


def read_csv_with_rejects(spark: SparkSession, path: str, schema, *, policy: str = "skip",
                          counts: Observation | None = None, **kw) -> tuple[DataFrame, DataFrame]:
    """SRC-3: malformed-row policy.

    ``skip``: returns the (good, rejected) split of ``parse_csv``, both lazy;
    ``counts``, an ``Observation``, gets ``accepted`` and ``rejected`` from the
    same pass that reads the good rows. ``error``: FAILFAST, the first bad row
    fails the job. Rows with too many *or* too few fields are rejected."""
    if policy == "error":
        return read_csv(spark, path, _schema(schema), mode="FAILFAST", **kw), None
    if policy != "skip":
        raise ValueError("policy must be 'skip' or 'error'")
    df = parse_csv(spark, path, schema, **kw)
    seen = df
    if counts is not None:
        seen = df.observe(counts, F.count_if(F.col(CORRUPT).isNull()).alias("accepted"),
                          F.count_if(F.col(CORRUPT).isNotNull()).alias("rejected"))
    return seen.where(F.col(CORRUPT).isNull()).drop(CORRUPT), df.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def ingest_csv(spark: SparkSession, path: str, schema, out: str, **kw) -> dict[str, int]:
    """SRC-3 with both halves kept: one job writes accepted rows to
    ``<out>/accepted`` and raw bad lines to ``<out>/rejected`` (Parquet) and
    counts both."""
    counts = Observation()
    df = parse_csv(spark, path, schema, **kw).withColumn("_kind", F.when(F.col(CORRUPT).isNull(), "accepted").otherwise("rejected"))
    df.observe(counts, F.count_if(F.col("_kind") == "accepted").alias("accepted"),
               F.count_if(F.col("_kind") == "rejected").alias("rejected")) \
        .write.mode("errorifexists").partitionBy("_kind").parquet(out)
    return {k: int(v) for k, v in counts.get.items()}


def read_ingested(spark: SparkSession, out: str, schema) -> tuple[DataFrame, DataFrame]:
    """The (accepted, rejected) halves that ``ingest_csv`` wrote."""
    base = _schema(schema)
    full = T.StructType([*base.fields, T.StructField(CORRUPT, T.StringType(), True), T.StructField("_kind", T.StringType())])
    df = spark.read.schema(full).parquet(out)
    return (df.where("_kind = 'accepted'").select(*[f"`{f.name}`" for f in base.fields]),
            df.where("_kind = 'rejected'").select(CORRUPT))


def read_json(spark: SparkSession, path: str, schema, *, array_file: bool = False) -> DataFrame:
    """SRC-4: JSON lines, or a file holding one JSON array (``array_file``)."""
    require_path(path)
    return spark.read.schema(_schema(schema)).option("multiLine", array_file).json(path)


def read_parquet(spark: SparkSession, paths: str | Iterable[str], columns: Sequence[str] | None = None,
                 where: Column | None = None) -> DataFrame:
    """SRC-5/SRC-6: (multi-file) Parquet scan with column list and pushed predicate.

    The predicate is applied right on the scan so Catalyst pushes it into the
    Parquet reader (row-group skipping), and ``columns`` becomes the ReadSchema.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.parquet(*paths)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def read_manifest(spark: SparkSession, path: str, array_field: str | None = None) -> DataFrame:
    """SRC-7: JSON manifest read back as a table; ``array_field`` names an
    array-of-struct member to flatten into rows with ``inline``."""
    df = spark.read.option("multiLine", True).json(require_path(path))
    if array_field:
        df = df.select(F.inline(F.col(array_field)))
    return df


CHUNK = 8 << 20         # bytes of a file held at a time
_STREAMED = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs"}


def list_files(spark: SparkSession, path_glob: str) -> list[tuple[str, int]]:
    """(URI, bytes) of the files that a path or glob names, folders descended
    into; mount tables (viewfs) are resolved to the store behind them."""
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(path_glob)
    fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    todo, out = list(fs.globStatus(pattern) or []), []
    while todo:
        status = todo.pop()
        name = status.getPath().getName()
        if name.startswith(("_", ".")):
            continue
        if status.isDirectory():
            todo += list(fs.listStatus(status.getPath()))
        else:
            out.append((fs.resolvePath(status.getPath()).toUri().toString(), int(status.getLen())))
    return sorted(out)


def stream_sha256(uri: str, chunk: int = CHUNK) -> tuple[int, str]:
    """(bytes, SHA-256) of a file, ``chunk`` bytes at a time."""
    import hashlib

    from pyarrow import fs as pafs
    scheme, _, rest = uri.partition(":")
    where, path = pafs.FileSystem.from_uri(f"{_STREAMED[scheme]}:{'//' + rest if not rest.startswith('//') else rest}")
    digest, size = hashlib.sha256(), 0
    with where.open_input_stream(path, buffer_size=0) as f:
        while part := f.read(chunk):
            digest.update(part)
            size += len(part)
    return size, digest.hexdigest()


def file_lineage(spark: SparkSession, path_glob: str) -> DataFrame:
    """SRC-8: byte size and SHA-256 per source file, computed by executors.

    The driver lists names and sizes only; every file is one row that a task
    streams through the digest, so a file of any size takes one chunk of
    memory. Stores that pyarrow cannot open are read by Spark's binaryFile
    scan (whole files, up to 2 GB each)."""
    files = list_files(spark, path_glob)
    schema = "path string, bytes bigint, sha256 string"
    out = spark.createDataFrame([], schema)
    streamed = [f for f in files if f[0].partition(":")[0] in _STREAMED]
    if streamed:
        def digest(batches):
            import pyarrow as pa
            for b in batches:
                found = [stream_sha256(uri) for uri in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in found], pa.int64()),
                                                  pa.array([d for _, d in found], pa.string())], names=["path", "bytes", "sha256"])
        # largest first, dealt round robin: long files start early, in tasks of their own
        streamed.sort(key=lambda f: -f[1])
        rows = spark.createDataFrame([(u,) for u, _ in streamed], "path string")
        out = rows.repartition(min(len(streamed), 4 * spark.sparkContext.defaultParallelism)).mapInArrow(digest, schema)
    rest = [u for u, _ in files if u.partition(":")[0] not in _STREAMED]
    if rest:
        whole = spark.read.format("binaryFile").load(rest).select(
            "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
        out = whole if not streamed else out.unionByName(whole)
    return out
