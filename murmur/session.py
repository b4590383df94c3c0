"""Session construction and lineage-cutting helpers."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC timestamps, AQE for runtime re-planning
# (partition coalescing, skew-join splitting, broadcast conversion by measured
# size) and Arrow for the few Pandas UDFs.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of frames that are no longer referenced are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "murmur", extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with the engine defaults applied.

    ``master`` and ``shuffle_partitions`` are only applied when given: on a
    cluster they come from the submit configuration.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    # Runtime-settable SQL confs are re-applied: getOrCreate may return a
    # session that was built elsewhere.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must already be set to shared storage. Only when it is
    unset (local tests) is a private scratch folder created.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = tempfile.mkdtemp(prefix="murmur-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


KNOWN_SIZE = 1 << 40    # bytes up to which the planner's estimate is kept


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Used where a frame is re-read by several consumers or where recomputation
    after executor loss would be non-deterministic (range partitioning fed by
    a shuffle). Never a local checkpoint: those die with the executor.

    The planner takes the product of both sides for the size of a join, and a
    checkpoint keeps that number: over a chain of joins and checkpoints it
    doubles its digits each time. A number beyond ``KNOWN_SIZE`` is dropped, so
    the frame's size is unknown and later joins are planned at run time.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    out = df.checkpoint(eager=True)
    plan = out._jdf.queryExecution()
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) <= KNOWN_SIZE:
        return out
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.toRdd(), out._jdf.schema(), False), spark)


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """Of a write inside, the shuffle files are removed when it has ended."""
    before = spark.conf.get(_FREE, "false")
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE, before)


def stored(df: DataFrame) -> DataFrame:
    """``cut_lineage`` for frames with a row per document or more: the rows as
    compressed files in the shared checkpoint folder, read again from there.
    The shuffle files of the finished write are freed, so the disk holds those
    of one step, never of all steps before it."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
