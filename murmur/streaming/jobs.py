"""Structured Streaming forms of ingest, scoring and the time matrices
(STM-1..4).

A file-family "stream" (the reference's notion) maps to a file source read
with ``trigger(availableNow=True)``: every file present is processed once,
progress is committed in the checkpoint, and a restart skips finished files.
Sinks write to shared storage per micro-batch, under the batch's id, so a batch
that is repeated after a failure replaces itself (STM-3). Running totals are
mergeable moments, kept per batch or in the state store.
"""

from __future__ import annotations

import uuid
from typing import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from murmur.session import checkpoint_dir, shuffles_freed


def scratch(spark: SparkSession, name: str) -> tuple[str, str]:
    """(output, checkpoint) folders for one run under the shared checkpoint
    directory."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"
    return f"{base}/out", f"{base}/checkpoint"


def file_stream(spark: SparkSession, directory: str, schema: T.StructType, *, fmt: str = "parquet",
                glob: str | None = None, max_files_per_trigger: int | None = None, **options) -> DataFrame:
    """A streaming scan of a file family (``glob`` selects members)."""
    r = spark.readStream.schema(schema).format(fmt)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(directory)


def _finish(q) -> None:
    """Wait for the end of the available input, however long it takes."""
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def run_batches(df: DataFrame, ckpt: str, process: Callable[[DataFrame, int], None]) -> None:
    """Give every micro-batch to ``process(batch, batch_id)`` until the
    available input is consumed. A batch whose commit was lost comes again
    with the same id and the same rows, so ``process`` writes what belongs to
    a batch under its id (``batch_folder``) and a repeat replaces it."""
    _finish(df.writeStream.foreachBatch(process).option("checkpointLocation", ckpt).trigger(availableNow=True).start())


def batch_folder(out: str, name: str, batch_id: int) -> str:
    return f"{out}/{name}/batch_id={batch_id}"


def read_batches(spark: SparkSession, out: str, name: str, schema: T.StructType | str) -> DataFrame:
    """What all batches wrote under ``name``, with their ``batch_id``; no rows
    if there was no batch."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    whole = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{name}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).parquet(f"{out}/{name}")


METRICS = "name string, value string"


def run_append(df: DataFrame, out: str, ckpt: str, *, metrics: dict[str, Column] | None = None,
               after_write: Callable[[int], None] | None = None) -> None:
    """STM-1/3: append the stream to ``<out>/data`` and, of every batch, the
    metrics to ``<out>/metrics``. Metrics are observed in the pass that writes
    the rows and are written by the batch itself, so none can be missed.
    ``after_write`` is called between a batch's write and its commit."""
    named = {"rows": F.count(F.lit(1)), **(metrics or {})}

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        batch.observe(seen, *[c.alias(k) for k, c in named.items()]).write.mode("overwrite").parquet(
            batch_folder(out, "data", batch_id))
        got = seen.get
        rows = [(k, None if got[k] is None else str(got[k])) for k in named]
        batch.sparkSession.createDataFrame(rows, METRICS).coalesce(1).write.mode("overwrite").parquet(
            batch_folder(out, "metrics", batch_id))
        if after_write:
            after_write(batch_id)
    run_batches(df, ckpt, write)


def batch_metrics(spark: SparkSession, out: str) -> DataFrame:
    """(batch_id, name, value as text) of every batch of ``run_append``."""
    return read_batches(spark, out, "metrics", METRICS).select("batch_id", "name", "value")


def run_complete(df: DataFrame, out: str, ckpt: str) -> None:
    """Run a streaming aggregate in complete mode, rewriting the result
    table after each micro-batch (STM-4 matrices)."""
    def write(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    _finish(df.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", ckpt)
            .trigger(availableNow=True).start())


# --- mergeable moments -------------------------------------------------------
MOMENTS = "n long, mean double, m2 double, lo double, hi double"


def moments(df: DataFrame, group: str, score: str) -> DataFrame:
    """Per group: rows, and of the scores mean, sum of squared deviations,
    least and greatest; parts of a table merge to those of the whole."""
    return df.groupBy(group).agg(
        F.count(score).alias("n"), F.avg(score).alias("mean"), (F.var_pop(score) * F.count(score)).alias("m2"),
        F.min(score).alias("lo"), F.max(score).alias("hi"))


def merged_moments(parts: DataFrame, group: str) -> DataFrame:
    """(group, n, mean, std, min, max) of the union that the parts came from."""
    total = F.sum("n")
    mean = F.sum(F.col("n") * F.col("mean")) / total
    # sum of (m2 + n mean^2) would cancel; deviations are taken from the merged mean
    centre = parts.groupBy(F.col(group).alias("_g")).agg(total.alias("_n"), mean.alias("_mean"))
    j = parts.join(centre, F.col(group).eqNullSafe(F.col("_g")))
    d = F.col("mean") - F.col("_mean")
    return j.groupBy(F.col("_g").alias(group)).agg(
        F.max("_n").alias("n"), F.max("_mean").alias("mean"),
        F.sqrt(F.try_divide(F.sum(F.col("m2") + F.col("n") * d * d), F.max("_n") - 1)).alias("std"),
        F.min("lo").alias("min"), F.max("hi").alias("max"))


def score_stream(df: DataFrame, out: str, ckpt: str, *, score: Callable[[DataFrame], DataFrame], group: str, value: str) -> None:
    """STM-2: score every micro-batch with batch operators, keep its rows under
    ``<out>/scored`` and its moments under ``<out>/moments``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        folder = batch_folder(out, "scored", batch_id)
        with shuffles_freed(batch.sparkSession):
            score(batch).write.mode("overwrite").parquet(folder)
        moments(batch.sparkSession.read.parquet(folder), group, value).coalesce(1).write.mode("overwrite").parquet(
            batch_folder(out, "moments", batch_id))
    run_batches(df, ckpt, write)


def running_totals(spark: SparkSession, out: str, group: str) -> DataFrame:
    """Totals of all batches of ``score_stream`` so far."""
    return merged_moments(read_batches(spark, out, "moments", f"{group} string, {MOMENTS}"), group)


class RunningMoments(StatefulProcessor):
    """State of one group: its merged moments. Every batch brings partial
    moments, and the group's new totals go out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._held = handle.getValueState("moments", MOMENTS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd
        n, mean, m2, lo, hi = self._held.get() if self._held.exists() else (0, 0.0, 0.0, float("inf"), float("-inf"))
        for part in rows:
            for r in part.itertuples(index=False):
                both = n + r.n
                step = r.mean - mean
                m2 += r.m2 + step * step * n * r.n / both
                mean += step * r.n / both
                n, lo, hi = both, min(lo, r.lo), max(hi, r.hi)
        self._held.update((int(n), float(mean), float(m2), float(lo), float(hi)))
        yield pd.DataFrame([(key[0], n, mean, m2, lo, hi)], columns=["key", "n", "mean", "m2", "lo", "hi"])

    def close(self) -> None:
        pass


_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_totals(df: DataFrame, out: str, ckpt: str, *, group: str, value: str) -> None:
    """STM-2 with the totals in the state store: tasks reduce their rows of a
    micro-batch to moments per group first, so a group's state takes one row
    per task, however many rows the group has; updated totals are written
    under ``<out>/totals`` by batch."""
    def partial(batches):
        import pandas as pd
        for pdf in batches:
            pdf = pdf[pdf["value"].notna()]
            g = pdf.groupby("key", dropna=False)["value"]
            yield pd.DataFrame({"n": g.count(), "mean": g.mean(), "m2": g.var(ddof=0) * g.count(), "lo": g.min(),
                                "hi": g.max()}).reset_index()[["key", "n", "mean", "m2", "lo", "hi"]]

    schema = f"key string, {MOMENTS}"
    parts = df.select(F.col(group).cast("string").alias("key"), F.col(value).cast("double").alias("value")).mapInPandas(partial, schema)
    totals = parts.groupBy("key").transformWithStateInPandas(
        RunningMoments(), outputStructType=schema, outputMode="Update", timeMode="None")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_folder(out, "totals", batch_id))
    spark = df.sparkSession
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        _finish(totals.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", ckpt)
                .trigger(availableNow=True).start())
    finally:
        spark.conf.set(_STORE, before)


def latest_totals(spark: SparkSession, out: str) -> DataFrame:
    """The last totals of every group that ``stateful_totals`` wrote."""
    rows = read_batches(spark, out, "totals", f"key string, {MOMENTS}")
    last = rows.groupBy("key").agg(F.max("batch_id").alias("batch_id"))
    on = rows["key"].eqNullSafe(last["key"]) & (rows["batch_id"] == last["batch_id"])
    return rows.join(last, on, "left_semi").select(
        "key", "n", "mean", F.sqrt(F.try_divide("m2", F.col("n") - 1)).alias("std"), F.col("lo").alias("min"), F.col("hi").alias("max"))


def hourly_matrix_stream(df: DataFrame, ts_col: str, score: str, *, unit: str = "1 hour",
                         id_col: str | None = None, watermark: str | None = None) -> DataFrame:
    """STM-4: tumbling-window volume / mean / sample std (0 for one row).
    With ``watermark`` the state of closed windows is dropped (append or
    update mode); without it the full result is kept (complete mode)."""
    s = df.where(F.col(ts_col).isNotNull())
    if watermark:
        s = s.withWatermark(ts_col, watermark)
    return s.groupBy(F.window(ts_col, unit).alias("w")).agg(
        F.count(F.col(id_col) if id_col else F.col(score)).alias("volume"), F.avg(score).alias("mean_sentiment"),
        F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("std_sentiment")).select(
        F.col("w.start").alias("timestamp_hourly"), "volume", "mean_sentiment", "std_sentiment")


def stream_to_table(spark: SparkSession, name: str, build: Callable[[], DataFrame], *, complete: bool = False,
                    metrics: dict[str, Column] | None = None) -> DataFrame:
    """Run ``build()`` (a streaming frame) to completion and return the
    written table as a batch frame."""
    out, ckpt = scratch(spark, name)
    df = build()
    if complete:
        run_complete(df, out, ckpt)
        return spark.read.parquet(out)
    run_append(df, out, ckpt, metrics=metrics)
    return read_batches(spark, out, "data", df.schema).drop("batch_id")
