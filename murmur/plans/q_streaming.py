"""Streaming queries: each runs a file-source stream over the driver's
Parquet family to completion (availableNow) and returns the written table."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.operators import schema as sc
from murmur.operators import sentiment as se
from murmur.operators.common import with_scalars
from murmur.plans.registry import query, rounded
from murmur.session import shuffles_freed, stored
from murmur.sources.tables import utc_timestamps
from murmur.streaming import jobs


def _events_stream(spark, sf):
    # the stream's schema is declared up front (taken from the batch table's
    # footer once), never inferred per file
    raw_schema = spark.read.parquet(f"{sf.rstrip('/')}/events.parquet").schema
    return utc_timestamps(jobs.file_stream(spark, sf, raw_schema, glob="events.parquet"))


@query("stm_01_stream_ingest", oracle="""
SELECT CAST(event_id AS VARCHAR) AS id, ts AS date, CAST(user_id AS VARCHAR) AS user_id, event_type AS candidate,
       value AS score, 'events' AS source_file FROM events""")
def stm_01_stream_ingest(spark, sf):
    """STM-1: micro-batch ingest with the E1 transform (rename, constants,
    projection, UTC) and per-batch observed metrics."""
    def build():
        s = _events_stream(spark, sf)
        s = s.withColumns({"event_id": F.col("event_id").cast("string"), "user_id": F.col("user_id").cast("string")})
        return sc.ingest_transform(
            s, rename_fields={"event_id": "id", "ts": "date", "event_type": "candidate", "value": "score"},
            constant_fields={"source_file": "events"},
            fields=["id", "date", "user_id", "candidate", "score", "source_file"], timestamp_columns=["date"])
    return jobs.stream_to_table(spark, "ingest", build, metrics={
        "rows": F.count(F.lit(1)), "min_time": F.min("date"), "max_time": F.max("date")})


@query("stm_04_stream_hourly_matrix", oracle="""
SELECT date_trunc('hour', ts) AS timestamp_hourly, count(event_id) AS volume,
       round(avg(value), 6) AS mean_sentiment, round(coalesce(stddev_samp(value), 0), 6) AS std_sentiment
FROM events WHERE ts IS NOT NULL GROUP BY 1""")
def stm_04_stream_hourly_matrix(spark, sf):
    """STM-4: the hourly matrix as a tumbling-window streaming aggregate."""
    t = jobs.stream_to_table(spark, "hourly", lambda: jobs.hourly_matrix_stream(
        _events_stream(spark, sf), "ts", "value", id_col="event_id"), complete=True)
    return rounded(t)


def _family(spark, df, files: int, name: str) -> str:
    """The rows as a family of files in the shared folder."""
    folder = f"{jobs.scratch(spark, name)[0]}/family"
    with shuffles_freed(spark):
        df.repartition(files).write.parquet(folder)
    return folder


@query("stm_01_batch_metrics", oracle="""
SELECT 'rows' AS name, CAST(count(*) AS VARCHAR) AS value FROM events
UNION ALL SELECT 'min_id', CAST(min(event_id) AS VARCHAR) FROM events UNION ALL SELECT 'max_id', CAST(max(event_id) AS VARCHAR) FROM events
UNION ALL SELECT 'batches', '4'""")
def stm_01_batch_metrics(spark, sf):
    """STM-1: the metrics that every micro-batch of an ingest wrote, put
    together (eight files, two a batch)."""
    e = spark.read.parquet(f"{sf.rstrip('/')}/events.parquet")
    src = _family(spark, e.select("event_id", "event_type", "value"), 8, "family")
    out, ckpt = jobs.scratch(spark, "metrics")
    jobs.run_append(jobs.file_stream(spark, src, e.select("event_id", "event_type", "value").schema, max_files_per_trigger=2), out, ckpt,
                    metrics={"min_id": F.min("event_id"), "max_id": F.max("event_id")})
    m = jobs.batch_metrics(spark, out).withColumn("n", F.col("value").cast("long"))
    total = m.groupBy("name").agg(F.when(F.col("name") == "rows", F.sum("n")).when(F.col("name") == "min_id", F.min("n"))
                                  .otherwise(F.max("n")).cast("string").alias("value"))
    return total.unionByName(m.agg(F.lit("batches").alias("name"), F.count_distinct("batch_id").cast("string").alias("value")))


class _Stopped(Exception):
    pass


@query("stm_03_stream_resume", oracle="""
SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, 3 AS batches FROM events GROUP BY event_type""")
def stm_03_stream_resume(spark, sf):
    """STM-3: an ingest that dies between the write and the commit of its
    second batch and is started again: no row twice, none missing."""
    e = spark.read.parquet(f"{sf.rstrip('/')}/events.parquet").select("event_id", "event_type", "value")
    src = _family(spark, e, 6, "resumed")
    out, ckpt = jobs.scratch(spark, "resume")

    def die(batch_id):
        if batch_id == 1:
            raise _Stopped("lost before the commit")
    stream = lambda: jobs.file_stream(spark, src, e.schema, max_files_per_trigger=2)
    try:
        jobs.run_append(stream(), out, ckpt, after_write=die)
    except Exception as stopped:  # noqa: BLE001 - the planted failure, wrapped by the stream
        if "lost before the commit" not in str(stopped):
            raise
    jobs.run_append(stream(), out, ckpt)
    rows = jobs.read_batches(spark, out, "data", e.schema)
    batches = rows.agg(F.count_distinct("batch_id").cast("int").alias("batches"))
    return with_scalars(rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")), batches)


def _totals_sql():
    from murmur.plans.q_models import LEXICON_SCORES_SQL
    return f"""
SELECT vader_label, count(*) AS n, round(avg(vader_compound), 6) AS mean, round(stddev_samp(vader_compound), 6) AS std,
       min(vader_compound) AS min, max(vader_compound) AS max FROM ({LEXICON_SCORES_SQL}) GROUP BY vader_label"""


@query("stm_02_stream_running_totals", oracle=_totals_sql())
def stm_02_stream_running_totals(spark, sf):
    """STM-2: lexicon scoring of the documents as a stream of files, with
    mergeable totals per label."""
    from murmur.plans.q_models import lexicon
    lex = stored(lexicon(spark, sf))
    d = spark.read.parquet(f"{sf.rstrip('/')}/documents.parquet").select("doc_id", "text")
    src = _family(spark, d, 4, "documents")
    out, ckpt = jobs.scratch(spark, "totals")
    jobs.score_stream(jobs.file_stream(spark, src, d.schema, max_files_per_trigger=2), out, ckpt,
                      score=lambda batch: se.lexicon_scores(batch, "text", lex, check_blank=False),
                      group="vader_label", value="vader_compound")
    return rounded(jobs.running_totals(spark, out, "vader_label"))


@query("stm_02_stateful_totals", oracle="""
SELECT event_type AS key, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min,
       max(value) AS max FROM events GROUP BY event_type""")
def stm_02_stateful_totals(spark, sf):
    """STM-2 with running moments in the state store, over four batches."""
    e = spark.read.parquet(f"{sf.rstrip('/')}/events.parquet").select("event_type", "value")
    src = _family(spark, e, 8, "state")
    out, ckpt = jobs.scratch(spark, "state")
    jobs.stateful_totals(jobs.file_stream(spark, src, e.schema, max_files_per_trigger=2), out, ckpt, group="event_type", value="value")
    return rounded(jobs.latest_totals(spark, out))
