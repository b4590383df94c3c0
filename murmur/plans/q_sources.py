"""Sources and sinks as queries: files are written from the driver's tables,
by Spark, to the shared folder, and read back by the readers under test."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from murmur.plans import bindings as b
from murmur.plans.registry import query, rounded
from murmur.session import checkpoint_dir
from murmur.sources import readers as rd
from murmur.sources import sinks as sk
from murmur.sources.tables import table


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/files/{name}-{uuid.uuid4().hex[:12]}"


_EVENT = "event_id long, user_id long, event_type string, value double"


@query("src_01_csv_options", oracle="""
SELECT c_custkey, c_name || CASE WHEN c_custkey % 5 = 0 THEN ' | "quoted"' ELSE '' END AS c_name, round(c_acctbal, 6) AS c_acctbal
FROM customer""")
def src_01_csv_options(spark, sf):
    """SNK-3 + SRC-1/2: customers to CSV (own separator, quotes inside values)
    and back with a declared schema and a column list."""
    path = _folder(spark, "csv")
    c = table(spark, sf, "customer").withColumn("c_name", F.when(
        F.col("c_custkey") % 5 == 0, F.concat("c_name", F.lit(' | "quoted"'))).otherwise(F.col("c_name")))
    c.write.option("sep", "|").option("header", True).option("escape", '"').csv(path)
    back = rd.read_csv(spark, path, c.schema, sep="|", columns=["c_custkey", "c_name", "c_acctbal"])
    return rounded(back)


@query("src_03_csv_reject_split", oracle="""
WITH e AS (SELECT *, event_id % 11 = 0 AS wide, event_id % 13 = 0 AS narrow, event_id % 17 = 0 AS bad FROM events),
f AS (SELECT *, wide OR narrow OR bad AS faulty FROM e)
SELECT 'accepted' AS status, event_type, count(*) AS n, round(sum(value), 4) AS total, min(event_id) AS first_id, max(event_id) AS last_id
FROM f WHERE NOT faulty GROUP BY event_type
UNION ALL SELECT 'rejected', CASE WHEN wide THEN 'too many' WHEN narrow THEN 'too few' ELSE 'bad number' END, count(*),
  NULL, min(event_id), max(event_id) FROM f WHERE faulty GROUP BY 2
UNION ALL SELECT 'counted', 'accepted', count(CASE WHEN NOT faulty THEN 1 END), NULL, NULL, NULL FROM f
UNION ALL SELECT 'counted', 'rejected', count(CASE WHEN faulty THEN 1 END), NULL, NULL, NULL FROM f""")
def src_03_csv_reject_split(spark, sf):
    """SRC-3: events as CSV lines, some with a field too many, a field too few
    or a bad number; the split, the bad lines by fault, and both counts."""
    lines, out = _folder(spark, "lines"), _folder(spark, "split")
    e = b.events(spark, sf)
    num = F.col("value").cast("string")
    line = (F.when(F.col("event_id") % 11 == 0, F.concat_ws(",", "event_id", "user_id", "event_type", num, F.lit("extra")))
            .when(F.col("event_id") % 13 == 0, F.concat_ws(",", "event_id", "user_id", "event_type"))
            .when(F.col("event_id") % 17 == 0, F.concat_ws(",", "event_id", "user_id", "event_type", F.lit("n/a")))
            .otherwise(F.concat_ws(",", "event_id", "user_id", "event_type", num)))
    # a blank line after every 50th
    e.select(F.explode(F.when(F.col("event_id") % 50 == 0, F.array(line, F.lit(""))).otherwise(F.array(line))).alias("value")) \
        .write.text(lines)
    counts = rd.ingest_csv(spark, lines, _EVENT, out, header=False)
    good, bad = rd.read_ingested(spark, out, _EVENT)
    kept = good.groupBy(F.lit("accepted").alias("status"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("event_id").alias("first_id"),
        F.max("event_id").alias("last_id"))
    fields = F.split(rd.CORRUPT, ",")
    fault = F.when(F.size(fields) > 4, "too many").when(F.size(fields) < 4, "too few").otherwise("bad number")
    lost = bad.groupBy(F.lit("rejected").alias("status"), fault.alias("event_type")).agg(
        F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("total"), F.min(fields[0].cast("long")).alias("first_id"),
        F.max(fields[0].cast("long")).alias("last_id"))
    told = spark.createDataFrame([("counted", k, v, None, None, None) for k, v in counts.items()], kept.schema)
    return kept.unionByName(lost).unionByName(told)


@query("src_04_json_lines", oracle="""
SELECT 'lines' AS kind, event_id AS id, event_type AS name, round(value, 6) AS value FROM events
UNION ALL SELECT 'array', n_nationkey, n_name, CAST(n_regionkey AS DOUBLE) FROM nation""")
def src_04_json_lines(spark, sf):
    """SNK-5 + SRC-4: events as JSON lines, and the nations of each region as
    files that hold one JSON array, both back with declared schemas."""
    lines, arrays = _folder(spark, "lines"), _folder(spark, "arrays")
    sk.write_jsonl(b.events(spark, sf).select("event_id", "event_type", "value"), lines)
    n = table(spark, sf, "nation")
    n.groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey"))).alias("value")) \
        .select("value", F.col("n_regionkey").alias("part")).write.partitionBy("part").text(arrays)
    a = rd.read_json(spark, lines, "event_id long, event_type string, value double").select(
        F.lit("lines").alias("kind"), F.col("event_id").alias("id"), F.col("event_type").alias("name"), "value")
    z = rd.read_json(spark, arrays, "n_nationkey long, n_name string, n_regionkey long", array_file=True).select(
        F.lit("array").alias("kind"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"),
        F.col("n_regionkey").cast("double").alias("value"))
    return rounded(a.unionByName(z))


@query("snk_06_versioned_runs", oracle="""
SELECT run_id, event_type, count(*) AS n, round(sum(value), 4) AS total, (SELECT count(*) FROM events WHERE (event_type = 'error') = (run_id = 'errors'))
         AS manifest_rows
FROM (SELECT *, CASE WHEN event_type = 'error' THEN 'errors' ELSE 'others' END AS run_id FROM events) GROUP BY run_id, event_type""")
def snk_06_versioned_runs(spark, sf):
    """SNK-2/4/6 + SRC-7: two runs staged and committed, a third staged and
    left there; readers see the two whole runs and their manifests."""
    root = _folder(spark, "runs")
    e = b.events(spark, sf).select("event_id", "event_type", "value")
    sk.write_versioned(e.where("event_type = 'error'"), root, "errors")
    sk.write_versioned(e.where("event_type <> 'error'"), root, "others")
    sk.stage_run(e.where("event_id % 2 = 0"), root)     # its writer is lost before the commit
    runs = spark.createDataFrame([(m["run_id"], m["rows"]) for m in sk.committed_runs(spark, root)], "run_id string, manifest_rows long")
    return sk.read_runs(spark, root).groupBy("run_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).join(runs, "run_id")
