"""How the driver tables play the roles of the social-listening data model.

* posts            <- ``events``: id=event_id, created_at=ts, user=user_id,
                      score=value, stream from event_type
* event registry   <- top-4 ``error`` events by value desc, event_id
* text corpus      <- ``documents`` (source acts as the author)
* regions/outcomes <- ``nation`` x ``customer`` x ``orders``
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.operators.temporal import event_registry_from_top
from murmur.sources.tables import table

# Fixed binding values: which event types feed each of the two streams.
# 'error' rows belong to both, like posts collected by both hashtag streams.
STREAM_A_TYPES = ["click", "view", "error"]
STREAM_B_TYPES = ["purchase", "signup", "error"]
REGISTRY_K = 4


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def registry(spark: SparkSession, sf: str) -> DataFrame:
    ev = events(spark, sf).where(F.col("event_type") == "error")
    return event_registry_from_top(
        ev, k=REGISTRY_K, order_by=[F.desc("value"), F.asc("event_id")],
        name=F.concat(F.lit("error_"), F.col("event_id").cast("string")), time_col="ts")


def streams(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    ev = events(spark, sf)
    a = ev.where(F.col("event_type").isin(*STREAM_A_TYPES)).withColumn("candidate", F.lit("stream_a"))
    b = ev.where(F.col("event_type").isin(*STREAM_B_TYPES)).withColumn("candidate", F.lit("stream_b"))
    return a, b


# Fixed binding values: historical class of each nation by its region key.
REGION_CLASS = {0: "battleground", 1: "battleground", 2: "safe_red", 3: "safe_blue", 4: "unknown"}


def posts(spark: SparkSession, sf: str) -> DataFrame:
    """Posts: both streams resolved by id (first kept, membership labelled),
    with the author's nation as region."""
    from murmur.operators.dedupe import resolve_membership
    a, b = streams(spark, sf)
    p = resolve_membership([a, b], ["stream_a", "stream_b"], id_col="event_id", order_by=["ts"],
                           candidates=["candidate_a", "candidate_b"])
    cust = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nat = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("state_code"))
    return (p.join(cust, p["user_id"] == cust["c_custkey"], "left")
            .join(nat, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .drop("c_custkey", "c_nationkey", "n_nationkey"))


def regions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_name").alias("state_code"))


def returns_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Per nation: order counts by status as the two main tallies and the
    total, customer means as controls, region key as historical class."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderstatus")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = table(spark, sf, "nation")
    votes = (o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_nationkey").alias("_vk")).agg(
        F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("a_votes"),
        F.count(F.when(F.col("o_orderstatus") == "O", 1)).alias("b_votes"),
        F.count(F.lit(1)).alias("total_votes")))
    ctrl = c.groupBy(F.col("c_nationkey").alias("_ck")).agg(
        F.avg("c_acctbal").alias("c_age"), F.max("c_acctbal").alias("c_income"),
        F.count(F.lit(1)).cast("double").alias("c_urban"),
        (100.0 * F.avg((F.col("c_mktsegment") == "BUILDING").cast("double"))).alias("c_edu"),
        (100.0 * F.avg((F.col("c_mktsegment") == "AUTOMOBILE").cast("double"))).alias("c_hisp"))
    cls = F.create_map(*[x for k, v in REGION_CLASS.items() for x in (F.lit(k), F.lit(v))])
    return (n.join(votes, F.col("n_nationkey") == F.col("_vk"))
            .join(ctrl, F.col("n_nationkey") == F.col("_ck"), "left")
            .select(F.col("n_name"), "a_votes", "b_votes", "total_votes", "c_age", "c_income", "c_urban", "c_edu",
                    "c_hisp", F.element_at(cls, F.col("n_regionkey")).alias("hist")))


CONTROLS = {"median_age": "c_age", "median_income": "c_income", "urbanization_index": "c_urban",
            "ba_education_pct": "c_edu", "hispanic_latino_pct": "c_hisp"}


def returns(spark: SparkSession, sf: str) -> DataFrame:
    from murmur.operators.spatial import returns_mapping
    return returns_mapping(returns_raw(spark, sf), state="n_name", a_votes="a_votes", b_votes="b_votes",
                           total="total_votes", controls=CONTROLS, historical="hist",
                           a_name="candidate_a", b_name="candidate_b")
