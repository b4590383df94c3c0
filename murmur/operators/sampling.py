"""Exact, reproducible sampling (SMP-1..5, WIN-9, AGG-37/44).

Samples are ordered by ``md5(seed || '|' || id)``: reproducible across runs,
partitionings and engines (DuckDB computes the same digest), and exact in
size - unlike ``DataFrame.sample``, whose size is random.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.operators.common import with_scalars
from murmur.operators.rank import positions
from murmur.session import cut_lineage


def sample_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))


def simple_sample(df: DataFrame, n: int, *, id_col: str, seed: int = 2020) -> DataFrame:
    """SMP-1: exactly ``min(n, rows)`` rows, the n smallest sample keys
    (a bounded top-k: TakeOrderedAndProject keeps n rows per task)."""
    if n <= 0:
        raise ValueError("sample size must be positive")
    k = sample_key(id_col, seed)
    return df.withColumn("_key", k).orderBy("_key", id_col).limit(n).drop("_key")


def allocation(df: DataFrame, n: int, strata: Sequence[str]) -> DataFrame:
    """SMP-2 allocation audit (Hamilton / largest remainder): per stratum
    source_records, exact_allocation, floor, remainder, allocated_records,
    shares. Leftover units go to the largest remainders, ties by stratum
    keys. The strata frame is small (one row per stratum)."""
    counts = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("source_records"))
    tot = counts.agg(F.sum("source_records").alias("_N"))
    c = with_scalars(counts, tot)
    c = c.withColumn("exact_allocation", F.col("source_records") / F.col("_N") * n).withColumn(
        "_floor", F.floor("exact_allocation").cast("long")).withColumn(
        "fractional_remainder", F.col("exact_allocation") - F.col("_floor"))
    left = c.agg((F.lit(n) - F.sum("_floor")).alias("_left"))
    c = with_scalars(c, left)
    w = Window.orderBy(F.desc("fractional_remainder"), *[F.asc(s) for s in strata])  # one row per stratum
    c = c.withColumn("_prio", F.row_number().over(w))
    c = c.withColumn("allocated_records", (F.col("_floor") + (F.col("_prio") <= F.col("_left")).cast("long")))
    return c.select(*strata, "source_records", "exact_allocation", "fractional_remainder", "allocated_records",
                    (100.0 * F.col("source_records") / F.col("_N")).alias("source_share_pct"),
                    (100.0 * F.col("allocated_records") / F.lit(n)).alias("sample_share_pct"))


def stratified_sample(df: DataFrame, n: int, strata: Sequence[str], *, id_col: str, seed: int = 2020,
                      slack: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """SMP-2: proportional stratified sample of exactly ``n`` rows.

    Within a stratum the rows with the smallest sample keys are taken. To
    avoid a window over a whole (possibly huge) stratum, rows are first
    pre-filtered by a key threshold that keeps ~k + slack*sqrt(k) + 10 of
    them; the kept set is a prefix of the stratum's key order, so ranking
    it is exact whenever it holds at least k rows. The few strata where it
    does not are ranked in full. Returns (sample, allocation)."""
    alloc = allocation(df, n, strata)
    key = sample_key(id_col, seed)
    # first 15 hex digits -> [0, 1): monotone in the digest order
    u = F.conv(F.substring(key, 1, 15), 16, 10).cast("double") / float(16 ** 15)
    own = [f"_s{i}" for i in range(len(strata))]  # null strata are strata too
    a = alloc.select(*[F.col(s).alias(o) for s, o in zip(strata, own)], "allocated_records", "source_records")
    same = [F.col(s).eqNullSafe(F.col(o)) for s, o in zip(strata, own)]
    rows = df.join(a, same).withColumn("_key", key).withColumn("_u", u)
    k = F.col("allocated_records")
    bound = F.least(F.lit(1.0), (k + slack * F.sqrt(k) + 10) / F.col("source_records"))
    cand = rows.where((k > 0) & (F.col("_u") <= bound))
    w = Window.partitionBy(*own).orderBy("_key", id_col)
    ranked = cand.withColumn("_rn", F.row_number().over(w)).withColumn(
        "_nc", F.count(F.lit(1)).over(Window.partitionBy(*own)))
    ok = ranked.where(F.col("_nc") >= k).where(F.col("_rn") <= k)
    # from the allocation: a stratum may have no candidate at all
    kept = cand.groupBy(*[F.col(o).alias(f"{o}k") for o in own]).agg(F.count(F.lit(1)).alias("_nk"))
    short = a.where(k > 0).join(kept, [F.col(o).eqNullSafe(F.col(f"{o}k")) for o in own], "left").where(
        F.coalesce("_nk", F.lit(0)) < k).select(*[F.col(o).alias(f"{o}x") for o in own])
    full = rows.where(k > 0).join(short, [F.col(o).eqNullSafe(F.col(f"{o}x")) for o in own], "left_semi").withColumn("_rn", F.row_number().over(w)).where(
        F.col("_rn") <= k)
    keep = [c for c in df.columns]
    sample = ok.select(*keep).unionByName(full.select(*keep))
    return sample, alloc


FAN = 64    # children of a node of the checksum's tree


def sample_checksum(sample: DataFrame, id_col: str) -> DataFrame:
    """SMP-3: an order-sensitive SHA-256 of the selected ids, with the rows.

    A Merkle tree: in the order of the ids as text, every ``FAN`` of them are
    joined by commas and hashed, then every ``FAN`` digests, up to one root. So
    no task ever holds more than ``FAN`` values, however large the sample. An
    empty sample has the digest of the empty text."""
    placed = positions(sample.select(F.col(id_col).cast("string").alias("_id")), ["_id"])
    level = cut_lineage(placed.select("_pos", "_id"))
    rows = level.agg(F.count(F.lit(1)).alias("n"), F.count("_id").alias("ids")).first()
    name, n = "_id", rows["n"]
    while True:
        group = F.expr(f"_pos div {FAN}")
        level = level.groupBy(group.alias("_up")).agg(
            F.sort_array(F.collect_list(F.struct("_pos", F.coalesce(F.col(name), F.lit("")).alias("v")))).alias("_c")).select(
            F.col("_up").alias("_pos"), F.sha2(F.array_join(F.transform("_c", lambda c: c["v"]), ","), 256).alias("_h"))
        name, n = "_h", -(-n // FAN)
        if n <= 1:
            break
    root = level.agg(F.max("_h").alias("_h"))
    return root.select(F.lit(rows["n"]).cast("long").alias("sample_rows"),
                       F.coalesce("_h", F.sha2(F.lit(""), 256)).alias("checksum_sha256"))


def stratum_sizes(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    """AGG-37: stratum sizes with their min and max."""
    c = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.count(F.lit(1)).alias("strata"), F.min("n").alias("min_stratum"), F.max("n").alias("max_stratum"))


def share_vs_source(sample: DataFrame, source: DataFrame, col: str) -> DataFrame:
    """AGG-44: category share in the sample vs the source."""
    s = sample.groupBy(col).agg(F.count(F.lit(1)).alias("sample_n"))
    t = source.groupBy(col).agg(F.count(F.lit(1)).alias("source_n"))
    j = t.join(s, col, "left").na.fill(0, ["sample_n"])
    tot = j.agg(F.sum("sample_n").alias("_sn"), F.sum("source_n").alias("_tn"))
    j = with_scalars(j, tot)
    return j.select(col, "source_n", "sample_n", (100.0 * F.col("source_n") / F.col("_tn")).alias("source_pct"),
                    (100.0 * F.col("sample_n") / F.col("_sn")).alias("sample_pct"))
