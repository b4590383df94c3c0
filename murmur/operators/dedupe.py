"""De-duplication, stream membership and set operations
(DED-1..6, PRJ-16, SET-1..4, AGG-36, TOP-3).

First/last-kept rows are chosen with ``min_by``/``max_by`` over an explicit
ordering struct inside a ``groupBy``: the aggregate has a map-side partial
step, so a key repeated millions of times (a short slogan, the missing
user) collapses before the shuffle instead of landing in one window
partition. NULL keys group together, like pandas ``duplicated``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def keep_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], *, last: bool = False) -> DataFrame:
    """DED-1..5: one row per key, the first (or last) by ``order_by``.

    ``order_by`` must make rows unique within a key (end it with an id) so
    the result is deterministic."""
    row = F.struct(*[F.col(c) for c in df.columns])
    order = F.struct(*[F.col(c) for c in order_by])
    pick = (F.max_by if last else F.min_by)(row, order)
    return df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(
        pick.alias("_r")).select("_r.*")


def drop_duplicates_mask(df: DataFrame, keys: Sequence[str], order_by: Sequence[str],
                         flag: str = "is_first") -> DataFrame:
    """Boolean flag instead of a filter (for telemetry): true on the kept row."""
    first = df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(
        F.min(F.struct(*order_by)).alias("_first"))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return (df.join(first, same, "left").withColumn(flag, F.struct(*order_by).eqNullSafe(F.col("_first")))
            .drop("_first", *[f"__k{i}" for i in range(len(keys))]))


def resolve_membership(streams: Sequence[DataFrame], names: Sequence[str], *, id_col: str,
                       order_by: Sequence[str], candidates: Sequence[str] | None = None) -> DataFrame:
    """SET-1 + DED-4 + PRJ-16: union all streams (tagged by position), keep
    the first row per id (earlier stream first, then ``order_by``), and
    label membership: 'both' when an id occurs in more than one stream,
    else '<name>_only'; ``candidate_resolved`` maps to the stream's candidate
    (or 'both')."""
    tagged = None
    for i, s in enumerate(streams):
        t = s.withColumn("_stream", F.lit(i))
        tagged = t if tagged is None else tagged.unionByName(t)
    row = F.struct(*[F.col(c) for c in tagged.columns if c != "_stream"])
    agg = tagged.groupBy(id_col).agg(
        F.min_by(row, F.struct("_stream", *order_by)).alias("_r"),
        F.min("_stream").alias("_lo"), F.max("_stream").alias("_hi"))
    names_arr = F.array(*[F.lit(n) for n in names])
    cands = F.array(*[F.lit(c) for c in (candidates or names)])
    member = F.when(F.col("_lo") != F.col("_hi"), F.lit("both")).otherwise(
        F.concat(F.element_at(names_arr, F.col("_lo") + 1), F.lit("_only")))
    resolved = F.when(F.col("_lo") != F.col("_hi"), F.lit("both")).otherwise(
        F.element_at(cands, F.col("_lo") + 1))
    return agg.select("_r.*", member.alias("stream_membership"), resolved.alias("candidate_resolved"))


def overlap_counts(a: DataFrame, b: DataFrame, id_col: str) -> DataFrame:
    """AGG-36 / SET-3: ids in each stream, in both, and shares of each."""
    ia = a.select(id_col).distinct().withColumn("_a", F.lit(1))
    ib = b.select(id_col).distinct().withColumn("_b", F.lit(1))
    j = ia.join(ib, id_col, "full")
    s = j.agg(F.count("_a").alias("ids_a"), F.count("_b").alias("ids_b"),
              F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("ids_both"))
    return s.select("ids_a", "ids_b", "ids_both",
                    (100.0 * F.col("ids_both") / F.col("ids_a")).alias("pct_of_a"),
                    (100.0 * F.col("ids_both") / F.col("ids_b")).alias("pct_of_b"))


def repeated_values(df: DataFrame, col: str, *, min_count: int = 2, top: int | None = 20) -> DataFrame:
    """DED-6 / TOP-3: values occurring at least ``min_count`` times, most
    frequent first, ties by value; ``top`` keeps the report to k rows."""
    r = df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    return r.orderBy(F.desc("n"), F.asc(col)).limit(top) if top else r


def missing_from(expected: DataFrame, present: DataFrame, cols: Sequence[str]) -> DataFrame:
    """SET-4: expected values that are absent (distinct, anti join)."""
    return expected.select(*cols).distinct().join(present.select(*cols).distinct(), list(cols), "left_anti")
