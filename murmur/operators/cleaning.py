"""Cleaning filters and stage telemetry (FLT-2..13, AGG-8/42/46, PRO-2b helpers).

Filters are plain ``where`` predicates (pushed into the Parquet scan when
they touch raw columns). Telemetry never runs one count per stage: every
stage predicate becomes a flag column and a single aggregate counts them.
"""

from __future__ import annotations

import datetime as dt
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions import text as tx

ELECTION_DATE = dt.datetime(2020, 11, 3)


def account_age_ok(created, *, election_date: dt.datetime = ELECTION_DATE, min_days: int = 30) -> Column:
    """FLT-2: keep when creation time is unknown or at least ``min_days``
    before the reference date."""
    c = (F.col(created) if isinstance(created, str) else created).try_cast("timestamp")
    cutoff = F.lit(election_date - dt.timedelta(days=min_days)).cast("timestamp")
    return c.isNull() | (c <= cutoff)


def bot_score_ok(score, threshold: float) -> Column:
    """FLT-3: keep NULL or non-numeric scores and scores below ``threshold``."""
    if threshold < 0:
        raise ValueError("bot_score_threshold must be non-negative")
    s = (F.col(score) if isinstance(score, str) else score).try_cast("double")
    return s.isNull() | (s < threshold)


def nonempty(c) -> Column:
    """FLT-6."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.length(col) > 0, F.lit(False))


def us_region(c, codes: Sequence[str]) -> Column:
    """FLT-7: region membership after trim + upper."""
    col = F.col(c) if isinstance(c, str) else c
    return F.upper(F.trim(col.cast("string"))).isin(*codes)


def period(ts, *, pre_end: dt.date, day: dt.date) -> Column:
    """PRJ-15: pre / election_day / post bucketing on the UTC date."""
    d = F.to_date(F.col(ts) if isinstance(ts, str) else ts)
    return (F.when(d < F.lit(day), F.lit("pre")).when(d == F.lit(day), F.lit("election_day"))
            .otherwise(F.lit("post")))


def stage_telemetry(df: DataFrame, stages: Mapping[str, Column]) -> DataFrame:
    """AGG-8 / AGG-46: funnel of cumulative stage predicates in one pass.

    ``stages`` is ordered: stage k keeps rows passing predicates 1..k.
    Output rows: stage, initial, final, dropped, drop_pct (0 when empty)."""
    names = list(stages)
    keep = F.lit(True)
    aggs = [F.count(F.lit(1)).alias("_initial")]
    for n in names:
        keep = keep & F.coalesce(stages[n], F.lit(False))
        aggs.append(F.count(F.when(keep, 1)).alias(n))
    s = df.agg(*aggs)
    prev = ["_initial"] + names[:-1]
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("stage_order"), F.lit(n).alias("stage"),
                                        F.col(p).alias("initial"), F.col(n).alias("final"))
                               for i, (n, p) in enumerate(zip(names, prev))]))
    out = s.select(rows.alias("r")).select("r.*")
    return out.withColumn("dropped", F.col("initial") - F.col("final")).withColumn(
        "drop_pct", F.when(F.col("initial") > 0, 100.0 * F.col("dropped") / F.col("initial")).otherwise(0.0))


def volume_before_after(df: DataFrame, ts: str, keep: Column, unit: str = "day") -> DataFrame:
    """AGG-42: per-day volume before and after a filter, one groupBy."""
    return df.groupBy(F.date_trunc(unit, F.col(ts)).alias("day")).agg(
        F.count(F.lit(1)).alias("before"), F.count(F.when(keep, 1)).alias("after"))


def clean_and_dedupe(df: DataFrame, *, text_col: str, user_col: str, order_by: Sequence[str],
                     decode: bool = True, key: str = "user_text") -> DataFrame:
    """The v3 cleaning step: clean text, drop empties (FLT-6), keep the first
    row per (user, cleaned text) (DED-3); ``key='text'`` gives DED-2."""
    from murmur.operators.dedupe import keep_first
    c = df.withColumn(f"{text_col}_cleaned", tx.clean_text(text_col, decode))
    c = c.where(nonempty(f"{text_col}_cleaned"))
    keys = [user_col, f"{text_col}_cleaned"] if key == "user_text" else [f"{text_col}_cleaned"]
    return keep_first(c, keys, order_by)
