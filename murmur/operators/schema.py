"""Projection, schema mapping and typing (PRJ-*), keyed lookups (JOI-3/4/12/13).

The ingest transform applies, in this fixed order: record mapper ->
rename -> constants -> projection -> UTC normalisation (the reference's
order). All steps are column expressions on one projection.
"""

from __future__ import annotations

from typing import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.operators.common import require_columns


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """PRJ-2 / PRJ-17."""
    require_columns(df, mapping.keys())
    return df.withColumnsRenamed(dict(mapping))


def prefix_columns(df: DataFrame, cols: Sequence[str], prefix: str) -> DataFrame:
    """PRJ-17: prefix a block of score columns (e.g. per model)."""
    return rename(df, {c: f"{prefix}{c}" for c in cols})


def constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """PRJ-3."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def to_utc(df: DataFrame, cols: Sequence[str], errors: str = "raise", fmt: str | None = None) -> DataFrame:
    """PRJ-5: parse to UTC timestamps (session zone is UTC, so naive values
    are taken as UTC). ``errors='raise'`` fails on a bad value (ANSI
    cast), ``'coerce'`` turns it into NULL."""
    if errors not in ("raise", "coerce"):
        raise ValueError("errors must be 'raise' or 'coerce'")
    out = {}
    for c in cols:
        src = F.col(c)
        if errors == "coerce":
            out[c] = F.try_to_timestamp(src.cast("string"), F.lit(fmt)) if fmt else src.try_cast("timestamp")
        else:
            out[c] = F.to_timestamp(src.cast("string"), fmt) if fmt else src.cast("timestamp")
    return df.withColumns(out)


def align_zone(c, zone: str) -> Column:
    """PRJ-6: UTC instant -> wall-clock time in ``zone`` (an unknown zone is
    an error raised by Spark)."""
    return F.from_utc_timestamp(F.col(c) if isinstance(c, str) else c, zone)


def ingest_transform(df: DataFrame, *, mapper: Callable[[DataFrame], DataFrame] | None = None,
                     rename_fields: Mapping[str, str] | None = None,
                     constant_fields: Mapping[str, object] | None = None, fields: Sequence[str] | None = None,
                     timestamp_columns: Sequence[str] = (), timestamp_errors: str = "raise") -> DataFrame:
    """E1 step 4: mapper (PRJ-4, runs first) -> rename (PRJ-2) -> constants
    (PRJ-3) -> projection (PRJ-1, missing names are an error) -> UTC (PRJ-5)."""
    out = df.transform(mapper) if mapper else df
    if rename_fields:
        out = rename(out, rename_fields)
    if constant_fields:
        out = constants(out, constant_fields)
    if fields:
        out = require_columns(out, fields).select(*fields)
    if timestamp_columns:
        out = to_utc(out, timestamp_columns, timestamp_errors)
    return out


def event_registry(df: DataFrame, *, apply_timezone: bool = False) -> DataFrame:
    """PRJ-7: curated events. As in the reference, ``event_timestamp_utc``
    is read from the local timestamp and the zone is only carried; with
    ``apply_timezone`` the local wall clock is converted to UTC."""
    local = F.col("event_timestamp_local").cast("timestamp")
    utc = F.to_utc_timestamp(local, F.col("event_timezone")) if apply_timezone else local
    return df.select(F.col("event_id").cast("string"), utc.alias("event_timestamp_utc"), "event_timezone",
                     "event_name", "event_category", "event_description", "source_url")


def infer_column(df: DataFrame, candidates: Sequence[str], required: bool = True) -> str | None:
    """PRJ-11: first existing column among ordered candidates."""
    for c in candidates:
        if c in df.columns:
            return c
    if required:
        raise ValueError(f"none of {list(candidates)} present")
    return None


def score_column(df: DataFrame, preferred: str = "sentiment", fallbacks: Sequence[str] = ("roberta_score",
                                                                                           "vader_compound")) -> str:
    """PRJ-12: score-column fallback chain (error when none exists)."""
    return infer_column(df, [preferred, *fallbacks])


def numeric(c) -> Column:
    """PRJ-14: numeric coercion, bad values -> NULL."""
    return (F.col(c) if isinstance(c, str) else c).try_cast("double")


def append_block(df: DataFrame, block: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """PRJ-18: add the columns a block produces; a block that would overwrite
    an existing column is an error."""
    out = block(df)
    before = set(df.columns)
    missing = before - set(out.columns)
    if missing:
        raise ValueError(f"block dropped columns: {sorted(missing)}")
    return out


def guard_new_columns(df: DataFrame, new_cols: Iterable[str]) -> None:
    clash = sorted(set(new_cols) & set(df.columns))
    if clash:
        raise ValueError(f"columns already exist: {clash}")


def required_fields(df: DataFrame, *, texts: Sequence[str] = (), counts: Sequence[str] = (),
                    parts: Mapping[str, Sequence[str]] | None = None, fault: str = "fault") -> tuple[DataFrame, DataFrame]:
    """PRJ-9: (good, bad) rows. Texts must not be blank (they are trimmed),
    counts must be whole numbers from 0 on (they become longs), and the parts
    of a total must not exceed it. Bad rows keep their values as they came and
    say in ``fault`` which rule failed first."""
    number = {c: F.when(F.trim(F.col(c).cast("string")).rlike("^[+-]?[0-9]+$"), F.col(c).cast("string")).try_cast("long") for c in counts}
    reason = F.lit(None).cast("string")
    rules = [(F.coalesce(F.trim(F.col(c)) == "", F.lit(True)), f"{c}: text required") for c in texts]
    rules += [(F.coalesce(number[c] < 0, F.lit(True)), f"{c}: count required") for c in counts]
    rules += [(sum((number[p] for p in ps), F.lit(0)) > number[t], f"{t}: less than its parts") for t, ps in (parts or {}).items()]
    for broken, text in reversed(rules):
        reason = F.when(broken, F.lit(text)).otherwise(reason)
    marked = df.withColumn(fault, reason)
    good = marked.where(F.col(fault).isNull()).drop(fault).withColumns({**{c: F.trim(F.col(c)) for c in texts}, **number})
    return good, marked.where(F.col(fault).isNotNull())


def alias_columns(df: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """PRJ-10: compatibility alias columns (new name -> existing column)."""
    return df.withColumns({new: F.col(old) for new, old in aliases.items()})


def schema_profile(df: DataFrame, required: Sequence[str] = (), optional: Sequence[str] = ()) -> DataFrame:
    """PRJ-19: one row per column (name, type, required flag) plus the row
    count as a column; missing required columns are an error."""
    require_columns(df, required)
    spark = df.sparkSession
    meta = spark.createDataFrame([(f.name, f.dataType.simpleString(), f.name in required)
                                  for f in df.schema.fields],
                                 "column string, type string, required boolean")
    n = df.agg(F.count(F.lit(1)).alias("row_count"))
    missing = [c for c in optional if c not in df.columns]
    from murmur.operators.common import with_scalars
    return with_scalars(meta, n).withColumn("missing_optional_columns",
                                            F.array(*[F.lit(c) for c in missing]).cast("array<string>"))


def row_position(df: DataFrame, key: str, out: str = "row_position") -> DataFrame:
    """PRJ-13: 0-based position of each row in ``key`` order, for keys of any
    type, without a single-partition sort (ties share the position of their
    first row). One row per distinct key is placed and joined back."""
    from murmur.operators.common import join_back
    from murmur.operators.rank import positions
    from murmur.session import cut_lineage
    keys = df.groupBy(F.col(key).alias("_pk")).agg(F.count(F.lit(1)).alias("_rows"))
    placed = positions(keys, ["_pk"], "_place")
    before = Window.partitionBy("_block").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut_lineage(placed.withColumn("_block", F.expr("_place div 4096")))
    sums = blocks.groupBy("_block").agg(F.sum("_rows").alias("_sum"))
    # rows before each block of keys: one row per 4096 keys
    starts = sums.select("_block", F.coalesce(F.sum("_sum").over(
        Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    found = blocks.join(starts, "_block").select("_pk", "_rows", (
        F.col("_start") + F.coalesce(F.sum("_rows").over(before), F.lit(0))).alias(out))
    return join_back(df, cut_lineage(found), {"_pk": key}, "_rows")


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "variable",
            value: str = "value") -> DataFrame:
    """PRJ-21: wide -> long."""
    return df.unpivot(list(ids), list(values), name, value)


def unique_right(right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JOI-3/4/12: the right side of a many-to-one join, with a run-time
    uniqueness check: a duplicated key fails the job. The check is an
    aggregate on the join key, so the join that follows reuses its
    partitioning (no extra shuffle)."""
    others = [c for c in right.columns if c not in keys]
    g = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in others])
    msg = F.concat(F.lit("duplicate right key: "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))
    checked = g.withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(msg)).otherwise(F.col("_n")))
    return checked.where(F.col("_n").isNotNull()).drop("_n")   # the filter keeps the check alive


def left_join_unique(left: DataFrame, right: DataFrame, keys: Sequence[str], *,
                     only_new: bool = True) -> DataFrame:
    """JOI-4: left join by a unique key, attaching only columns the left side
    does not have."""
    r = unique_right(right, keys)
    if only_new:
        r = r.select(*keys, *[c for c in r.columns if c not in keys and c not in left.columns])
    return left.join(r, list(keys), "left")
