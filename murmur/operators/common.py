"""Small shared helpers."""

from __future__ import annotations

from typing import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY = 64      # a key with 1 / HEAVY of all rows is heavy: at most HEAVY keys are
SALTS = 4096    # over which rows that are already served are dealt
SMALL = 32 << 20    # measured bytes up to which a table is broadcast


def with_scalars(df: DataFrame, scalars: DataFrame, how: str = "inner") -> DataFrame:
    """Attach the columns of a one-row frame (a global aggregate or a
    ``limit(1)``) to every row of ``df``.

    Size bound: callers only pass frames that are global aggregates or
    limited to one row, so the broadcast side is one row regardless of data
    size. Planned as a broadcast hash join on a constant key."""
    return (df.withColumn("_sk", F.lit(0))
            .join(F.broadcast(scalars.withColumn("_sk", F.lit(0))), "_sk", how).drop("_sk"))


def fits_broadcast(df: DataFrame, most: int = SMALL) -> bool:
    """Whether a materialised frame of words or ids is measured to be small;
    the planner's estimate of its size may be far off, and it finds the true
    one only after the other side has been shuffled. Never where broadcasts
    are switched off."""
    if df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").startswith("-"):
        return False
    size = F.lit(0)
    for f in df.schema.fields:
        size = size + (F.coalesce(F.octet_length(f.name), F.lit(0)) + 16 if f.dataType.simpleString() in ("string", "binary")
                       else F.lit(8))
    return (df.agg(F.sum(size.cast("long")).alias("bytes")).first()["bytes"] or 0) <= most


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan with fewer splits than the cluster has cores
    (a small file is one split) to all cores, before costly work on each row.
    A scan with enough splits is left as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def join_back(df: DataFrame, keyed: DataFrame, on: Mapping[str, Column | str], weight: str) -> DataFrame:
    """Attach to every row of ``df`` the columns of ``keyed``, which has one
    row per key and in ``weight`` the number of rows of ``df`` with that key.
    ``on`` maps the key columns of ``keyed`` to columns or expressions of
    ``df``; NULL keys match NULL keys, keys without a row give NULLs.

    A join on a value sends all rows of a frequent value to one task. Here the
    weights tell which keys hold at least ``1 / HEAVY`` of all rows: those, at
    most ``HEAVY`` rows whatever the data, go by broadcast. Only the other
    rows are joined by shuffle; the rows already served take part in it under
    random salts that match nothing, so they are dealt evenly. ``keyed`` is
    read three times and should be materialised."""
    names, values = list(on), [c for c in keyed.columns if c not in on and c != weight]
    total = keyed.agg(F.sum(weight).alias("_all"))
    heavy = with_scalars(keyed, total).where(F.col(weight) * HEAVY >= F.col("_all")).select(
        *[F.col(k).alias(f"_h{i}") for i, k in enumerate(names)], F.struct(*values).alias("_hv"))
    light = keyed.select(*[F.col(k).alias(f"_l{i}") for i, k in enumerate(names)], F.struct(*values).alias("_lv"),
                         F.least(F.col(weight), F.lit(0)).cast("long").alias("_lsalt"))  # 0, but no literal: a join key
    left = df.withColumns({f"_k{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(on.values())})

    def same(side):
        out = F.lit(True)
        for i in range(len(names)):
            out = out & F.col(f"_k{i}").eqNullSafe(F.col(f"_{side}{i}"))
        return out
    left = left.join(F.broadcast(heavy), same("h"), "left").withColumn(
        "_salt", F.when(F.col("_hv").isNotNull(), 1 + F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
        .otherwise(F.lit(0)).cast("long"))
    both = left.join(light, same("l") & (F.col("_salt") == F.col("_lsalt")), "left")
    value = F.coalesce("_hv", "_lv")
    return both.select(*df.columns, *[value[c].alias(c) for c in values])


def require_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """PRJ-1 guard: missing names are an error before anything runs."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"required columns are missing: {missing}")
    return df


def safe_corr(a, b):
    """Pearson correlation over pairwise-complete rows, NULL (not an ANSI
    divide-by-zero error) when either side is constant."""
    x = F.col(a) if isinstance(a, str) else a
    y = F.col(b) if isinstance(b, str) else b
    xm = F.when(y.isNotNull(), x.cast("double"))
    ym = F.when(x.isNotNull(), y.cast("double"))
    return F.try_divide(F.covar_samp(xm, ym), F.stddev_samp(xm) * F.stddev_samp(ym))
