"""Global ranks and exact quantiles without a single-partition sort (F-9).

WIN-1/2/3/6/7/8, AGG-2/21/25/29/49 and STA-2 all need a value's position in
the sorted column. A plain ``Window.orderBy`` would pull the whole column
into one task. Instead:

1. reduce the column to distinct values with counts (``groupBy(value)``; a
   hot value is one row after the map-side partial aggregate);
2. cut the distinct values into ~B balanced buckets using approximate
   quantile boundaries (one tiny row per group, checkpointed so a retried
   task sees the same boundaries);
3. per-bucket totals -> prefix offsets (a frame of B rows per group);
4. inside each bucket an ordered window gives the local running count;
   offset + local = number of rows strictly below the value.

Everything downstream (average rank, ECDF, Lorenz, Gini, exact linear
interpolation quantiles) is arithmetic on that ``rank frame``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.operators.common import join_back, with_scalars
from murmur.session import cut_lineage

_K = "_k"


def _buckets(df: DataFrame, buckets: int | None) -> int:
    if buckets:
        return buckets
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")))


def _probs(nb: int) -> list[float]:
    return [i / nb for i in range(1, nb)]


def range_buckets(d: DataFrame, value: str, out: str = "_b", *, buckets: int | None = None) -> DataFrame:
    """Adds ``out``: the number of a balanced range of ``value`` (0 first).
    The boundaries are one row, pinned by a checkpoint."""
    nb = _buckets(d, buckets)
    bounds = cut_lineage(d.agg(F.percentile_approx(value, _probs(nb), max(1000, 10 * nb)).alias("_bounds")))
    return with_scalars(d, bounds).withColumn(
        out, F.size(F.filter("_bounds", lambda x: x < F.col(value)))).drop("_bounds")


def rank_frame(df: DataFrame, value: str | Column, group_cols: Sequence[str] = (), *,
               buckets: int | None = None, with_weight: bool = False, rows: str | None = None) -> DataFrame:
    """Distinct (group..., _v) with _c (rows), _below (rows with a smaller
    value in the group), _n (non-null rows in group), _nd (distinct values),
    and with ``with_weight`` _wbelow (sum of smaller values) and _wsum.
    ``rows`` names a column that says how many rows a row of ``df`` stands
    for; _held is the number of rows of ``df`` itself. NULL groups are groups."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    g = list(group_cols)
    keys = g + [_K]
    count = F.col(rows).cast("long") if rows else F.lit(1).cast("long")
    base = df.select(*g, v.alias("_v"), count.alias("_c")).where(F.col("_v").isNotNull()).withColumn(_K, F.lit(0))
    d = base.groupBy(*keys, "_v").agg(F.sum("_c").alias("_c"), F.count(F.lit(1)).alias("_held"))
    nb = _buckets(df, buckets)
    bounds = d.groupBy(*keys).agg(
        F.percentile_approx("_v", _probs(nb), max(1000, 10 * nb)).alias("_bounds"),
        F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_nd"),
        *([F.sum(F.col("_v") * F.col("_c")).alias("_wsum")] if with_weight else []))
    # The sketch depends on merge order, so the boundaries are pinned by a
    # reliable checkpoint: every read, a retried task's too, has the same.
    bounds = cut_lineage(bounds)
    if g:
        # a group may hold most of the values: its one row of boundaries is
        # copied to nb salts and the values are dealt to them
        d = d.withColumn("_s", F.pmod(F.hash("_v"), F.lit(nb)))
        bounds = bounds.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
        d = _join(d, bounds, keys + ["_s"]).drop("_s")
    else:
        d = d.join(F.broadcast(bounds), keys)  # exactly one row
    d = d.withColumn("_b", F.size(F.filter("_bounds", lambda x: x < F.col("_v")))).drop("_bounds")
    per_b = d.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc"),
                                       *([F.sum(F.col("_v") * F.col("_c")).alias("_bw")] if with_weight else []))
    wb = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per_b = per_b.select(*keys, "_b", F.coalesce(F.sum("_bc").over(wb), F.lit(0)).alias("_off"),
                         *([F.coalesce(F.sum("_bw").over(wb), F.lit(0.0)).alias("_woff")] if with_weight else []))
    d = _join(d, per_b, keys + ["_b"])
    wl = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    out = d.withColumn("_below", F.col("_off") + F.coalesce(F.sum("_c").over(wl), F.lit(0)))
    cols = [*g, "_v", "_c", "_held", "_below", "_n", "_nd"]
    if with_weight:
        out = out.withColumn("_wbelow", F.col("_woff") + F.coalesce(
            F.sum(F.col("_v") * F.col("_c")).over(wl), F.lit(0.0)))
        cols += ["_wbelow", "_wsum"]
    return out.select(*cols)


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on equal names, NULL equal to NULL."""
    right = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(right, same).drop(*[f"_r_{k}" for k in keys])


def positions(df: DataFrame, order_by: Sequence[str], out: str = "_pos") -> DataFrame:
    """Adds the 0-based place of every row in the order of any columns (of any
    type; equal rows take places next to each other). Rows are cut into ranges
    of the order, pinned by a checkpoint, and numbered within; one row per
    range carries the numbers before it."""
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")))
    ranged = cut_lineage(df.repartitionByRange(n, *order_by).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(*order_by)
    return ranged.withColumn(out, F.row_number().over(inside)).join(starts, "_range").withColumn(
        out, F.col("_start") + F.col(out) - 1).drop("_range", "_start")


def avg_rank_pct(rf: DataFrame) -> Column:
    """Average rank / n (pandas ``rank(method='average', pct=True)``); a
    column with one distinct value ranks 0."""
    pct = (F.col("_below") + (F.col("_c") + 1) / 2.0) / F.col("_n")
    return F.when(F.col("_nd") == 1, F.lit(0.0)).otherwise(F.least(F.greatest(pct, F.lit(0.0)), F.lit(1.0)))


def percentile_rank(df: DataFrame, value: str, out: str, group_cols: Sequence[str] = (),
                    *, buckets: int | None = None, rows: str | None = None) -> DataFrame:
    """WIN-1: null-preserving percentile rank, joined back on the value."""
    return percentile_ranks(df, {value: out}, group_cols, buckets=buckets, rows=rows)


def percentile_ranks(df: DataFrame, mapping: dict[str, str], group_cols: Sequence[str] = (),
                     *, buckets: int | None = None, rows: str | None = None) -> DataFrame:
    """WIN-1 for several columns (``rows`` as in ``rank_frame``).

    The distinct tuples of groups and values with their counts are kept, and
    nothing else of ``df``: ranks are found and attached on those, then the
    tuples are joined back to ``df`` in one join whose frequent tuples (99 %
    zeros, say) go by broadcast (``join_back``). ``df`` is read twice."""
    g = [f"_g{i}" for i in range(len(group_cols))]
    values = {f"_t{i}": F.col(v).cast("double") for i, v in enumerate(mapping)}
    on = {**{a: F.col(c) for a, c in zip(g, group_cols)}, **values}
    count = F.sum(F.col(rows).cast("long")) if rows else F.count(F.lit(1))
    tuples = cut_lineage(df.groupBy(*[c.alias(a) for a, c in on.items()]).agg(
        count.alias("_rows"), F.count(F.lit(1)).alias("_weight")))
    for t, name in zip(values, mapping.values()):
        rf = rank_frame(tuples, t, g, buckets=buckets, rows="_rows")
        ranks = rf.select(*g, F.col("_v").alias(t), avg_rank_pct(rf).alias(f"_p{t}"), "_held")
        tuples = join_back(tuples, cut_lineage(ranks), {c: c for c in [*g, t]}, "_held")
    ranked = tuples.select(*on, *[F.col(f"_p{t}").alias(f"_n{t}") for t in values], "_weight")
    if len(values) > 1:
        ranked = cut_lineage(ranked)
    out = join_back(df, ranked, on, "_weight")
    return out.withColumnsRenamed({f"_n{t}": name for t, name in zip(values, mapping.values())})


def small_weighted_rank(dist: DataFrame, value: str, weight: str, out: str) -> DataFrame:
    """Average-rank percentile over a frame of distinct *count* values with
    row weights (value k held by ``weight`` rows). The number of distinct
    count values is at most sqrt(2N) for N rows, so an ordered window over
    this frame is small by construction."""
    w = Window.orderBy(value)
    below = F.coalesce(F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.sum(weight).over(Window.partitionBy())
    nd = F.count(F.lit(1)).over(Window.partitionBy())
    pct = (below + (F.col(weight) + 1) / 2.0) / n
    return dist.select(value, F.when(nd == 1, F.lit(0.0)).otherwise(
        F.least(F.greatest(pct, F.lit(0.0)), F.lit(1.0))).alias(out))


def repetition_risk(df: DataFrame, count_col: str, out: str) -> DataFrame:
    """WIN-3: count 1 -> 0, NULL stays NULL, repeated rows (count > 1) get
    their percentile rank among repeated rows only."""
    masked = F.when(F.col(count_col) > 1, F.col(count_col).cast("double"))
    ranked = percentile_rank(df.withColumn("_rep", masked), "_rep", "_rep_rank")
    return ranked.withColumn(out, F.when(F.col(count_col).isNull(), F.lit(None).cast("double"))
                             .when(F.col(count_col) > 1, F.col("_rep_rank")).otherwise(F.lit(0.0))
                             ).drop("_rep", "_rep_rank")


def quantiles(df: DataFrame, value: str | Column, probs: dict[str, float],
              group_cols: Sequence[str] = (), *, buckets: int | None = None,
              rf: DataFrame | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas ``quantile`` /
    DuckDB ``quantile_cont``), one row per group, one column per name.

    Each distinct value checks which requested order statistics
    (floor/ceil of ``(n-1)p``) fall inside its rank span, so the lookup is a
    projection plus a tiny aggregate: no join, no collect."""
    g = list(group_cols)
    rf = rf if rf is not None else rank_frame(df, value, g, buckets=buckets)
    spec = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(p)).alias("p")) for k, p in probs.items()])
    h = lambda s: (F.col("_n") - 1) * s["p"]
    inside = lambda i: (i >= F.col("_below")) & (i < F.col("_below") + F.col("_c"))
    hits = rf.select(*g, F.explode(F.filter(F.transform(spec, lambda s: F.struct(
        s["name"].alias("name"), h(s).alias("h"),
        F.when(inside(F.floor(h(s))), F.col("_v")).alias("lo"),
        F.when(inside(F.ceil(h(s))), F.col("_v")).alias("hi"))),
        lambda s: s["lo"].isNotNull() | s["hi"].isNotNull())).alias("s")).select(*g, "s.*")
    per = hits.groupBy(*g, "name").agg(F.max("h").alias("h"), F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    per = per.withColumn("q", F.col("lo") + (F.col("h") - F.floor("h")) * (F.col("hi") - F.col("lo")))
    wide = per.groupBy(*g).pivot("name", list(probs)).agg(F.first("q"))
    return wide


def ecdf(rf: DataFrame) -> Column:
    """WIN-7: share of rows <= value."""
    return (F.col("_below") + F.col("_c")) / F.col("_n")


def gini(df: DataFrame, value: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """AGG-25: Gini coefficient from rank offsets; 0 when empty or all zero.

    With 1-based positions i over ascending x: G = 2*sum(i*x)/(n*sum(x)) - (n+1)/n;
    a tie block of value v at positions below+1..below+c contributes
    v*(c*below + c*(c+1)/2)."""
    g = list(group_cols)
    rf = rank_frame(df, value, g, with_weight=True)
    s = rf.groupBy(*g).agg(
        F.sum(F.col("_v") * (F.col("_c") * F.col("_below") + F.col("_c") * (F.col("_c") + 1) / 2.0)).alias("_six"),
        F.first("_n").alias("_n"), F.first("_wsum").alias("_sx"))
    gexpr = 2.0 * F.col("_six") / (F.col("_n") * F.col("_sx")) - (F.col("_n") + 1) / F.col("_n")
    return s.select(*g, F.when(F.col("_sx") > 0, gexpr).otherwise(F.lit(0.0)).alias("gini"))


def lorenz(df: DataFrame, value: str) -> DataFrame:
    """WIN-6: cumulative user share vs cumulative volume share, one point
    per distinct value (ascending)."""
    rf = rank_frame(df, value, with_weight=True)
    return rf.select(F.col("_v").alias(value),
                     ((F.col("_below") + F.col("_c")) / F.col("_n")).alias("cum_user_share"),
                     ((F.col("_wbelow") + F.col("_v") * F.col("_c")) / F.col("_wsum")).alias("cum_volume_share"))
