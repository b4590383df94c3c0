"""Agreement statistics and regression (STA-1..20).

Correlations and confusion counts are Spark aggregates. Least squares is a
tree-reduced QR: tasks factor blocks of their rows, Spark groups and reduces
the small factors, and only the per-group p x p algebra (coefficients,
sandwich, p-values) runs over a frame holding one row per group - its size is
the number of groups, never the number of rows.
"""

from __future__ import annotations

import math
from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.operators import rank as rk
from murmur.operators.common import safe_corr, with_scalars
from murmur.session import cut_lineage

LABELS = ["negative", "neutral", "positive"]
Z975 = 1.959963984540054


# --- distribution helpers (run on per-group rows only) ---------------------------
def _betacf(a, b, x, iters=300, eps=3e-16):
    """Continued fraction for the regularised incomplete beta (modified Lentz)."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = np.ones_like(x)
    d = 1.0 - qab * x / qap
    d = np.where(np.abs(d) < tiny, tiny, d)
    d = 1.0 / d
    h = d.copy()
    for m in range(1, iters + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < tiny, tiny, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < tiny, tiny, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        d = 1.0 / d
        delta = d * c
        h *= delta
        if np.all(np.abs(delta - 1.0) < eps):
            break
    return h


def betainc(a, b, x):
    """Regularised incomplete beta I_x(a, b) for arrays."""
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    out = np.full(np.broadcast(a, b, x).shape, np.nan)
    a, b, x = np.broadcast_arrays(a, b, x)
    ok = (x >= 0) & (x <= 1) & (a > 0) & (b > 0)
    lgam = np.vectorize(math.lgamma)
    with np.errstate(all="ignore"):
        lbt = lgam(a + b) - lgam(a) - lgam(b) + a * np.log(np.where(x > 0, x, 1)) + b * np.log(np.where(x < 1, 1 - x, 1))
        bt = np.where((x == 0) | (x == 1), 0.0, np.exp(lbt))
        direct = (x < (a + 1) / (a + b + 2))
        r1 = bt * _betacf(a, b, np.where(direct, x, 0.5)) / a
        r2 = 1.0 - bt * _betacf(b, a, np.where(direct, 0.5, 1 - x)) / b
    out = np.where(direct, r1, r2)
    out = np.where(x == 0, 0.0, np.where(x == 1, 1.0, out))
    return np.where(ok, out, np.nan)


def corr_p_value(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided p of a correlation under the t distribution with n-2 df
    (the Pearson/Spearman test): p = I_{df/(df+t^2)}(df/2, 1/2)."""
    r = np.asarray(r, dtype=float)
    n = np.asarray(n, dtype=float)
    df = n - 2
    with np.errstate(all="ignore"):
        t2 = r * r * df / np.maximum(1 - r * r, 0.0)
        p = betainc(df / 2.0, 0.5, df / (df + t2))
    p = np.where(np.abs(r) >= 1.0, 0.0, p)
    return np.where(df > 0, np.clip(p, 0.0, 1.0), np.nan)


@F.pandas_udf(T.DoubleType())
def corr_p_udf(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(corr_p_value(r.to_numpy(dtype=float, na_value=np.nan), n.to_numpy(dtype=float)))


def normal_two_sided_p(z: np.ndarray) -> np.ndarray:
    """erfc(|z|/sqrt 2): the normal p-value statsmodels reports for robust
    covariance types."""
    from math import erfc
    return np.vectorize(lambda v: erfc(abs(v) / math.sqrt(2.0)) if np.isfinite(v) else np.nan)(z)


# --- STA-1..11: agreement bundle -------------------------------------------------
def fisher_ci(r: Column, n: Column) -> tuple[Column, Column]:
    """STA-3: 95 % interval via atanh with r clipped to +-0.999999."""
    z = F.atanh(F.least(F.greatest(r, F.lit(-0.999999)), F.lit(0.999999)))
    se = 1.0 / F.sqrt(n - 3)
    return F.tanh(z - Z975 * se), F.tanh(z + Z975 * se)


def agreement(df: DataFrame, *, a_score: str, b_score: str, a_label: str, b_label: str,
              group_cols: Sequence[str] = (), min_rows: int = 4, labels: Sequence[str] = LABELS,
              with_p: bool = False) -> DataFrame:
    """STA-1/2/3/4/5/6/7/8 (+STA-9 when grouped): one row per group with at
    least ``min_rows`` rows. ``a`` plays the predicted/lexicon side, ``b``
    the reference/model side (F1 uses b as truth)."""
    g = list(group_cols)
    base = df.select(*g, F.col(a_score).cast("double").alias("_a"), F.col(b_score).cast("double").alias("_b"),
                     F.col(a_label).alias("_la"), F.col(b_label).alias("_lb"),
                     F.monotonically_increasing_id().alias("_rid"))
    base = base.where(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    # Spearman: Pearson on average ranks within the group (F-9 ranks)
    ranked = rk.percentile_ranks(base, {"_a": "_ra", "_b": "_rb"}, g)
    aggs = [F.count(F.lit(1)).alias("record_count"), safe_corr("_a", "_b").alias("pearson_r"),
            safe_corr("_ra", "_rb").alias("spearman_rho"),
            F.avg((F.col("_la") == F.col("_lb")).cast("double")).alias("label_agreement_rate"),
            F.avg(F.abs(F.col("_a") - F.col("_b"))).alias("mean_absolute_score_difference")]
    for i, la in enumerate(labels):
        for j, lb in enumerate(labels):
            aggs.append(F.count(F.when((F.col("_la") == la) & (F.col("_lb") == lb), 1)).alias(f"cm_{i}{j}"))
    s = ranked.groupBy(*g).agg(*aggs).where(F.col("record_count") >= min_rows)
    k = len(labels)
    n = F.col("record_count")
    cm = lambda i, j: F.col(f"cm_{i}{j}")
    f1s = []
    for L in range(k):
        tp = cm(L, L)
        fp = sum((cm(L, j) for j in range(k) if j != L), F.lit(0))   # a says L, b says other
        fn = sum((cm(i, L) for i in range(k) if i != L), F.lit(0))   # b says L, a says other
        den = 2 * tp + fp + fn
        f1s.append(F.when(den > 0, 2.0 * tp / den).otherwise(0.0))
    rowm = [sum((cm(i, j) for j in range(k)), F.lit(0)) for i in range(k)]
    colm = [sum((cm(i, j) for i in range(k)), F.lit(0)) for j in range(k)]
    po = sum((cm(i, i) for i in range(k)), F.lit(0)) / n
    pe = sum((rowm[i] * colm[i] for i in range(k)), F.lit(0)) / (n * n)
    lo, hi = fisher_ci(F.col("pearson_r"), n)
    out = s.select(*g, "record_count", "pearson_r", lo.alias("pearson_ci_low"), hi.alias("pearson_ci_high"),
                   "spearman_rho", "label_agreement_rate", (sum(f1s, F.lit(0.0)) / k).alias("macro_f1_agreement"),
                   F.when(pe < 1, (po - pe) / (1 - pe)).alias("cohen_kappa"), "mean_absolute_score_difference",
                   *[cm(i, j) for i in range(k) for j in range(k)])
    if with_p:
        out = out.withColumn("pearson_p_value", corr_p_udf(F.col("pearson_r"), n)).withColumn(
            "spearman_p_value", corr_p_udf(F.col("spearman_rho"), n))
    return out


# --- STA-12..19: OLS with HC1 ------------------------------------------------------
TINY = 1e-12    # of the largest singular value: below it a direction is missing


def _stacked(rows: np.ndarray) -> np.ndarray:
    """The triangular factor of rows stacked on each other (square, upper)."""
    k = rows.shape[1]
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((k - len(r), k))]) if len(r) < k else r


def _tsqr(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(keys..., _r): per group the triangular factor of the columns, by a
    tree: every task factors its blocks of rows, the factors (k x k numbers
    each) are stacked and factored over dealt parts, then per group. Cross
    products are never formed, so nothing is squared and lost."""
    k = len(cols)
    fields = [T.StructField(c, df.schema[c].dataType) for c in keys]
    schema = T.StructType(fields + [T.StructField("_part", T.IntegerType()), T.StructField("_r", T.ArrayType(T.DoubleType()))])

    def blocks(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        part, held, names = TaskContext.get().partitionId(), {}, {}

        def rows():
            return pd.DataFrame([(*names[n], part, r.ravel()) for n, r in held.items()], columns=[f.name for f in schema])
        for pdf in it:
            for _, block in pdf.groupby(list(keys), dropna=False, sort=False):
                name = tuple(None if pd.isna(v) else v for v in block[list(keys)].iloc[0])
                x = block[list(cols)].to_numpy(dtype=float)
                names[repr(name)] = name
                held[repr(name)] = _stacked(x if repr(name) not in held else np.vstack([held[repr(name)], x]))
            if len(held) > 10_000:
                yield rows()
                held, names = {}, {}
        yield rows()

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.head(1).copy()
        out["_r"] = [_stacked(np.vstack([np.asarray(r, float).reshape(k, k) for r in pdf["_r"]])).ravel()]
        return out[[f.name for f in schema]]

    r = df.select(*keys, *cols).mapInPandas(blocks, schema)
    fan = max(1, math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))))
    r = r.groupBy(*keys, F.pmod("_part", F.lit(fan)).alias("_deal")).applyInPandas(merged, schema)
    return r.groupBy(*keys).applyInPandas(merged, schema).drop("_part")


def _design(r: dict, q: int, add_constant: bool):
    """What one group's moments say: which regressors are constant, whether
    the fit has an intercept, and whether it is the added one."""
    flat = np.array([r[f"lo{i}"] == r[f"hi{i}"] for i in range(q)])
    level = np.array([r[f"lo{i}"] for i in range(q)])
    own = add_constant and not (flat & (level != 0)).any()
    return flat, own, own or bool((flat & (level != 0)).any())


def _solve(r: dict, q: int, add_constant: bool):
    """Coefficients of one group: (of the scaled columns, of the original
    terms with the constant first, map from scaled to original, rank, own).

    In the scaled columns [1, z] the factor is diag(sqrt n, R). Where every
    direction is there, original coefficients follow by rescaling; else the
    shortest solution in the original terms is taken, as a pseudo-inverse does."""
    flat, own, level = _design(r, q, add_constant)
    mean = np.array([r[f"mean{i}"] for i in range(q)])
    scale = np.where(flat, 0.0, [r[f"scale{i}"] for i in range(q)])
    live = np.flatnonzero(~flat)
    full = np.asarray(r["_r"], float).reshape(q + 1, q + 1)
    rz, rhs = full[:, live], full[:, q]
    u, s, vt = np.linalg.svd(rz, full_matrices=False)
    rank = int((s > TINY * s.max()).sum()) if len(s) else 0
    inv = (vt[:rank].T / s[:rank]) if rank else np.zeros((len(live), 0))
    theta = np.zeros(1 + q)                      # intercept at the mean, scaled slopes
    theta[0] = r["ymean"] if level else 0.0
    theta[1 + live] = inv @ (u[:, :rank].T @ rhs)
    constants = [i for i in range(q) if flat[i] and r[f"lo{i}"] != 0]
    back = np.zeros((1 + q, 1 + q))              # original = back @ scaled
    for i in live:
        back[1 + i, 1 + i] = 1 / scale[i]
    if level:
        back[0, 0], back[0, 1 + live] = 1.0, -mean[live] / scale[live]
        if not own and constants:                # a constant regressor carries the intercept
            back[1 + constants[0]] = back[0] / mean[constants[0]]
            back[0] = 0.0
    root = np.zeros((1 + q, 1 + q))              # (X'X)^-1 = root root' in the scaled columns
    if level:
        root[0, 0] = 1 / math.sqrt(r["n"])
    root[np.ix_(1 + live, 1 + np.arange(rank))] = inv
    if rank < len(live) or len(constants) > 1:
        # original columns = [1, z] @ make; the shortest solution in them
        make = np.zeros((1 + q, 1 + q))
        make[0, 0] = 1.0 if own else 0.0
        make[0, 1:], make[1 + live, 1 + live] = mean, scale[live]
        whole = np.zeros((1 + len(full), 1 + q))
        whole[0, 0] = math.sqrt(r["n"])
        whole[1:, 1 + live] = rz
        short = np.linalg.pinv(whole @ make, rcond=TINY)
        back = short @ whole
        theta_full = np.concatenate([[math.sqrt(r["n"]) * r["ymean"]], rhs]) if level else np.concatenate([[0.0], rhs])
        return theta, short @ theta_full, back, rank + int(level), own, root
    return theta, back @ theta, back, rank + int(level), own, root


def ols_hc1(df: DataFrame, y: str, xs: Sequence[str], group_cols: Sequence[str] = (), *,
            add_constant: bool = True, min_rows: int = 1) -> DataFrame:
    """Grouped OLS with HC1 robust errors, by tree-reduced QR.

    Output per group: n, rank, has_const, r_squared, adj_r_squared and for
    each term (``const`` + xs) ``b_<term>``, ``se_<term>``, ``p_<term>``.
    Rows with a NULL in y or any x are dropped (FLT-11). As in
    statsmodels' ``add_constant(has_constant='skip')``, no intercept is
    added for a group where some regressor is a non-zero constant; its
    ``b_const`` is then 0. Singular designs get the shortest solution.
    p-values are normal (statsmodels' robust default).

    Three passes over the thin rows: means and spreads per group; the factor
    of the centred and scaled columns; the factor of the same columns weighted
    by the residuals, which holds the HC1 "meat" and the residual sum."""
    g, q = list(group_cols), len(xs)
    keys = g + ["_k"]
    terms = (["const"] if add_constant else []) + list(xs)
    base = cut_lineage(df.select(*g, F.col(y).cast("double").alias("_y"), *[
        F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(xs)]).dropna(
        subset=["_y", *[f"x{i}" for i in range(q)]]).withColumn("_k", F.lit(0)))
    stats = [F.count(F.lit(1)).alias("n"), F.avg("_y").alias("_ybar")]
    for i in range(q):
        stats += [F.min(f"x{i}").alias(f"lo{i}"), F.max(f"x{i}").alias(f"hi{i}"), F.avg(f"x{i}").alias(f"_avg{i}"),
                  F.stddev_pop(f"x{i}").alias(f"_sd{i}"), F.sqrt(F.avg(F.col(f"x{i}") * F.col(f"x{i}"))).alias(f"_rms{i}")]
    m = base.groupBy(*keys).agg(*stats).where(F.col("n") >= min_rows)
    level = F.lit(add_constant)
    for i in range(q):
        level = level | ((F.col(f"lo{i}") == F.col(f"hi{i}")) & (F.col(f"lo{i}") != 0))
    m = m.withColumn("_level", level).select(
        *keys, "n", F.when(F.col("_level"), F.col("_ybar")).otherwise(0.0).alias("ymean"),
        *[c for i in range(q) for c in (
            F.col(f"lo{i}"), F.col(f"hi{i}"), F.when(F.col("_level"), F.col(f"_avg{i}")).otherwise(0.0).alias(f"mean{i}"),
            F.when(F.col(f"lo{i}") == F.col(f"hi{i}"), 1.0).when(F.col("_level"), F.col(f"_sd{i}"))
            .otherwise(F.col(f"_rms{i}")).alias(f"scale{i}"))])
    m = cut_lineage(m)
    centred = rk._join(base, m, keys).select(
        *keys, *[F.when(F.col(f"lo{i}") == F.col(f"hi{i}"), 0.0)
                 .otherwise((F.col(f"x{i}") - F.col(f"mean{i}")) / F.col(f"scale{i}")).alias(f"z{i}") for i in range(q)],
        (F.col("_y") - F.col("ymean")).alias("_yc"), F.when(level, 1.0).otherwise(0.0).alias("_one"))
    zs = [f"z{i}" for i in range(q)]
    fit = cut_lineage(rk._join(m, _tsqr(centred, keys, [*zs, "_yc"]), keys))

    out_names = [f"t{i}" for i in range(q)]
    slope_schema = T.StructType([T.StructField(c, fit.schema[c].dataType) for c in keys]
                                + [T.StructField(c, T.DoubleType()) for c in out_names])

    def slopes(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(*[r[c] for c in keys], *_solve(r, q, add_constant)[0][1:]) for r in pdf.to_dict("records")]
            yield pd.DataFrame(rows, columns=[*keys, *out_names])

    e = F.col("_yc") - sum((F.col(f"t{i}") * F.col(f"z{i}") for i in range(q)), F.lit(0.0))
    weighted = rk._join(centred, fit.mapInPandas(slopes, slope_schema), keys).withColumn("_e", e).select(
        *keys, "_e", (F.col("_e") * F.col("_one")).alias("w"), *[(F.col("_e") * F.col(z)).alias(f"w{i}") for i, z in enumerate(zs)])
    meat = _tsqr(weighted, keys, ["_e", "w", *[f"w{i}" for i in range(q)]]).withColumnRenamed("_r", "_meat")
    both = rk._join(fit, meat, keys)

    out_fields = [T.StructField(c, fit.schema[c].dataType) for c in g] + [
        T.StructField("n", T.LongType()), T.StructField("rank", T.IntegerType()),
        T.StructField("has_const", T.BooleanType()), T.StructField("r_squared", T.DoubleType()),
        T.StructField("adj_r_squared", T.DoubleType())]
    for t in terms:
        out_fields += [T.StructField(f"{c}_{t}", T.DoubleType()) for c in ("b", "se", "p")]
    out_schema = T.StructType(out_fields)

    def finish(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for r in pdf.to_dict("records"):
                n = int(r["n"])
                _, b, back, rank, own, root = _solve(r, q, add_constant)
                factor = np.asarray(r["_meat"], float).reshape(q + 2, q + 2)
                ssr = factor[0, 0] ** 2
                half = back @ root @ root.T @ factor[:, 1:].T
                scale = n / (n - rank) if n > rank else np.nan
                se = np.sqrt(scale * (half * half).sum(axis=1))
                with np.errstate(all="ignore"):
                    p = normal_two_sided_p(b / se)
                sst = (np.asarray(r["_r"], float).reshape(q + 1, q + 1)[:, q] ** 2).sum()
                if not own and _design(r, q, add_constant)[2]:
                    sst += n * r["ymean"] ** 2
                r2 = 1.0 - ssr / sst if sst > 0 else np.nan
                adj = 1.0 - (n - int(own)) / (n - rank) * (1 - r2) if n > rank else np.nan
                row = [*[r[c] for c in g], n, rank, own, float(r2), float(adj)]
                for i, t in enumerate(terms):
                    j = i if add_constant else i + 1
                    row += [0.0, np.nan, np.nan] if t == "const" and not own else [float(b[j]), float(se[j]), float(p[j])]
                rows.append(row)
            yield pd.DataFrame(rows, columns=[f.name for f in out_schema.fields])

    return both.mapInPandas(finish, out_schema)


def itsa(windows: DataFrame, *, y: str = "mean_sentiment", t: str = "time_elapsed_hours",
         d: str = "post_event_dummy", group: str = "event_name", min_rows: int = 10,
         n_tests: int = 4, alpha: float = 0.05) -> DataFrame:
    """STA-12/13: y = b0 + b1 T + b2 D + b3 T*D per event with >= ``min_rows``
    rows; pre/post counts, Bonferroni-adjusted p of b2 (min(1, n_tests*p))."""
    w = windows.withColumn("_td", F.col(t) * F.col(d))
    fit = ols_hc1(w, y, [t, d, "_td"], [group], min_rows=min_rows)
    counts = windows.groupBy(group).agg(F.count(F.when(F.col(t) < 0, 1)).alias("pre_period_n"),
                                        F.count(F.when(F.col(t) >= 0, 1)).alias("post_period_n"))
    out = fit.join(counts, group).select(
        group, "n", "pre_period_n", "post_period_n",
        F.col("b_const").alias("beta_0_baseline"), F.col(f"b_{t}").alias("beta_1_pre_slope"),
        F.col(f"b_{d}").alias("beta_2_immediate_shock"), F.col("b__td").alias("beta_3_post_slope_change"),
        F.coalesce(F.col(f"p_{d}"), F.lit(1.0)).alias("p_value_immediate_shock"),
        F.coalesce(F.col("p__td"), F.lit(1.0)).alias("p_value_post_slope_change"), "r_squared")
    adj = F.least(F.lit(1.0), F.col("p_value_immediate_shock") * n_tests)
    return out.withColumn("bonferroni_adj_p_value", adj).withColumn("significant", adj < alpha)


def bivariate_fit(df: DataFrame, y: str, x: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """STA-18: slope, intercept and R^2 with classical errors (built-in
    regression aggregates) and HC1 errors (``ols_hc1``)."""
    g = list(group_cols)
    s = df.groupBy(*g).agg(
        F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"),
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r_squared"), F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"),
        F.regr_sxy(y, x).alias("_sxy"), F.regr_avgx(y, x).alias("_mean"))
    left = (F.col("_syy") - F.try_divide(F.col("_sxy") * F.col("_sxy"), F.col("_sxx")))
    variance = F.try_divide(F.greatest(left, F.lit(0.0)), F.nullif(F.greatest(F.col("n") - 2, F.lit(0)), F.lit(0)))
    s = s.withColumn("se_slope", F.sqrt(F.try_divide(variance, F.col("_sxx")))).withColumn(
        "se_intercept", F.sqrt(variance * (F.try_divide(F.lit(1.0), F.col("n")) + F.try_divide(
            F.col("_mean") * F.col("_mean"), F.col("_sxx"))))).drop("_sxx", "_syy", "_sxy", "_mean")
    robust = ols_hc1(df, y, [x], g).select(*g, F.col(f"se_{x}").alias("se_slope_hc1"),
                                           F.col("se_const").alias("se_intercept_hc1"))
    return rk._join(s, robust, g) if g else with_scalars(s, robust, how="left")
