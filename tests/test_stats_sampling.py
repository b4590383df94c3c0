import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from murmur.operators import sampling as smp
from murmur.operators import stats as st


def test_hamilton_allocation_and_exact_sample(spark):
    rows = [(f"s{s}", i) for s, n in zip("ABCD", (40, 30, 20, 10)) for i in range(n)]
    df = spark.createDataFrame([(f"{a}-{i}", a) for a, i in rows], "id string, stratum string")
    sample, alloc = smp.stratified_sample(df, 20, ["stratum"], id_col="id")
    got = {r.stratum: r.allocated_records for r in alloc.collect()}
    assert got == {"sA": 8, "sB": 6, "sC": 4, "sD": 2}
    s = sample.collect()
    assert len(s) == 20 and len({r.id for r in s}) == 20
    per = pd.Series([r.stratum for r in s]).value_counts().to_dict()
    assert per == {"sA": 8, "sB": 6, "sC": 4, "sD": 2}


def test_largest_remainder_ties(spark):
    df = spark.createDataFrame([(str(i), "a" if i < 5 else ("b" if i < 10 else "c")) for i in range(15)],
                               "id string, g string")
    alloc = {r.g: r.allocated_records for r in smp.allocation(df, 4, ["g"]).collect()}
    # 4/3 each: floors 1,1,1, one leftover to the first stratum by key
    assert alloc == {"a": 2, "b": 1, "c": 1}


def test_stratified_sample_matches_full_ranking(spark):
    """The pre-filter must not change the result: compare with ranking every row."""
    df = spark.range(0, 3000).select(F.col("id").cast("string").alias("id"),
                                     (F.col("id") % 3).cast("string").alias("g"))
    sample, alloc = smp.stratified_sample(df, 100, ["g"], id_col="id", seed=7)
    k = {r.g: r.allocated_records for r in alloc.collect()}
    pdf = df.withColumn("key", smp.sample_key("id", 7)).toPandas()
    exp = set()
    for g, grp in pdf.groupby("g"):
        exp |= set(grp.sort_values(["key", "id"]).head(k[g])["id"])
    assert {r.id for r in sample.collect()} == exp


def test_simple_sample_exact_and_reproducible(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "event_id")
    a = [r.event_id for r in smp.simple_sample(df, 37, id_col="event_id").collect()]
    b = [r.event_id for r in smp.simple_sample(df.repartition(7), 37, id_col="event_id").collect()]
    assert len(a) == 37 and sorted(a) == sorted(b)


def test_agreement_identical_raters(spark):
    vals = [-0.8, -0.4, 0.2, 0.9]
    lab = lambda v: "positive" if v >= 0.05 else ("negative" if v <= -0.05 else "neutral")
    df = spark.createDataFrame([(v, v, lab(v), lab(v)) for v in vals], "a double, b double, la string, lb string")
    r = st.agreement(df, a_score="a", b_score="b", a_label="la", b_label="lb", with_p=True).collect()[0]
    assert abs(r.pearson_r - 1) < 1e-12 and r.label_agreement_rate == 1.0
    assert r.mean_absolute_score_difference == 0.0 and abs(r.spearman_rho - 1) < 1e-12
    assert r.macro_f1_agreement == 2 / 3  # the neutral class is absent: its F1 is 0
    assert r.pearson_p_value == 0.0


def test_corr_p_value_known():
    # r = 0.5, n = 10: t = 1.633, two-sided p = 0.14111 (t distribution, 8 df)
    assert abs(st.corr_p_value(np.array([0.5]), np.array([10]))[0] - 0.141106) < 1e-5
    # symmetric and bounded
    p = st.corr_p_value(np.array([-0.3, 0.3, 0.0]), np.array([30, 30, 30]))
    assert abs(p[0] - p[1]) < 1e-12 and abs(p[2] - 1.0) < 1e-12


def test_betainc_against_integration():
    a, b, x = 2.5, 0.5, 0.7
    xs = np.linspace(0, x, 200001)[1:]
    f = xs ** (a - 1) * (1 - xs) ** (b - 1)
    num = np.trapezoid(f, xs)
    beta = math.gamma(a) * math.gamma(b) / math.gamma(a + b)
    assert abs(st.betainc(a, b, x) - num / beta) < 1e-4


def _hc1_numpy(X, y):
    n, k = X.shape
    beta = np.linalg.pinv(X.T @ X) @ X.T @ y
    e = y - X @ beta
    inv = np.linalg.pinv(X.T @ X)
    cov = n / (n - k) * inv @ (X.T * e ** 2) @ X @ inv
    r2 = 1 - (e @ e) / ((y - y.mean()) @ (y - y.mean()))
    return beta, np.sqrt(np.diag(cov)), r2


def test_ols_hc1_matches_numpy(spark):
    rng = np.random.default_rng(0)
    n = 60
    t = np.arange(n) - 30.0
    d = (t >= 0).astype(float)
    y = 0.2 + 0.01 * t + 0.5 * d - 0.02 * t * d + rng.normal(0, 0.1, n)
    pdf = pd.DataFrame({"g": "e1", "t": t, "d": d, "td": t * d, "y": y})
    fit = st.ols_hc1(spark.createDataFrame(pdf), "y", ["t", "d", "td"], ["g"]).collect()[0]
    X = np.column_stack([np.ones(n), t, d, t * d])
    beta, se, r2 = _hc1_numpy(X, y)
    got_b = [fit.b_const, fit.b_t, fit.b_d, fit.b_td]
    got_se = [fit.se_const, fit.se_t, fit.se_d, fit.se_td]
    assert np.allclose(got_b, beta, atol=1e-9) and np.allclose(got_se, se, atol=1e-9)
    assert abs(fit.r_squared - r2) < 1e-9
    assert abs(fit.p_d - math.erfc(abs(beta[2] / se[2]) / math.sqrt(2))) < 1e-9


def test_itsa_skips_constant_intercept(spark):
    """All rows post-event: the dummy is a non-zero constant, so no intercept."""
    t = np.arange(12, dtype=float)
    pdf = pd.DataFrame({"event_name": "e", "time_elapsed_hours": t, "post_event_dummy": 1,
                        "mean_sentiment": 0.5 + 0.1 * t})
    r = st.itsa(spark.createDataFrame(pdf)).collect()[0]
    assert r.beta_0_baseline == 0.0 and r.n == 12


def test_itsa_min_rows_and_bonferroni(spark):
    t = np.arange(-5, 5, dtype=float)
    pdf = pd.DataFrame({"event_name": "e", "time_elapsed_hours": t, "post_event_dummy": (t >= 0).astype(int),
                        "mean_sentiment": np.sin(t)})
    r = st.itsa(spark.createDataFrame(pdf)).collect()[0]
    assert (r.pre_period_n, r.post_period_n) == (5, 5)
    assert r.bonferroni_adj_p_value == min(1.0, 4 * r.p_value_immediate_shock)
    assert st.itsa(spark.createDataFrame(pdf.iloc[:9])).count() == 0


def _exact_ols(X, y):
    """Least squares and HC1 errors in rational numbers."""
    from fractions import Fraction
    X = [[Fraction(float(v)) for v in row] for row in X]
    y = [Fraction(float(v)) for v in y]
    n, k = len(X), len(X[0])

    def inverse(m):
        m = [row[:] + [Fraction(int(i == j)) for j in range(k)] for i, row in enumerate(m)]
        for i in range(k):
            p = next(r for r in range(i, k) if m[r][i])
            m[i], m[p] = m[p], m[i]
            m[i] = [v / m[i][i] for v in m[i]]
            for r in range(k):
                if r != i and m[r][i]:
                    m[r] = [a - m[r][i] * b for a, b in zip(m[r], m[i])]
        return [row[k:] for row in m]
    inv = inverse([[sum(r[i] * r[j] for r in X) for j in range(k)] for i in range(k)])
    xy = [sum(r[i] * v for r, v in zip(X, y)) for i in range(k)]
    b = [sum(inv[i][j] * xy[j] for j in range(k)) for i in range(k)]
    e = [v - sum(r[i] * b[i] for i in range(k)) for r, v in zip(X, y)]
    meat = [[sum(d * d * r[i] * r[j] for r, d in zip(X, e)) for j in range(k)] for i in range(k)]
    half = [[sum(inv[i][a] * meat[a][j] for a in range(k)) for j in range(k)] for i in range(k)]
    var = [sum(half[i][a] * inv[a][i] for a in range(k)) * n / (n - k) for i in range(k)]
    return [float(v) for v in b], [math.sqrt(float(v)) for v in var]


def test_ols_of_an_ill_conditioned_design(spark):
    """A regressor far from zero and two that nearly agree: cross products
    would lose every digit of the difference."""
    rng = np.random.default_rng(1)
    n = 80
    x1 = 1e8 + rng.normal(size=n)
    x2 = rng.normal(size=n)
    x3 = x2 + 1e-6 * rng.normal(size=n)
    y = 3 + 0.5 * (x1 - 1e8) + 2 * x2 - x3 + rng.normal(0, 0.1, n)
    df = spark.createDataFrame(pd.DataFrame({"x1": x1, "x2": x2, "x3": x3, "y": y})).repartition(5)
    fit = st.ols_hc1(df, "y", ["x1", "x2", "x3"]).collect()[0]
    b, se = _exact_ols(np.column_stack([np.ones(n), x1, x2, x3]), y)
    assert fit.rank == 4
    assert np.allclose([fit.b_const, fit.b_x1, fit.b_x2, fit.b_x3], b, rtol=1e-8, atol=0)
    assert np.allclose([fit.se_const, fit.se_x1, fit.se_x2, fit.se_x3], se, rtol=1e-8, atol=0)


def test_ols_groups_without_full_rank(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in ("full", "twin", "flat", "zero", None):
        for i in range(20):
            a, c = rng.normal(), rng.normal()
            rows.append((g, 1.0 + a - c + rng.normal(0, 0.2), a, {"twin": a, "flat": 2.0, "zero": 0.0}.get(g, c)))
    rows += [("full", None, 1.0, 1.0), ("full", 1.0, None, 2.0), ("few", 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "g string, y double, a double, c double").repartition(4)
    fits = {r.g: r for r in st.ols_hc1(df, "y", ["a", "c"], ["g"], min_rows=2).collect()}
    assert set(fits) == {"full", "twin", "flat", "zero", None}
    for g, r in fits.items():
        own = np.array([x[1:] for x in rows if x[0] == g and None not in x[1:]])
        y, X = own[:, 0], own[:, 1:]
        if g != "flat":
            X = np.column_stack([np.ones(len(X)), X])
        inv = np.linalg.pinv(X)
        b = inv @ y
        e = y - X @ b
        k = np.linalg.matrix_rank(X)
        se = np.sqrt(np.diag(inv @ np.diag(e * e) @ inv.T) * len(y) / (len(y) - k))
        got = [r.b_const, r.b_a, r.b_c], [r.se_const, r.se_a, r.se_c]
        assert r.n == 20 and r.rank == k and r.has_const == (g != "flat")
        assert np.allclose(got[0][-len(b):], b, atol=1e-10), g
        keep = b != 0
        assert np.allclose(np.array(got[1][-len(b):])[keep], se[keep], atol=1e-10), g
    assert fits["flat"].b_const == 0.0 and fits["flat"].se_const is None or math.isnan(fits["flat"].se_const)


def test_ols_without_constant(spark):
    rng = np.random.default_rng(3)
    x, z = rng.normal(5, 1, 40), rng.normal(size=40)
    y = 2 * x - z + rng.normal(0, 0.1, 40)
    r = st.ols_hc1(spark.createDataFrame(pd.DataFrame({"x": x, "z": z, "y": y})), "y", ["x", "z"], add_constant=False).collect()[0]
    b, se = _exact_ols(np.column_stack([x, z]), y)
    assert np.allclose([r.b_x, r.b_z, r.se_x, r.se_z], b + se, rtol=1e-10)
    assert abs(r.r_squared - (1 - ((y - x * b[0] - z * b[1]) ** 2).sum() / (y ** 2).sum())) < 1e-12


def test_bivariate_errors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=30)
    y = 1 + 2 * x + rng.normal(0, abs(x) + 0.1)
    r = st.bivariate_fit(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), "y", "x").collect()[0]
    b, se = _exact_ols(np.column_stack([np.ones(30), x]), y)
    e = y - b[0] - b[1] * x
    s2 = (e @ e) / 28
    assert np.allclose([r.intercept, r.slope, r.se_intercept_hc1, r.se_slope_hc1], b + se, rtol=1e-10)
    assert np.allclose([r.se_slope, r.se_intercept], [math.sqrt(s2 / ((x - x.mean()) ** 2).sum()),
                                                     math.sqrt(s2 * (1 / 30 + x.mean() ** 2 / ((x - x.mean()) ** 2).sum()))])


def test_checksum_tree_against_brute_force(spark):
    import hashlib

    def brute(ids):
        level = sorted(ids, key=str.encode)
        while True:
            level = [hashlib.sha256(",".join(level[i:i + 64]).encode()).hexdigest() for i in range(0, len(level), 64)]
            if len(level) <= 1:
                return level[0] if level else hashlib.sha256(b"").hexdigest()
    for n in (0, 1, 64, 65, 5000):
        ids = [f"id-{i * 7919 % 100003}" for i in range(n)]
        r = smp.sample_checksum(spark.createDataFrame([(i,) for i in ids], "id string").repartition(5), "id").collect()[0]
        assert (r.sample_rows, r.checksum_sha256) == (n, brute(ids))
    one = smp.sample_checksum(spark.createDataFrame([("a",), ("b",)], "id string"), "id").collect()[0].checksum_sha256
    two = smp.sample_checksum(spark.createDataFrame([("a",), ("c",)], "id string"), "id").collect()[0].checksum_sha256
    assert one != two


def test_positions_of_any_key(spark):
    from murmur.operators import schema as sc
    from murmur.operators.rank import positions
    big = [2 ** 53, 2 ** 53 + 1, 5, 5, None, -3]
    df = spark.createDataFrame([(k,) for k in big], "k bigint")
    assert sorted((r.k is None, r.k or 0, r.row_position) for r in sc.row_position(df, "k").collect()) == [
        (False, -3, 1), (False, 5, 2), (False, 5, 2), (False, 2 ** 53, 4), (False, 2 ** 53 + 1, 5), (True, 0, 0)]
    words = [f"w{i * 37 % 1000:03d}" for i in range(1000)]
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "k string, i int").repartition(7)
    assert {r.k: r.row_position for r in sc.row_position(df, "k").collect()} == {w: i for i, w in enumerate(sorted(words))}
    rows = positions(df, ["k", "i"]).collect()
    assert [r.k for r in sorted(rows, key=lambda r: r._pos)] == sorted(words) and sorted(r._pos for r in rows) == list(range(1000))
