"""Operator 12: whitening of embedding vectors.

Entries become whole numbers x = floor(64 c) + 1000000, so the sums S and the
deviations n x - S are exact. Tasks add centred products of their rows; the
(row, column) sums of the covariance are added by Spark, and only that matrix,
whose size depends on the dimension alone, reaches the driver. There it is
brought to tridiagonal form by Householder reflections, the leading
eigenvalues are bisected by Sturm counts, inverse iteration gives each vector,
reorthogonalised within clusters of close eigenvalues, and the reflections
carry them back. The projection is broadcast; a second pass adds up the
whitened rows' own covariance for ``identity_error``.

Defined results: rows whose vector is null, empty, or holds null or non-finite
entries drop out, as do rows whose vector is of another than the most common
length (of the longer one at a tie); entries beyond +-2^45 count as that
bound; components with an eigenvalue up to ``LEAST`` of the trace have no
whitened value and are left out (equal vectors only: no rows); repeated rows
and ids count and come out as often as they stand; a deviation too large for
a long is null; each component's largest entry is positive, so reruns agree;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.common import small_batches
from murmur.sources.tables import table

COMPONENTS = 32
LEAST = 1e-12             # of the trace: eigenvalues up to this count as zero
SCALE, SHIFT = 64.0, 1_000_000
_BOUND = 2.0 ** 51
CLOSE = 1e-3              # of the norm: eigenvalues this close form a cluster
_BLOCK = 4096             # rows of one dense block


# ---- symmetric eigenvalues ------------------------------------------------
def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflectors) of a symmetric matrix: reflector k
    acts on the rows and columns from k + 1 on."""
    a = np.array(a, np.float64)
    n = len(a)
    vectors = []
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        scale = np.abs(v[1:]).max()
        if scale == 0:
            vectors.append(None)
            continue
        v[0] += np.copysign(np.linalg.norm(v), v[0] if v[0] else 1.0)
        v /= np.linalg.norm(v)
        rest = a[k + 1:, k + 1:]
        w = rest @ v
        w -= (v @ w) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        column = a[k + 1:, k]
        column -= 2 * (v @ column) * v
        a[k, k + 1:] = column
        vectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), vectors


def below(diag: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues are smaller than each number of ``at``."""
    tiny = np.finfo(np.float64).tiny * 4 + np.finfo(np.float64).eps ** 2 * max(np.abs(off).max(initial=0), 1e-300)
    q = diag[0] - at
    count = (q < 0).astype(np.int64)
    for k in range(1, len(diag)):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = diag[k] - at - off[k - 1] ** 2 / q
        count += q < 0
    return count


def leading_values(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected to the last bit."""
    reach = np.abs(np.concatenate([off, [0]])) + np.abs(np.concatenate([[0], off]))
    low = np.full(k, (diag - reach).min())
    high = np.full(k, (diag + reach).max())
    pad = np.finfo(np.float64).eps * max(abs(low[0]), abs(high[0]), 1e-300) * len(diag)
    low, high = low - pad, high + pad
    want = len(diag) - np.arange(1, k + 1)     # eigenvalues below the j-th largest
    while True:
        middle = low + (high - low) / 2
        if not ((middle > low) & (middle < high)).any():
            return middle
        over = below(diag, off, middle) > want
        high = np.where(over, middle, high)
        low = np.where(over, low, middle)


def _solver(diag: np.ndarray, off: np.ndarray, shift: float):
    """Solve (T - shift) x = b by elimination with row exchanges."""
    n = len(diag)
    tiny = np.finfo(np.float64).eps * max(np.abs(diag).max(), np.abs(off).max(initial=0), 1e-300)
    d, up, up2 = diag - shift, np.append(off, 0.0), np.zeros(n)
    down = off.copy()
    swaps = []
    for i in range(n - 1):
        swap = abs(d[i]) < abs(down[i])
        if swap:
            d[i], down[i] = down[i], d[i]
            up[i], d[i + 1] = d[i + 1], up[i]
            if i + 2 < n:
                up2[i], up[i + 1] = up[i + 1], 0.0
        if d[i] == 0:
            d[i] = tiny
        down[i] /= d[i]
        d[i + 1] -= down[i] * up[i]
        if swap and i + 2 < n:
            up[i + 1] -= down[i] * up2[i]
        swaps.append(swap)
    if abs(d[-1]) < tiny:
        d[-1] = tiny

    def solve(b):
        x = b.copy()
        for i in range(n - 1):
            if swaps[i]:
                x[i], x[i + 1] = x[i + 1], x[i]
            x[i + 1] -= down[i] * x[i]
        x[-1] /= d[-1]
        for i in range(n - 2, -1, -1):
            x[i] -= up[i] * x[i + 1] + (up2[i] * x[i + 2] if i + 2 < n else 0.0)
            x[i] /= d[i]
        return x
    return solve


def vectors_of(diag: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of the tridiagonal matrix by inverse
    iteration; those of close eigenvalues are made orthogonal each round."""
    n = len(diag)
    norm = max(np.abs(diag).max() + 2 * np.abs(off).max(initial=0), 1e-300)
    rng = np.random.default_rng(12)
    out = np.zeros((n, len(values)))
    first, shift = 0, None
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLOSE * norm:
            first = j
        # equal eigenvalues get slightly different shifts
        step = 4 * np.finfo(np.float64).eps * norm
        shift = value if j == first else min(value, shift - step)
        solve = _solver(diag, off, shift)
        x = rng.uniform(-1, 1, n)
        for _ in range(5):
            x = solve(x / np.abs(x).max())
            for _ in range(2):
                x -= out[:, first:j] @ (out[:, first:j].T @ x)
            x /= np.linalg.norm(x)
        out[:, j] = x
    return out


def leading_components(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit vectors as columns) of a covariance."""
    scale = np.abs(cov).max()
    diag, off, reflectors = tridiagonal(cov / scale)
    values = leading_values(diag, off, k)
    x = vectors_of(diag, off, values)
    for at in range(len(reflectors) - 1, -1, -1):
        v = reflectors[at]
        if v is not None:
            x[at + 1:] -= 2 * np.outer(v, v @ x[at + 1:])
    x *= np.sign(x[np.abs(x).argmax(axis=0), np.arange(k)])
    return values * scale, x


# ---- passes over the rows -------------------------------------------------
def _whole(column: pa.Array, dim: int) -> np.ndarray:
    """Scaled entries without the shift, as whole numbers, one row a vector."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.floor(np.clip(flat * SCALE, -_BOUND, _BOUND)).astype(np.int64)


def _sums(batches):
    """Sum of every entry and number of rows, by length of the vector."""
    held: dict[int, list] = {}
    for batch in batches:
        sizes = batch.column(1).value_lengths().to_numpy()
        for dim in np.unique(sizes):
            x = _whole(batch.column(1).filter(pa.array(sizes == dim)), int(dim))
            one = held.setdefault(int(dim), [0, np.zeros(dim, np.int64)])
            one[0] += len(x)
            one[1] += x.sum(axis=0)
    for dim, (n, s) in held.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(dim, dim, np.int64)), pa.array(np.arange(dim)), pa.array(np.full(dim, n, np.int64)),
             pa.array(s)], names=["dim", "at", "n", "s"])


def _deviations(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """n x - S, exact."""
    if n * float(np.abs(x).max(initial=0)) + float(np.abs(s).max(initial=0)) < 2.0 ** 62:
        return n * x - s
    return n * x.astype(object) - s.astype(object)


def _products(dim, n, s, projection=None):
    """Sums of centred products (of the projected rows, if a projection is given)."""
    def run(batches):
        total, seen = 0, False
        for batch in batches:
            x = _whole(batch.column(1), dim)
            for lo in range(0, len(x), _BLOCK):
                y = (_deviations(x[lo:lo + _BLOCK], n, s) / n).astype(np.float64)
                if projection is not None:
                    y = y @ projection.value
                total, seen = total + y.T @ y, True
        if seen:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "v"])
    return run


def _matrix(rows: DataFrame, run, size: int, n: int) -> np.ndarray:
    """The symmetric matrix whose partial sums ``run`` gives, over n."""
    out = np.zeros((size, size))
    for r in rows.mapInArrow(run, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"] / n
    return out


def _squares(y: np.ndarray) -> list:
    if y.dtype != object and y.shape[1] * float(np.abs(y).max(initial=0)) ** 2 < 2.0 ** 62:
        return (y * y).sum(axis=1).tolist()
    y = y.astype(object)
    return [int(v) if v < 2 ** 63 else None for v in (y * y).sum(axis=1)]


def _project(dim, n, s, projection, explained, error):
    k = len(explained)

    def run(batches):
        for batch in batches:
            x = _whole(batch.column(1), dim)
            for lo in range(0, len(x), _BLOCK):
                y = _deviations(x[lo:lo + _BLOCK], n, s)
                rows = len(y)
                z = (y / n).astype(np.float64) @ projection.value
                ids = batch.column(0).slice(lo, rows).take(pa.array(np.repeat(np.arange(rows), k)))
                deviation = pa.array(_squares(y), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                     pa.array(np.full(rows * k, n, np.int64)), deviation, pa.array(z.ravel()),
                     pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error),
    one row for each remaining vector and component."""
    spark = vectors.sparkSession
    small_batches(spark)
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    schema = (f"vec_id {id_type}, component int, n bigint, deviation bigint, whitened double, explained double,"
              " identity_error double")
    rows = vectors.select("vec_id", F.col(column).cast("array<double>").alias("v")).where(
        "size(v) > 0 AND forall(v, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('Infinity'))")
    sums = rows.mapInArrow(_sums, "dim bigint, at bigint, n bigint, s bigint").groupBy("dim", "at").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"))
    # of the lengths that occur, the most common one
    best = sums.where("at = 0").orderBy(F.desc("n"), F.desc("dim")).select("dim", "n").first()
    if best is None:
        return spark.createDataFrame([], schema)
    dim, n = best["dim"], best["n"]
    s = np.zeros(dim, np.int64)
    for r in sums.where(F.col("dim") == dim).collect():
        s[r["at"]] = r["s"]
    rows = rows.where(F.size("v") == dim)
    cov = _matrix(rows, _products(dim, n, s), dim, n)
    if not np.abs(cov).max() > 0:
        return spark.createDataFrame([], schema)
    values, comps = leading_components(cov, min(components, dim))
    keep = values > LEAST * np.trace(cov)
    values, comps = values[keep], comps[:, keep]
    projection = spark.sparkContext.broadcast(comps / np.sqrt(values))
    white = _matrix(rows, _products(dim, n, s, projection), len(values), n)
    error = float(np.abs(white - np.eye(len(values))).max())
    return rows.mapInArrow(_project(dim, n, s, projection, values / np.trace(cov), error), schema)


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_whitening": _query}
