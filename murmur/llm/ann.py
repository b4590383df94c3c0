"""Operator 8: nearest vectors by multi-index hashing.

A rotation is learned (PCA, then iterative quantisation) on at most ``SAMPLE``
vectors; the signs of a centred, rotated vector are its code. Codes are cut
into ``PARTS`` substrings, each indexed. A code within Hamming radius R of the
query's agrees with it in one substring up to R // PARTS bits (pigeonhole), so
probing those buckets retrieves every code within the radius; the retrieved
ones are checked on the whole code and reranked by exact cosine on the floats.

Every vector is indexed. Rows are dealt to blocks of about ``BLOCK`` by a hash
of their id, so memory is bounded and no value is hot; the stated query set
meets every block, and the blocks' lists are merged by a second grouping.
Where a block finds fewer than k codes, its radius grows until it has k or
all of them, so short results only come from short tables.

Defined results: vectors that are null, zero or hold a null or non-finite
component, or differ in length from most, take no part; ties go to the smaller id; rows
repeated under one id are one candidate each but never their own query's;
null ids take no part; no vectors, no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.sources.tables import table

BITS = 64
PARTS = 4
RADIUS = 30
BLOCK = 20_000
SAMPLE = 8_000
_WIDTH = BITS // PARTS
_COUNT = np.array([bin(i).count("1") for i in range(1 << _WIDTH)], np.uint8)
_BALL = {}


def ball(radius: int) -> np.ndarray:
    """All substrings of at most that many bits, fewest first."""
    if radius not in _BALL:
        near = np.flatnonzero(_COUNT <= radius)
        _BALL[radius] = near[np.argsort(_COUNT[near], kind="stable")]
    return _BALL[radius]


class Codes:
    """Centre and rotations that turn a vector into ``BITS`` signs."""

    def __init__(self, sample: np.ndarray, seed: int = 8, rounds: int = 30):
        rng = np.random.default_rng(seed)
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.centre = unit.mean(axis=0)
        x = unit - self.centre
        _, axes = np.linalg.eigh(x.T @ x)
        parts, left = [], BITS
        while left > 0:  # as many learned rotations as the bits need
            use = axes[:, ::-1][:, :left]
            z = x @ use
            turn = np.linalg.qr(rng.normal(size=(use.shape[1],) * 2))[0]
            for _ in range(rounds):
                u, _, v = np.linalg.svd(np.where(z @ turn > 0, 1.0, -1.0).T @ z)
                turn = (u @ v).T
            parts.append(use @ turn)
            left -= use.shape[1]
        self.turn = np.concatenate(parts, axis=1)

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        """Rows of PARTS substrings."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        bits = ((unit - self.centre) @ self.turn > 0).reshape(len(vectors), PARTS, _WIDTH)
        return bits @ (1 << np.arange(_WIDTH))


def search_block(codes, ids, vectors, queries, query_ids, k, radius):
    """(query, id, cosine) of the k nearest of a block for every query."""
    own, norm = codes(vectors), np.sqrt((vectors * vectors).sum(axis=1))
    order = [np.argsort(own[:, p], kind="stable") for p in range(PARTS)]
    first = [np.searchsorted(own[o, p], np.arange((1 << _WIDTH) + 1)) for p, o in enumerate(order)]
    out = []
    for code, q, qid in zip(codes(queries), queries, query_ids):
        r, others = radius, int((ids != qid).sum())
        while True:
            hit = np.zeros(len(ids), bool)
            for p in range(PARTS):
                bucket = code[p] ^ ball(min(_WIDTH, r // PARTS))
                a, n = first[p][bucket], first[p][bucket + 1] - first[p][bucket]
                hit[order[p][np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())]] = True
            got = np.flatnonzero(hit)
            got = got[_COUNT[own[got] ^ code].sum(axis=1) <= r]
            got = got[ids[got] != qid]
            if len(got) >= min(k, others) or r >= BITS:
                break
            r = min(BITS, r + PARTS)
        cosine = (vectors[got] * q).sum(axis=1) / (norm[got] * np.sqrt((q * q).sum()))
        best = np.lexsort((ids[got], -cosine))[:k]
        out += [(int(qid), int(ids[got[i]]), float(cosine[i])) for i in best]
    return out


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, radius: int = RADIUS,
            id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): every query's k nearest other rows."""
    spark = rows.sparkSession
    fine = (f"{id_col} IS NOT NULL AND size({vec_col}) > 0 AND forall({vec_col}, x -> x IS NOT NULL AND NOT isnan(x)"
            f" AND abs(x) < double('infinity')) AND exists({vec_col}, x -> x <> 0)")
    pick = [F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")]
    rows, queries = rows.where(fine).select(*pick), queries.where(fine).select(*pick)
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    empty = "query_id bigint, vec_id bigint, score double"
    if not sizes:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    total = rows.count()
    rows, queries = (x.where(F.size("vec") == sizes[0]["d"]) for x in (rows, queries))
    million = 1_000_000
    share = min(million, -(-SAMPLE * million // total))
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(million)) < share).limit(2 * SAMPLE).collect()
    codes = Codes(np.array([r["vec"] for r in sample] or [r["vec"] for r in rows.limit(100).collect()]))
    blocks = -(-total // BLOCK)
    left = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    right = queries.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def run(key, own, asked):
        import pandas as pd
        if not len(own) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        found = search_block(codes, own["vec_id"].to_numpy(), np.stack(own["vec"]), np.stack(asked["vec"]),
                             asked["vec_id"].to_numpy(), k, radius)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    found = left.groupBy("block").cogroup(right.groupBy("block")).applyInPandas(run, empty)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows of every block
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 50 = 0"))


QUERIES = {"op8_nearest_vectors": _query}
