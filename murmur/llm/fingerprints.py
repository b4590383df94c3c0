"""Operator 2: MinHash document fingerprints.

A text's set is its distinct five-word shingles. ``PERMUTATIONS`` universal
hashes a*x+b modulo 2^32 (a odd: permutations) run over all shingles in
vectorised numpy; the fingerprint keeps 16 bits of every minimum. The share of
equal positions, corrected for chance, estimates the Jaccard likeness.
``similar_pairs`` cuts fingerprints into bands, joins equal bands in Spark and
verifies Jaccard on whole sets: equal sets are one class first, a bucket emits
a star around one hub, and buckets that this leaves in pieces go on with the
exact index of rare shingles of ``near_dedup``, so two documents at the
threshold are always joined by links, directly or over others. The query has
the least id of each document's group (``class_id``) and its number of links.

The neighbour in descending id order is found without a global sort in one
task: ids are dealt to buckets at approximate quantiles, every bucket also gets
a copy of the row that follows its last one, and each bucket is read in order
by one task. Texts cross one shuffle.

Defined results: null texts are empty; a text without words has the all-ones
fingerprint, whose likeness to another such is 1 and to any other 0; null ids
come last, equal ids are ordered by text, downwards; a single document is its
own neighbour; an empty table gives no rows; other columns are ignored; texts
without words have no links, null ids neither links nor class.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm import near_dedup
from murmur.llm.common import (blocks_of, documents, free, mix, shingle_hashes, small_batches, stored, to_bytes,
                               word_hashes)

PERMUTATIONS = 128
SHINGLE = 5
_rng = np.random.default_rng(20)
_A = (_rng.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
_NONE = np.full(PERMUTATIONS, 0xFFFF, np.uint16)
# bands are cut from these and some more
BANDS, ROWS = 32, 5      # a pair at 0.80 misses all bands with odds near 3e-6
_more = np.random.default_rng(21)
_BAND_A = np.append(_A, (_more.integers(0, 1 << 31, BANDS * ROWS - PERMUTATIONS, dtype=np.uint32) << np.uint32(1))
                    | np.uint32(1))
_BAND_B = np.append(_B, _more.integers(0, 1 << 32, BANDS * ROWS - PERMUTATIONS, dtype=np.uint32))


def signature(shingles: np.ndarray, a: np.ndarray = _A, b: np.ndarray = _B) -> np.ndarray:
    """16 bits of the least value of every permutation over the shingles."""
    if not len(shingles):
        return np.full(len(a), 0xFFFF, np.uint16)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 2048):
            np.minimum(low, (x[None, i:i + 2048] * a[:, None] + b[:, None]).min(axis=1), out=low)
        low ^= low >> np.uint32(15)
        low *= np.uint32(0x2C1B3C6D)
        low ^= low >> np.uint32(12)
    return (low >> np.uint32(16)).astype(np.uint16)


def signatures(texts: list[bytes]) -> list[np.ndarray]:
    out = []
    for lo, hi in blocks_of(texts):
        words, first = word_hashes(texts[lo:hi])
        out += [signature(s) for s in shingle_hashes(words, first, SHINGLE)]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard likeness of two fingerprints' sets."""
    if (a == _NONE).all() or (b == _NONE).all():
        return float(np.array_equal(a, b))
    by_chance = 1 / 65536
    return float(max(0.0, ((a == b).mean() - by_chance) / (1 - by_chance)))


def _hex(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every text."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        import pyarrow as pa
        for b in batches:
            sigs = signatures([to_bytes(t) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_hex(s) for s in sigs], pa.string())],
                                             names=["doc_id", "fingerprint"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def in_id_order(docs: DataFrame, n: int, beside: DataFrame | None = None) -> DataFrame:
    """(doc_id, text, bucket, after, thin): every bucket's rows in descending
    id order in one partition, then a copy (``after`` = 1) of what follows.
    Rows of ``beside`` (doc_id and more) come along as ``thin`` ones, each
    right before the documents with its id, so nothing wide is joined."""
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000).alias("c")) \
        .first()["c"] if n > 1 else None
    cuts = F.array(*[F.lit(c) for c in sorted(set(cuts or []))]).cast("array<bigint>")
    bucket = F.coalesce(F.size(F.filter(cuts, lambda c: c < F.col("doc_id"))), F.lit(0))
    docs = docs.select("doc_id", "text", bucket.alias("bucket"))
    # one row per bucket: bounded by n
    heads = docs.groupBy("bucket").agg(F.max("doc_id").alias("head")).orderBy("bucket").collect()
    ups = heads[1:] + heads[:1]  # the bucket before, in descending order
    rows = [(h["head"], u["bucket"]) for h, u in zip(heads, ups)]
    follow = docs.sparkSession.createDataFrame(rows, "head bigint, target int")
    both = docs.join(F.broadcast(follow), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    here = F.struct(F.col("bucket"), F.lit(0).alias("after"))
    there = F.struct(F.col("target").alias("bucket"), F.lit(1).alias("after"))
    out = both.select("doc_id", "text", F.explode(
        F.when(F.col("target").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("at")) \
        .select("doc_id", "text", "at.bucket", "at.after", F.lit(False).alias("thin"))
    if beside is not None:
        out = out.unionByName(beside.withColumns({
            "text": F.lit(None).cast("string"), "bucket": bucket, "after": F.lit(0), "thin": F.lit(True)}),
            allowMissingColumns=True)
    return out.repartitionById(n, F.col("bucket")).sortWithinPartitions(
        "bucket", "after", F.desc_nulls_last("doc_id"), F.desc("thin"), F.desc("text"))


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the start of another."""
    k = len(text) // 2
    return text[:len(text) - k] + following[:k]


def against_next(docs: DataFrame, beside: DataFrame | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited form, with likenesses;
    with ``beside``, also class_id and n_links of the document's id."""
    spark = docs.sparkSession
    small_batches(spark)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    src = in_id_order(docs.select(F.col("doc_id").cast("bigint"),
                                  F.coalesce("text", F.lit("")).alias("text")), n, beside)
    with_class = beside is not None
    src = src.select("doc_id", "text", "after", "thin", *(["class_id", "n_links"] if with_class else []))

    def run(batches):
        import pyarrow as pa
        last = own = None  # the last document, the last thin row
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            sigs = iter(signatures([to_bytes(t) for t, thin in zip(columns[1], columns[3]) if not thin]))
            rows = [last] if last else []
            for doc_id, text, after, thin, *more in zip(*columns):
                if thin:
                    own = doc_id, more
                    continue
                links = own[1] if own and own[0] == doc_id else [None, 0]
                rows.append((doc_id, text, after, next(sigs), links))
            last = rows[-1] if rows else None
            pairs = [(x, y) for x, y in zip(rows[:-1], rows[1:]) if not x[2]]
            texts = [to_bytes(edited(x[1], y[1])) for x, y in pairs]
            sigs = signatures(texts)
            out = {
                "doc_id": pa.array([x[0] for x, _ in pairs], pa.int64()),
                "n_chars": pa.array([len(x[1]) for x, _ in pairs], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                "fingerprint": pa.array([_hex(x[3]) for x, _ in pairs], pa.string()),
                "edited_fingerprint": pa.array([_hex(s) for s in sigs], pa.string()),
                "near_edited": pa.array([likeness(x[3], s) for (x, _), s in zip(pairs, sigs)], pa.float64()),
                "near_next": pa.array([likeness(x[3], y[3]) for x, y in pairs], pa.float64())}
            if with_class:
                out["class_id"] = pa.array([x[4][0] for x, _ in pairs], pa.int64())
                out["n_links"] = pa.array([x[4][1] for x, _ in pairs], pa.int64())
            yield pa.RecordBatch.from_pydict(out)

    return src.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string,"
                               " edited_fingerprint string, near_edited double, near_next double"
                               + (", class_id bigint, n_links bigint" if with_class else ""))


def signature_bands(shingles: np.ndarray) -> np.ndarray:
    """Hashes of ``BANDS`` bands of ``ROWS`` positions."""
    cut = signature(shingles, _BAND_A, _BAND_B).reshape(BANDS, ROWS)
    with np.errstate(over="ignore"):
        out = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for k in range(ROWS):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + cut[:, k])
    return out


def _linked(docs: DataFrame, threshold: float, scratch: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with their class, and all links (a, b, jaccard)."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("bigint"), "text").where("doc_id IS NOT NULL")
    found, links = near_dedup.linked(src, round(100 * threshold), signature_bands, scratch)
    found = stored(found, scratch)
    pairs = found.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"),
                                                F.lit(1.0).alias("jaccard"))
    if links is not None:
        pairs = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard") \
            .unionByName(pairs)
    return found, pairs.groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"))


def similar_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, jaccard): verified links, to whole percents of ``threshold``.

    Bands of positions are joined on equality. The links are not all pairs of
    a group but join all that are similar; their number is linear."""
    return _linked(docs, threshold)[1]


def with_links(docs: DataFrame) -> DataFrame:
    """The rows of ``against_next`` with class_id and n_links. The tables that
    the links were found with are freed before any text is shuffled."""
    scratch: list[str] = []
    found, pairs = _linked(docs, 0.8, scratch)
    ends = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b"))
    count = ends.groupBy("doc_id").agg(F.count("*").alias("n_links"))
    each = stored(found.groupBy("doc_id").agg(F.min(F.coalesce("component_id", "doc_id")).alias("class_id"))
                  .join(count, "doc_id", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0))))
    free(docs.sparkSession, scratch)
    return against_next(docs, each)


QUERIES = {"op2_fingerprints": lambda spark, sf_dir: with_links(documents(spark, sf_dir))}
