"""Operator 9: near-duplicate documents by one-permutation hashing.

A document's set is its distinct five-word shingles (fewer words: the whole
sequence). One permutation's values are cut into ``BINS`` bins; every bin keeps
its least value, and empty bins borrow one from a bin chosen by a shared hash
(optimal densification). Bands of bins are the buckets: a pair with Jaccard
0.85 misses all 40 bands of 7 with odds near 2e-7. A lower bound needs shorter
bands: at 0.80 a pair misses 46 bands of 6 with odds near 8e-7.

Equal sets are one class before anything is compared. A bucket then emits
star-shaped edges only: its hub against every other member. An edge counts if
the whole sets confirm 100 * intersection >= percent * union (85 in op9). A star alone can miss
a link between two spokes, so the members of buckets that are not yet all
connected are indexed exactly by their rarest shingles (``prefix_rows``), and
stars go on in those smaller buckets, first with the hubs that have the fewest
shingles of their own, until no untested pair could join two components: no
link between different texts is lost, and no bucket emits all its pairs.

Everything is joined and grouped by Spark: nothing is collected, hubs with many
spokes are salted, and intermediate tables are checkpointed in the shared
folder, so lost executors cost recomputation of their tasks only.

Defined results: null texts and texts without words have an empty set, are
linked with nothing and are kept; rows with the same doc_id are one document;
a row without doc_id has no component and is not kept; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import (blocks_of, checkpointed, documents, mix, shingle_hashes, small_batches, stored,
                               to_bytes, word_hashes)

BANDS, ROWS = 40, 7      # for 0.85
SHINGLE = 5
SALTS = 16


class Bands:
    """Fixed random choices of ``bands`` bands of ``rows`` bins each."""

    def __init__(self, bands: int, rows: int):
        self.shape, self.bins = (bands, rows), bands * rows
        self.edges = np.array([(i << 64) // self.bins for i in range(self.bins)], dtype=np.uint64)
        rng = np.random.default_rng(9)
        self.borrow = rng.integers(0, self.bins, (2048, self.bins))
        self.odd = rng.integers(0, 1 << 63, self.shape, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.number = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


bands_of = lru_cache(Bands)
_ODD = bands_of(BANDS, ROWS).odd[0]


def one_permutation(values: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Densified sketch of a sorted, non-empty array of distinct hashes."""
    b = bands_of(bands, rows)
    at = np.append(np.searchsorted(values, b.edges), len(values))
    filled = at[1:] > at[:-1]
    out = values[np.minimum(at[:-1], len(values) - 1)]
    empty = np.flatnonzero(~filled)
    for row in b.borrow:
        if not len(empty):
            return out
        lender = row[empty]
        ok = filled[lender]
        out[empty[ok]] = values[at[lender[ok]]]
        empty = empty[~ok]
    full = np.flatnonzero(filled)  # a few empty bins left: the next filled one
    out[empty] = values[at[full[np.searchsorted(full, empty) % len(full)]]]
    return out


def band_hashes(values: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    b = bands_of(bands, rows)
    with np.errstate(over="ignore"):
        return mix((one_permutation(values, bands, rows).reshape(b.shape) * b.odd).sum(axis=1, dtype=np.uint64)
                   + b.number)


def _sets(texts):
    for lo, hi in blocks_of(texts, 1 << 18):
        words, first = word_hashes(texts[lo:hi])
        yield from map(np.unique, shingle_hashes(words, first, SHINGLE))


def sketches(docs: DataFrame, banded=band_hashes) -> DataFrame:
    """(doc_id, n, k1, k2, bands): size and 128-bit key of the set, its buckets
    by ``banded``."""

    def run(batches):
        import pyarrow as pa
        for b in batches:
            n, k1, k2, bands = [], [], [], []
            for s in _sets([to_bytes(t) for t in b.column(1).to_pylist()]):
                n.append(len(s))
                with np.errstate(over="ignore"):
                    k1.append(mix(s ^ _ODD[0]).sum(dtype=np.uint64))
                    k2.append(mix(s ^ _ODD[1]).sum(dtype=np.uint64))
                bands.append(banded(s).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(np.array(k1, np.uint64).view(np.int64)),
                 pa.array(np.array(k2, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n", "k1", "k2", "bands"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, k1 bigint, k2 bigint, bands array<bigint>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, shingles) with the whole set of every document."""

    def run(batches):
        import pyarrow as pa
        for b in batches:
            got = [s.view(np.int64) for s in _sets([to_bytes(t) for t in b.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int64()))],
                                             names=["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id bigint, shingles array<bigint>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(hub, doc_id, jaccard, linked) of the pairs, on whole sets.

    A hub may have any number of spokes, so its set is dealt to salts."""
    pairs = pairs.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(SALTS)))
    hubs = pairs.select("hub", "salt").distinct() \
        .join(sets.select(F.col("doc_id").alias("hub"), F.col("shingles").alias("hs")), "hub")
    both = pairs.join(hubs, ["hub", "salt"]).join(sets, "doc_id") \
        .withColumn("common", F.size(F.array_intersect("hs", "shingles"))) \
        .withColumn("total", F.size("hs") + F.size("shingles") - F.col("common"))
    return both.groupBy("hub", "doc_id").agg(
        F.max(F.col("common") / F.col("total")).alias("jaccard"),
        F.max(F.lit(100) * F.col("common") >= F.lit(percent) * F.col("total")).alias("linked"))


def components(links: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """(doc_id, component): least id reachable over links (a, b).

    Every round takes the least label among the neighbours and then the label
    of that label, so paths shrink by half; rounds end when nothing changes."""
    both = stored(links.select("a", "b").unionAll(links.select(F.col("b"), F.col("a"))).distinct(), scratch)
    labels = both.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.min("a"), F.min("b")).alias("component"))
    labels = stored(labels, scratch)
    while True:
        step = both.join(labels, F.col("b") == F.col("doc_id")) \
            .groupBy("a").agg(F.min("component").alias("near"))
        low = labels.join(step, F.col("doc_id") == F.col("a"), "left") \
            .select("doc_id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("doc_id").alias("component"), F.col("component").alias("next"))
        new = stored(low.join(jump, "component", "left").select(
            "doc_id", "old", F.least("component", "next").alias("component")), scratch)
        labels = new.select("doc_id", "component")
        if new.where("component <> old").isEmpty():
            return labels


def with_component(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def in_pieces(rows: DataFrame, bucket: str) -> DataFrame:
    """Buckets whose members are in more than one component."""
    return rows.groupBy(bucket).agg(F.min("component").alias("lo"), F.max("component").alias("hi")) \
        .where("lo <> hi").select(bucket)


def prefix_rows(sets: DataFrame, percent: int) -> DataFrame:
    """(token, doc_id, n, alone, after): an exact candidate index.

    With every set ordered by (how many sets hold the shingle, shingle), two
    sets x, y of Jaccard p have an intersection of at least
    p / (1 + p) * (|x| + |y|), so their first shared shingle has that many
    shingles ``after`` it (itself counted) in both; it is among the first
    n - ceil(p n) + 1. Shingles of one set alone come first and match nobody,
    so copies with many edits of their own drop out; ``alone`` counts them."""
    whole = sets.withColumn("n", F.size("shingles").cast("bigint")).withColumn("sid", F.xxhash64("shingles"))
    tokens = whole.select("doc_id", "sid", "n", F.explode("shingles").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    held = tokens.join(shared, "token").groupBy("doc_id", "sid", "n") \
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("held")) \
        .withColumn("alone", F.col("n") - F.size("held"))
    probe = F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1
    return held.where(probe > F.col("alone")).select("doc_id", "n", "alone", F.posexplode(F.slice(
        "held", F.lit(1), (probe - F.col("alone")).cast("int"))).alias("pos", "one")) \
        .select(F.col("one.token").alias("token"), "doc_id", "n", "alone",
                (F.col("n") - F.col("alone") - F.col("pos")).alias("after")) \
        .groupBy("token", "doc_id", "n").agg(F.min("alone").alias("alone"), F.max("after").alias("after"))


def linked(src: DataFrame, percent: int, banded=band_hashes,
           scratch: list[str] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows (doc_id, n, rep, component_id) of (doc_id, text) with the least ids
    of their equal sets and of their component (null if there is no other), and
    the links (a, b, jaccard) between equal sets' least ids, None without any.
    ``scratch`` takes the folders of all tables that these still read."""
    keep = partial(stored, scratch=scratch)
    base = keep(sketches(src, banded))
    known = base.where("n > 0 AND doc_id IS NOT NULL")
    key = ["k1", "k2", "n"]
    classes = keep(known.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("members")))
    members = known.join(classes.select(F.col("rep").alias("doc_id"), *key), ["doc_id", *key], "left_semi") \
        .select("doc_id", "n", F.explode("bands").alias("band"))
    first = members.groupBy("band").agg(F.min("doc_id").alias("hub"), F.count("*").alias("size")).where("size > 1")
    active = keep(members.join(first.select("band", "hub"), "band")
                         .select("band", "doc_id", "n", "hub").distinct())
    labels = links = None
    if not active.isEmpty():
        wanted = keep(active.select("doc_id").distinct())
        few = wanted.count() * 16 < 8 << 20  # a measured size, else Spark shuffles
        # whole sets of any length: a checkpoint is read row by row, Parquet in vectors of rows
        sets = checkpointed(shingle_sets(src.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")), scratch)
        hubs = active.where("doc_id = hub").select("band", "hub", F.col("n").alias("hub_n")).distinct()
        pairs = active.where("doc_id <> hub").join(hubs, ["band", "hub"]) \
            .where(100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")).select("hub", "doc_id").distinct()
        tested = keep(verified(pairs, sets, percent))
        links = tested.where("linked").select(F.col("hub").alias("a"), F.col("doc_id").alias("b"), "jaccard")
        labels = components(links, scratch)
        # buckets that are in more than one piece without their hub
        rest = with_component(active.where("doc_id <> hub").select("band", "doc_id"), labels)
        rest = rest.join(in_pieces(rest, "band"), "band", "left_semi").select("doc_id").distinct()
        rows = keep(prefix_rows(sets.join(rest, "doc_id", "left_semi"), percent))
        tested, spread = tested.select("hub", "doc_id"), 1
        while True:
            rows = with_component(rows.drop("component"), labels)
            rows = keep(rows.join(in_pieces(rows, "token"), "token", "left_semi"))
            if rows.isEmpty():
                break
            best = F.struct((-F.col("alone")).alias("alone"), (-F.col("doc_id")).alias("neg"), "n", "after", "component")
            hubs = keep(rows.groupBy("token", F.pmod(F.hash("doc_id"), F.lit(spread)).alias("part"))
                               .agg(F.max(best).alias("top")).select(
                "token", (-F.col("top.neg")).alias("hub"), F.col("top.n").alias("hub_n"),
                F.col("top.after").alias("hub_after"), F.col("top.component").alias("hub_component")))
            pairs = rows.join(hubs, "token").where(
                (F.col("component") != F.col("hub_component"))
                & (100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
                & ((100 + percent) * F.least("after", "hub_after") >= percent * (F.col("n") + F.col("hub_n")))) \
                .select(F.least("hub", "doc_id").alias("hub"), F.greatest("hub", "doc_id").alias("doc_id")).distinct() \
                .join(tested, ["hub", "doc_id"], "left_anti")
            found = keep(verified(pairs, sets, percent))
            new = found.where("linked").select(F.col("hub").alias("a"), F.col("doc_id").alias("b"), "jaccard")
            if not new.isEmpty():
                links = keep(links.unionAll(new))
                labels = components(links, scratch)
            tested = keep(tested.unionAll(found.select("hub", "doc_id")))
            # a hub's pairs in its bucket are settled
            rows = rows.join(hubs.select("token", F.col("hub").alias("doc_id")), ["token", "doc_id"], "left_anti")
            spread *= 32
    # classes whose members' component is not simply their own id
    if labels is None:
        joined = classes.where("members > 1").withColumn("component_id", F.col("rep"))
    else:
        joined = classes.join(labels.withColumnRenamed("doc_id", "rep"), "rep", "left") \
            .where("members > 1 OR component IS NOT NULL") \
            .withColumn("component_id", F.coalesce("component", "rep"))
    salted = joined.select(*key, "rep", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = base.drop("bands").withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(SALTS))) \
        .join(salted, [*key, "salt"], "left").select("doc_id", "n", "rep", "component_id")
    return rows, links


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id",
                    text_col: str = "text", bands: int = BANDS, band_rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; ``bands`` bands of
    ``band_rows`` bins must be so many that a pair at ``percent`` hardly misses all."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows, _ = linked(src, percent, partial(band_hashes, bands=bands, rows=band_rows))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce(
        "component_id", "doc_id")).alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


QUERIES = {"op9_near_dedup": lambda spark, sf_dir: near_duplicates(documents(spark, sf_dir))}
