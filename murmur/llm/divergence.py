"""Operator 11: how far the sources of a language differ in their words.

One translation table lowers A-Z and blanks every other ASCII byte, so one
``bytes.translate`` and one ``bytes.split`` give a text's terms (runs of ASCII
letters and of bytes from 0x80 on) and a Counter per document gives
frequencies and, by its keys, document counts. A task adds them up by
(lang, source, term) before anything is shuffled.

A language keeps its terms in at least ``LEAST_DOCS`` documents. Every
(lang, source) group and every language gives each kept term a smoothed share
in billionths, all in whole numbers, and the divergence of two such lists is
the sum of floor((p-q)^2 / q). A kept term that a group lacks has the group's
share for zero occurrences, so only occurrences are stored. The pair sums are
taken per bucket of about ``BUCKET_TERMS`` terms of a language, the buckets'
sums are added by Spark.

Defined results: null text, lang and source count as ''; every row is a
document of its own, repeated or null ids included; a group without terms has
shares for zero occurrences everywhere; a language without kept terms has
pairs of value 0; a source alone in its language has no pair; an empty table
gives no rows; only text, lang and source are read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.common import documents, small_batches, stored, to_bytes

LEAST_DOCS = 3
TOP_TERMS = 200
UNIT = 1_000_000_000
BUCKET_TERMS = 8192       # kept terms of a language in one bucket, about
HELD_TERMS = 400_000      # (lang, source, term) counts a task holds before it emits them
SLICE = 4 << 20           # bytes of one text that are split at a time
_CELLS = 1 << 20          # numbers of one dense block of terms by sources

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def term_counts(text: bytes) -> Counter:
    """Terms of one text and how often each occurs."""
    plain = text.translate(_TABLE)
    if len(plain) <= SLICE:
        return Counter(plain.split())
    out, lo = Counter(), 0
    while lo < len(plain):
        hi = plain.find(b" ", lo + SLICE)
        hi = len(plain) if hi < 0 else hi
        out.update(plain[lo:hi].split())
        lo = hi
    return out


def _count(batches):
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()),
                        ("n", pa.int64()), ("docs", pa.int64())])

    def rows():
        for (lang, source), (n, docs) in held.items():
            terms = [t.decode("utf-8", "replace") for t in n]
            # a group is announced by a row without a term
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(n) + 1)), pa.array([source] * (len(n) + 1)), pa.array([None, *terms], pa.string()),
                 pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())], schema=schema)

    held, size = {}, 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            one = term_counts(to_bytes(text))
            size -= len(n)
            n.update(one)
            docs.update(one.keys())
            size += len(n)
            if size > HELD_TERMS:
                yield from rows()
                held, size = {}, 0
    yield from rows()


def _share(n: str, total: str, kept: str) -> str:
    """Billionths of a term with ``n`` occurrences, in whole numbers."""
    return (f"1 + (CAST({UNIT} AS DECIMAL(10,0)) * CAST({n} + 1 AS DECIMAL(20,0)))"
            f" div CAST(greatest({total} + {kept}, 1) AS DECIMAL(20,0))")


def _pair_sums(key, rows):
    """Sums of floor((p-q)^2/q) over the terms of one bucket, for every two sources."""
    import pandas as pd
    head = rows["term"].isna().to_numpy()
    names = rows.loc[head, "source"].to_numpy()
    order = np.argsort(names, kind="stable")
    names, base = names[order], rows.loc[head, "p"].to_numpy(np.int64)[order]
    body = rows.loc[~head]
    term, _ = pd.factorize(body["term"])
    terms = int(term.max()) + 1 if len(term) else 0
    col = np.searchsorted(names, body["source"].to_numpy()) if terms else np.zeros(0, np.int64)
    share = body["p"].to_numpy(np.int64)
    by_term = np.argsort(term, kind="stable")
    term, col, share = term[by_term], col[by_term], share[by_term]
    total = np.zeros((len(names), len(names)), np.int64)
    step = max(1, _CELLS // max(len(names), 1))
    for lo in range(0, terms, step):
        a, b = np.searchsorted(term, [lo, lo + step])
        p = np.repeat(base[None, :], min(step, terms - lo), axis=0)
        p[term[a:b] - lo, col[a:b]] = share[a:b]
        for j in range(len(names)):
            q = p[:, j:j + 1]
            total[:, j] += ((p - q) ** 2 // q).sum(axis=0)
    i, j = np.nonzero(~np.eye(len(names), dtype=bool))
    return pd.DataFrame({"lang": key[0], "source": names[i], "item": names[j], "value": total[i, j]})


def divergence(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other
    sources of the language, part ``term`` the terms a group uses more often
    than its language."""
    small_batches(docs.sparkSession)
    text = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = text.mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    word = Window.partitionBy("lang", "term")
    kept = stored(counts.withColumn("in_docs", F.sum("docs").over(word)).withColumn("lang_n", F.sum("n").over(word))
                  .withColumn("first", F.row_number().over(word.orderBy("source")) == 1)
                  .where(f"term IS NULL OR in_docs >= {LEAST_DOCS}")
                  .select("lang", "source", "term", "n", "lang_n", "first"))
    # one row per group and per language
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"),
                                     F.count_if(F.expr("first AND term IS NOT NULL")).alias("kept"))
    sizes = stored(groups.join(langs, "lang"))
    shares = kept.where("term IS NOT NULL").join(sizes, ["lang", "source"]) \
        .withColumn("p", F.expr(_share("n", "group_total", "kept")))
    # terms
    rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    more = shares.withColumn("q", F.expr(_share("lang_n", "lang_total", "kept"))).where("p > q") \
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                F.expr("((p - q) * (p - q)) div q").alias("value")) \
        .withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= TOP_TERMS)
    # pairs: the rows of a bucket, and each group's share for zero occurrences
    buckets = f"kept div {BUCKET_TERMS} + 1"
    body = shares.select("lang", F.expr(f"pmod(xxhash64(term), {buckets})").alias("bucket"), "source", "term", "p")
    head = sizes.select("lang", F.explode(F.expr(f"sequence(0L, {buckets} - 1L)")).alias("bucket"), "source",
                        F.lit(None).cast("string").alias("term"), F.expr(_share("0L", "group_total", "kept")).alias("p"))
    pairs = body.unionByName(head).groupBy("lang", "bucket").applyInPandas(
        _pair_sums, "lang string, source string, item string, value bigint") \
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")) \
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value") \
        .withColumn("rank", F.row_number().over(rank))
    return pairs.unionByName(more)


_ORACLE = rf"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT lang, source, id, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= {LEAST_DOCS}),
langs AS (SELECT l.lang, count(k.term)::HUGEINT AS v, coalesce(sum(k.n), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept k ON k.lang = l.lang GROUP BY l.lang),
counts AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w
  JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + l.v) AS p,
    1 + ({UNIT}::HUGEINT * (k.n + 1)) // (l.total + l.v) AS q
  FROM groups g JOIN langs l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
    LEFT JOIN pairs s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value,
  (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM found QUALIFY part = 'pair' OR rank <= {TOP_TERMS}
"""

QUERIES = {"op11_source_divergence": lambda spark, sf_dir: divergence(documents(spark, sf_dir))}
ORACLES = {"op11_source_divergence": _ORACLE}
