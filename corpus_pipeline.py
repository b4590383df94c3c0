"""A training-corpus pipeline: language ID, near-dedup, personal data, mixing,
byte-level BPE. Every stage works on all its predecessor kept; the columns of
``documents`` are kept up to the last stage.

Defined results: rows without doc_id are never near-duplicates of others and
stay; of rows that share a doc_id one stays (the least text); an empty table
passes through every stage; further columns, whatever their names, come
through all stages but the last unchanged."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm import bpe, langid, mixing, near_dedup, pii
from murmur.llm.common import documents, fresh, stored
from murmur.session import checkpoint_dir

LEAST_SCORE = 0.4       # of the predicted language; below it a text is rejected
NEAR = 80               # percent of shingles that near copies share
BANDS, ROWS = 46, 6     # a pair at 0.80 misses all bands with odds near 8e-7
MIX_SHARE = 0.9         # of the tokens that reach the mix
SMALL = 8 << 20         # bytes up to which a measured id list is broadcast


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without a likely language go."""
    net = langid.fit(docs)
    lang, score = fresh(docs, "_lang", "_score")
    found = langid.with_language(docs, net, names=(lang, score))
    return found.where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).drop(lang, score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard 0.80 or more) stays."""
    found = near_dedup.near_duplicates(docs, percent=NEAR, bands=BANDS, band_rows=ROWS)
    gone = stored(found.where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct())
    few = gone.count() * 16 <= SMALL
    left = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)
    ids = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    ids = stored(ids)
    if ids.isEmpty():
        return left
    # rows that share an id: the least text stays
    many = left.join(ids, "doc_id", "left_semi").select(*docs.columns)
    key = F.struct(F.coalesce("text", F.lit("")).alias("least"), F.struct(*docs.columns).alias("row"))
    one = many.groupBy("doc_id").agg(F.min(key).alias("first")).select("first.row.*")
    return left.join(ids, "doc_id", "left_anti").select(*docs.columns).unionByName(one)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind."""
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                             .otherwise(F.length("text")).cast(kind))
    return out.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights."""
    return mixing.mix(docs, share=MIX_SHARE, max_epochs=1).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of them and of what they decode to."""
    return bpe.round_trip(docs, keep_ids=True)


STAGES = [("language_id", language), ("near_dedup", near_duplicates), ("personal_data", personal_data),
          ("mixing", mixture), ("byte_bpe", tokens)]
ORACLE_SQL = None       # no stage but mixing can be said in SQL; tests hold it against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the
    shared folder and read again."""
    docs = documents(spark, sf_dir)
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
