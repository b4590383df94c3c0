"""Annotation batches and reply parsing (ANN-1..3, JSN-1/2), representative
case selection (TOP-1/4).

Prompts are assembled per chunk of ``chunk_size`` texts: chunk membership
comes from a global row position (rank kernel, no single-partition sort),
and each chunk is one bounded ``collect_list``. Replies are parsed with
``from_json`` into an array of structs and flattened with ``inline``.
"""

from __future__ import annotations

from typing import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.operators.common import with_scalars
from murmur.operators.sampling import sample_key
from murmur.operators.schema import row_position

ANNOTATION_SCHEMA = ("array<struct<tweet:string, candidate_target:string, expressed_sentiment:string, "
                     "intended_sentiment:string, sarcasm:boolean, stance:string, confidence:double>>")
# Defaults applied to missing reply fields.
REPLY_DEFAULTS = {"tweet": "", "candidate_target": "other", "expressed_sentiment": "neutral",
                  "intended_sentiment": "neutral", "sarcasm": False, "stance": "neutral", "confidence": 0.90}
INSTRUCTIONS = [
    "Label every numbered text below.",
    "Fields: candidate_target, expressed_sentiment, intended_sentiment (after irony), sarcasm (true/false),",
    "stance (favor/against/neutral) and confidence (0 to 1).",
    "Reply with one JSON array, one object per text, in order.",
]


def record_json(df: DataFrame, cols: Sequence[str], out: str = "record_json") -> DataFrame:
    """JSN-1: one JSON string per row."""
    return df.withColumn(out, F.to_json(F.struct(*[F.col(c) for c in cols])))


def prompt_batches(df: DataFrame, *, id_col: str, text_col: str, chunk_size: int = 20,
                   seeds: DataFrame | None = None, seed_cols: Sequence[str] = ()) -> DataFrame:
    """ANN-1: one prompt per chunk of ``chunk_size`` texts in id order:
    instructions, then the seed examples as JSON lines (the seed frame is a
    bounded pick, see ``seed_pick``), then the numbered texts."""
    pos = row_position(df.select(id_col, text_col), id_col, "_pos")
    pos = pos.withColumn("chunk", F.floor(F.col("_pos") / chunk_size).cast("long"))
    items = pos.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("_pos", F.col(text_col).alias("t"),
                                                                          F.col(id_col).alias("id")))).alias("_it"))
    header = "\n".join(INSTRUCTIONS)
    body = F.array_join(F.transform("_it", lambda e, i: F.format_string('Text %d: "%s"', i + 1, e["t"])), "\n")
    if seeds is not None:
        ex = seeds.agg(F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct(*seed_cols)))), "\n")
                       .alias("_seeds"))
        items = with_scalars(items, ex)
        prompt = F.concat_ws("\n", F.lit(header), F.lit("Examples:"), F.col("_seeds"), F.lit("Texts:"), body)
    else:
        prompt = F.concat_ws("\n", F.lit(header), F.lit("Texts:"), body)
    return items.select("chunk", F.transform("_it", lambda e: e["id"]).alias("ids"),
                        F.size("_it").alias("n_texts"), prompt.alias("prompt"))


def parse_replies(df: DataFrame, reply_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """JSN-2 / ANN-2: strip a ```json fence, parse the array of 7-field
    objects, one row per object, defaults for missing fields. Unparseable
    replies yield no rows (``from_json`` returns NULL)."""
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.col(reply_col)), r"^```json", ""), r"```$", ""))
    parsed = F.from_json(cleaned, ANNOTATION_SCHEMA)
    rows = df.select(*keep, F.inline(F.coalesce(parsed, F.array().cast(ANNOTATION_SCHEMA))))
    return rows.select(*keep, *[F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in REPLY_DEFAULTS.items()])


def seed_pick(df: DataFrame, *, id_col: str, cells: Sequence[str], score: str, threshold: float = 0.5,
              total: int = 15, seed: int = 42) -> DataFrame:
    """ANN-3: per cell (e.g. stream x label) one row above and one at or
    below ``threshold`` (the smallest sample key in each band), then the
    ``total`` rows with the smallest keys overall. Bounded by cells x 2."""
    k = sample_key(id_col, seed)
    band = F.when(F.col(score) > threshold, F.lit("high")).otherwise(F.lit("low"))
    picked = df.withColumn("_band", band).withColumn("_key", k).groupBy(*cells, "_band").agg(
        F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.col("_key")).alias("_r"), F.min("_key").alias("_key"))
    return picked.orderBy("_key").limit(total).select("_r.*", "_band")


def top_by_abs_difference(df: DataFrame, a: str, b: str, id_col: str, n: int = 50) -> DataFrame:
    """TOP-1: the n rows with the largest |a - b| (ties by id)."""
    d = F.abs(F.col(a) - F.col(b))
    return df.withColumn("absolute_score_difference", d).orderBy(F.desc("absolute_score_difference"),
                                                                 F.asc(id_col)).limit(n)


def representatives(df: DataFrame, cases: Sequence[tuple[str, Column, Column]], id_col: str) -> DataFrame:
    """TOP-4: one representative per ordered case, never reusing a row an
    earlier case took. Each case is (name, filter, ascending numeric order
    key). Case i can be blocked by at most i earlier picks, so only its first
    i+1 candidates are kept (a bounded top-k per case, at most n(n+1)/2 rows
    overall); the sequential no-reuse pick then runs over that tiny frame in
    one task."""
    from pyspark.sql import Window
    parts = []
    for i, (name, where, order) in enumerate(cases):
        c = (df.where(where).withColumn("_ord", order.cast("double")).orderBy("_ord", id_col).limit(i + 1)
             .withColumn("_case", F.lit(i)).withColumn("case", F.lit(name)))
        parts.append(c)
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    u = u.withColumn("_rank", F.row_number().over(Window.partitionBy("_case").orderBy("_ord", id_col)))
    schema = u.schema

    def pick(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(it)
        if not frames:
            return
        pdf = pd.concat(frames, ignore_index=True)
        used, rows = set(), []
        for case in sorted(pdf["_case"].unique()):
            for _, r in pdf[pdf["_case"] == case].sort_values("_rank").iterrows():
                if r[id_col] not in used:
                    used.add(r[id_col])
                    rows.append(r)
                    break
        yield pd.DataFrame(rows, columns=pdf.columns) if rows else pdf.iloc[0:0]

    return u.coalesce(1).mapInPandas(pick, schema).drop("_rank", "_ord", "_case")
