"""Regional matrices and outcome tables (PRJ-8/9/10, AGG-12/13/14/15/16/33/39/48,
JOI-1/2/7/14, FLT-7/12/13).

Region-level frames are as large as the region dimension (51 states in the
reference), not as the data: every operator here reduces the posts to one
row per region with a single conditional ``groupBy`` (partial aggregation
map-side) before anything is joined.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.classify import STATE_CODES
from murmur.operators.common import safe_corr, with_scalars


def returns_mapping(df: DataFrame, *, state: str, a_votes: str, b_votes: str, total: str,
                    swing_threshold: float = 5.0, a_name: str = "Biden", b_name: str = "Trump",
                    suffix: str = "", controls: Mapping[str, str] | None = None,
                    historical: str | None = None) -> DataFrame:
    """PRJ-8 (+ v2 controls, PRJ-9 vote check, PRJ-10 aliases).

    Shares, signed/absolute margin, winner, swing/safe at |margin| <= threshold.
    A region whose two main counts exceed its total fails the job."""
    a, b, t = (F.col(a_votes).cast("long"), F.col(b_votes).cast("long"), F.col(total).cast("long"))
    check = F.when(a + b > t, F.raise_error(F.concat(F.lit("major-party votes exceed total votes for "),
                                                     F.col(state).cast("string"))))
    margin = 100.0 * (a - b) / t
    s = suffix
    cols = [F.col(state).cast("string").alias("state_code"), a.alias(f"a_votes{s}"), b.alias(f"b_votes{s}"),
            t.alias(f"total_votes{s}"), (t - a - b).alias(f"other_votes{s}"),
            (100.0 * a / t).alias(f"a_vote_share_pct{s}"), (100.0 * b / t).alias(f"b_vote_share_pct{s}"),
            F.coalesce(check, margin).alias(f"democratic_margin_pct{s}"),
            F.abs(margin).alias(f"absolute_margin_pct{s}"),
            F.when(margin > 0, F.lit(a_name)).otherwise(F.lit(b_name)).alias(f"winner{s}"),
            F.when(F.abs(margin) <= swing_threshold, F.lit("swing")).otherwise(F.lit("safe"))
            .alias(f"state_classification{s}_margin" if s else "state_classification"),
            F.lit(float(swing_threshold)).alias("swing_threshold_pct")]
    if historical is not None:
        cols.append(F.coalesce(F.col(historical).cast("string"), F.lit("unknown")).alias("historical_classification"))
    for name, src in (controls or {}).items():
        cols.append(F.coalesce(F.col(src).cast("double"), F.lit(0.0)).alias(name))
    return df.select(*cols)


def _in_regions(posts: DataFrame, region_col: str, regions: Sequence[str] | DataFrame | None) -> DataFrame:
    """FLT-7: keep posts whose trimmed, upper-cased region is a valid code."""
    r = F.upper(F.trim(F.col(region_col).cast("string")))
    posts = posts.withColumn("_region", r)
    if regions is None:
        regions = STATE_CODES
    if isinstance(regions, DataFrame):
        dim = regions.select(F.upper(F.trim(F.col(regions.columns[0]).cast("string"))).alias("_region")).distinct()
        return posts.join(dim, "_region", "left_semi")
    return posts.where(F.col("_region").isin(*regions))


def region_matrix(posts: DataFrame, returns: DataFrame, *, region_col: str, candidate_col: str,
                  scores: Mapping[str, str] | str, regions: Sequence[str] | DataFrame | None = None,
                  a_pattern: str = "biden|joe", b_pattern: str = "trump|donald", both_value: str = "both",
                  mode: str = "primary", id_col: str | None = None) -> DataFrame:
    """AGG-12 (+ AGG-13, JOI-1/2, FLT-13).

    Per region: mean score and row count for each side (case-insensitive
    substring patterns on the candidate), margin Xi = mean_a - mean_b, then
    ``returns`` LEFT JOIN the matrix.
    ``mode``: 'primary' drops 'both' rows (v3 primary), 'split' counts them
    for each side and fills every NULL with 0 after the join (as v3 does),
    'v1' keeps rows as they are (a 'both' value matches no pattern).
    One conditional groupBy replaces the reference's two grouped frames and
    their outer join (JOI-2)."""
    p = _in_regions(posts, region_col, regions)
    cand = F.lower(F.col(candidate_col).cast("string"))
    is_both = F.col(candidate_col) == both_value
    if mode == "primary":
        p = p.where(~is_both | F.col(candidate_col).isNull())
    a_mask = F.coalesce(cand.rlike(a_pattern), F.lit(False))
    b_mask = F.coalesce(cand.rlike(b_pattern), F.lit(False))
    if mode == "split":
        a_mask = a_mask | F.coalesce(is_both, F.lit(False))
        b_mask = b_mask | F.coalesce(is_both, F.lit(False))
    single = isinstance(scores, str)
    mapping = {"": scores} if single else dict(scores)
    aggs = [F.count(F.when(a_mask, 1)).alias("_a_rows"), F.count(F.when(b_mask, 1)).alias("_b_rows")]
    first = next(iter(mapping.values()))
    cnt_src = F.col(id_col) if id_col else F.col(first)
    aggs += [F.count(F.when(a_mask, cnt_src)).alias("a_tweet_count"),
             F.count(F.when(b_mask, cnt_src)).alias("b_tweet_count")]
    for sfx, col in mapping.items():
        x = f"_{sfx}" if sfx else ""
        aggs += [F.coalesce(F.avg(F.when(a_mask, F.col(col))), F.lit(0.0)).alias(f"a_mean_sentiment{x}"),
                 F.coalesce(F.avg(F.when(b_mask, F.col(col))), F.lit(0.0)).alias(f"b_mean_sentiment{x}")]
    m = p.groupBy(F.col("_region").alias("state_code")).agg(*aggs).where(
        (F.col("_a_rows") > 0) | (F.col("_b_rows") > 0)).drop("_a_rows", "_b_rows")
    for sfx in mapping:
        x = f"_{sfx}" if sfx else ""
        m = m.withColumn(f"state_sentiment_margin_Xi{x}",
                         F.col(f"a_mean_sentiment{x}") - F.col(f"b_mean_sentiment{x}"))
    out = returns.join(m, "state_code", "left")
    if mode == "split":
        return out.na.fill(0).na.fill(0.0)
    xi = [f"state_sentiment_margin_Xi{'_' + s if s else ''}" for s in mapping]
    return out.na.fill(0.0, subset=xi)


def classification_lists(matrix: DataFrame, col: str = "historical_classification") -> DataFrame:
    """AGG-14 / FLT-12: battleground and safe region lists (sorted). The
    lists are region-dimension sized."""
    return matrix.agg(
        F.array_sort(F.collect_list(F.when(F.col(col) == "battleground", F.col("state_code"))))
        .alias("battleground_states"),
        F.array_sort(F.collect_list(F.when(F.col(col).isin("safe_red", "safe_blue"), F.col("state_code"))))
        .alias("safe_states"))


def representativeness(posts: DataFrame, returns: DataFrame, regions: DataFrame, *, region_col: str,
                       user_col: str, score_col: str, min_rows: int = 100,
                       total_col: str = "total_votes") -> tuple[DataFrame, DataFrame]:
    """AGG-33 + JOI-14: per region of the dimension (absent regions get 0):
    rows, users, share of geocoded rows, share of total votes, ratio,
    low-confidence flag; plus one summary row (correlation of the two
    shares, low-confidence count, mean score mapped vs not mapped)."""
    dim = regions.select(F.upper(F.trim(F.col(regions.columns[0]).cast("string"))).alias("state_code")).distinct()
    r = F.upper(F.trim(F.col(region_col).cast("string")))
    tagged = posts.withColumn("_region", r).join(
        dim.withColumnRenamed("state_code", "_region").withColumn("_mapped", F.lit(True)), "_region", "left")
    mapped = F.coalesce(F.col("_mapped"), F.lit(False))
    per = tagged.where(mapped).groupBy(F.col("_region").alias("state_code")).agg(
        F.count(F.lit(1)).alias("n_tweets"), F.count_distinct(user_col).alias("n_users"))
    votes = returns.select("state_code", F.col(total_col).alias("_votes"))
    t = dim.join(per, "state_code", "left").join(votes, "state_code", "left").na.fill(0, ["n_tweets", "n_users"])
    tot = t.agg(F.sum("n_tweets").alias("_geo"), F.sum("_votes").alias("_allv"))
    t = with_scalars(t, tot)
    share_geo = F.when(F.col("_geo") > 0, F.col("n_tweets") / F.col("_geo")).otherwise(0.0)
    share_vote = F.when(F.col("_allv") > 0, F.coalesce(F.col("_votes"), F.lit(0)) / F.col("_allv")).otherwise(0.0)
    per_region = t.select("state_code", "n_tweets", "n_users", share_geo.alias("share_of_geocoded"),
                          share_vote.alias("share_of_votes")).withColumn(
        "ratio_geo_to_votes", F.when(F.col("share_of_votes") > 0,
                                     F.col("share_of_geocoded") / F.col("share_of_votes")).otherwise(0.0)
    ).withColumn("low_confidence", F.col("n_tweets") < min_rows)
    s1 = per_region.agg(safe_corr("share_of_geocoded", "share_of_votes").alias("correlation_geo_vs_votes"),
                        F.count(F.when(F.col("low_confidence"), 1)).alias("low_confidence_states_count"))
    s2 = tagged.agg(F.coalesce(F.avg(F.when(mapped, F.col(score_col))), F.lit(0.0)).alias("mean_score_geocoded"),
                    F.coalesce(F.avg(F.when(~mapped, F.col(score_col))), F.lit(0.0)).alias("mean_score_non_geocoded"))
    summary = with_scalars(s1, s2)
    return per_region, summary


def language_by_region(posts: DataFrame, returns: DataFrame, *, region_col: str, lang_col: str, lang: str, share: str,
                       demographic: str, min_rows: int = 100) -> DataFrame:
    """JOI-7: per region the rows, the rows of a language and their share in
    percent, inner join with a demographic column, regions under ``min_rows``
    left out; the fit line of the share on it and their correlation."""
    counts = posts.groupBy(F.col(region_col).alias("state_code")).agg(
        F.count(F.lit(1)).alias("n_tweets"), F.count_if(F.col(lang_col) == lang).alias("n_lang"))
    m = counts.withColumn(share, F.col("n_lang") * 100.0 / F.col("n_tweets")).join(
        returns.select("state_code", demographic), "state_code").where(F.col("n_tweets") >= min_rows)
    line = m.agg(F.regr_intercept(share, demographic).alias("_i"), F.regr_slope(share, demographic).alias("_s"),
                 safe_corr(demographic, share).alias("pearson_r"))
    return with_scalars(m, line).withColumn("fitted_share_pct", F.col("_i") + F.col("_s") * F.col(demographic)).drop("_i", "_s")


def crosstab_with_totals(df: DataFrame, row: Column, col: Column, total: str = "Total") -> DataFrame:
    """AGG-15: row x column counts with a total row and column (``cube`` with
    ``grouping`` flags), long form: region, language, n."""
    c = df.select(row.alias("region"), col.alias("language")).cube("region", "language").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("region").alias("_gr"), F.grouping("language").alias("_gl"))
    return c.select(F.when(F.col("_gr") == 1, F.lit(total)).otherwise(F.col("region")).alias("region"),
                    F.when(F.col("_gl") == 1, F.lit(total)).otherwise(F.col("language")).alias("language"),
                    "n")


def region_language_counts(df: DataFrame, region_class: Column, language_class: Column) -> DataFrame:
    """AGG-16: scalar counts in one aggregate."""
    us = region_class.startswith("US_")
    return df.agg(F.count(F.lit(1)).alias("total_tweets"),
                  F.count(F.when(us, 1)).alias("us_state_tweets"),
                  F.count(F.when(us & (language_class == "Spanish"), 1)).alias("us_spanish_tweets"),
                  F.count(F.when(us & (language_class == "Other"), 1)).alias("us_other_language_tweets"),
                  F.count(F.when(region_class == "Non_US", 1)).alias("non_us_tweets"),
                  F.count(F.when(region_class == "Unmapped", 1)).alias("unmapped_tweets"))
