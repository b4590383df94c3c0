"""Row-level reliability profilers (PRO-1..10, MAT-1/2, WIN-2/4).

Each profiler is ``df.transform``-able: it appends diagnostic columns and
never touches the canonical ones (CHK-7). Risk scores are in [0, 1] or
NULL; missing evidence stays NULL, never a filled score.
Group-level counts (duplicates, hour volumes) are aggregated once and joined
back (aggregate-then-join), so a text repeated millions of times is one row
in the shuffle, not one giant window partition.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions import classify as geo
from murmur.functions import text as tx
from murmur.operators import rank as rk
from murmur.operators.common import join_back, with_scalars
from murmur.operators.temporal import hour_spine_counts, nearest_event_hours
from murmur.session import cut_lineage, stored


# --- MAT-1 / MAT-2 ---------------------------------------------------------------
def clip01(c: Column) -> Column:
    """Clip to [0, 1], NULL preserved."""
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(
        F.least(F.greatest(c.cast("double"), F.lit(0.0)), F.lit(1.0)))


def available_mean(cols: Sequence[Column]) -> Column:
    """NULL-skipping row mean, clipped; NULL when every input is NULL."""
    num = sum((F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols), F.lit(0.0))
    den = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    return clip01(F.when(den > 0, num / den))


def normalised_entropy(ps: Sequence[Column]) -> Column:
    """MAT-2: -sum p ln max(p, 1e-12) / ln(k)."""
    return -sum((p * F.ln(F.greatest(p, F.lit(1e-12))) for p in ps), F.lit(0.0)) / math.log(len(ps))


def top_two_margin(ps: Sequence[Column]) -> Column:
    s = F.sort_array(F.array(*[F.coalesce(p, F.lit(0.0)) for p in ps]), asc=False)
    return F.element_at(s, 1) - F.element_at(s, 2)


def robust_z_sigmoid(df: DataFrame, value: str, out: str) -> DataFrame:
    """WIN-2: 1/(1+exp(-clip((x-median)/IQR, +-40))); IQR 0 -> 0; NULL kept.
    Median/quartiles are exact (shared rank kernel), attached as one row."""
    q = rk.quantiles(df, value, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75})
    j = with_scalars(df, q, how="left")
    x = F.col(value).cast("double")
    iqr = F.col("_q3") - F.col("_q1")
    z = F.least(F.greatest((x - F.col("_q2")) / iqr, F.lit(-40.0)), F.lit(40.0))
    score = F.when(x.isNull(), F.lit(None).cast("double")).when(
        iqr.isNull() | (iqr == 0), F.lit(0.0)).otherwise(clip01(1.0 / (1.0 + F.exp(-z))))
    return j.withColumn(out, score).drop("_q1", "_q2", "_q3")


# --- PRO-1 textual evidence ----------------------------------------------------------
def textual_facts(text: Column, original: Column | None = None) -> dict[str, Column]:
    """What PRO-1 needs of a text and of the original text, row by row."""
    t = F.coalesce(text, F.lit(""))
    had = F.lit(None).cast("string") if original is None else original.cast("string")
    return {
        "word_count": tx.word_count(t), "character_count": tx.char_count(t), "hashtag_count": tx.hashtag_count(t),
        "mention_count": tx.mention_count(t), "emoji_count": tx.emoji_count(t), "punctuation_count": tx.punctuation_count(t),
        "is_hashtag_only": tx.only_pattern(t, tx.HASHTAG), "is_mention_only": tx.only_pattern(t, tx.MENTION),
        "prior_url_evidence_available": had.isNotNull(),
        "had_url_before_cleaning": F.when(had.isNotNull(), had.rlike(tx.URL_PATTERN))}


def textual_risks(df: DataFrame, rows: str | None = None) -> DataFrame:
    """The ratios, ranks and risks of PRO-1 over ``textual_facts``, which
    ``df`` holds as columns (``rows``: how many rows a row stands for)."""
    wc = F.col("word_count")
    df = df.withColumns({
        "hashtag_ratio": tx.safe_divide(F.col("hashtag_count"), wc),
        "mention_ratio": tx.safe_divide(F.col("mention_count"), wc),
        "emoji_ratio": tx.safe_divide(F.col("emoji_count"), wc),
        "is_extremely_short": wc <= 3, "text_sparsity_risk": clip01(1.0 - wc / 12.0),
        "prior_url_evidence_risk": F.lit(None).cast("double")})
    ranked = rk.percentile_ranks(df, {"hashtag_ratio": "hashtag_dominance_risk",
                                      "mention_ratio": "mention_dominance_risk",
                                      "emoji_ratio": "emoji_dominance_risk"}, rows=rows)
    return ranked.withColumn("textual_evidence_risk", available_mean(
        [F.col(c) for c in ("text_sparsity_risk", "hashtag_dominance_risk", "mention_dominance_risk",
                            "emoji_dominance_risk")]))


def textual_evidence(df: DataFrame, text_col: str, original_col: str | None = None) -> DataFrame:
    """PRO-1. All evidence is a function of the text (and of the original
    text), so it is found once per distinct text, kept under the text's
    digest, ranked there (each digest counting its rows) and joined back;
    rows of a very common text go by broadcast."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    original = F.col(original_col).cast("string") if original_col else F.lit(None).cast("string")
    keys = {"_dt": _digest(text), "_do": _digest(original)}
    out = df.select(*[c.alias(k) for k, c in keys.items()], text.alias("_text"), original.alias("_original"))
    facts = textual_facts(F.col("_text"), F.col("_original"))
    out = out.select(*keys, *[c.alias(k) for k, c in facts.items()])
    per_text = cut_lineage(out.groupBy(*keys).agg(F.first(F.struct(*facts)).alias("_e"), F.count(F.lit(1)).alias("_rows"))
                           .select(*keys, "_rows", "_e.*"))
    return join_back(df, cut_lineage(textual_risks(per_text, "_rows")), keys, "_rows")


def _digest(text: Column) -> Column:
    """SHA-256 as 32 bytes (NULL of NULL)."""
    return F.unhex(F.sha2(text, 256))


# --- PRO-5 duplicate amplification --------------------------------------------------
def _repetition_risk_by_count(groups: DataFrame, count_col: str, rows_col: str, out: str) -> DataFrame:
    """WIN-3 on group-level frames: the row-level distribution of a count is
    (value k, k-row groups summed), so ranks come from the distinct count
    values, never from a pass over the rows. Count 1 -> 0."""
    dist = groups.where(F.col(count_col) > 1).groupBy(count_col).agg(F.sum(rows_col).alias("_w"))
    risk = rk.small_weighted_rank(dist, count_col, "_w", out)
    return (groups.join(risk, count_col, "left")
            .withColumn(out, F.when(F.col(count_col).isNull(), F.lit(None).cast("double"))
                        .otherwise(F.coalesce(F.col(out), F.lit(0.0)))))


def duplicate_digests(text: Column, signature_length: int | None = None) -> dict[str, Column]:
    """Digests of a text, of its normal form and of its near signature."""
    t = F.coalesce(text, F.lit(""))
    return {"_hx": _digest(t), "_hn": _digest(tx.duplicate_normal_form(t)),
            "near_duplicate_cluster_id": F.sha2(tx.near_signature(t, signature_length), 256)}


def duplicate_amplification(df: DataFrame, text_col: str, user_col: str, *,
                            signature_length: int | None = None, exact_removed: int = 0) -> DataFrame:
    """``digested_amplification`` of a frame that holds the texts."""
    return digested_amplification(df, duplicate_digests(F.col(text_col), signature_length), user_col,
                                  exact_removed=exact_removed)


def digested_amplification(df: DataFrame, digests: dict[str, Column], user_col: str, *,
                           exact_removed: int = 0) -> DataFrame:
    """Exact / normalised / near-signature / cross-user repetition counts and
    the mean of their repetition risks.

    The normal form and the signature are functions of the text, so one row
    per (text digest, user) with its count is all that is kept: the three
    groupings and their ranks are found there, put together per distinct text,
    and joined back to the rows once, on the text's digest (a text with many
    copies by broadcast). Texts themselves are never shuffled for the counts.
    ``digests`` are the columns of ``duplicate_digests``."""
    seen = stored(df.select(
        *[c.alias(k) for k, c in digests.items()],
        F.coalesce(F.col(user_col).cast("string"), F.lit("__MISSING_USER_ID__")).alias("_u"))
        .groupBy("_hx", "_hn", "near_duplicate_cluster_id", "_u").agg(F.count(F.lit(1)).alias("_n")))
    exact, normal, near, users = ("post_clean_exact_duplicate_count", "normalized_repetition_count",
                                  "near_duplicate_cluster_size", "cross_user_repetition_count")
    texts = seen.groupBy("_hx", "_hn", "near_duplicate_cluster_id").agg(F.sum("_n").alias(exact))
    texts = stored(_repetition_risk_by_count(texts, exact, exact, "_r1"))
    by_normal = seen.groupBy("_hn", "_u").agg(F.sum("_n").alias("_n")).groupBy("_hn").agg(
        F.sum("_n").alias(normal), F.count(F.lit(1)).alias(users))
    by_normal = _repetition_risk_by_count(by_normal, normal, normal, "_r2")
    by_normal = _repetition_risk_by_count(by_normal, users, normal, "_r4")
    by_near = seen.groupBy("near_duplicate_cluster_id").agg(F.sum("_n").alias(near))
    by_near = _repetition_risk_by_count(by_near, near, near, "_r3")
    for key, part in (("_hn", by_normal), ("near_duplicate_cluster_id", by_near)):
        held = texts.groupBy(F.col(key).alias("_hk")).agg(F.count(F.lit(1)).alias("_texts"))
        part = stored(part.join(held, F.col(key) == F.col("_hk")).drop("_hk"))
        texts = join_back(texts, part, {key: key}, "_texts")
    texts = stored(texts.withColumn("_rows", F.col(exact)).withColumn(
        "duplicate_amplification_risk", available_mean([F.col(c) for c in ("_r1", "_r2", "_r3", "_r4")]))
        .drop("_r1", "_r2", "_r3", "_r4", "_hn"))
    out = join_back(df, texts, {"_hx": digests["_hx"]}, "_rows")
    return out.withColumns({"phase2_exact_duplicates_removed": F.lit(int(exact_removed)),
                            "near_duplicate_evidence_type": F.lit("same signature: lexical evidence only")})


# --- PRO-3 / PRO-3c sarcasm ---------------------------------------------------------------
# Sarcasm marker phrases and cue patterns.
SARCASM_MARKERS = ["yeah right", "sure jan", "totally", "as always", "great job", "nice job", "lol", "lmao", "smh"]
QUOTED_POSITIVE = r'(?i)["“”](?:great|genius|leader|honest)["“”]'
CONTRAST_WORDS = ["but", "however", "yeah right"]
EYE_ROLL = "\U0001F644"


def _words_re(words) -> str:
    initials = "".join(sorted({w[0] for w in words}))   # tried first: few places pass
    return rf"(?i)(?=[{initials}]){tx.NB}(?:{'|'.join(w.replace(' ', r'\ ') for w in words)}){tx.NA}"


def sarcasm_proxy(df: DataFrame, text_col: str) -> DataFrame:
    """PRO-3: mean of four binary cues (marker, eye-roll, quoted positive
    word, contrast word)."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    marker = F.regexp_count(t, F.lit(_words_re(SARCASM_MARKERS))).cast("long")
    cues = [(marker > 0).cast("double"), t.contains(EYE_ROLL).cast("double"),
            t.rlike(QUOTED_POSITIVE).cast("double"), t.rlike(_words_re(CONTRAST_WORDS)).cast("double")]
    ind = clip01(sum(cues, F.lit(0.0)) / 4.0)
    return df.withColumns({"sarcasm_marker_count": marker, "rule_based_sarcasm_indicator": ind,
                           "sarcasm_evidence_available": F.lit(True), "sarcasm_irony_risk": ind,
                           "sarcasm_proxy_note": F.lit("cue-based estimate, unverified")})


_S = tx.SPACE
# Pattern set of the v2 sarcasm score.
SARCASM_V2 = (rf"(?i)(oh[{_S}]+sure|oh[{_S}]+great|oh[{_S}]+brilliant|totally|absolutely|definitely|"
              rf"of[{_S}]+course|yeah[{_S}]+right|right\.\.\.|sure\.\.\.|wow[,{_S}]+so|"
              rf"thanks[{_S}]+for[{_S}]+nothing|what[{_S}]+a[{_S}]+(great|brilliant|wonderful|fantastic)|"
              rf"just[{_S}]+(love|wonderful|great)|\.\.\.|{tx.NB}lol{tx.NA}|{tx.NB}lmao{tx.NA})")
REPEAT_PUNCT = r"\.{2,}|!{2,}|\?{2,}"
POS_THEN_NEG = (rf"(?i){tx.NB}(great|wonderful|brilliant|fantastic|amazing){tx.NA}.{{0,30}}"
                rf"{tx.NB}(but|however|except|not){tx.NA}")


def sarcasm_score_v2(c) -> Column:
    """PRO-3c: min(0.15*matches, 0.45) + min(0.3*caps_share, 0.30)
    + 0.15 repeated punctuation + 0.25 positive-then-contrast; cap 1,
    rounded to 4 places; blank -> 0."""
    t = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    s = (F.least(F.regexp_count(t, F.lit(SARCASM_V2)) * 0.15, F.lit(0.45))
         + F.least(F.coalesce(tx.upper_word_share(t), F.lit(0.0)) * 0.3, F.lit(0.30))
         + F.when(t.rlike(REPEAT_PUNCT), 0.15).otherwise(0.0)
         + F.when(t.rlike(POS_THEN_NEG), 0.25).otherwise(0.0))
    return F.when(tx.token_count(t) == 0, F.lit(0.0)).otherwise(F.round(F.least(s, F.lit(1.0)), 4))


# --- PRO-2 sentiment ambiguity, PRO-8 model suitability ------------------------------
PROBS = ("roberta_negative_probability", "roberta_neutral_probability", "roberta_positive_probability")


def sentiment_ambiguity(df: DataFrame, compound: str = "vader_compound", probs: Sequence[str] = PROBS) -> DataFrame:
    c = F.col(compound).try_cast("double") if compound in df.columns else F.lit(None).cast("double")
    out = df.withColumns({"vader_ambiguity_available": c.isNotNull(),
                          "vader_ambiguity_risk": clip01(1.0 - F.abs(c))})
    out = out.withColumn("sentiment_ambiguity_risk", F.col("vader_ambiguity_risk"))
    if all(p in df.columns for p in probs):
        ps = [F.col(p).try_cast("double") for p in probs]
        avail = F.lit(True)
        for p in ps:
            avail = avail & p.isNotNull()
        return out.withColumns({
            "roberta_entropy_risk": F.when(avail, clip01(normalised_entropy(ps))),
            "roberta_margin_ambiguity_risk": F.when(avail, clip01(1.0 - top_two_margin(ps)))})
    return out.withColumns({"roberta_entropy_risk": F.lit(None).cast("double"),
                            "roberta_margin_ambiguity_risk": F.lit(None).cast("double")})


def model_suitability(df: DataFrame, lang: str = "detected_language", compound: str = "vader_compound",
                      score: str = "roberta_score", probs: Sequence[str] = PROBS) -> DataFrame:
    l = F.col(lang).cast("string") if lang in df.columns else F.lit(None).cast("string")
    have_p = all(p in df.columns for p in probs)
    ps = [F.col(p).try_cast("double") for p in probs] if have_p else []
    avail = F.lit(False)
    if have_p:
        avail = F.lit(True)
        for p in ps:
            avail = avail & p.isNotNull()
    dis = (clip01(F.abs(F.col(compound).try_cast("double") - F.col(score).try_cast("double")) / 2.0)
           if compound in df.columns and score in df.columns else F.lit(None).cast("double"))
    unc = clip01(1.0 - F.greatest(*ps)) if have_p else F.lit(None).cast("double")
    out = df.withColumns({
        "language_diagnostic_available": l.isNotNull(),
        "language_model_suitability_risk": F.when(l.isNotNull(), (F.lower(l) != "en").cast("double")),
        "roberta_diagnostic_available": avail,
        "baseline_roberta_diagnostic_available": F.lit(False),
        "model_disagreement_risk": F.when(avail, dis),
        "roberta_model_uncertainty_risk": F.when(avail, unc)})
    return out.withColumn("model_suitability_risk", F.when(avail, available_mean(
        [F.col("model_disagreement_risk"), F.col("roberta_model_uncertainty_risk")])))


# --- PRO-6 spatial validity ---------------------------------------------------------------
def spatial_validity(df: DataFrame, location_col: str) -> DataFrame:
    if location_col not in df.columns:
        return df.withColumns({"location_availability": F.lit("unavailable_column"),
                               "location_mapping_available": F.lit(False),
                               "spatial_validity_risk": F.lit(None).cast("double")})
    raw = F.col(location_col).cast("string")
    stripped = F.trim(raw)
    missing = raw.isNull() | (stripped == "")
    # costly matches as columns of their own, found once a row
    df = df.withColumns({"_states": geo.extract_states(stripped), "_national": geo.is_national(stripped),
                         "_fictional": geo.is_fictional(stripped), "_non_us": geo.mentions_non_us(stripped)})
    states, national, fictional = F.col("_states"), F.col("_national"), F.col("_fictional")
    n = F.size(states)
    non_us = F.col("_non_us") & (n == 0)
    one, multi = n == 1, n > 1
    ambiguous = ~missing & ~national & ~fictional & ~non_us & ~one
    conf = (F.when(ambiguous | fictional | non_us, 0.0).when(national, 0.0).when(multi, 0.25)
            .when(one, 1.0).otherwise(F.lit(None).cast("double")))
    return df.withColumns({
        "location_availability": F.when(missing, F.lit("missing")).otherwise(F.lit("available")),
        "location_mapping_available": ~missing,
        "matched_state": F.when(n > 0, F.array_join(states, ";")),
        "state_mapping_confidence": conf,
        "national_only_location": national, "ambiguous_location": ambiguous | multi,
        "non_us_location": non_us, "missing_location": missing, "fictional_location": fictional,
        "state_analysis_available": one, "national_temporal_analysis_available": F.lit(True),
        "spatial_validity_risk": F.when(~missing, 1.0 - conf)}).drop("_states", "_national", "_fictional", "_non_us")


# --- PRO-7 temporal coverage ---------------------------------------------------------------
def temporal_coverage(df: DataFrame, ts_col: str, events: DataFrame, *, event_window_hours: float = 24,
                      risk_horizon_hours: float = 48) -> tuple[DataFrame, DataFrame]:
    """Per-row hour, nearest-event distance, window flag, volume-spike risk
    (percentile rank of the hour's volume over the dense spine, WIN-4) and
    event-concentration risk; plus the per-hour diagnostics frame."""
    diag = rk.percentile_rank(hour_spine_counts(df, ts_col), "tweet_volume", "volume_spike_risk")
    ts = F.col(ts_col)
    out = nearest_event_hours(df, ts_col, events).withColumn("tweet_hour", F.date_trunc("hour", ts))
    d = F.col("time_to_nearest_event_hours")
    out = out.join(diag.select(F.col("hour").alias("tweet_hour"), F.col("volume_spike_risk")), "tweet_hour", "left")
    out = out.withColumns({
        "temporal_diagnostic_available": ts.isNotNull(),
        "event_window_flag": F.when(ts.isNotNull(), d <= event_window_hours),
        "volume_spike_risk": F.when(ts.isNotNull(), F.col("volume_spike_risk")),
        "event_concentration_risk": F.when(d.isNotNull(), clip01(1.0 - d / risk_horizon_hours))})
    out = out.withColumn("temporal_coverage_risk", F.when(ts.isNotNull(), available_mean(
        [F.col("volume_spike_risk"), F.col("event_concentration_risk")])))
    return out, diag


# --- PRO-4 user representativeness -------------------------------------------------------
def user_representativeness(df: DataFrame, metrics: DataFrame, choice: DataFrame, *, user_col: str = "user_id",
                            metric: str = "tweets_per_active_day") -> DataFrame:
    """Activity and contribution percentile ranks over the audited users,
    their mean, and the retained-by-threshold flag; joined many-to-one."""
    m = rk.percentile_rank(metrics, metric, "user_activity_percentile")
    m = rk.percentile_rank(m, "total_tweets", "user_contribution_percentile")
    m = m.withColumn("user_representativeness_risk", available_mean(
        [F.col("user_activity_percentile"), F.col("user_contribution_percentile")]))
    m = with_scalars(m, choice.select("selected_threshold"))
    m = m.withColumn("retained_by_approved_activity_threshold", F.col(metric) <= F.col("selected_threshold"))
    keep = [user_col, "total_tweets", "active_days", metric, "user_activity_percentile",
            "user_contribution_percentile", "user_representativeness_risk",
            "retained_by_approved_activity_threshold", "selected_threshold"]
    m = m.select(*keep).withColumnRenamed(user_col, "_uid")
    out = df.join(m, F.col(user_col).cast("string") == F.col("_uid"), "left").drop("_uid")
    return (out.withColumn("user_audit_available", F.col(metric).isNotNull())
            .withColumnRenamed("selected_threshold", "approved_activity_threshold")
            .withColumn("activity_threshold_provenance", F.lit("pre-filter user audit")))
