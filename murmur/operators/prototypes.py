"""Prototype profilers kept as options (PRO-2b/3b/6b/8b, MAP-1).

The production profilers (murmur.operators.profilers) superseded these;
they remain available because analyses compare the two generations. Note
the prototype convention of filling missing evidence with 0 (``_f``),
which the production profilers deliberately do not do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.classify import STATE_CODES, STATE_NAMES
from murmur.functions.text import NA, NB, word_count
from murmur.operators import rank as rk
from murmur.operators.profilers import available_mean, clip01, normalised_entropy, top_two_margin


def _w(words) -> str:
    return rf"(?i){NB}(?:{'|'.join(w.replace(' ', r'\ ') for w in words)}){NA}"


def _has(t: Column, words) -> Column:
    return t.rlike(_w(words))


def _count(t: Column, words) -> Column:
    return F.regexp_count(t, F.lit(_w(words))).cast("long")


def _f(b: Column) -> Column:
    """bool -> float with NULL as 0 (prototype convention)."""
    return F.coalesce(b, F.lit(False)).cast("double")


# Prototype marker word lists.
CONTRAST = ["but", "however", "although", "though", "yet", "still", "despite", "whereas"]
UNCERTAIN = ["maybe", "perhaps", "apparently", "seems", "seem", "unclear", "not sure", "could", "might", "possibly"]
NEGATE = ["no", "not", "never", "none", "nothing", "neither", "nor", "cannot", "can't", "don't", "doesn't",
          "didn't", "isn't", "wasn't"]
TARGET_A = ["trump", "donald", "maga", "potus"]
TARGET_B = ["biden", "joe", "kamala", "harris"]
SARC_KEYWORDS = ["yeah right", "sure", "totally", "as always", "great job", "nice job", "brilliant move", "what a guy",
                 "lol", "lmao", "lmfao", "haha", "ha ha", "smh"]
IRONY = ["lol", "lmao", "lmfao", "haha", "ha ha", "sure jan", "yeah right", "smh"]
POS_WORDS = ["great", "wonderful", "amazing", "brilliant", "perfect", "love", "best", "excellent", "thanks", "awesome",
             "presidential"]
NEG_CONTEXT = ["ruin", "ruining", "liar", "lies", "corrupt", "nightmare", "disaster", "idiot", "stupid", "racist",
               "fraud", "loser", "kill", "killing", "hate", "worst", "clown", "evil", "sucks"]
NEG_WORDS = ["bad", "terrible", "awful", "horrible", "worst", "sick", "dead", "crying", "tears"]
POS_CONTEXT = ["love", "great", "best", "win", "winning", "happy", "proud", "celebrating"]
QUOTED = r'["“”](great|winner|patriot|genius|leader|presidential|honest)["“”]'
FICTIONAL = ["earth", "moon", "mars", "universe", "worldwide", "internet", "somewhere", "nowhere", "hell", "heaven",
             "maga country", "kag country", "home"]
COUNTRY_ONLY = r"(?i)^(usa|u\.s\.a\.?|us|u\.s\.?|united states|america|united states of america)$"


def polarity(label: Column) -> Column:
    """MAP-1: label -> -1 / 0 / 1 (NULL for anything else)."""
    return (F.when(label == "negative", -1).when(label == "neutral", 0).when(label == "positive", 1))


def polarity_conflict(a: Column, b: Column) -> Column:
    """MAP-1: opposite polarities (product = -1)."""
    return polarity(a) * polarity(b) == -1


def ambiguity_v0(df: DataFrame, text_col: str) -> DataFrame:
    """PRO-2b: contrast / uncertainty / negation / dual-target / short-phrase
    cues, question intensity rank, and the mean with lexicon/model terms."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    low = F.lower(t)
    ta, tb = F.regexp_count(low, F.lit(_w(TARGET_A))), F.regexp_count(low, F.lit(_w(TARGET_B)))
    q = F.regexp_count(t, F.lit(r"\?")).cast("long")
    targets = (ta > 0).cast("int") + (tb > 0).cast("int")
    out = df.withColumns({
        "question_mark_count": q, "exclamation_count": F.regexp_count(t, F.lit("!")).cast("long"),
        "quote_count": F.regexp_count(t, F.lit("[\"'“”‘’]")).cast("long"),
        "contains_contrast_marker": _has(t, CONTRAST), "contains_uncertainty_marker": _has(t, UNCERTAIN),
        "contains_negation": _has(t, NEGATE), "target_candidate_count": targets,
        "candidate_mention_balance": ((ta > 0) & (tb > 0)).cast("double"),
        "short_ambiguous_phrase_flag": (word_count(t) <= 5) & ((q > 0) | (targets > 0))})
    proxies = ["contains_contrast_marker", "contains_uncertainty_marker", "contains_negation",
               "candidate_mention_balance", "short_ambiguous_phrase_flag"]
    out = out.withColumns({f"{c}_risk": _f(F.col(c).cast("boolean")) for c in proxies})
    out = rk.percentile_rank(out, "question_mark_count", "question_intensity_risk")
    out = out.withColumn("text_proxy_ambiguity_risk", available_mean(
        [F.col(f"{c}_risk") for c in proxies] + [F.col("question_intensity_risk")]))
    parts = [F.col("text_proxy_ambiguity_risk")]
    if "vader_compound" in df.columns:
        out = out.withColumn("vader_uncertainty_risk", clip01(1.0 - F.abs("vader_compound")))
        parts.append(F.col("vader_uncertainty_risk"))
    if "vader_neutral" in df.columns:
        out = out.withColumn("neutral_dominance_risk", clip01(F.col("vader_neutral")))
        parts.append(F.col("neutral_dominance_risk"))
    probs = ["roberta_negative_probability", "roberta_neutral_probability", "roberta_positive_probability"]
    if all(p in df.columns for p in probs):
        ps = [F.col(p).try_cast("double") for p in probs]
        ok = ps[0].isNotNull() & ps[1].isNotNull() & ps[2].isNotNull()
        out = out.withColumns({"roberta_entropy": F.when(ok, clip01(normalised_entropy(ps))),
                               "model_uncertainty_risk": F.when(ok, clip01(1.0 - top_two_margin(ps)))})
        parts += [F.col("roberta_entropy"), F.col("model_uncertainty_risk")]
    return out.withColumn("sentiment_ambiguity_risk", available_mean(parts))


def sarcasm_v0(df: DataFrame, text_col: str) -> DataFrame:
    """PRO-3b: eight rule components (capped counts, flags, ranks of
    ellipsis and contrast counts) plus the label-conflict component."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    out = df.withColumns({
        "sarcasm_keyword_count": _count(t, SARC_KEYWORDS), "irony_marker_count": _count(t, IRONY),
        "eye_roll_emoji_flag": t.contains("\U0001F644"),
        "positive_word_negative_context_flag": _has(t, POS_WORDS) & _has(t, NEG_CONTEXT),
        "negative_word_positive_context_flag": _has(t, NEG_WORDS) & _has(t, POS_CONTEXT),
        "quotation_around_sentiment_word_flag": t.rlike("(?i)" + QUOTED),
        "ellipsis_count": F.regexp_count(t, F.lit(r"\.\.\.|…")).cast("long"),
        "contrast_marker_count": _count(t, CONTRAST)})
    out = rk.percentile_ranks(out, {"ellipsis_count": "_r_ell", "contrast_marker_count": "_r_con"})
    comps = [F.least(F.col("sarcasm_keyword_count") / 2.0, F.lit(1.0)),
             F.least(F.col("irony_marker_count") / 2.0, F.lit(1.0)),
             _f(F.col("eye_roll_emoji_flag")), _f(F.col("positive_word_negative_context_flag")),
             _f(F.col("negative_word_positive_context_flag")), _f(F.col("quotation_around_sentiment_word_flag")),
             F.coalesce(F.col("_r_ell"), F.lit(0.0)), F.coalesce(F.col("_r_con"), F.lit(0.0))]
    out = out.withColumn("rule_based_sarcasm_risk", clip01(sum(comps, F.lit(0.0)) / len(comps))).drop("_r_ell", "_r_con")
    parts = [F.col("rule_based_sarcasm_risk")]
    if "vader_label" in df.columns and "roberta_label" in df.columns:
        conflict = polarity_conflict(F.col("vader_label"), F.col("roberta_label"))
        out = out.withColumns({"vader_roberta_polarity_conflict": F.coalesce(conflict, F.lit(False)),
                               "model_conflict_sarcasm_risk": _f(conflict)})
        parts.append(F.col("model_conflict_sarcasm_risk"))
    return out.withColumn("sarcasm_irony_risk", available_mean(parts))


def location_ladder(df: DataFrame, location_col: str | None) -> DataFrame:
    """PRO-6b: confidence ladder 0 (missing) / .05 (fictional) / .90 (one
    state with a code token) / .80 (one state) / .55 (several) / .35
    (country only) / .25 (other). Code tokens need a separator on both
    sides and consume it, as a left-to-right scan does."""
    if location_col is None:
        return df.withColumns({"user_loc_missing_flag": F.lit(True), "matched_state": F.lit(""),
                               "matched_state_confidence": F.lit(0.0), "spatial_validity_risk": F.lit(1.0)})
    loc = F.trim(F.coalesce(F.col(location_col).cast("string"), F.lit("")))
    sep = r"[\s,;/|()\-]"
    abbr = rf"(^|{sep})({'|'.join(STATE_CODES)})($|{sep})"
    codes = F.regexp_extract_all(F.upper(loc), F.lit(abbr), 2)
    names_re = rf"(?=({NB}(?:{'|'.join(n.replace(' ', r'\ ') for n, _ in STATE_NAMES)}){NA}))"
    n2c = F.create_map(*[x for n, c in STATE_NAMES for x in (F.lit(n), F.lit(c))])
    by_name = F.transform(F.regexp_extract_all(F.lower(loc), F.lit(names_re), 1), lambda n: F.element_at(n2c, n))
    states = F.array_sort(F.array_distinct(F.concat(codes, by_name)))
    n = F.size(states)
    missing = loc == ""
    fictional = _has(loc, FICTIONAL)
    abbr_hit = F.upper(loc).rlike(abbr)
    country = loc.rlike(COUNTRY_ONLY)
    conf = (F.when(missing, 0.0).when(fictional, 0.05).when((n == 1) & abbr_hit, 0.90).when(n == 1, 0.80)
            .when(n > 1, 0.55).when(country, 0.35).otherwise(0.25))
    return df.withColumns({
        "user_loc_missing_flag": missing, "matched_state": F.array_join(states, ";"),
        "location_parse_success": n > 0, "state_abbreviation_match_flag": abbr_hit, "country_only_flag": country,
        "fictional_location_flag": fictional, "ambiguous_city_flag": n > 1,
        "location_confidence_score": conf, "matched_state_confidence": conf,
        "location_missing_risk": missing.cast("double"), "location_ambiguity_risk": (n > 1).cast("double"),
        "spatial_validity_risk": 1.0 - conf})


def disagreement_v0(df: DataFrame) -> DataFrame:
    """PRO-8b: label disagreement 0 (same) / 0.5 (differs, not opposite) /
    1 (opposite polarity), plus confidence and entropy terms."""
    out = df
    parts = []
    probs = ["roberta_negative_probability", "roberta_neutral_probability", "roberta_positive_probability"]
    if all(p in df.columns for p in probs):
        ps = [F.col(p).try_cast("double") for p in probs]
        ok = ps[0].isNotNull() & ps[1].isNotNull() & ps[2].isNotNull()
        out = out.withColumns({"roberta_max_probability": F.when(ok, F.greatest(*ps)),
                               "roberta_entropy": F.when(ok, clip01(normalised_entropy(ps)))})
        out = out.withColumn("model_confidence_risk", clip01(1.0 - F.col("roberta_max_probability")))
        parts += [F.col("model_confidence_risk"), F.col("roberta_entropy")]
    if "vader_label" in df.columns and "roberta_label" in df.columns:
        va, rb = polarity(F.col("vader_label")), polarity(F.col("roberta_label"))
        valid = va.isNotNull() & rb.isNotNull()
        out = out.withColumn("model_disagreement_risk", F.when(valid, F.when(va == rb, 0.0)
                                                                .when(va * rb == -1, 1.0).otherwise(0.5)))
        parts.append(F.col("model_disagreement_risk"))
    if "vader_compound" in df.columns and "roberta_score" in df.columns:
        out = out.withColumn("absolute_vader_roberta_difference",
                             clip01(F.abs(F.col("vader_compound") - F.col("roberta_score")) / 2.0))
        parts.append(F.col("absolute_vader_roberta_difference"))
    return out.withColumn("model_suitability_risk", available_mean(parts) if parts else F.lit(None).cast("double"))
