"""Remaining operator queries: annotation batches, representative cases,
model-comparison statistics, prototypes, telemetry, joins and sources."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from murmur.functions import text as tx
from murmur.operators import activity as act
from murmur.operators import annotate as an
from murmur.operators import cleaning as cl
from murmur.operators import dedupe as dd
from murmur.operators import profilers as pf
from murmur.operators import prototypes as pt
from murmur.operators import quality as qa
from murmur.operators import rank as rk
from murmur.operators import sampling as smp
from murmur.operators import schema as sc
from murmur.operators import sentiment as se
from murmur.operators import stats as st
from murmur.operators import summaries as su
from murmur.plans import bindings as b
from murmur.plans.q_geo import RESOLVED_SQL, resolved
from murmur.plans.q_models import RATERS_SQL, _band, _matrix, _raters, lexicon
from murmur.plans.q_spatial import _matrix_sql, exact
from murmur.plans.q_text import sql_clean
from murmur.plans.q_users import CHOICE_SQL
from murmur.plans.registry import query, rounded
from murmur.sources.readers import file_lineage, read_parquet
from murmur.sources.tables import table


def _conv_scored(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    # (conversation, turn) as text of fixed width: in order, and never two alike
    row = F.concat_ws(":", F.lpad(F.col("conv_id").cast("string"), 19, "0"), F.lpad(F.col("turn").cast("string"), 10, "0"))
    return se.model_scores(c.withColumn("row_id", row), "text", se.char_profile_predictor)


@query("ann_03_seed_pick")
def ann_03_seed_pick(spark, sf):
    """ANN-3: one high / one low positive-probability turn per role x label,
    then 15 by sample key."""
    s = _conv_scored(spark, sf)
    return rounded(an.seed_pick(s, id_col="row_id", cells=["role", "roberta_label"],
                                score="roberta_positive_probability").drop("text"))


@query("ann_01_prompt_batches")
def ann_01_prompt_batches(spark, sf):
    """ANN-1 (+JSN-1): prompts of 20 user turns with the picked seeds as
    JSON examples."""
    s = _conv_scored(spark, sf)
    seeds = an.seed_pick(s, id_col="row_id", cells=["role", "roberta_label"], score="roberta_positive_probability")
    turns = s.where(F.col("role") == "user").select("row_id", "text")
    return an.prompt_batches(turns, id_col="row_id", text_col="text", chunk_size=20, seeds=seeds,
                             seed_cols=["text", "roberta_label"])


@query("jsn_02_parse_replies", oracle="""
SELECT l.doc_id, d.text AS tweet, 'other' AS candidate_target, 'neutral' AS expressed_sentiment,
       'neutral' AS intended_sentiment, l.toxic = 1 AS sarcasm,
       CASE WHEN l.quality = 1 THEN 'favor' ELSE 'neutral' END AS stance, CAST(0.9 AS DOUBLE) AS confidence
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""")
def jsn_02_parse_replies(spark, sf):
    """JSN-2 / ANN-2: fenced JSON replies built from the labelled documents
    (JSN-1) and parsed back with defaults."""
    lab = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    arr = F.array(F.struct(F.col("text").alias("tweet"),
                           (F.col("toxic") == 1).alias("sarcasm"),
                           F.when(F.col("quality") == 1, "favor").alias("stance")))
    replies = lab.select("doc_id", F.concat(F.lit("```json\n"), F.to_json(arr), F.lit("\n```")).alias("reply"))
    return an.parse_replies(replies, "reply", keep=["doc_id"])


@query("top_01_largest_differences", oracle=f"""
SELECT doc_id, lang, round(a_score, 6) AS a_score, round(b_score, 6) AS b_score,
       round(abs(a_score - b_score), 6) AS absolute_score_difference
FROM ({RATERS_SQL}) ORDER BY abs(a_score - b_score) DESC, doc_id LIMIT 50""")
def top_01_largest_differences(spark, sf):
    r = _raters(spark, sf).select("doc_id", "lang", "a_score", "b_score")
    return rounded(an.top_by_abs_difference(r, "a_score", "b_score", "doc_id", 50))


def _cases_sql():
    cases = [("strongest_a_negative", "true", "a_score"),
             ("a_neutral", "a_label = 'neutral'", "abs(a_score)"),
             ("strongest_a_positive", "true", "-a_score"),
             ("caps_and_repeated_punctuation", "regexp_matches(text, '[A-Z]{4,}.*[!?]{2,}|[!?]{2,}.*[A-Z]{4,}')",
              "doc_id"),
             ("non_ascii", "regexp_matches(text, '[^\\x00-\\x7F]')", "doc_id"),
             ("largest_disagreement", "a_label <> b_label", "-abs(a_score - b_score)")]
    ctes = [f"r AS (SELECT x.*, {_band('a_score')} AS a_label, {_band('b_score')} AS b_label, d.text "
            f"FROM ({RATERS_SQL}) x JOIN documents d USING (doc_id))"]
    picks = []
    for i, (name, where, order) in enumerate(cases):
        used = " AND ".join(f"doc_id <> (SELECT doc_id FROM p{j})" for j in range(i)) or "true"
        ctes.append(f"p{i} AS (SELECT '{name}' AS \"case\", * FROM r WHERE ({where}) AND {used} "
                    f"ORDER BY {order}, doc_id LIMIT 1)")
        picks.append(f"SELECT * FROM p{i}")
    body = " UNION ALL ".join(picks)
    return (f"WITH {', '.join(ctes)} SELECT \"case\", doc_id, lang, round(a_score, 6) AS a_score, "
            f"round(b_score, 6) AS b_score, a_label, b_label FROM ({body})")


@query("top_04_representative_cases", oracle=_cases_sql())
def top_04_representative_cases(spark, sf):
    """TOP-4: six ordered cases, no row reused."""
    r = _raters(spark, sf).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    cases = [("strongest_a_negative", F.lit(True), F.col("a_score")),
             ("a_neutral", F.col("a_label") == "neutral", F.abs("a_score")),
             ("strongest_a_positive", F.lit(True), -F.col("a_score")),
             ("caps_and_repeated_punctuation", F.col("text").rlike(r"[A-Z]{4,}.*[!?]{2,}|[!?]{2,}.*[A-Z]{4,}"),
              F.col("doc_id")),
             ("non_ascii", F.col("text").rlike(r"[^\x00-\x7F]"), F.col("doc_id")),
             ("largest_disagreement", F.col("a_label") != F.col("b_label"), -F.abs(F.col("a_score") - F.col("b_score")))]
    out = an.representatives(r, cases, "doc_id")
    return rounded(out.drop("text"))


@query("sta_10_labels_when_a_zero", oracle=f"""
WITH r AS (SELECT *, {_band('b_score')} AS b_label FROM ({RATERS_SQL}))
SELECT b_label, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM r), 6) AS share_of_all
FROM r WHERE a_score = 0 GROUP BY b_label""")
def sta_10_labels_when_a_zero(spark, sf):
    """STA-10: b's label distribution where a's score is exactly 0."""
    r = _raters(spark, sf)
    tot = r.agg(F.count(F.lit(1)).alias("_all"))
    from murmur.operators.common import with_scalars
    c = r.where(F.col("a_score") == 0).groupBy("b_label").agg(F.count(F.lit(1)).alias("n"))
    return rounded(with_scalars(c, tot).withColumn("share_of_all", F.col("n") / F.col("_all")).drop("_all"))


@query("sta_11_heuristic_vs_model")
def sta_11_heuristic_vs_model(spark, sf):
    """STA-11: Pearson / Spearman between the rule-based sarcasm score and the
    model's positive probability (with p-values)."""
    s = _conv_scored(spark, sf).withColumn("heuristic", pf.sarcasm_score_v2("text"))
    s = s.withColumns({"a_label": se.label_bands(F.col("heuristic")),
                       "b_label": se.label_bands(F.col("roberta_positive_probability"))})
    a = st.agreement(s, a_score="heuristic", b_score="roberta_positive_probability", a_label="a_label",
                     b_label="b_label", with_p=True)
    return rounded(a.select("record_count", "pearson_r", "pearson_p_value", "spearman_rho", "spearman_p_value"))


def _residuals_sql():
    from murmur.plans.q_models import REGRESSORS, ols_sql
    m = exact(_matrix_sql("primary"))
    fitted = " + ".join(["b_const", *(f"b_{x} * {x}" for x in REGRESSORS)])
    return f"""
WITH m AS ({m}), f AS ({ols_sql('SELECT * FROM m', 'democratic_margin_pct', REGRESSORS, [])}),
r AS (SELECT state_code, democratic_margin_pct AS observed, {fitted} AS fitted FROM m, f)
SELECT state_code, round(observed, 6) AS observed, round(fitted, 6) AS fitted, round(observed - fitted, 6) AS residual,
  round((rank() OVER (ORDER BY observed - fitted) - 0.5) / count(*) OVER (), 6) AS qq_position FROM r"""


@query("sta_19_fitted_and_residuals", oracle=_residuals_sql())
def sta_19_fitted_and_residuals(spark, sf):
    """STA-19: fitted values and residuals of the national region OLS (the
    coefficients are one row, attached by broadcast), with QQ positions
    (ECDF of the residual from the rank kernel)."""
    from murmur.operators.common import with_scalars
    m = _matrix(spark, sf)
    xs = ["state_sentiment_margin_Xi", *b.CONTROLS]
    fit = st.ols_hc1(m, "democratic_margin_pct", xs)
    j = with_scalars(m, fit.select("b_const", *[f"b_{x}" for x in xs]))
    fitted = F.col("b_const") + sum((F.col(f"b_{x}") * F.col(x) for x in xs), F.lit(0.0))
    out = j.select("state_code", F.col("democratic_margin_pct").alias("observed"), fitted.alias("fitted"))
    out = out.withColumn("residual", F.col("observed") - F.col("fitted"))
    rf = rk.rank_frame(out, "residual")
    q = rf.select(F.col("_v").alias("_rv"), ((F.col("_below") + 0.5) / F.col("_n")).alias("qq_position"))
    return rounded(out.join(q, F.col("residual") == F.col("_rv"), "left").drop("_rv"))


@query("sta_20_demographic_sensitivity", oracle=f"""
WITH m AS ({exact(_matrix_sql('primary'))}) SELECT 'median_age' AS control,
  round(corr(state_sentiment_margin_Xi, median_age), 6) AS corr,
  round(regr_slope(median_age, state_sentiment_margin_Xi), 6) AS slope, count(*) AS n
FROM m WHERE a_tweet_count + b_tweet_count >= 100
UNION ALL SELECT 'median_income', round(corr(state_sentiment_margin_Xi, median_income), 6),
  round(regr_slope(median_income, state_sentiment_margin_Xi), 6), count(*) FROM m WHERE a_tweet_count + b_tweet_count >= 100""")
def sta_20_demographic_sensitivity(spark, sf):
    """STA-20: correlation and slope of controls on Xi over regions with at
    least 100 rows (FLT-10)."""
    from murmur.operators.common import safe_corr
    m = _matrix(spark, sf).where((F.col("a_tweet_count") + F.col("b_tweet_count")) >= 100)
    out = None
    for c in ("median_age", "median_income"):
        r = m.agg(F.lit(c).alias("control"), safe_corr("state_sentiment_margin_Xi", c).alias("corr"),
                  F.regr_slope(c, "state_sentiment_margin_Xi").alias("slope"), F.count(F.lit(1)).alias("n"))
        out = r if out is None else out.unionByName(r)
    return rounded(out)


def _two_class(texts):
    p = se.char_profile_predictor(texts)
    irony = p[:, 0] * 0.5 + p[:, 2] * 0.5
    return np.stack([1 - irony, irony], axis=1)


@query("sen_05_irony_scores")
def sen_05_irony_scores(spark, sf):
    """SEN-5: the batch inference path with two classes."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    out = se.model_scores(c, "text", _two_class, classes=("non_irony", "irony"), prefix="irony_")
    return rounded(out.drop("text"))


def _flags_sql():
    from murmur.plans.q_models import LEXICON_SCORES_SQL
    return f"""
WITH r AS (SELECT doc_id, {_band('a_score')} AS a_label, {_band('b_score')} AS b_label FROM ({RATERS_SQL})),
x AS ({LEXICON_SCORES_SQL})
SELECT x.*, r.a_label, r.b_label, vader_label = a_label AS agree_lexicon_a, vader_label = b_label AS agree_lexicon_b,
       a_label = b_label AS agree_a_b, a_label = vader_label AND b_label = vader_label AS agree_all
FROM x JOIN r ON r.doc_id = x.doc_id"""


@query("sen_06_agreement_flags", oracle=_flags_sql())
def sen_06_agreement_flags(spark, sf):
    """SEN-6: pairwise and three-way agreement of three label sources."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    lex = se.lexicon_scores(d, "text", lexicon(spark, sf), check_blank=False)
    r = _raters(spark, sf).select("doc_id", "a_label", "b_label")
    j = lex.join(r, "doc_id")
    out = se.agreement_flags(j, {"lexicon": "vader_label", "a": "a_label", "b": "b_label"})
    return out.drop("text")


@query("sen_07_model_placeholders", oracle="""
SELECT doc_id, CAST(NULL AS DOUBLE) AS roberta_negative_probability, CAST(NULL AS DOUBLE) AS roberta_neutral_probability,
       CAST(NULL AS DOUBLE) AS roberta_positive_probability, CAST(NULL AS DOUBLE) AS roberta_score,
       CAST(NULL AS VARCHAR) AS roberta_label, 'not_run' AS roberta_status FROM documents""")
def sen_07_model_placeholders(spark, sf):
    return se.model_placeholders(table(spark, sf, "documents").select("doc_id"))


@query("map_01_polarity_conflict", oracle=f"""
WITH r AS (SELECT *, {_band('a_score')} AS a_label, {_band('b_score')} AS b_label FROM ({RATERS_SQL}))
SELECT doc_id, (CASE a_label WHEN 'negative' THEN -1 WHEN 'neutral' THEN 0 ELSE 1 END)
             * (CASE b_label WHEN 'negative' THEN -1 WHEN 'neutral' THEN 0 ELSE 1 END) = -1 AS polarity_conflict
FROM r""")
def map_01_polarity_conflict(spark, sf):
    r = _raters(spark, sf)
    return r.select("doc_id", pt.polarity_conflict(F.col("a_label"), F.col("b_label")).alias("polarity_conflict"))


@query("pro_02b_08b_prototype_model_risks")
def pro_02b_08b_prototype_model_risks(spark, sf):
    """PRO-2b + PRO-8b prototypes over conversation turns scored by the
    lexicon and the stand-in model."""
    s = _conv_scored(spark, sf)
    s = se.lexicon_scores(s, "text", lexicon(spark, sf), check_blank=False)
    out = pt.disagreement_v0(pt.ambiguity_v0(s, "text"))
    return rounded(out.select("conv_id", "turn", "text_proxy_ambiguity_risk", "sentiment_ambiguity_risk",
                              "model_disagreement_risk", "model_suitability_risk"))


def _sarcasm_v0_sql():
    nb = "[^\\p{L}\\p{N}_]"
    dbl = f"regexp_replace(lower(t), '({nb})', '\\1\\1', 'g')"

    def cnt(words):
        alt = "|".join(w.replace(" ", "  ") for w in words)
        return f"CAST(len(regexp_extract_all({dbl}, '(?:^|{nb})({alt})(?:$|{nb})', 1)) AS BIGINT)"

    def has(words):
        return f"regexp_matches(t, '(?i)(^|{nb})({'|'.join(words)})($|{nb})')"

    def pr(x):
        return (f"CASE WHEN count(DISTINCT {x}) OVER () = 1 THEN 0.0 ELSE (rank() OVER (ORDER BY {x}) - 1 "
                f"+ (count(*) OVER (PARTITION BY {x}) + 1) / 2.0) / count({x}) OVER () END")
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations),
f AS (SELECT conv_id, turn, {cnt(pt.SARC_KEYWORDS)} AS sarcasm_keyword_count, {cnt(pt.IRONY)} AS irony_marker_count,
             contains(t, '\U0001F644') AS eye_roll_emoji_flag,
             {has(pt.POS_WORDS)} AND {has(pt.NEG_CONTEXT)} AS positive_word_negative_context_flag,
             {has(pt.NEG_WORDS)} AND {has(pt.POS_CONTEXT)} AS negative_word_positive_context_flag,
             regexp_matches(t, '(?i){pt.QUOTED}') AS quotation_around_sentiment_word_flag,
             CAST(len(regexp_extract_all(t, '\\.\\.\\.|…')) AS BIGINT) AS ellipsis_count,
             {cnt(pt.CONTRAST)} AS contrast_marker_count FROM c),
r AS (SELECT *, {pr('ellipsis_count')} AS re, {pr('contrast_marker_count')} AS rc FROM f),
g AS (SELECT *, least(greatest((least(sarcasm_keyword_count / 2.0, 1.0) + least(irony_marker_count / 2.0, 1.0)
             + eye_roll_emoji_flag::INT + positive_word_negative_context_flag::INT
             + negative_word_positive_context_flag::INT + quotation_around_sentiment_word_flag::INT
             + coalesce(re, 0) + coalesce(rc, 0)) / 8.0, 0.0), 1.0) AS rule FROM r)
SELECT conv_id, turn, sarcasm_keyword_count, irony_marker_count, eye_roll_emoji_flag,
       positive_word_negative_context_flag, negative_word_positive_context_flag,
       quotation_around_sentiment_word_flag, ellipsis_count, contrast_marker_count,
       round(rule, 6) AS rule_based_sarcasm_risk, round(rule, 6) AS sarcasm_irony_risk FROM g"""


@query("pro_03b_prototype_sarcasm", oracle=_sarcasm_v0_sql())
def pro_03b_prototype_sarcasm(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return rounded(pt.sarcasm_v0(c, "text").drop("text"))


def _ladder_sql():
    from murmur.functions.classify import STATE_CODES
    from murmur.plans.q_geo import CODE_BY_NAME, CODES, NAME_LIST, names_found_sql
    sep = r"[\s,;/|()\-]"
    abbr = f"(^|{sep})({'|'.join(STATE_CODES)})($|{sep})"
    fict = "|".join(pt.FICTIONAL)
    nb = "[^\\p{L}\\p{N}_]"
    return f"""
WITH d AS (SELECT doc_id, trim(coalesce(text, '')) AS loc FROM documents),
x AS (SELECT doc_id, loc,
        list_sort(list_distinct(list_concat(regexp_extract_all(upper(loc), '{abbr}', 2),
          list_transform({names_found_sql('loc')}, lambda n: {CODE_BY_NAME}[list_position({NAME_LIST}, n)])))) AS st,
        regexp_matches(upper(loc), '{abbr}') AS abbr_hit,
        regexp_matches(loc, '(?i)^(usa|u\\.s\\.a\\.?|us|u\\.s\\.?|united states|america|united states of america)$') AS country,
        regexp_matches(loc, '(?i)(^|{nb})({fict})($|{nb})') AS fictional FROM d),
y AS (SELECT *, len(st) AS n, loc = '' AS missing,
        CAST(CASE WHEN loc = '' THEN 0.0 WHEN fictional THEN 0.05 WHEN len(st) = 1 AND abbr_hit THEN 0.90
             WHEN len(st) = 1 THEN 0.80 WHEN len(st) > 1 THEN 0.55 WHEN country THEN 0.35 ELSE 0.25 END AS DOUBLE)
          AS conf FROM x)
SELECT doc_id, missing AS user_loc_missing_flag, array_to_string(st, ';') AS matched_state, n > 0 AS location_parse_success,
       abbr_hit AS state_abbreviation_match_flag, country AS country_only_flag, fictional AS fictional_location_flag,
       n > 1 AS ambiguous_city_flag, conf AS location_confidence_score, conf AS matched_state_confidence,
       missing::DOUBLE AS location_missing_risk, (n > 1)::DOUBLE AS location_ambiguity_risk,
       round(1.0 - conf, 6) AS spatial_validity_risk FROM y"""


@query("pro_06b_prototype_location", oracle=_ladder_sql())
def pro_06b_prototype_location(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("loc"))
    return rounded(pt.location_ladder(d, "loc").drop("loc"))


@query("agg_08_stage_telemetry", oracle=f"""
WITH d AS (SELECT doc_id, source, {sql_clean('text')} AS c FROM documents),
k AS (SELECT *, length(c) > 0 AS nonempty,
             row_number() OVER (PARTITION BY source, c ORDER BY doc_id) = 1 AS first FROM d)
SELECT 0 AS stage_order, 'non_empty_text' AS stage, count(*) AS initial, count(CASE WHEN nonempty THEN 1 END) AS final,
       count(*) - count(CASE WHEN nonempty THEN 1 END) AS dropped,
       round(100.0 * (count(*) - count(CASE WHEN nonempty THEN 1 END)) / count(*), 6) AS drop_pct FROM k
UNION ALL
SELECT 1, 'first_of_author_text', count(CASE WHEN nonempty THEN 1 END), count(CASE WHEN nonempty AND first THEN 1 END),
       count(CASE WHEN nonempty THEN 1 END) - count(CASE WHEN nonempty AND first THEN 1 END),
       round(100.0 * (count(CASE WHEN nonempty THEN 1 END) - count(CASE WHEN nonempty AND first THEN 1 END))
             / count(CASE WHEN nonempty THEN 1 END), 6) FROM k""")
def agg_08_stage_telemetry(spark, sf):
    """AGG-8 / AGG-46: the cleaning funnel as flags counted in one pass."""
    d = table(spark, sf, "documents").select("doc_id", "source", tx.clean_text("text").alias("c"))
    flagged = dd.drop_duplicates_mask(d, ["source", "c"], ["doc_id"], "first")
    return rounded(cl.stage_telemetry(flagged, {"non_empty_text": cl.nonempty("c"),
                                                "first_of_author_text": F.col("first")}))


@query("agg_42_volume_before_after", oracle=f"""
WITH m AS (SELECT coalesce(CAST(user_id AS VARCHAR), '__MISSING_USER_ID__') AS user_id,
                  count(*) / count(DISTINCT date_trunc('day', ts)) AS x FROM events GROUP BY 1),
c AS ({CHOICE_SQL}),
h AS (SELECT m.user_id FROM m, c WHERE m.x > c.selected_threshold)
SELECT date_trunc('day', e.ts) AS day, count(*) AS before,
       count(CASE WHEN CAST(e.user_id AS VARCHAR) NOT IN (SELECT user_id FROM h) THEN 1 END) AS after
FROM events e GROUP BY 1""")
def agg_42_volume_before_after(spark, sf):
    """AGG-42: per-day volume before and after the activity filter."""
    ev = b.events(spark, sf)
    m, _, _, choice = act.audit(ev, "user_id", "ts")
    from murmur.operators.common import with_scalars
    hi = with_scalars(m, choice.select("selected_threshold")).where(
        F.col(act.METRIC) > F.col("selected_threshold")).select(F.col("user_id").alias("_hu"), F.lit(True).alias("_hi"))
    j = ev.join(hi, F.col("user_id").cast("string") == F.col("_hu"), "left")
    return cl.volume_before_after(j, "ts", F.col("_hi").isNull())


@query("joi_08_semi_anti", oracle="""
SELECT (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS labelled,
       (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS unlabelled""")
def joi_08_semi_anti(spark, sf):
    """JOI-8: semi join (id in set) and anti join (id not in set)."""
    d = table(spark, sf, "documents").select("doc_id")
    lab = table(spark, sf, "labels").select("doc_id")
    a = d.join(lab, "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("labelled"))
    z = d.join(lab, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("unlabelled"))
    from murmur.operators.common import with_scalars
    return with_scalars(a, z)


@query("joi_13_two_key_join", oracle="""
WITH ud AS (SELECT user_id, date_trunc('day', ts) AS day, count(*) AS user_day_rows FROM events GROUP BY 1, 2)
SELECT e.event_id, ud.user_day_rows FROM events e LEFT JOIN ud
  ON e.user_id = ud.user_id AND date_trunc('day', e.ts) = ud.day""")
def joi_13_two_key_join(spark, sf):
    """JOI-13: two-key left join (user, day) with a many-to-one check."""
    ev = b.events(spark, sf).withColumn("day", F.date_trunc("day", "ts"))
    ud = ev.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("user_day_rows"))
    return sc.left_join_unique(ev.select("event_id", "user_id", "day"), ud, ["user_id", "day"]).select(
        "event_id", "user_day_rows")


@query("src_06_pushed_filter_scan", oracle="""
SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'error') OR value > 300 GROUP BY 1""")
def src_06_pushed_filter_scan(spark, sf):
    """SRC-5/6: column list and an isin-OR-comparison predicate pushed into
    the Parquet scan (PushedFilters)."""
    ev = read_parquet(spark, f"{sf.rstrip('/')}/events.parquet", columns=["event_type", "value"],
                      where=F.col("event_type").isin("click", "error") | (F.col("value") > 300))
    return ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("src_08_file_lineage")
def src_08_file_lineage(spark, sf):
    """SRC-8: byte size and SHA-256 of every source file, by executors."""
    f = file_lineage(spark, f"{sf.rstrip('/')}/*.parquet")
    return f.select(F.element_at(F.split("path", "/"), -1).alias("file"), "bytes", "sha256")


@query("smp_05_location_sample", oracle=f"""
SELECT user_id, state_code_resolved FROM ({RESOLVED_SQL}) WHERE state_code_source = 'user_location_gazetteer'
ORDER BY md5('42|' || CAST(user_id AS VARCHAR)), user_id LIMIT 50""")
def smp_05_location_sample(spark, sf):
    """SMP-5: 50 gazetteer-recovered locations (exact, seeded)."""
    r = resolved(spark, sf).where(F.col("state_code_source") == "user_location_gazetteer")
    return smp.simple_sample(r.select("user_id", "state_code_resolved"), 50, id_col="user_id", seed=42)


@query("chk_06_09_closure_and_rescoring")
def chk_06_09_closure_and_rescoring(spark, sf):
    """CHK-9 (re-scoring reproduces score and label) and CHK-6 (row counts
    reconcile between the corpus and the scored output); blank texts count."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    lex = lexicon(spark, sf)
    a = se.lexicon_scores(d, "text", lex, check_blank=False)
    b2 = se.lexicon_scores(d, "text", lex, check_blank=False)
    r = qa.rescoring_matches(a, b2, id_col="doc_id", score="vader_compound", label="vader_label")
    from murmur.operators.common import with_scalars
    n = with_scalars(d.agg(F.count(F.lit(1)).alias("_a")), a.agg(F.count(F.lit(1)).alias("_b")))
    closure = n.select(F.lit("row_counts_reconcile").alias("check"),
                       F.when(F.col("_a") == F.col("_b"), "pass").otherwise("fail").alias("status"),
                       F.concat_ws("/", F.col("_a").cast("string"), F.col("_b").cast("string")).alias("detail"))
    return r.unionByName(closure)


# The register of PRO-11, which later phases each criterion
# affects, in its order.
LINKAGE = [
    ("textual_evidence", "textual_evidence_risk", "Phase 3/4/5"),
    ("sentiment_ambiguity", "sentiment_ambiguity_risk", "Phase 3/4/5"),
    ("sarcasm_irony_proxy", "sarcasm_irony_risk", "Phase 3/4/5"),
    ("user_representativeness", "user_representativeness_risk", "Phase 4/5"),
    ("duplicate_amplification_proxy", "duplicate_amplification_risk", "Phase 4/5"),
    ("spatial_validity", "spatial_validity_risk", "Phase 4/5 state analysis"),
    ("temporal_coverage", "temporal_coverage_risk", "Phase 4/5 temporal analysis"),
    ("model_suitability", "model_suitability_risk", "Phase 3/4/5"),
]


@query("pro_11_risk_linkage")
def pro_11_risk_linkage(spark, sf):
    """PRO-11: the static linkage register joined to the measured summary,
    with a pending mitigation decision per risk."""
    from murmur.plans.q_reliability import RISKS, reliability_run
    reg = spark.createDataFrame(LINKAGE, "criterion string, risk_score string, affected_phase string")
    s = su.criterion_summary(reliability_run(spark, sf), RISKS)
    return rounded(reg.join(s, "risk_score", "left").withColumn("mitigation_status", F.lit("pending")))
