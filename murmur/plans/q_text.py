"""Text queries over ``documents`` / ``pages`` / ``conversations``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from murmur.functions import classify as geo
from murmur.functions import text as tx
from murmur.operators import cleaning as cl
from murmur.operators import dedupe as dd
from murmur.operators import profilers as pf
from murmur.operators.common import spread
from murmur.plans.registry import query, rounded
from murmur.sources.tables import table

# RE2 spellings of the classes used by murmur.functions.text
W = r"[\p{L}\p{N}_]"
S = r"\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}"


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{S}]+', ' ', 'g'))"


def sql_unescape(x: str) -> str:
    """Named entities present in the corpus; &amp; last (single-pass result)."""
    for ent, ch in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"),
                    ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{ent}', '{ch}')"
    return x


def sql_clean(x: str, decode: bool = True) -> str:
    if decode:
        x = sql_unescape(x)
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?i)https?://[^{S}]*|www\\.[^{S}]+', '', 'g')"
    return sql_collapse(x)


def sql_count(x: str, pat: str) -> str:
    return f"CAST(len(regexp_extract_all(coalesce({x}, ''), '{pat}')) AS BIGINT)"


def sql_pct_rank(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN count(DISTINCT {x}) OVER () = 1 THEN 0.0 "
            f"ELSE (rank() OVER (ORDER BY {x}) - 1 + (count(*) OVER (PARTITION BY {x}) + 1) / 2.0)"
            f" / count({x}) OVER () END")


def docs(spark, sf):
    return table(spark, sf, "documents")


@query("str_02_clean_pages", oracle=f"""
SELECT page_id, {sql_clean('html')} AS html_cleaned FROM pages""")
def str_02_clean_pages(spark, sf):
    """STR-1 + STR-2 on raw web pages (decode, tags, URLs, whitespace)."""
    p = table(spark, sf, "pages")
    return p.select("page_id", tx.clean_text("html").alias("html_cleaned"))


# Fixed binding: pages that came as markup only, as nothing but a link, or with
# a character that could not be decoded.
_RECEIVED = ("CASE page_id % 6 WHEN 0 THEN '<p> <br/></p> &nbsp; ' WHEN 1 THEN 'https://' || substr(url, 8) || ' <a href=\"x\">' "
             "WHEN 2 THEN html || '\ufffd' ELSE html END")


@query("flt_04_valid_text_pages", oracle=f"""
WITH p AS (SELECT page_id, {_RECEIVED} AS html FROM pages)
SELECT page_id, length({sql_clean(sql_clean('html'))}) > 0
       AND NOT regexp_matches({sql_clean(sql_clean('html'))}, '\\x{{FFFD}}') AS is_valid FROM p""")
def flt_04_valid_text_pages(spark, sf):
    """FLT-4/5: validity applied to already-cleaned text (second decode)."""
    p = table(spark, sf, "pages").withColumn("html", F.expr(_RECEIVED))
    return p.select("page_id", tx.is_valid_text(tx.clean_text("html")).alias("is_valid"))


@query("ded_01_exact_text_first", oracle="""
SELECT doc_id, source, lang FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def ded_01_exact_text_first(spark, sf):
    d = docs(spark, sf).select("doc_id", "text", "source", "lang")
    return dd.keep_first(d, ["text"], ["doc_id"]).drop("text")


@query("ded_05_last_by_id", oracle="""
SELECT doc_id, quality, toxic, origin FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY prio DESC) AS rn FROM (
    SELECT doc_id, quality, toxic, 'sample' AS origin, 0 AS prio FROM labels
    UNION ALL SELECT doc_id, CAST(NULL AS INTEGER), CAST(NULL AS INTEGER), 'corpus', -1 FROM documents
    UNION ALL SELECT doc_id, quality, 1 - toxic, 'validation', 1 FROM labels WHERE quality = 1))
WHERE rn = 1""")
def ded_05_last_by_id(spark, sf):
    """DED-5 + SET-2: union by name with missing columns, the validation row
    wins over the sampled row for the same id (source priority)."""
    lab = table(spark, sf, "labels")
    sample = lab.select("doc_id", "quality", "toxic", F.lit("sample").alias("origin"), F.lit(0).alias("prio"))
    corpus = docs(spark, sf).select("doc_id", F.lit("corpus").alias("origin"), F.lit(-1).alias("prio"))
    valid = lab.where(F.col("quality") == 1).select("doc_id", "quality", (1 - F.col("toxic")).alias("toxic"),
                                                    F.lit("validation").alias("origin"), F.lit(1).alias("prio"))
    u = sample.unionByName(corpus, allowMissingColumns=True).unionByName(valid, allowMissingColumns=True)
    return dd.keep_first(u, ["doc_id"], ["prio"], last=True).drop("prio")


@query("ded_03_user_text_dedupe", oracle=f"""
SELECT doc_id, source, text_cleaned FROM (
  SELECT doc_id, source, {sql_clean('text')} AS text_cleaned FROM documents)
WHERE length(text_cleaned) > 0
QUALIFY row_number() OVER (PARTITION BY source, text_cleaned ORDER BY doc_id) = 1""")
def ded_03_user_text_dedupe(spark, sf):
    """v3 cleaning: clean, drop empty, first per (author, cleaned text)."""
    d = spread(docs(spark, sf).select("doc_id", "source", "text"))
    return cl.clean_and_dedupe(d, text_col="text", user_col="source", order_by=["doc_id"]).drop("text")


@query("ded_02_cleaned_text_dedupe", oracle=f"""
SELECT doc_id FROM (SELECT doc_id, {sql_clean('text')} AS t FROM documents)
WHERE length(t) > 0 QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1""")
def ded_02_cleaned_text_dedupe(spark, sf):
    d = docs(spark, sf).select("doc_id", "source", "text")
    return cl.clean_and_dedupe(d, text_col="text", user_col="source", order_by=["doc_id"], key="text").select("doc_id")


@query("ded_06_top_repeated_texts", oracle=f"""
SELECT text_cleaned, count(*) AS n FROM (
  SELECT * FROM (SELECT {sql_clean('text')} AS text_cleaned, source, doc_id FROM documents)
  WHERE length(text_cleaned) > 0
  QUALIFY row_number() OVER (PARTITION BY source, text_cleaned ORDER BY doc_id) = 1)
GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, text_cleaned LIMIT 20""")
def ded_06_top_repeated_texts(spark, sf):
    d = docs(spark, sf).select("doc_id", "source", "text")
    kept = cl.clean_and_dedupe(d, text_col="text", user_col="source", order_by=["doc_id"])
    return dd.repeated_values(kept, "text_cleaned", min_count=2, top=20)


def _nf(x):
    x = f"lower(coalesce({x}, ''))"
    x = f"regexp_replace({x}, 'https?://[^{S}]+|www\\.[^{S}]+', ' ', 'g')"
    x = f"regexp_replace({x}, '@{W}+', '@user', 'g')"
    return sql_collapse(x)


def _near(x):
    y = f"regexp_replace({_nf(x)}, '#{W}+', '#tag', 'g')"
    y = f"regexp_replace({y}, '\\p{{Nd}}+', '0', 'g')"
    return y


@query("str_05_signature_hashes", oracle=f"""
SELECT doc_id, sha256(coalesce(text, '')) AS exact_sha256, md5(coalesce(text, '')) AS exact_md5,
       sha256({_nf('text')}) AS normalized_sha256, sha256({_near('text')}) AS near_signature_sha256
FROM documents""")
def str_05_signature_hashes(spark, sf):
    """STR-3/4/5: normal form, near-duplicate signature, SHA-256/MD5."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return docs(spark, sf).select(
        "doc_id", tx.sha256(t).alias("exact_sha256"), F.md5(t).alias("exact_md5"),
        tx.sha256(tx.duplicate_normal_form(t)).alias("normalized_sha256"),
        tx.sha256(tx.near_signature(t)).alias("near_signature_sha256"))


_COUNTS = {
    "word_count": f"{W}+", "hashtag_count": f"#{W}+", "mention_count": f"@{W}+",
    "emoji_count": r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]", "punctuation_count": f"[^\\p{{L}}\\p{{N}}_{S}#@]",
}


def _textual_sql():
    counts = ", ".join(f"{sql_count('text', p)} AS {k}" for k, p in _COUNTS.items())
    return f"""
WITH c AS (SELECT doc_id, text, {counts}, CAST(length(coalesce(text, '')) AS BIGINT) AS character_count FROM documents),
r AS (SELECT *, hashtag_count / nullif(word_count, 0) AS hashtag_ratio,
             mention_count / nullif(word_count, 0) AS mention_ratio,
             emoji_count / nullif(word_count, 0) AS emoji_ratio FROM c),
k AS (SELECT *, {sql_pct_rank('hashtag_ratio')} AS hashtag_dominance_risk,
             {sql_pct_rank('mention_ratio')} AS mention_dominance_risk,
             {sql_pct_rank('emoji_ratio')} AS emoji_dominance_risk,
             least(greatest(1.0 - word_count / 12.0, 0.0), 1.0) AS text_sparsity_risk FROM r)
SELECT doc_id, word_count, character_count, hashtag_count, mention_count, emoji_count, punctuation_count,
       round(hashtag_ratio, 6) AS hashtag_ratio, round(mention_ratio, 6) AS mention_ratio,
       round(emoji_ratio, 6) AS emoji_ratio, word_count <= 3 AS is_extremely_short,
       round(text_sparsity_risk, 6) AS text_sparsity_risk,
       round(hashtag_dominance_risk, 6) AS hashtag_dominance_risk,
       round(mention_dominance_risk, 6) AS mention_dominance_risk,
       round(emoji_dominance_risk, 6) AS emoji_dominance_risk,
       round(least(greatest((text_sparsity_risk + coalesce(hashtag_dominance_risk, 0)
              + coalesce(mention_dominance_risk, 0) + coalesce(emoji_dominance_risk, 0))
              / (1 + (hashtag_dominance_risk IS NOT NULL)::INT + (mention_dominance_risk IS NOT NULL)::INT
                 + (emoji_dominance_risk IS NOT NULL)::INT), 0.0), 1.0), 6) AS textual_evidence_risk
FROM k"""


@query("pro_01_textual_evidence", oracle=_textual_sql())
def pro_01_textual_evidence(spark, sf):
    d = spread(docs(spark, sf).select("doc_id", "text"))
    out = pf.textual_evidence(d, "text")
    return rounded(out.select(
        "doc_id", "word_count", "character_count", "hashtag_count", "mention_count", "emoji_count",
        "punctuation_count", "hashtag_ratio", "mention_ratio", "emoji_ratio", "is_extremely_short",
        "text_sparsity_risk", "hashtag_dominance_risk", "mention_dominance_risk", "emoji_dominance_risk",
        "textual_evidence_risk"))


# Fixed binding: documents.lang plays the period role, source the stream.
@query("str_09_top_terms", oracle=f"""
WITH t AS (SELECT lang, lower(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z'']+'))) AS term
           FROM documents),
c AS (SELECT lang, term, count(*) AS sample_count FROM t
      WHERE length(term) >= 3 AND NOT list_contains({list(tx.STOPWORDS)}, term) GROUP BY 1, 2)
SELECT lang, term, sample_count FROM c
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sample_count DESC, term) <= 15""")
def str_09_top_terms(spark, sf):
    """STR-9 + WIN-5: top 15 terms per language."""
    d = docs(spark, sf).select("lang", F.explode(tx.terms("text")).alias("term"))
    c = d.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("sample_count"))
    w = Window.partitionBy("lang").orderBy(F.desc("sample_count"), F.asc("term"))
    return c.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 15).drop("_r")


@query("str_08_top_hashtags", oracle="""
WITH x AS (SELECT role, regexp_replace(text, '(^|\\s)([A-Za-z]{6,})', '\\1#\\2', 'g') AS t FROM conversations),
t AS (SELECT role, lower(unnest(regexp_extract_all(t, '(?:^|[^\\p{L}\\p{N}_])#([A-Za-z0-9_]+)', 1))) AS hashtag FROM x),
c AS (SELECT role, hashtag, count(*) AS sample_count FROM t GROUP BY 1, 2)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY role ORDER BY sample_count DESC, hashtag) <= 10""")
def str_08_top_hashtags(spark, sf):
    """STR-8 + WIN-5: top 10 hashtags per role. Fixed binding: words of six
    letters or more are written as hashtags."""
    c = table(spark, sf, "conversations").select("role", F.regexp_replace("text", r"(^|\s)([A-Za-z]{6,})", "$1#$2").alias("text"))
    c = c.select("role", F.explode(tx.hashtags("text")).alias("hashtag")).groupBy("role", "hashtag").agg(
        F.count(F.lit(1)).alias("sample_count"))
    w = Window.partitionBy("role").orderBy(F.desc("sample_count"), F.asc("hashtag"))
    return c.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 10).drop("_r")


def _sql_tokens(x):
    return (f"CASE WHEN {sql_collapse(x)} = '' THEN 0 ELSE "
            f"len(string_split({sql_collapse(x)}, ' ')) END")


def _sql_spanish_hits(x):
    return (f"(len(list_filter(regexp_extract_all(lower(coalesce({x}, '')), '{W}+'), "
            f"lambda w: list_contains({list(tx.SPANISH_WORDS)}, w))) "
            f"+ len(regexp_extract_all(coalesce({x}, ''), '[{tx.SPANISH_CHARS}]')))")


@query("lng_02_language_classes", oracle=f"""
SELECT doc_id,
  CASE WHEN lang IS NULL OR trim(lang) = '' THEN 'Unknown'
       WHEN lower(trim(lang)) IN ('en', 'english') THEN 'English'
       WHEN lower(trim(lang)) IN ('es', 'spanish') THEN 'Spanish'
       WHEN lower(trim(lang)) IN ('und', 'undetermined') THEN 'Undetermined' ELSE 'Other' END AS language_class,
  CASE WHEN text IS NULL OR {_sql_tokens('text')} = 0 THEN 'English'
       WHEN {_sql_spanish_hits('text')} >= 2 OR ({_sql_spanish_hits('text')} >= 1 AND {_sql_tokens('text')} <= 6)
       THEN 'Spanish' ELSE 'English' END AS heuristic_language,
  CAST({_sql_spanish_hits('text')} AS BIGINT) AS spanish_hits
FROM documents""")
def lng_02_language_classes(spark, sf):
    """LNG-1 (declared tag class) + LNG-2 (two-class regex fallback)."""
    return docs(spark, sf).select("doc_id", geo.language_class("lang").alias("language_class"),
                                  geo.heuristic_language("text").alias("heuristic_language"),
                                  tx.spanish_hits("text").alias("spanish_hits"))


@query("str_11_model_text", oracle="""
SELECT conv_id, turn,
  array_to_string(list_transform(string_split(text, ' '), lambda t: CASE WHEN t LIKE '@%' AND length(t) > 1 THEN '@user'
    WHEN t LIKE 'http%' THEN 'http' ELSE t END), ' ') AS model_text
FROM conversations""")
def str_11_model_text(spark, sf):
    """STR-11: token-wise model normal form over conversation turns."""
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", tx.model_text_tokens("text").alias("model_text"))


@query("pro_05_duplicate_amplification", oracle=f"""
WITH b AS (SELECT doc_id, coalesce(text, '') AS t, {_nf('text')} AS nf, sha256({_near('text')}) AS near_id,
                  coalesce(source, '__MISSING_USER_ID__') AS u FROM documents),
c AS (SELECT doc_id, near_id,
             count(*) OVER (PARTITION BY t) AS ex, count(*) OVER (PARTITION BY nf) AS nr,
             count(*) OVER (PARTITION BY near_id) AS ns FROM b),
x AS (SELECT nf, count(DISTINCT u) AS cu FROM b GROUP BY nf),
j AS (SELECT c.*, x.cu FROM c JOIN b USING (doc_id) JOIN x ON b.nf = x.nf),
m AS (SELECT *, CASE WHEN ex > 1 THEN ex END AS ex2, CASE WHEN nr > 1 THEN nr END AS nr2,
             CASE WHEN ns > 1 THEN ns END AS ns2, CASE WHEN cu > 1 THEN cu END AS cu2 FROM j),
r AS (SELECT *, coalesce({sql_pct_rank('ex2')}, 0.0) AS rex, coalesce({sql_pct_rank('nr2')}, 0.0) AS rnr,
             coalesce({sql_pct_rank('ns2')}, 0.0) AS rns, coalesce({sql_pct_rank('cu2')}, 0.0) AS rcu FROM m)
SELECT doc_id, near_id AS near_duplicate_cluster_id, ex AS post_clean_exact_duplicate_count,
       nr AS normalized_repetition_count, ns AS near_duplicate_cluster_size, cu AS cross_user_repetition_count,
       round(least(greatest((rex + rnr + rns + rcu) / 4.0, 0.0), 1.0), 6) AS duplicate_amplification_risk FROM r""")
def pro_05_duplicate_amplification(spark, sf):
    d = spread(docs(spark, sf).select("doc_id", "text", "source"))
    out = pf.duplicate_amplification(d, "text", "source")
    return rounded(out.select("doc_id", "near_duplicate_cluster_id", "post_clean_exact_duplicate_count",
                              "normalized_repetition_count", "near_duplicate_cluster_size",
                              "cross_user_repetition_count", "duplicate_amplification_risk"))


# Fixed binding: what some turns add to what they say.
_CUED = ("concat(text, CASE (conv_id + turn) % 5 WHEN 1 THEN ' yeah right, great job' WHEN 2 THEN ' but a \"great\" one' "
         "WHEN 3 THEN ' lol 🙄 LOL' ELSE '' END)")


def _sarcasm_sql():
    nb = "[^\\p{L}\\p{N}_]"
    markers = "|".join(m.replace(" ", "  ") for m in pf.SARCASM_MARKERS)
    contrast = "|".join(pf.CONTRAST_WORDS)
    dbl = f"regexp_replace(lower(coalesce(text, '')), '({nb})', '\\1\\1', 'g')"
    return f"""
WITH x AS (SELECT conv_id, turn, {_CUED} AS text FROM conversations),
c AS (SELECT conv_id, turn, coalesce(text, '') AS t,
             CAST(len(regexp_extract_all({dbl}, '(?:^|{nb})({markers})(?:$|{nb})', 1)) AS BIGINT) AS m
           FROM x),
f AS (SELECT *, (m > 0)::INT + contains(t, '🙄')::INT
                + regexp_matches(t, '(?i)["“”](?:great|genius|leader|honest)["“”]')::INT
                + regexp_matches(t, '(?i)(^|{nb})({contrast})($|{nb})')::INT AS cues FROM c)
SELECT conv_id, turn, m AS sarcasm_marker_count, round(least(greatest(cues / 4.0, 0.0), 1.0), 6) AS rule_based_sarcasm_indicator,
       true AS sarcasm_evidence_available, round(least(greatest(cues / 4.0, 0.0), 1.0), 6) AS sarcasm_irony_risk,
       'cue-based estimate, unverified' AS sarcasm_proxy_note FROM f"""


@query("pro_03_sarcasm_proxy", oracle=_sarcasm_sql())
def pro_03_sarcasm_proxy(spark, sf):
    """PRO-3 over conversation turns (four regex cues)."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.expr(_CUED).alias("text"))
    return rounded(pf.sarcasm_proxy(c, "text").drop("text"))


@query("pro_03c_sarcasm_score_v2")
def pro_03c_sarcasm_score_v2(spark, sf):
    """PRO-3c over conversation turns (unit-tested against Python ``re``:
    its cues need look-arounds that RE2 lacks)."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return c.select("conv_id", "turn", pf.sarcasm_score_v2("text").alias("sarcasm_score_v2"))


def _spatial_sql():
    from murmur.plans.q_geo import CODE_BY_NAME, CODES, NAME_LIST, names_found_sql
    nb = "[^\\p{L}\\p{N}_]"
    fict = "|".join(geo.FICTIONAL_WORDS)
    nonus = "|".join(geo.NON_US_WORDS)
    return f"""
WITH d AS (SELECT doc_id, trim(text) AS loc FROM documents),
x AS (SELECT doc_id, loc, loc = '' AS missing,
        list_sort(list_distinct(list_concat(
          list_transform({names_found_sql('loc')}, lambda n: {CODE_BY_NAME}[list_position({NAME_LIST}, n)]),
          list_filter(regexp_extract_all(regexp_replace(loc, '([^A-Za-z])', '\\1\\1', 'g'),
                                         '(?:^|[^A-Za-z])([A-Z]{{2}})(?:$|[^A-Za-z])', 1),
                      lambda c: list_contains({CODES}, c))))) AS st,
        regexp_matches(loc, '(?i)^(usa|u\\.?s\\.?a?\\.?|united states|america|united states of america)$') AS national,
        regexp_matches(loc, '(?i)(^|{nb})({fict})($|{nb})') AS fictional,
        regexp_matches(loc, '(?i)(^|{nb})({nonus})($|{nb})') AS mentions_non_us FROM d),
y AS (SELECT *, len(st) AS n, mentions_non_us AND len(st) = 0 AS non_us FROM x),
z AS (SELECT *, NOT missing AND NOT national AND NOT fictional AND NOT non_us AND n <> 1 AS ambiguous,
             CASE WHEN (NOT missing AND NOT national AND NOT fictional AND NOT non_us AND n <> 1) OR fictional OR non_us
                  THEN 0.0 WHEN national THEN 0.0 WHEN n > 1 THEN 0.25 WHEN n = 1 THEN 1.0 END AS conf FROM y)
SELECT doc_id, CASE WHEN missing THEN 'missing' ELSE 'available' END AS location_availability,
       NOT missing AS location_mapping_available, CASE WHEN n > 0 THEN array_to_string(st, ';') END AS matched_state,
       conf AS state_mapping_confidence, national AS national_only_location, ambiguous OR n > 1 AS ambiguous_location,
       non_us AS non_us_location, missing AS missing_location, fictional AS fictional_location,
       n = 1 AS state_analysis_available, true AS national_temporal_analysis_available,
       CASE WHEN NOT missing THEN 1.0 - conf END AS spatial_validity_risk FROM z"""


@query("pro_06_spatial_validity", oracle=_spatial_sql())
def pro_06_spatial_validity(spark, sf):
    """PRO-6 with each document's whole text as the free-text location."""
    d = docs(spark, sf).select("doc_id", F.col("text").alias("user_loc"))
    return pf.spatial_validity(d, "user_loc").drop("user_loc")
