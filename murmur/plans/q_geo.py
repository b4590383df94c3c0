"""Region resolution and region x language queries over user profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.functions import classify as geo
from murmur.operators import spatial as sp
from murmur.operators.geo import resolve_regions
from murmur.plans.registry import query, rounded
from murmur.sources.tables import table

W = r"\p{L}\p{N}_"
S = r"\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}"
CODES = "[" + ", ".join(f"'{c}'" for c in geo.STATE_CODES) + "]"
NAME_LIST = "[" + ", ".join(f"'{n}'" for n, _ in geo.STATE_NAMES) + "]"
CODE_BY_NAME = "[" + ", ".join(f"'{c}'" for _, c in geo.STATE_NAMES) + "]"


def _doubled(x: str) -> str:
    """Every non-word character doubled, so consecutive matches that share a
    separator can each consume one copy (RE2 has no look-around)."""
    return f"regexp_replace({x}, '([^{W}])', '\\1\\1', 'g')"


def names_found_sql(x: str) -> str:
    """Distinct gazetteer names occurring as whole words in lower(x), as a
    list. One constant regex over the doubled text; a name that occurs inside
    another name (e.g. 'virginia' in 'west virginia') gets its own scan."""
    names = [n for n, _ in geo.STATE_NAMES]
    alt = "|".join(sorted((n.replace(" ", "  ") for n in names), key=len, reverse=True))
    nested = [n for n in names if any(n != m and f" {n}" in f" {m}" for m in names)]
    d = _doubled(f"lower({x})")
    parts = [f"regexp_extract_all({d}, '(?:^|[^{W}])({alt})(?:$|[^{W}])', 1)"]
    parts += [f"regexp_extract_all({d}, '(?:^|[^{W}])({n.replace(' ', '  ')})(?:$|[^{W}])', 1)" for n in nested]
    found = parts[0]
    for q in parts[1:]:
        found = f"list_concat({found}, {q})"
    return f"list_distinct(list_transform({found}, lambda n: replace(n, '  ', ' ')))"


# Fixed binding: customers play the users, with profile fields of nine kinds
# made from their keys (code, region, name, three spellings of a location, none,
# and no hit); the market segment plays the language.
def _profile_sql(pick) -> str:
    code, name = pick([c for _, c in geo.STATE_NAMES]), pick([n for n, _ in geo.STATE_NAMES])
    return f"""SELECT c_custkey AS user_id,
  CASE c_custkey % 9 WHEN 0 THEN ' ' || lower({code}) || ' ' WHEN 1 THEN 'ENG' END AS state_code,
  CASE c_custkey % 9 WHEN 2 THEN upper({name}) END AS state,
  CASE c_custkey % 9 WHEN 3 THEN 'Somewhere, ' || {code} WHEN 4 THEN 'near ' || upper({name}) || '!' WHEN 5 THEN {code} || ', the USA'
    WHEN 6 THEN c_name || ' Street' WHEN 8 THEN 'from ' || {code} || ' to nowhere' END AS location,
  CASE c_custkey % 7 WHEN 0 THEN 'Canada' WHEN 1 THEN 'nan' WHEN 2 THEN 'usa' END AS country,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'en' WHEN 'AUTOMOBILE' THEN 'es' WHEN 'HOUSEHOLD' THEN 'fr' WHEN 'MACHINERY' THEN 'und' END AS lang
FROM """


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def profiles(spark, sf):
    table(spark, sf, "customer").createOrReplaceTempView("murmur_customer")
    return spark.sql(_profile_sql(lambda v: f"element_at(array({_quoted(v)}), CAST(c_custkey div 9 % 51 AS INT) + 1)")
                     + "murmur_customer")


RESOLVED_SQL = f"""
WITH d AS (SELECT user_id, lang, trim(coalesce(location, '')) AS loc, upper(trim(coalesce(state_code, ''))) AS sc,
             lower(trim(coalesce(state, ''))) AS st, upper(trim(coalesce(country, ''))) AS ctry
           FROM ({_profile_sql(lambda v: f"([{_quoted(v)}][c_custkey // 9 % 51 + 1])")} customer)),
x AS (SELECT *,
        list_min(list_transform({names_found_sql('loc')}, lambda n: list_position({NAME_LIST}, n))) AS prio,
        list_filter(regexp_extract_all(replace(loc, ',', ',,'), ',[{S}]*([A-Z]{{2}})(?:$|[^{W}])', 1),
                    lambda c: list_contains({CODES}, c)) AS cc,
        list_filter(regexp_extract_all({_doubled('loc')}, '(?:^|[^{W}])([A-Z]{{2}})(?:$|[^{W}])', 1),
                    lambda c: list_contains({CODES}, c)) AS bc,
        regexp_matches(loc, '(?i)(^|[^{W}])(usa|us|united states)($|[^{W}])') AS has_us
      FROM d),
f AS (SELECT *, CASE WHEN length(loc) > 0 THEN coalesce({CODE_BY_NAME}[prio],
          list_sort(list_distinct(list_concat(cc, CASE WHEN has_us THEN bc ELSE [] END)))[1]) END AS from_loc FROM x),
r AS (SELECT *, CASE WHEN list_contains({CODES}, sc) THEN 'original_state_code' WHEN list_contains({NAME_LIST}, st) THEN 'state_name_match'
          WHEN sc IN ({_quoted(geo.NON_US_REGION_CODES)})
            OR ctry NOT IN ({_quoted([*geo.US_COUNTRY, 'NAN', 'NONE', 'NULL'])}) THEN 'non_us'
          WHEN from_loc IS NOT NULL THEN 'user_location_gazetteer' ELSE 'unmapped' END AS state_code_source FROM f),
q AS (SELECT *, CASE state_code_source WHEN 'original_state_code' THEN sc
          WHEN 'state_name_match' THEN {CODE_BY_NAME}[list_position({NAME_LIST}, st)] WHEN 'user_location_gazetteer' THEN from_loc END AS code
      FROM r)
SELECT user_id, lang, code AS state_code_resolved, state_code_source,
       CASE WHEN code IS NULL OR code = '' THEN 'Unmapped' WHEN list_contains({CODES}, code) THEN 'US_' || code
            ELSE 'Non_US' END AS region_class,
       CASE WHEN lang IS NULL OR trim(lang) = '' THEN 'Unknown'
            WHEN lower(trim(lang)) IN ('en', 'english') THEN 'English'
            WHEN lower(trim(lang)) IN ('es', 'spanish') THEN 'Spanish'
            WHEN lower(trim(lang)) IN ('und', 'undetermined') THEN 'Undetermined' ELSE 'Other' END AS language_class
FROM q"""


def resolved(spark, sf):
    r = resolve_regions(profiles(spark, sf), state_code="state_code", state="state", location="location", country="country")
    return r.select("user_id", "lang", "state_code_resolved", "state_code_source",
                    geo.region_class("state_code_resolved").alias("region_class"),
                    geo.language_class("lang").alias("language_class"))


@query("geo_01_resolve_region", oracle=f"""
SELECT user_id, state_code_resolved, state_code_source, region_class FROM ({RESOLVED_SQL})""")
def geo_01_resolve_region(spark, sf):
    """GEO-1 + GEO-2 for every user's profile."""
    return resolved(spark, sf).select("user_id", "state_code_resolved", "state_code_source", "region_class")


@query("agg_15_region_language_crosstab", oracle=f"""
SELECT CASE WHEN grouping(region_class) = 1 THEN 'Total' ELSE region_class END AS region,
       CASE WHEN grouping(language_class) = 1 THEN 'Total' ELSE language_class END AS language, count(*) AS n
FROM ({RESOLVED_SQL}) GROUP BY CUBE (region_class, language_class)""")
def agg_15_region_language_crosstab(spark, sf):
    r = resolved(spark, sf)
    return sp.crosstab_with_totals(r, F.col("region_class"), F.col("language_class"))


@query("agg_16_region_language_counts", oracle=f"""
SELECT count(*) AS total_tweets, count(CASE WHEN region_class LIKE 'US\\_%' ESCAPE '\\' THEN 1 END) AS us_state_tweets,
       count(CASE WHEN region_class LIKE 'US\\_%' ESCAPE '\\' AND language_class = 'Spanish' THEN 1 END) AS us_spanish_tweets,
       count(CASE WHEN region_class LIKE 'US\\_%' ESCAPE '\\' AND language_class = 'Other' THEN 1 END)
         AS us_other_language_tweets,
       count(CASE WHEN region_class = 'Non_US' THEN 1 END) AS non_us_tweets,
       count(CASE WHEN region_class = 'Unmapped' THEN 1 END) AS unmapped_tweets FROM ({RESOLVED_SQL})""")
def agg_16_region_language_counts(spark, sf):
    r = resolved(spark, sf)
    return sp.region_language_counts(r, F.col("region_class"), F.col("language_class"))


@query("agg_17_language_survey", oracle=f"""
WITH r AS ({RESOLVED_SQL}),
c AS (SELECT 'corpus_wide' AS scope, lang, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS pct
      FROM r GROUP BY lang
      UNION ALL
      SELECT 'us_state_mapped', lang, count(*), 100.0 * count(*) / sum(count(*)) OVER ()
      FROM r WHERE state_code_source IN ('original_state_code', 'state_name_match', 'user_location_gazetteer')
      GROUP BY lang)
SELECT scope, lang, n, round(pct, 6) AS pct, scope = 'us_state_mapped' AND lang <> 'en' AND pct > 1.0
       AS dedicated_handling FROM c""")
def agg_17_language_survey(spark, sf):
    """AGG-17: language counts and shares for the corpus and for rows mapped
    to a US region; non-English languages above 1 % of mapped rows flagged."""
    from pyspark.sql import Window
    r = resolved(spark, sf)
    mapped = r.where(F.col("state_code_source").isin("original_state_code", "state_name_match",
                                                     "user_location_gazetteer"))
    w = Window.partitionBy("scope")  # two scopes x distinct languages: small
    a = r.groupBy(F.lit("corpus_wide").alias("scope"), "lang").agg(F.count(F.lit(1)).alias("n"))
    bb = mapped.groupBy(F.lit("us_state_mapped").alias("scope"), "lang").agg(F.count(F.lit(1)).alias("n"))
    u = a.unionByName(bb).withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(w))
    return rounded(u.withColumn("dedicated_handling", (F.col("scope") == "us_state_mapped") &
                                (F.col("lang") != "en") & (F.col("pct") > 1.0)))


@query("agg_18_resolution_by_source", oracle=f"""
SELECT state_code_source, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct
FROM ({RESOLVED_SQL}) GROUP BY 1""")
def agg_18_resolution_by_source(spark, sf):
    """AGG-18: geography resolution by source."""
    from pyspark.sql import Window
    r = resolved(spark, sf).groupBy("state_code_source").agg(F.count(F.lit(1)).alias("n"))
    return rounded(r.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())))


@query("agg_39_spanish_share_by_region", oracle=f"""
SELECT region_class, count(*) AS n, round(avg(CASE WHEN lang = 'es' THEN 1.0 ELSE 0.0 END), 6) AS spanish_share
FROM ({RESOLVED_SQL}) GROUP BY 1""")
def agg_39_spanish_share_by_region(spark, sf):
    r = resolved(spark, sf)
    return rounded(r.groupBy("region_class").agg(F.count(F.lit(1)).alias("n"), F.avg(
        F.coalesce(F.col("lang") == "es", F.lit(False)).cast("double")).alias("spanish_share")))


@query("agg_48_valid_region_share", oracle=f"""
SELECT count(*) AS n, round(avg(CASE WHEN region_class LIKE 'US\\_%' ESCAPE '\\' THEN 1.0 ELSE 0.0 END), 6)
         AS valid_region_share FROM ({RESOLVED_SQL})""")
def agg_48_valid_region_share(spark, sf):
    r = resolved(spark, sf)
    return rounded(r.agg(F.count(F.lit(1)).alias("n"),
                         F.avg(F.col("region_class").startswith("US_").cast("double")).alias("valid_region_share")))
