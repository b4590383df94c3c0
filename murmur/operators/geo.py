"""GEO-1 by a phrase index: the phrases of a gazetteer are found in texts by
an equi-join of token n-grams, for gazetteers of any size, in place of one
alternation of all names tried at every character."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.functions import classify as geo
from murmur.functions.text import WORD, col_
from murmur.operators.common import join_back
from murmur.session import cut_lineage


def gazetteer(spark: SparkSession) -> DataFrame:
    """(phrase, kind, value, place): the state names in order of priority and
    the words that stand for the country."""
    rows = [(name, "state", code, i) for i, (name, code) in enumerate(geo.STATE_NAMES)]
    rows += [(w, "us", None, None) for w in geo.US_WORDS]
    return spark.createDataFrame(rows, "phrase string, kind string, value string, place int")


def n_grams(text: Column, longest: int) -> Column:
    """All phrases of 1 to ``longest`` words of a text, lower-cased. Words of a
    phrase are a single space apart, so a phrase never spans punctuation."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(rf"[{WORD}]+(?: [{WORD}]+)*"), 0)

    def grams(w):
        out, last = [w], w
        for n in range(1, longest):
            last = F.zip_with(last, F.slice(w, F.lit(n + 1), F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))
            out.append(last)
        return F.filter(F.concat(*out), lambda g: g.isNotNull())
    # the words of a run are computed once and bound
    return F.flatten(F.transform(F.transform(runs, lambda r: F.split(r, " ")), grams))


def phrase_hits(df: DataFrame, text: Column, phrases: DataFrame, values: Sequence[str], longest: int) -> DataFrame:
    """One row per distinct text: _key (its digest), _rows, and _hits, the set
    of (phrase, values...) of the phrases that occur in it as whole words."""
    plain = F.coalesce(text, F.lit(""))
    # an empty phrase that every text has, so texts without a hit are kept
    ex = df.select(F.unhex(F.sha2(plain, 256)).alias("_key"),
                   F.explode(F.concat(F.array(F.lit("")), n_grams(plain, longest))).alias("phrase"))
    found = ex.join(phrases.select("phrase", F.struct("phrase", *values).alias("_hit")), "phrase", "left")
    return found.where((F.col("phrase") == "") | F.col("_hit").isNotNull()).groupBy("_key").agg(
        F.count_if(F.col("phrase") == "").alias("_rows"), F.collect_set("_hit").alias("_hits"))


def resolve_regions(df: DataFrame, *, state_code, state, location, country, longest_match: bool = False,
                    longest: int = 3) -> DataFrame:
    """GEO-1 for frames: adds state_code_resolved and state_code_source, as
    ``classify.resolve_region`` defines them, with the names in the location
    found by ``phrase_hits`` and joined back on the location's digest."""
    place = F.trim(F.coalesce(col_(location).cast("string"), F.lit("")))
    hits = cut_lineage(phrase_hits(df, place, gazetteer(df.sparkSession), ["kind", "value", "place"], longest))
    out = join_back(df, hits, {"_key": F.unhex(F.sha2(place, 256))}, "_rows")
    states = F.filter("_hits", lambda h: h["kind"] == "state")
    if longest_match:
        states = F.filter(states, lambda h: ~F.exists("_hits", lambda m: (m["kind"] == "state") & (
            F.length(m["phrase"]) > F.length(h["phrase"])) & m["phrase"].contains(h["phrase"])))
    first = F.array_min(F.transform(states, lambda h: F.struct(h["place"].alias("place"), h["value"].alias("value"))))
    code, source = geo.resolved_from(first["value"], F.exists("_hits", lambda h: h["kind"] == "us"),
                                     state_code, state, location, country)
    return out.withColumns({"state_code_resolved": code, "state_code_source": source}).drop("_hits")
