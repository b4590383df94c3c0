import re

import pytest
from pyspark.sql import functions as F

from murmur.functions import classify as geo
from murmur.functions import text as tx

PY_PUNCT = re.compile(r"[^\w\s#@]")


def _one(spark, col, value):
    return spark.createDataFrame([(value,)], "t string").select(col(F.col("t")).alias("o")).collect()[0].o


def test_cleaning_fixture(spark):
    assert _one(spark, tx.clean_text, "<b>AMAZING!!!</b> Vote 😊 https://example.com") == "AMAZING!!! Vote 😊"
    assert _one(spark, tx.clean_text, "Test https:// broken source") == "Test broken source"
    assert _one(spark, tx.clean_text, "a &amp; b &copy; c") == "a & b © c"
    assert _one(spark, tx.clean_text, None) is None


def test_validity_second_decode(spark):
    # the second decode turns escaped markup into a tag that is then removed
    assert _one(spark, lambda c: tx.is_valid_text(tx.clean_text(c)), "&amp;lt;b&amp;gt;") is False
    assert _one(spark, lambda c: tx.is_valid_text(tx.clean_text(c)), "&amp;lt;3 hearts") is True
    assert _one(spark, lambda c: tx.is_valid_text(c), "  <p></p> ") is False
    assert _one(spark, lambda c: tx.is_valid_text(c), "bad � char") is False


@pytest.mark.parametrize("text", [
    "Vote NOW #A 10 @joe_b http://x.y/z", "Ça va? Très bien, merci! #élection", "a_b c-d e.f",
    "lol LMAO... really?!", "Müller sagt: „Nein“ — 12:30", "  spaced\ttext\nnew line  ", "",
])
def test_counts_match_python(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(
        tx.word_count("t").alias("w"), tx.hashtag_count("t").alias("h"), tx.mention_count("t").alias("m"),
        tx.punctuation_count("t").alias("p"), tx.char_count("t").alias("c"),
        tx.collapse_ws("t").alias("ws"), tx.token_count("t").alias("tk")).collect()[0]
    assert row.w == len(re.findall(r"\b\w+\b", text))
    assert row.h == len(re.findall(r"#\w+", text))
    assert row.m == len(re.findall(r"@\w+", text))
    assert row.p == len(PY_PUNCT.findall(text))
    assert row.c == len(text)
    assert row.ws == " ".join(text.split())
    assert row.tk == len(text.split())


def test_normal_form_and_signature(spark):
    text = "Vote NOW #A 10 @Joe https://t.co/x  "
    nf = _one(spark, tx.duplicate_normal_form, text)
    assert nf == "vote now #a 10 @user"
    assert _one(spark, tx.near_signature, text) == "vote now #tag 0 @user"


def test_hashtags_and_terms(spark):
    assert _one(spark, tx.hashtags, "#Vote2020 and#no x#no #Yes!") == ["vote2020", "yes"]
    assert _one(spark, tx.terms, "The voters don't TRUST it, and go") == ["voters", "don't", "trust"]


def test_model_text_tokens(spark):
    assert _one(spark, tx.model_text_tokens, "hi @bob see https://x.y @ now") == "hi @user see http @ now"


def test_region_and_language_classes(spark):
    df = spark.createDataFrame([("TX", "es"), ("TX", "en"), ("FL", "es"), ("CA", "en"), (None, "en")],
                               "state string, lang string")
    from murmur.operators.spatial import region_language_counts
    r = region_language_counts(df, geo.region_class(F.col("state")), geo.language_class(F.col("lang"))).collect()[0]
    assert (r.total_tweets, r.us_state_tweets, r.us_spanish_tweets, r.unmapped_tweets) == (5, 4, 2, 1)


def test_heuristic_spanish(spark):
    assert _one(spark, geo.heuristic_language, "gracias por todo") == "Spanish"
    assert _one(spark, geo.heuristic_language, "the vote is tomorrow and we go") == "English"
    assert _one(spark, geo.heuristic_language, "¿qué?") == "Spanish"
    assert _one(spark, geo.heuristic_language, "") == "English"


@pytest.mark.parametrize("sc,st,loc,country,code,source", [
    (" tx ", None, None, None, "TX", "original_state_code"),
    (None, "Texas", None, None, "TX", "state_name_match"),
    ("ON", None, "Toronto", "Canada", None, "non_us"),
    (None, None, "Austin, TX", "US", "TX", "user_location_gazetteer"),
    (None, None, "Love West Virginia", "", "VA", "user_location_gazetteer"),
    (None, None, "NY and USA", "", "NY", "user_location_gazetteer"),
    (None, None, "NY forever", "", None, "unmapped"),
    (None, None, "somewhere", "France", None, "non_us"),
])
def test_resolve_region(spark, sc, st, loc, country, code, source):
    df = spark.createDataFrame([(sc, st, loc, country)], "sc string, st string, loc string, c string")
    c, s = geo.resolve_region(F.col("sc"), F.col("st"), F.col("loc"), F.col("c"))
    row = df.select(c.alias("code"), s.alias("source")).collect()[0]
    assert (row.code, row.source) == (code, source)


def test_resolve_region_longest_match(spark):
    df = spark.createDataFrame([("Love West Virginia",)], "loc string")
    c, _ = geo.resolve_region(F.lit(None), F.lit(None), F.col("loc"), F.lit(None), longest_match=True)
    assert df.select(c.alias("c")).collect()[0].c == "WV"


def test_entities_are_decoded_as_html_says(spark):
    import html
    import random
    rng = random.Random(7)
    parts = ["&amp;", "&amp", "&lt;b&gt;", "&notit;", "&notin;", "&not", "&nbsp;x", "&#39;", "&#x1F600;", "&#128;", "&#x80", "&#0;", "&#13;",
             "&#xD800;", "&#1114112;", "&#99999999999999999999;", "&#x;", "&#;", "&;", "& ", "&unknown;", "&frac12x", "&fjlig;", "&#11;",
             "&#xFEFF;", "&#64976;", "&#x1FFFF;", "&acE;", "&Acirc", "&thorny", "plain", " ", "&", "\n", "&#0065;", "&CounterClockwiseContourIntegral;",
             "é", "&copy2020", "&#127;", "&#xD;", "&abcdefghijklmnopqrstuvwxyzabcdefghijkl;", "&\t", "&#12a", "&lt;&lt", "😀&amp;amp;"]
    texts = parts + ["".join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(400)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.d for r in df.select("i", tx.html_unescape("t").alias("d")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else html.unescape(t)), t
    plan = df.select(tx.clean_text("t"))._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "InPandas" not in plan


def test_phrase_index_finds_what_the_pattern_finds(spark):
    import random
    from murmur.operators.geo import resolve_regions
    rng = random.Random(2)
    words = ["west", "virginia", "West Virginia", "new", "york", "New York", "TX", "CA", "usa", "us", "united states", "district of columbia",
             ",", ", ", " ", "  ", "-", "x", "Kansas", "arkansas", "_", "Washington,", "DC", "é", "states", "ON", "\n"]
    rows = [(rng.choice([None, "tx ", "ZZ", "ENG", ""]), rng.choice([None, "Ohio", "nowhere"]),
             rng.choice([None, "", "".join(rng.choices(words, k=rng.randrange(1, 7))), " ".join(rng.choices(words, k=rng.randrange(1, 7)))]),
             rng.choice([None, "USA", "Canada", "nan"])) for _ in range(500)]
    df = spark.createDataFrame([(i % 9, *r) for i, r in enumerate(rows)], "i int, sc string, st string, loc string, c string")
    for longest in (False, True):
        code, source = geo.resolve_region(F.col("sc"), F.col("st"), F.col("loc"), F.col("c"), longest_match=longest)
        want = sorted((tuple(r) for r in df.select("i", "sc", "st", "loc", "c", code, source).collect()), key=repr)
        out = resolve_regions(df, state_code="sc", state="st", location="loc", country="c", longest_match=longest)
        assert sorted((tuple(r) for r in out.collect()), key=repr) == want
        assert len({r[-1] for r in want}) == 5
