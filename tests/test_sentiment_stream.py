import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur.operators import annotate as an
from murmur.operators import quality as qa
from murmur.operators import sentiment as se


@pytest.fixture()
def lexicon(spark):
    words = [("good", 1.9), ("bad", -2.5), ("great", 3.1), ("love", 3.2), ("hate", -2.7), ("happy", 2.7),
             ("sad", -2.1), ("nice", 1.8), ("terrible", -2.5), ("win", 2.8)]
    return spark.createDataFrame(words, "word string, valence double")


def test_lexicon_rules(spark, lexicon):
    texts = {1: "The movie is good", 2: "The movie is not good", 3: "The movie is very good",
             4: "The movie is GOOD", 5: "I love it but the end was bad", 6: "nothing here", 7: "Good!!!"}
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    r = {x.id: x for x in se.lexicon_scores(df, "text", lexicon).collect()}
    assert r[1].vader_compound == 0.4404 and (r[1].vader_negative, r[1].vader_neutral, r[1].vader_positive) \
        == (0.0, 0.508, 0.492)
    assert r[2].vader_compound < 0 < r[1].vader_compound < r[3].vader_compound
    assert r[4].vader_compound > r[1].vader_compound          # caps emphasis
    assert r[5].vader_label == "negative"                       # 'but' shifts weight to the second clause
    assert r[6].vader_compound == 0.0 and r[6].vader_label == "neutral"
    assert r[7].vader_compound > r[1].vader_compound           # exclamation emphasis
    for x in r.values():
        assert abs(x.vader_negative + x.vader_neutral + x.vader_positive - 1) < 0.0011 or x.vader_neutral == 0


def test_lexicon_guards(spark, lexicon):
    df = spark.createDataFrame([(1, "ok", 0.1)], "id int, text string, vader_compound double")
    with pytest.raises(ValueError):
        se.lexicon_scores(df, "text", lexicon)
    blank = spark.createDataFrame([(1, "  ")], "id int, text string")
    with pytest.raises(Exception):
        se.lexicon_scores(blank, "text", lexicon).collect()
    empty = spark.createDataFrame([], "id int, text string")
    out = se.lexicon_scores(empty, "text", lexicon)
    assert out.count() == 0 and "vader_label" in out.columns


def test_lexicon_output_checks(spark, lexicon):
    df = spark.createDataFrame([(1, "good day"), (2, "bad day")], "id int, text string")
    res = {r.check: r.status for r in qa.lexicon_output(se.lexicon_scores(df, "text", lexicon), df).collect()}
    assert set(res.values()) == {"pass"}


def test_model_scores_and_checks(spark):
    df = spark.createDataFrame([(1, "what?? really"), (2, "GREAT!!"), (3, "plain words here")], "id int, text string")
    out = se.model_scores(df, "text", se.char_profile_predictor, max_tokens=2)
    rows = {r.id: r for r in out.collect()}
    assert rows[3].roberta_truncated and rows[3].roberta_token_count == 3
    assert all(r.roberta_label in ("negative", "neutral", "positive") for r in rows.values())
    assert {r.status for r in qa.model_output(out).collect()} == {"pass"}


def test_resumable_scoring(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "scores")
    df = spark.createDataFrame([(i, f"text {i}") for i in range(10)], "id int, text string")
    assert se.score_resumable(df.where("id < 4"), id_col="id", text_col="text", out_path=out,
                              predictor=se.char_profile_predictor) == 4
    assert se.score_resumable(df, id_col="id", text_col="text", out_path=out,
                              predictor=se.char_profile_predictor) == 6
    assert se.score_resumable(df, id_col="id", text_col="text", out_path=out,
                              predictor=se.char_profile_predictor) == 0
    assert spark.read.parquet(out).select("id").distinct().count() == 10


def test_language_id(spark):
    df = spark.createDataFrame([(1, "el niño está aquí mañana"), (2, "hi"), (3, "this is plain english text")],
                               "id int, text string")
    r = {x.id: x for x in se.language_id(df, "text", se.script_detector).collect()}
    assert r[1].detected_language == "es" and r[2].detected_language == "und" and r[2].language_confidence is None
    bad = se.language_id(df, "text", lambda t: 1 / 0).collect()
    assert {x.detected_language for x in bad} == {"unknown", "und"}


def test_parse_replies(spark):
    df = spark.createDataFrame([(1, '```json\n[{"tweet": "a", "sarcasm": true}, {"stance": "favor"}]\n```'),
                                (2, "not json")], "id int, reply string")
    rows = an.parse_replies(df, "reply", keep=["id"]).collect()
    assert len(rows) == 2 and rows[0].sarcasm is True and rows[0].confidence == 0.9
    assert rows[1].stance == "favor" and rows[1].candidate_target == "other"


def test_streaming_hourly_matrix_matches_batch(spark, tmpdir_path):
    import datetime as dt
    from murmur.operators.temporal import time_matrix
    from murmur.streaming import jobs
    src = os.path.join(tmpdir_path, "src")
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=17 * i), float(i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, value double")
    df.repartition(3).write.parquet(src)
    batch = {r.timestamp_hourly: (r.volume, round(r.mean_sentiment, 9))
             for r in time_matrix(df, "ts", "value", id_col="event_id").collect()}
    t = jobs.stream_to_table(spark, "t", lambda: jobs.hourly_matrix_stream(
        jobs.file_stream(spark, src, df.schema), "ts", "value", id_col="event_id"), complete=True)
    stream = {r.timestamp_hourly: (r.volume, round(r.mean_sentiment, 9)) for r in t.collect()}
    assert stream == batch


def brute_lexicon(text, lexicon):
    """The published rules, token by token."""
    raw = (text or "").split()
    w = [t if len(t.strip(se.PUNCT)) <= 2 else t.strip(se.PUNCT) for t in raw]
    low = [t.lower() for t in w]
    ups = sum(t.isupper() for t in raw)
    cap = 0 < ups < len(raw)
    rules = {**{x: 1 for x in se.BOOST_UP}, **{x: -1 for x in se.BOOST_DOWN}}
    scores = []
    for i, t in enumerate(low):
        v = 0.0 if t in rules else lexicon.get(t, 0.0)
        if v and w[i].isupper() and cap:
            v += 0.733 if v > 0 else -0.733
        for k, damp in ((1, 1.0), (2, 0.95), (3, 0.9)):
            if not v or i < k:
                continue
            p = low[i - k]
            if p not in lexicon:
                s = 0.293 * rules.get(p, 0) * (1 if v > 0 else -1)
                if p in rules and w[i - k].isupper() and cap:
                    s += 0.733 if v > 0 else -0.733
                v += s * damp
            if v and (p in se.NEGATIONS or "n't" in p):
                v *= -0.74
        scores.append(v)
    if "but" in low:
        at = low.index("but")
        scores = [v * (0.5 if i < at else 1.5 if i > at else 1) for i, v in enumerate(scores)]
    marks, asks = (text or "").count("!"), (text or "").count("?")
    emphasis = min(marks, 4) * 0.292 + (0 if asks < 2 else asks * 0.18 if asks <= 3 else 0.96)
    total = sum(scores)
    total += emphasis if total > 0 else -emphasis if total < 0 else 0
    pos, neg = sum(v + 1 for v in scores if v > 0), sum(v - 1 for v in scores if v < 0)
    if pos > -neg:
        pos += emphasis
    elif pos < -neg:
        neg -= emphasis
    every = pos - neg + sum(not v for v in scores)
    share = [0.0] * 3 if not scores or not every else [-neg / every, sum(not v for v in scores) / every, pos / every]
    return [*share, total / (total * total + 15) ** 0.5 if scores else 0.0]


def test_lexicon_scores_against_brute_force(spark):
    import random
    rng = random.Random(4)
    words = {"good": 1.9, "bad": -2.5, "very": 0.7, "nope": -1.0, "great": 3.1, "meh": 0.0, "fine": 0.8}
    pool = ["good", "BAD", "great!", "(bad)", "very", "VERY", "not", "isn't", "shouldn't've", "but", "But,", "kinda", "SO", "the",
            "The", "hardly", "meh", "nope", "never", "?", "!!", "a", ":(", "fine...", "NOT", "I", "it's", "ÉTÉ", "x y", "DON'T"]
    texts = [" ".join(rng.choices(pool, k=rng.randrange(0, 14))) for _ in range(400)] + [None, "", " \n ", "good", "good bad good"] * 2
    df = spark.createDataFrame([(i % 7, t) for i, t in enumerate(texts)], "id int, text string")
    lex = spark.createDataFrame([(w.upper(), v) for w, v in words.items()], "word string, valence double")
    got = se.lexicon_scores(df, "text", lex, check_blank=False).collect()
    assert len(got) == len(texts)
    seen = {}
    for r in got:
        seen.setdefault(r.text, set()).add((r.vader_negative, r.vader_neutral, r.vader_positive, r.vader_compound))
    for t in texts:
        (one,) = seen[t]
        want = brute_lexicon(t, words)
        assert all(abs(a - b) <= 0.00051 for a, b in zip(one[:3], want[:3])) and abs(one[3] - want[3]) <= 0.000051, t


def test_lexicon_scores_without_broadcast(spark, lexicon):
    df = spark.createDataFrame([(1, "a very good day, not bad"), (2, "HATE it")], "id int, text string")
    a = {r.id: r for r in se.lexicon_scores(df, "text", lexicon).collect()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {r.id: r for r in se.lexicon_scores(df, "text", lexicon).collect()} == a
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("known", [0, 4, 500])
def test_lexicon_too_large_for_a_broadcast(spark, lexicon, known, monkeypatch):
    """Words beyond the broadcast ones are looked up by shuffle, as narrow rows."""
    import random
    rng = random.Random(known)
    pool = ["good", "BAD", "great!", "(bad)", "very", "VERY", "not", "isn't", "but", "But,", "kinda", "SO", "the", "hardly", "HATE",
            "sad...", "never", "?", "!!", "NOT", "nice", "Terrible", "win"]
    texts = [" ".join(rng.choices(pool, k=rng.randrange(0, 16))) for _ in range(200)] + [None, "", "good good", "x"] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    columns = ["id", *se.LEX_COLS]
    whole = {r.id: r for r in se.lexicon_scores(df, "text", lexicon, check_blank=False).select(columns).collect()}
    monkeypatch.setattr(se, "fits_broadcast", lambda *a: False)
    monkeypatch.setattr(se, "KNOWN", known)
    assert {r.id: r for r in se.lexicon_scores(df, "text", lexicon, check_blank=False).select(columns).collect()} == whole


def test_no_fat_token_rows_where_the_lexicon_is_large(spark, lexicon, monkeypatch):
    """What is shuffled of a token beyond the broadcast words is its word, its
    row and its states, never its neighbours or the digest of its text."""
    df = spark.createDataFrame([(1, "a very good day, not BAD"), (2, "hate it")], "id int, text string")
    monkeypatch.setattr(se, "fits_broadcast", lambda *a: False)
    plan = se.lexicon_sums(df, F.col("text"), lexicon)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "_code" in plan and "Generate" not in plan and not any(f"{t}#" in plan for t in ("t1", "t2", "t3", "raw"))


def test_labels_go_to_the_texts(spark, tmpdir_path):
    from murmur.plans import q_models
    spark.createDataFrame([(i, "a word or two") for i in range(9)], "doc_id bigint, text string").write.parquet(f"{tmpdir_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(7)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmpdir_path}/labels.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")     # what the planner itself would not broadcast
    try:
        lex = q_models.lexicon(spark, tmpdir_path)
        plan = lex._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert {r.word: r.valence for r in lex.collect()} == {w: 2.0 for w in ("a", "word", "or", "two")}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
