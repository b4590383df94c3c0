"""The reliability run and the lexicon scorer shuffle no texts and no tokens."""

from pyspark.sql import functions as F

from murmur.operators import profilers as pf
from murmur.operators import sentiment as se


def test_digests_and_facts_stand_for_the_texts(spark):
    rows = [(i, t, u) for i, (t, u) in enumerate([("a #b http://x.y", "p"), ("A #B", "q"), ("a #b http://x.y", "q"), (None, None), ("", "p")])]
    df = spark.createDataFrame(rows, "i int, body string, who string")
    whole = pf.duplicate_amplification(pf.textual_evidence(df, "body"), "body", "who").drop("body")
    digests = pf.duplicate_digests(F.col("body"))
    held = df.withColumns({**pf.textual_facts(F.col("body")), **{f"_k{k}": c for k, c in digests.items()}}).drop("body")
    narrow = pf.digested_amplification(pf.textual_risks(held), {k: F.col(f"_k{k}") for k in digests}, "who")
    names = sorted(whole.columns)
    assert sorted(map(str, whole.select(names).collect())) == sorted(map(str, narrow.select(names).collect()))


def test_run_holds_no_text_and_keeps_the_canonical_columns(spark, tmpdir_path):
    from murmur.operators import quality as qa
    from murmur.plans import q_reliability as q
    spark.createDataFrame([(1, "a\nTexas", "en", "s"), (2, None, None, "t"), (None, "x", "de", None)],
                          "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmpdir_path}/documents.parquet")
    held = q.facts(spark, tmpdir_path)
    assert not {"text", "user_loc"} & set(held.columns)
    assert {r.doc_id: r.matched_state for r in held.collect()} == {1: "TX", 2: None, None: None}
    (check,) = qa.canonical_unchanged(q.canonical(spark, tmpdir_path), q.with_texts(held, spark, tmpdir_path), q.CANONICAL).collect()
    assert check.status == "pass" and check.detail == "3/3"


def test_tokens_are_looked_up_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, "good, but not VERY bad"), (2, "x")], "id int, text string")
    lex = spark.createDataFrame([("good", 1.5), ("bad", -2.0)], "word string, valence double")
    plan = se.lexicon_sums(df, F.col("text"), lex)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    got = {r._n: (r._hits, r._rows) for r in se.lexicon_sums(df, F.col("text"), lex).collect()}
    assert got == {5: (2, 1), 1: (0, 1)}
