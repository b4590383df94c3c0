"""The checks of the lexicon scores count documents without a text too."""

from murmur.plans.catalog import QUERIES


def documents(spark, folder):
    rows = [(i, t) for i, t in enumerate(["good day", None, "", "  ", "a bad day!"])]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_lexicon_output_counts_blank_texts(spark, tmpdir_path):
    documents(spark, tmpdir_path)
    got = {r.check: (r.status, r.detail) for r in QUERIES["chk_03_lexicon_output"](spark, tmpdir_path).collect()}
    assert len(got) == 7 and got.pop("rows_preserved") == ("pass", "5")
    assert set(got.values()) == {("pass", "0")}


def test_rescoring_counts_blank_texts(spark, tmpdir_path):
    documents(spark, tmpdir_path)
    got = {r.check: (r.status, r.detail) for r in QUERIES["chk_06_09_closure_and_rescoring"](spark, tmpdir_path).collect()}
    assert got == {"score_reproduced": ("pass", "0"), "label_reproduced": ("pass", "0"), "row_counts_reconcile": ("pass", "5/5")}
