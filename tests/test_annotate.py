from pyspark.sql import functions as F

from murmur.operators import annotate as an


def test_representatives_never_reuse_a_row(spark):
    df = spark.createDataFrame([(1, -0.9), (2, -0.5), (3, 0.0), (4, 0.7)], "id int, s double")
    cases = [("lowest", F.lit(True), F.col("s")),
             ("also_lowest", F.lit(True), F.col("s")),        # must skip id 1, take id 2
             ("highest", F.lit(True), -F.col("s"))]
    got = {r.case: r.id for r in an.representatives(df, cases, "id").collect()}
    assert got == {"lowest": 1, "also_lowest": 2, "highest": 4}
    assert "_case" not in an.representatives(df, cases, "id").columns


def test_prompt_batches_chunking(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(45)], "id long, text string")
    b = an.prompt_batches(df, id_col="id", text_col="text", chunk_size=20).orderBy("chunk").collect()
    assert [r.n_texts for r in b] == [20, 20, 5]
    assert b[0].ids == list(range(20)) and 'Text 1: "text 0"' in b[0].prompt


def test_seed_pick_bounded(spark):
    rows = [(i, "a" if i % 2 else "b", (i % 10) / 10.0) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, cell string, p double")
    out = an.seed_pick(df, id_col="id", cells=["cell"], score="p", total=3).collect()
    assert len(out) == 3 and len({r.id for r in out}) == 3
