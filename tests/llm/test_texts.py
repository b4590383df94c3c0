"""Hash collisions, clashing names, long rows, folds: operators 1, 4 to 7, 9, 10 and the pipeline."""

import hashlib
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import DOCS, MAIL, base_spans, brute_lm, components, frame, got


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048])
def test_thue_morse_words_have_hashes_of_their_own(spark, n):
    import base64
    import public_tokenizers as P
    import tiktoken
    from murmur.llm import bpe, near_dedup, ngram_lm
    from murmur.llm.common import word_hashes
    one = thue_morse(n)
    other = one.translate(str.maketrans("ab", "ba"))
    hashes, _ = word_hashes([one.encode(), other.encode()])
    assert len(set(hashes.tolist())) == 2
    docs = frame(spark, [(0, one, "en", "s"), (1, other, "en", "s"), (2, f"{one} {other}", "en", "s"),
                         (3, " ".join([one] * 9), "en", "s"), (4, " ".join([other] * 9), "en", "s")]).coalesce(1)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in got(docs)}
    assert all(r["ids"] == enc.encode_ordinary(texts[r["doc_id"]]) for r in got(bpe.encode(docs)))
    by = {r["doc_id"]: r["component_id"] for r in got(near_dedup.near_duplicates(docs))}
    assert by == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4}
    want = sorted(brute_lm(sorted(texts.items())))
    out = sorted(tuple(r) for r in ngram_lm.scored(docs).collect())
    assert [r[:5] for r in out] == [r[:5] for r in want] and [r[6] for r in out] == pytest.approx([r[6] for r in want])


def test_byte_coder_survives_equal_hashes(monkeypatch):
    import public_tokenizers as P
    import tiktoken
    from murmur.llm import bpe
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    # a first hash of five values: nearly everything collides
    real = bpe.run_hash_pairs
    monkeypatch.setattr(bpe, "run_hash_pairs", lambda *a: [real(*a)[0] % np.uint64(5), real(*a)[1]])
    coder = bpe.Coder(ranks, P.PATTERN)
    texts = ["hello world, hello there", "the cat sat on the mat", "", "another text 123 with naïve words 日本"]
    for _ in range(2):
        flat, n = coder.encode(texts)
        assert flat.tolist() == [i for t in texts for i in enc.encode_ordinary(t)]
        assert coder.decode(flat, np.concatenate([[0], np.cumsum(n)])) == [t.encode() for t in texts]


def test_hashes_do_not_depend_on_windows(monkeypatch):
    from murmur.llm import common
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 100, int(n)).astype(np.uint8)) + b" x " for n in rng.integers(0, 400, 30)]
    whole, first = common.word_hashes(texts)
    values, ends = rng.integers(0, 60_000, 500).astype(np.int32), np.sort(rng.integers(0, 500, 40))
    starts = np.concatenate([[0], ends[:-1]])
    runs = common.run_hashes(values, starts, ends)
    monkeypatch.setattr(common, "_WINDOW", 7)
    assert (common.word_hashes(texts)[0] == whole).all() and (common.run_hashes(values, starts, ends) == runs).all()
    monkeypatch.setattr(common, "_PLACES", 16)
    assert (common.word_hashes(texts)[0] == whole).all()
    for k in range(len(texts)):  # a word's hash does not depend on its place
        assert (common.word_hashes([texts[k].upper()])[0] == whole[first[k]:first[k + 1]]).all()


# ---- names --------------------------------------------------------------
NAMES = ["_lang", "_score", "_letter", "_base", "_null", "_digit", "_email", "_ip", "_card", "_phone", "_m", "_p", "_spans", "_wide",
         "_found", "_new", "_row", "_domain", "_tokens", "_name", "_md5", "_epoch", "_source", "_whole", "_left", "_cut", "_limit",
         "domain", "tokens", "epoch", "k", "r", "row", "least", "first", "count", "kept", "component_id", "n_shingles", "lang_pred",
         "score", "n", "bands", "bucket", "after", "held", "t", "s", "x"]


def test_columns_of_any_name_come_through_the_pipeline(spark, tmp_path):
    import corpus_pipeline as P
    rng = np.random.default_rng(3)
    sets = {"en": "the of and ing tion with", "de": "der und sch ung nicht ein"}
    rows = [(i, " ".join(rng.choice(sets[la].split(), 50)) + (" jo@x.com" if i % 5 == 0 else ""), la, f"src{i % 3}")
            for i, la in enumerate(["en", "de"] * 30)]
    rows += [(7, "die der und ung", "de", "src1"), (None, "the of and", "en", "src2")]
    docs = frame(spark, rows)
    docs = docs.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c)
                              for c in NAMES])
    for k, (name, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        out.write.parquet(path := str(tmp_path / name))
        docs = spark.read.parquet(path)
        kept = got(docs)
        assert len(kept) > 20, name
        for r in kept:
            assert all(r[c] == f"{c}:{'none' if r['doc_id'] is None else r['doc_id']}" for c in NAMES), name
    assert any("[EMAIL]" in r["text"] for r in kept)
    assert len(got(P.STAGES[-1][1](spark, docs, ""))) == len(kept)


def test_mix_keeps_columns_it_adds(spark):
    from murmur.llm import mixing
    docs = frame(spark, [(i, "w " * 5, "en", "src1") for i in range(8)]).withColumn("domain", F.lit("mine")).withColumn("_epoch", F.lit(3))
    out = mixing.mix(docs, share=1.0)
    assert out.columns == [*docs.columns, "_domain", "epoch", "tokens"]
    assert {(r["domain"], r["_epoch"], r["_domain"], r["tokens"]) for r in got(out)} == {("mine", 3, "books", 5)}


# ---- 6 ------------------------------------------------------------------
def test_personal_data_of_a_text_with_many_matches(spark):
    from murmur.llm import pii
    rng = np.random.default_rng(5)
    parts = ["10.0.0.7 ", "a@b.com, ", "415-555-2671 ", "x 4539148803436467 ", "call (415) 555-2671; ", "1.2.3 ", "jo (at) mail (dot) org "]
    text = "".join(rng.choice(parts, 10_000))
    want = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base_spans(text)]
    df = frame(spark, [(1, text, "en", "s"), (2, text[:900], "en", "s")])
    weights = pii.train(df)
    out = {r["doc_id"]: r for r in got(pii.find(df))}
    assert out[1]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
    # spans of the short text are those of the long one that end within it
    inside = [x for x in out[1]["spans"].split(",") if int(x.split(":")[2]) < 880]
    assert [x for x in out[2]["spans"].split(",") if int(x.split(":")[2]) < 880] == inside
    # no added span overlaps a base one
    spans = [tuple(map(int, x.split(":")[1:])) for x in out[1]["spans"].split(",")]
    base = {tuple(map(int, x.split(":")[1:])) for x in want}
    stop = 0
    for a, b in sorted(spans):
        assert a >= stop or (a, b) in base
        stop = max(stop, b)
    many = frame(spark, [(1, "10.0.0.7 " * 40_000, "en", "s")])
    spans_of = pii.with_personal_spans(many.select("doc_id", "text"), weights).select(F.size("_spans").alias("n"))
    assert got(spans_of)[0]["n"] == 40_000
    began = time.time()
    assert got(spans_of)[0]["n"] == 40_000
    assert time.time() - began < 10
    red = got(pii.redact(df))
    plain, pos = [], 0
    for x in out[1]["spans"].split(","):
        kind, a, b = x.split(":")
        if int(a) >= pos:
            plain += [text[pos:int(a)], f"[{kind.upper()}]"]
        pos = max(pos, int(b))
    assert next(r["text"] for r in red if r["doc_id"] == 1) == "".join(plain) + text[pos:]


def test_redaction_is_exact_around_piece_borders(spark):
    from murmur.llm import pii
    rows = [(i, "é" * (1000 + i) + " " + MAIL + " " + "\U0001F600" * (2050 - i), "en", "s") for i in range(0, 60, 3)]
    by = {r["doc_id"]: r["text"] for r in got(pii.redact(frame(spark, rows)))}
    done = "write to [EMAIL] or call [PHONE] now, card [CARD], host [IP]."
    assert all(by[i] == t.replace(MAIL, done) for i, t, _, _ in rows)


def test_context_and_neighbours_are_the_characters_beside(spark):
    from murmur.llm import pii
    text = "call 415-555-2671, version 415-555-2672; x=415-555-2673 phone:(415) 555-2674(415) 555-2675 415-555-2676y"  # no number begins in another
    row = got(pii.candidates(pii.base_spans(frame(spark, [(1, text, "en", "s")]).select("text"))).select("_wide"))[0]["_wide"]
    seen = {text[r["start"]:r["stop"]][-4:]: (r["context"], r["neighbours"]) for r in row}
    assert seen == {"2671": (1, 0), "2672": (-1, 0), "2673": (-1, -1), "2674": (1, 0), "2676": (0, -1)}


def test_classifier_uses_the_features_of_spans():
    from murmur.llm import pii
    # the same votes with another size; the votes of the other patterns tell them apart
    weights = pii.estimate([(3, 0, 1, 1, 1, 0, 1, 3, 80), (3, 0, -1, -1, -1, -1, 0, 1, 80), (3, 0, 1, -1, 0, 0, 1, 3, 9),
                            (3, 0, 1, -1, 0, 0, 0, 1, 9)])[3]
    size = weights[6:10]
    assert len(weights) == 14 and size[1] > size[0] and size[2] == size[3] == 0


# ---- 5 and 10: folds ----------------------------------------------------
def test_languages_are_learnt_from_the_other_folds(spark, monkeypatch):
    from murmur.llm import langid
    rng = np.random.default_rng(7)
    sets = {"en": "the of and ing tion with", "de": "der und sch ung nicht ein"}
    rows = [(i, " ".join(rng.choice(sets[la].split(), 40)), la, "s") for i, la in enumerate(["en", "de"] * 60)]
    # a language that only the held-out fold has is never learnt
    rows += [(i, "les eau que ment", "fr", "s") for i in range(500, 900) if zlib.crc32(str(i).encode()) % 5 == 0]
    rows += [(3, None, "en", "s"), (4, "123", "de", "s"), (None, "the of and", None, "s"), (5, "der und", "de", "s")]
    seen = []
    real = langid.fit
    monkeypatch.setattr(langid, "fit", lambda d, **k: (seen.extend(r["doc_id"] for r in d.collect()), real(d, **k))[1])
    out = got(langid.language_of_documents(frame(spark, rows)))
    fold = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5
    assert Counter(seen) == Counter(i for i, *_ in rows if fold(i) != 0)
    assert Counter((r["doc_id"], r["held_out"]) for r in out) == Counter((i, fold(i) == 0) for i, *_ in rows)
    right = [r["lang_pred"] == ["en", "de"][r["doc_id"] % 2] for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 120
             and r["doc_id"] > 5]
    assert np.mean(right) > 0.9 and "fr" not in {r["lang_pred"] for r in out}
    assert langid.language_of_documents(frame(spark, []))  .collect() == []


def test_training_windows_are_drawn_from_whole_texts(spark, monkeypatch):
    from murmur.llm import langid
    text = "a" * 5000 + "b" * 5000
    kept = []
    monkeypatch.setattr(langid.Network, "train", lambda self, x, label, **k: kept.append((x, label)))
    langid.fit(frame(spark, [(i, f"{i} {text} {i}", la, "s") for i in range(60) for la in ("en", "de")]))
    x, _ = kept[0]
    assert (x == 97).any() and (x == 98).any() and x.shape[0] <= 2 * 120 * (langid.TRAIN_BYTES // langid.WINDOW + 1)


def test_toxicity_of_documents_against_a_plain_machine(spark):
    from murmur.llm import toxicity as tox
    rng = np.random.default_rng(10)
    plain = "river stone market window garden letter simple yellow travel number morning winter".split()
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " ".join(rng.permutation([*rng.choice(plain, 20), *(["blockhead"] if bad else [])])), "en", "s"))
        if i % 3:
            labels.append((i, 1, int(bad)))
    rows += [(1000, None, None, None), (None, "blockhead", "en", "s"), (5, "a second text of five", "en", "s")]
    labels += [(7, 0, 1), (7, 0, 0), (None, 1, 1), (8, 0, None), (9999, 1, 0)]
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    fold = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 4
    out = got(tox.toxicity(docs, marks))
    assert Counter((r["doc_id"], r["held_out"]) for r in out) == Counter((i, fold(i) == 2) for i, *_ in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in held]) > 0.95
    # the same model from the rows that the labels of the other folds name
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, []).append(t or "")
    learn = sorted({(t, x) for i, _, x in labels if i is not None and x is not None and fold(i) != 2 for t in texts.get(i, [])})
    share = np.mean([x for i, _, x in labels if i is not None and x is not None and fold(i) != 2])
    model = tox.trained(learn, float(share))
    want = {t: float(model.scores([t.encode()])[0]) for t in {t for ts in texts.values() for t in ts}}
    assert {round(r["score"], 4) for r in out} <= {round(v, 4) for v in want.values()} or max(
        abs(r["score"] - np.mean([want[t] for t in texts[r["doc_id"]]])) for r in out if len(texts[r["doc_id"]]) == 1) < 0.05
    assert got(tox.toxicity(docs.limit(0), marks)) == []
    assert {r["score"] for r in got(tox.toxicity(docs, marks.limit(0)))} == {0.0}


def test_toxicity_draws_on_labels_alone(spark):
    from murmur.llm import toxicity as tox
    rows = [(i, int(i % 50 == 0)) for i in range(20_000)]
    few, share = tox.drawn(spark.createDataFrame(rows, "doc_id bigint, toxic int"), "doc_id")
    kinds = Counter(r["toxic"] for r in few)
    assert share == 0.02 and kinds[1] == 400 and 0.9 * tox.PER_LABEL < kinds[0] < 1.1 * tox.PER_LABEL
    assert tox.drawn(spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int"), "doc_id") == ([], 1.0)
