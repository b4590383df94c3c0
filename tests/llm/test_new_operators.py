"""Operators 11 to 13 against brute force: odd rows, ties, empty tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

DOCS = "doc_id bigint, text string, lang string, source string"


def got(df):
    return [r.asDict() for r in df.collect()]


# ---- 11 -----------------------------------------------------------------
def brute_divergence(rows, least=3, top=200):
    docs = [(la or "", s or "", re.findall("[a-zA-Z\x80-\U0010ffff]+", t or "")) for t, la, s in rows]
    docs = [(la, s, [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in ws]) for la, s, ws in docs]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(w for d in mine for w in set(d[2]))
        kept = [w for w in df if df[w] >= least]

        def shares(counts):
            total = sum(counts[w] for w in kept)
            return {w: 1 + 10 ** 9 * (counts[w] + 1) // (total + len(kept)) for w in kept}
        by_source = defaultdict(Counter)
        for _, s, ws in mine:
            by_source[s].update(ws)
        p = {s: shares(c) for s, c in by_source.items()}
        q = shares(sum(by_source.values(), Counter()))
        for s in p:
            pairs = [(sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o) for o in p if o != s]
            terms = [((p[s][w] - q[w]) ** 2 // q[w], w) for w in kept if by_source[s][w] and p[s][w] > q[w]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found[:limit])]
    return sorted(out)


def as_rows(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in got(df))


def corpus():
    rng = random.Random(3)
    names = ["Alpha", "beta", "naïve", "Ünï", "日本", "x", "don't", "a1b", "Zoë tail", "İx"]
    rows = [(" ".join(rng.choices(names, k=rng.randrange(0, 12))), rng.choice(["en", "de"]), f"s{rng.randrange(4)}")
            for _ in range(60)]
    rows += [(None, "en", "silent"), ("", None, None), ("alpha beta", None, "s1"), ("12 34 !!", "fr", "s1"),
             ("rare words only", "fr", "s2"), ("Alpha " * 500, "en", "s1"), ("alone", "it", "s1")]
    return rows + rows[:3]


def test_divergence_is_brute_force(spark, monkeypatch):
    from murmur.llm import divergence
    rows = corpus()
    df = spark.createDataFrame([(i % 5 or None, t, la, s, "en", 1) for i, (t, la, s) in enumerate(rows)],
                               DOCS + ", term string, p int")
    want = brute_divergence(rows)
    assert as_rows(divergence.divergence(df)) == want
    assert {r[4] for r in want if r[0] == "fr"} == {0}
    monkeypatch.setattr(divergence, "BUCKET_TERMS", 2)
    monkeypatch.setattr(divergence, "TOP_TERMS", 2)
    assert as_rows(divergence.divergence(df)) == brute_divergence(rows, top=2)
    assert got(divergence.divergence(df.limit(0))) == []


def test_divergence_blocks_and_slices_change_nothing(monkeypatch):
    import pandas as pd
    from murmur.llm import divergence
    text = ("ab, Cd\tef é1 " * 300).encode()
    whole = divergence.term_counts(text)
    monkeypatch.setattr(divergence, "SLICE", 50)
    assert divergence.term_counts(text) == whole == Counter({b"ab": 300, b"cd": 300, b"ef": 300, "é".encode(): 300})
    rows = pd.DataFrame({"term": [None, None, "a", "b", "b", "c"], "source": ["y", "x", "x", "x", "y", "y"],
                         "p": [3, 5, 900, 20, 7, 70]})
    first = divergence._pair_sums(("en", 0), rows)
    monkeypatch.setattr(divergence, "_CELLS", 2)
    assert divergence._pair_sums(("en", 0), rows).equals(first)
    assert dict(zip(first["source"], first["value"])) == {
        "x": 897 ** 2 // 3 + 13 ** 2 // 7 + 65 ** 2 // 70, "y": 897 ** 2 // 900 + 13 ** 2 // 20 + 65 ** 2 // 5}
    held = monkeypatch.setattr(divergence, "HELD_TERMS", 3)
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 4, "source": ["s"] * 4, "text": ["a b", "a c", "a d e", "f"]})
    out = pa.Table.from_batches(divergence._count(iter([batch]))).to_pandas()
    assert held is None and out[out["term"] == "a"][["n", "docs"]].sum().tolist() == [3, 3]


# ---- 12 -----------------------------------------------------------------
@pytest.mark.parametrize("n,kind", [(1, "one"), (2, "two"), (40, "random"), (40, "clusters"), (30, "split"), (12, "low")])
def test_leading_components_against_eigh(n, kind):
    from murmur.llm.whitening import below, leading_components, tridiagonal
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(n, n)))
    e = {"clusters": np.repeat([9.0, 9.0 + 1e-13, 4.0, 1.0], n // 4), "low": np.r_[5.0, 2.0, 1.0, np.zeros(max(n - 3, 0))],
         "split": np.arange(1.0, n + 1)}.get(kind, rng.uniform(0.1, 50, n))
    a = np.diag(e) if kind == "split" else (q * e) @ q.T
    a = (a + a.T) / 2
    k = min(n, 16)
    values, x = leading_components(a, k)
    want, vectors = np.linalg.eigh(a)
    want, vectors = want[::-1][:k], vectors[:, ::-1][:, :k]
    assert np.allclose(values, want, rtol=0, atol=1e-13 * want[0])
    assert np.allclose(x.T @ x, np.eye(k), atol=1e-12)
    assert np.abs(a @ x - x * values).max() < 1e-12 * want[0]
    if kind == "random":
        assert np.abs(np.abs((x * vectors).sum(axis=0)) - 1).max() < 1e-12
    d, o, _ = tridiagonal(a)
    for at in (0.05, 1.5, 4.5, 20.0):
        assert below(d, o, np.array([at]))[0] == (np.linalg.eigvalsh(a) < at).sum()


def brute_whitening(vectors, k=32):
    x = np.array([[int(np.floor(64 * float(c))) + 1000000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    y = n * x - s
    centred = (y / n).astype(float)
    cov = centred.T @ centred / n
    e, w = np.linalg.eigh(cov)
    e, w = e[::-1][:k], w[:, ::-1][:, :k]
    return [int((r * r).sum()) for r in y], centred @ w / np.sqrt(e), e / np.trace(cov)


def test_whitening_is_brute_force(spark):
    from murmur.llm import whitening
    rng = np.random.default_rng(1)
    base = (rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) * 3 + 10).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(7, rows[7][1]), (None, rows[9][1])]
    odd = [(900, None), (901, []), (902, [1.0, None, 2.0, 3.0, 4.0]), (903, [1.0, float("nan"), 2.0, 3.0, 4.0]),
           (904, [float("inf")] * 5), (905, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x", 3) for i, v in rows + odd],
                               "vec_id bigint, embedding array<float>, component string, n int").repartition(3)
    out = got(whitening.whiten(df))
    deviation, white, explained = brute_whitening([v for _, v in rows])
    assert len(out) == len(rows) * 5 and {r["n"] for r in out} == {len(rows)}
    assert max(r["identity_error"] for r in out) < 1e-10
    for c in range(5):
        mine = sorted((-1 if r["vec_id"] is None else r["vec_id"], r["whitened"], r["deviation"], r["explained"])
                      for r in out if r["component"] == c + 1)
        want = sorted((-1 if i is None else i, w, d) for (i, _), w, d in zip(rows, white[:, c], deviation))
        sign = np.sign(np.dot([r[1] for r in mine], [r[1] for r in want])) or 1
        if sign < 0:
            want = sorted((i, -w, d) for i, w, d in want)
        assert np.allclose([r[1] for r in mine], [r[1] for r in want], atol=1e-9)
        assert [r[0] for r in mine] == [r[0] for r in want] and [r[2] for r in mine] == [r[2] for r in want]
        assert abs(mine[0][3] - explained[c]) < 1e-10
    assert len(got(whitening.whiten(df, components=2))) == 2 * len(rows)


def test_whitening_without_spread(spark):
    from murmur.llm import whitening
    schema = "vec_id bigint, embedding array<double>"
    assert got(whitening.whiten(spark.createDataFrame([], schema))) == []
    assert got(whitening.whiten(spark.createDataFrame([(1, None), (2, [float("nan")])], schema))) == []
    assert got(whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema))) == []
    # one direction varies: one component; entries may be huge
    flat = got(whitening.whiten(spark.createDataFrame([(1, [1.0, 5.0]), (2, [2.0, 5.0]), (3, [3.0, 5.0])], schema)))
    assert [(r["component"], round(abs(r["whitened"]), 9)) for r in sorted(flat, key=lambda r: r["vec_id"])] == [
        (1, round(1.5 ** 0.5, 9)), (1, 0.0), (1, round(1.5 ** 0.5, 9))]
    huge = got(whitening.whiten(spark.createDataFrame([(1, [1e300]), (2, [-1e300]), (3, [0.5])], schema)))
    assert len(huge) == 3 and all(np.isfinite(r["whitened"]) for r in huge) and huge[0]["deviation"] is None
    # lengths tie: the longer one stays
    tie = got(whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [1.0, 0.0]), (4, [2.0, 0.0])], schema)))
    assert {r["vec_id"] for r in tie} == {3, 4}


# ---- 13 -----------------------------------------------------------------
TEXTS = [None, "", " ", "Hello world", "don't we'll  I'M 12 345 !!  \n\n x\t\ty ", "naïve 日本語 \U0001F600\U0001F600 कि ՘ x y",
         "a<|endoftext|>b <|endoftext|><|endoftext|> <|endoftext|", "word " * 3000, "x" * 5000, "ὠ0꟎ 1  　z",
         "'s 're 'x ''s", "\x1c\x1d a\x85b  c", "tab\t\t\tend \r\n\r\n", "Zwölf Boxkämpfer jagen Viktor", "word " * 3000]


def tokenizer():
    import public_tokenizers as P
    from tokenizers import Tokenizer
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("entries", [0, 5, 100_000])
def test_token_counts_are_the_library_s(spark, monkeypatch, entries):
    from murmur.llm import token_counts
    monkeypatch.setattr(token_counts, "DICTIONARY", max(entries, 1))
    if not entries:
        monkeypatch.setattr(token_counts, "ENTRY_BYTES", 0)
    df = spark.createDataFrame([(i if i != 3 else None, t, "k", 9) for i, t in enumerate(TEXTS)] + [(1, "again", "k", 9)],
                               "doc_id bigint, text string, key string, n int")
    t = tokenizer()
    want = sorted(((-1 if i == 3 else i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 512)
                   for i, x in [*enumerate(TEXTS), (1, "again")]))
    out = got(token_counts.token_counts(df))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out) == want
    assert got(token_counts.token_counts(df.limit(0))) == []


def test_token_counts_slices_and_classes(monkeypatch):
    import public_tokenizers as P
    from murmur.llm import token_counts
    config = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()
    split = token_counts.Splitter(config)
    t = tokenizer()
    rng = random.Random(8)
    texts = ["".join(rng.choices(" \n\t'ab1!é日\U0001F600s", k=200)) for _ in range(200)] + ["x" * 300, " " * 300]
    monkeypatch.setattr(token_counts, "SLICE", 7)
    for x in texts:
        words, special = split.counts(x)
        assert sum(n * p for n, p in zip(words.values(), split.pieces(list(words)))) + special == len(t.encode(x).ids)
    # the pattern engine and the library class these code points alike
    for c in range(0x10000):
        ch = chr(c)
        if not 0xD800 <= c < 0xE000 and not token_counts._ALIKE.search(ch):
            s = f"a{ch}1{ch}!{ch} {ch} x"
            assert split.find(s) == [s[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(s)], hex(c)


def test_queries_run_over_their_tables(spark):
    import __spark_entry__ as entry
    from murmur.sources.tables import table
    sf = "/root/testdata/sf0.001"
    q = entry.queries()
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    t = tokenizer()
    counts = got(q["op13_token_counts"](spark, sf))
    assert len(counts) == len(texts)
    assert all(r["n_tokens"] == len(t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids) for r in counts)
    rows = table(spark, sf, "documents").select("text", "lang", "source").collect()
    assert as_rows(q["op11_source_divergence"](spark, sf)) == brute_divergence([tuple(r) for r in rows])
    vectors = {r["vec_id"]: r["embedding"] for r in table(spark, sf, "embeddings").collect()}
    white = got(q["op12_whitening"](spark, sf))
    assert len(white) == 32 * len(vectors)
    deviation, _, explained = brute_whitening(list(vectors.values()))
    assert {r["vec_id"]: r["deviation"] for r in white} == dict(zip(vectors, deviation))
    assert max(abs(r["explained"] - explained[r["component"] - 1]) for r in white) < 1e-12
