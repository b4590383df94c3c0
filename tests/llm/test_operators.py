"""Small fixtures against brute force: odd rows, ties, empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
MAIL = "write to jo@mail.example.com or call +1 (555) 555-7713 now, card 4539 1488 0343 6467, host 10.0.0.255."
BASE = " ".join(f"word{i}" for i in range(120))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, la, s, None if t is None else len(t)) for i, t, la, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, BASE, "en", "src1"), (2, BASE, "en", "src1"), (3, BASE + " tail", "en", None),
            (4, None, None, None), (5, "", "de", "src2"), (6, " \n\t ", "de", "src2"), (7, "Hello", None, "src3"),
            (8, MAIL, "en", "src1"), (None, "no id here at all", "en", "src1"), (9, "x" * 6000, "fr", "src4"),
            (10, "die der und " * 4000, "de", "src2"), (11, "日本語 \U0001F600 naïve x  y", "fr", "src4"),
            (12, "123 456 !!", "en", "src1"), (8, MAIL, "en", "src1")]
    # an extra column, as joined tables have
    return frame(spark, rows).withColumn("score", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1.0))


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def got(df):
    return [r.asDict() for r in df.collect()]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles(t):
    w = words(t)
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


# ---- 1 ------------------------------------------------------------------
def test_bpe_is_tiktoken_and_decodes_back(odd, none):
    import base64
    import public_tokenizers as P
    import tiktoken
    from murmur.llm import bpe
    ranks = {base64.b64decode(a): int(b) for a, b in
             map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {(r["doc_id"], r["text"] or "") for r in got(odd)}
    seen = got(bpe.decode(bpe.encode(odd)))
    assert len(seen) == 14
    by_id = {r["doc_id"]: r for r in seen}
    for i, t in texts:
        assert by_id[i]["ids"] == enc.encode_ordinary(t)
        assert bytes(by_id[i]["decoded"]) == t.encode()
    for r in got(bpe.round_trip(odd)):
        t = next(t for i, t in texts if i == r["doc_id"])
        ids = enc.encode_ordinary(t)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert got(bpe.round_trip(none)) == []


def test_bpe_long_words_in_position_rows(monkeypatch):
    import public_tokenizers as P
    import tiktoken
    from murmur.llm import bpe
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(bpe, "LONG_WORD", 2)
    coder = bpe.Coder(ranks, P.PATTERN)
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abané\n 's1."), rng.integers(0, 25))) for _ in range(40)] + ["a" * 300, "ab" * 90]
    flat, n = coder.encode(texts)
    assert flat.tolist() == [i for t in texts for i in enc.encode_ordinary(t)]


def test_bpe_rejects_unknown_ids(spark):
    from murmur.llm import bpe
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [999_999])], "doc_id bigint, ids array<int>")).collect()


# ---- 2 ------------------------------------------------------------------
def test_fingerprints_against_the_next_document(odd, none, spark):
    from murmur.llm import fingerprints as fp
    rows = sorted(((r["doc_id"], r["text"] or "") for r in got(odd)),
                  key=lambda x: (x[0] is not None, x[0] or 0, x[1]), reverse=True)
    out = got(fp.against_next(odd))
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in rows)
    want = Counter((i, len(t), hashlib.sha256(fp.edited(t, u).encode()).hexdigest())
                   for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]))
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out) == want
    by = {r["doc_id"]: r for r in out}
    assert by[1]["fingerprint"] == by[2]["fingerprint"]
    assert by[2]["near_next"] == 1.0 and by[3]["near_next"] > 0.9
    assert all(0 <= r["near_edited"] <= 1 for r in out)
    assert got(fp.against_next(none)) == []


def test_similar_pairs_are_verified(odd):
    from murmur.llm import fingerprints as fp
    pairs = {(r["a"], r["b"]): r["jaccard"] for r in got(fp.similar_pairs(odd))}
    assert pairs[(1, 2)] == 1.0
    assert pairs[(1, 3)] == pytest.approx(116 / 117)
    assert set(pairs) == {(1, 2), (1, 3)}


def test_similar_pairs_keep_links_between_spokes(odd, none, spark):
    from murmur.llm import fingerprints as fp
    rows = [(r["doc_id"], r["text"]) for r in got(odd)]
    rng = np.random.default_rng(2)
    for g in range(2):  # smaller ids, too far for a link, are the hubs of all buckets the last two share
        own = [f"g{g}w{j}" for j in range(300)]
        for k in range(80):
            lo = int(rng.integers(0, 230))
            rows.append((1000 * (g + 1) + k, " ".join(own[:lo] + [f"g{g}k{k}x{j}" for j in range(70)] + own[lo + 70:])))
        rows += [(1000 * (g + 1) + 80, " ".join(own)),
                 (1000 * (g + 1) + 81, " ".join("new" if j % 60 == 30 else w for j, w in enumerate(own)))]
    docs = frame(spark, [(i, t, "en", "s") for i, t in rows])
    want = components(rows, percent=80)
    assert want[1081] == 1080 and want[2081] == 2080
    sets = {i: shingles(t) for i, t in rows}
    pairs = got(fp.similar_pairs(docs))
    for r in pairs:
        x, y = sets[r["a"]], sets[r["b"]]
        assert r["a"] < r["b"] and r["jaccard"] == pytest.approx(len(x & y) / len(x | y)) and r["jaccard"] >= 0.8
    up = {i: i for i in want}
    for _ in up:
        for r in pairs:
            up[r["a"]] = up[r["b"]] = min(up[r["a"]], up[r["b"]])
    assert up == want
    links = Counter(x for r in pairs for x in (r["a"], r["b"]))
    out = got(fp.with_links(docs))
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in rows)
    assert all(r["class_id"] == want.get(r["doc_id"]) and r["n_links"] == links[r["doc_id"]] for r in out)
    assert got(fp.with_links(none)) == []


# ---- 3 ------------------------------------------------------------------
def test_licences_against_brute_force(odd, none, spark):
    from murmur.llm import licenses as li
    lines = ["Licensed under the Apache License, Version 2.0.", "x", "RELEASED### under$$$ the MIT*** license!!",
             "Licensed under CC BY 4.0.", "licensed under cc by-nc 4.0", "Licensed under the License",
             "word " * 400, "This work is licensed under the GNU General Public License, version 3."]
    docs = frame(spark, [(1, "\n".join(lines), "en", "s"), (2, lines[0], "en", "s"), (2, lines[0], "en", "s"),
                         (None, lines[2], "en", "s"), (3, None, "en", "s"), (4, "", "en", "s")])
    want = {}
    for r in got(docs):
        for k, line in enumerate((r["text"] or "").split("\n")):
            a = li.bigrams(line)
            best = max(((2 * sum((a & li.bigrams(t)).values()) / (sum(a.values()) + sum(li.bigrams(t).values())), n)
                        for n, ts in li.TEMPLATES.items() for t in ts if a), default=(0, ""))
            if best[0] >= 0.8:
                want[(r["doc_id"], k)] = best[0]
    out = got(li.scan(docs))
    assert {(r["doc_id"], r["line_no"]): r["dice"] for r in out} == pytest.approx(want)
    assert len(out) == len(want)
    by = {(r["doc_id"], r["line_no"]): r["license"] for r in out}
    assert by[(1, 0)] == "apache-2.0" and by[(1, 2)] == "mit" and by[(1, 4)] == "cc-by-nc-4.0"
    assert got(li.scan(none)) == []
    assert got(li.scan(odd)) == []


def test_licences_wrapped_and_embedded(spark):
    from murmur.llm import licenses as li
    mit, bsd = li.TEMPLATES["mit"][2], li.TEMPLATES["bsd-3-clause"][1]
    long = " ".join(f"w{i}" for i in range(500))
    docs = frame(spark, [
        (1, "Copyright\n\n" + mit.replace("a copy of", "a copy\nof").replace(", to any", ",\n  to any"), "en", "s"),
        (2, f"{long} {bsd} {long}", "en", "s"),
        (3, f"x\n{long} Licensed under the MIT License. {long} Licensed under CC BY 4.0. {long}", "en", "s"),
        (4, " // ".join(["Licensed under CC BY-SA 4.0."] * 3), "en", "s"),
        (5, "Licensed under the", "en", "s"), (6, "MIT License.", "en", "s"),  # not across texts
        (7, f"{long} Licensed under a new MIT License {long}", "en", "s")])
    out = sorted((r["doc_id"], r["line_no"], r["word_no"], r["license"], r["dice"]) for r in got(li.scan(docs)))
    assert out == [(1, 2, 1, "mit", 1.0), (2, 0, 500, "bsd-3-clause", 1.0), (3, 1, 501, "mit", 1.0),
                   (3, 1, 1006, "cc-by-4.0", 1.0), *[(4, 0, 7 * k, "cc-by-sa-4.0", 1.0) for k in range(3)]]


def test_licence_windows_against_brute_force():
    from murmur.llm import licenses as li
    rng = np.random.default_rng(13)
    scanner = li.Scanner(li.TEMPLATES, 0.8)
    pool = sorted({t for ts in li.TEMPLATES.values() for t in ts})
    for _ in range(40):
        w = [x for t in rng.choice(pool, 3) for x in ["aa", *t.split()] if rng.random() > 0.06]
        text = " ".join(w)
        flat = re.sub("[^a-z0-9]+", " ", text.lower()).split()
        every = []
        for n in range(1, 32):
            for lo in range(len(flat) - n):
                bag = Counter(f"{a} {b}" for a, b in zip(flat[lo:lo + n], flat[lo + 1:lo + n + 1]))
                for k, (tid, name, _) in enumerate(scanner.templates):
                    tb = li.bigrams(li.TEMPLATES[name][int(tid.split("#")[1])])
                    dice = 2.0 * sum((bag & tb).values()) / (n + sum(tb.values()))
                    if dice >= 0.8:
                        every.append((-dice, k, n, lo))
        want, taken = [], set()
        for dice, k, n, lo in sorted(every):
            if taken.isdisjoint(range(lo, lo + n)):
                taken.update(range(lo, lo + n))
                want.append((lo, scanner.templates[k][1], -dice))
        assert sorted((r[2], r[4], r[5]) for r in scanner.notices([text.encode()])) == sorted(want)


# ---- 4 ------------------------------------------------------------------
def brute_lm(rows):
    texts = [(i, zlib.crc32(str("" if i is None else i).encode()) % 5 == 1, words(t) + ["</s>"]) for i, t in rows]
    c, b = Counter(), Counter()
    for _, held, w in texts:
        if not held:
            c.update(w), b.update(zip(["<s>"] + w[:-1], w))

    def disc(n):
        plain = [0, 0.5, 1.0, 1.5]
        if any(n[k] <= 0 for k in (1, 2, 3, 4)):
            return plain
        y = n[1] / (n[1] + 2 * n[2])
        d = [0] + [k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3)]
        return [0] + [d[k] if 0 < d[k] < k else plain[k] for k in (1, 2, 3)]

    big, cont = disc(Counter(b.values())), Counter(w for _, w in b)
    small, size, total, types = disc(Counter(cont.values())), len(c), sum(c.values()), len(b)
    hist = defaultdict(Counter)
    for (h, _), k in b.items():
        hist[h].update({"all": k, min(k, 3): 1})
    back = sum(small[min(k, 3)] for k in cont.values()) / types if types else 0

    def low(w):
        return max(cont[w] - small[min(cont[w], 3)], 0) / types + back / (size + 1) if types else 1 / (size + 1)

    def p(h, w):
        x = hist.get(h)
        if not x:
            return low(w)
        k = b[h, w]
        return max(k - big[min(k, 3)], 0) / x["all"] + sum(big[j] * x[j] for j in (1, 2, 3)) / x["all"] * low(w)

    return [(i, held, len(w), sum(c[x] > 0 for x in w), total,
             sum(math.log10((c[x] + .5) / (total + .5 * (size + 1))) for x in w),
             sum(math.log10(p(h, x)) for h, x in zip(["<s>"] + w[:-1], w))) for i, held, w in texts]


@pytest.mark.parametrize("chunk", [50, 2_000_000])
def test_ngram_scores_against_brute_force(odd, none, spark, monkeypatch, chunk):
    from murmur.llm import ngram_lm as lm
    monkeypatch.setattr(lm, "CHUNK_WORDS", chunk)
    rows = [(r["doc_id"], r["text"]) for r in got(odd)] + [(100 + i, "the cat sat on the mat " * (i % 4) + "the end")
                                                           for i in range(20)]
    df = frame(spark, [(i, t, "en", "s") for i, t in rows]).repartition(3).checkpoint()
    key = lambda r: (str(r[0]), r[2:4], round(r[6], 6))
    out = sorted((tuple(r) for r in lm.scored(df).collect()), key=key)
    want = sorted(brute_lm(rows), key=key)
    for a, b in zip(out, want):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)
    assert len(out) == len(want)
    assert lm.scored(none).collect() == []


# ---- 5 ------------------------------------------------------------------
def test_language_id(odd, none, spark):
    from murmur.llm import langid
    rng = np.random.default_rng(3)
    sets = {"en": "the of and ing tion with", "de": "der und sch ung nicht ein", "fr": "les eau que ment dans pour"}
    make = lambda la, n: " ".join(rng.choice(sets[la].split(), n))
    rows = [(i, make(la, 60), la, "s") for i, la in enumerate(["en", "de", "fr"] * 60)]
    net = langid.fit(frame(spark, rows))
    test = frame(spark, [(i, make(la, 40), la, "s") for i, la in enumerate(["en", "de", "fr"] * 20)])
    out = {r["doc_id"]: r["lang_pred"] for r in got(langid.predict(test, net))}
    assert np.mean([out[r["doc_id"]] == r["lang"] for r in got(test)]) >= 0.95
    seen = got(langid.predict(odd, net))
    assert len(seen) == 14 and all(0 <= r["score"] <= 1 for r in seen)
    by = {r["doc_id"]: r["lang_pred"] for r in seen}
    assert by[4] == by[5] == by[6] == by[12] == "und" and by[10] == "de"
    assert got(langid.predict(none, net)) == []
    assert langid.fit(none) is None
    assert {r["lang_pred"] for r in got(langid.predict(odd, None))} == {"und"}


# ---- 6 ------------------------------------------------------------------
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if i % 2 else int(c)
               for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                    "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]():
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_personal_data_against_brute_force(odd, none, spark):
    from murmur.llm import pii
    rng = np.random.default_rng(6)
    parts = ["a@b.com", "_x@y.z", "1.2.3.4", ".5", "300.1.1.1", "4539148803436467", "4539 1488-0343 6467", "12 ", "+49 30",
             "(017) 555-7713", "+1 (017) 555-7713", "@", " ", "é", "\U0001F600", "-", "..", "x", "7" * 30, "\n"]
    rows = [(100 + i, "".join(rng.choice(parts, rng.integers(0, 14))), "en", "s") for i in range(300)]
    df = frame(spark, rows + [(r["doc_id"], r["text"], "en", "s") for r in got(odd)] + [(999, "1 " * 9000, "en", "s")])
    out = got(pii.find(df))
    texts = {(r["doc_id"]): r["text"] or "" for r in got(df)}
    assert len(out) == 315
    for r in out:
        base = base_spans(texts[r["doc_id"]])
        line = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == j for x in base) for j in range(4)], texts[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(line).encode()).hexdigest()
        assert set(line) <= set(r["spans"].split(",")) | {""}
    assert got(pii.find(none)) == []


def test_personal_data_redacted(spark):
    from murmur.llm import pii
    df = frame(spark, [(1, MAIL, "en", "s"), (2, None, "en", "s"), (3, "nothing", "en", "s")])
    by = {r["doc_id"]: r["text"] for r in got(pii.redact(df))}
    assert by[1] == "write to [EMAIL] or call [PHONE] now, card [CARD], host [IP]."
    assert by[2] is None and by[3] == "nothing"


def test_em_learns_which_labelers_to_trust():
    from murmur.llm import pii
    weights = pii.estimate([(0, 1, 1, 1, 1, 0, 50), (0, -1, -1, -1, 0, -1, 50), (0, 1, 1, -1, 0, 0, 5)])[0]
    margin = lambda v: sum(a * b for a, b in zip(weights, [*v, 1]))
    assert margin((1, 1, 1, 1, 0)) > 0 > margin((-1, -1, -1, 0, -1))


# ---- 7 ------------------------------------------------------------------
def test_mixing_fills_leaves_and_redistributes(spark, none, odd):
    from murmur.llm import mixing
    rows = [(i, "w " * 10, "en", "src0") for i in range(10)] + [(100 + i, "w " * 10, "en", "src3") for i in range(90)] \
        + [(300 + i, "w " * 10, "de", "src1") for i in range(50)]
    out = got(mixing.mix(frame(spark, rows), share=0.4, max_epochs=2))
    budget = Counter()
    for r in out:
        budget[r["domain"], r["source"]] += r["tokens"]
    # web: src0 and src3, books: src1 (src2 has none): 600 tokens by 5 : 3
    assert budget["web", "src0"] == 180
    assert budget["web", "src3"] == 180 and budget["books", "src1"] == 220
    short = got(mixing.mix(frame(spark, rows), share=1.2, max_epochs=2))
    total = Counter()
    for r in short:
        total[r["source"], r["epoch"]] += r["tokens"]
    assert total["src0", 0] == 100 and total["src0", 1] == 100  # full after two epochs
    assert sum(total.values()) >= 1780
    assert got(mixing.mix(none)) == []
    seen = got(mixing.mix(odd, share=2.0, max_epochs=2))
    assert Counter(r["doc_id"] for r in seen if r["epoch"] == 0)[1] == 1
    assert [r["doc_id"] for r in seen if r["tokens"] == 0 and r["epoch"] > 0] == []


def test_mixing_matches_sql(spark):
    import duckdb
    from murmur.llm import mixing
    d = "/root/testdata/sf0.001"
    df = mixing.QUERIES["op7_mix_sources"](spark, d)
    cols = sorted(df.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    ran = con.execute(mixing.ORACLES["op7_mix_sources"])
    names = [x[0] for x in ran.description]
    want = sorted(tuple(r[names.index(c)] for c in cols) for r in ran.fetchall())
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == want and want


# ---- 8 ------------------------------------------------------------------
def test_nearest_vectors(spark, monkeypatch):
    from murmur.llm import ann
    monkeypatch.setattr(ann, "BLOCK", 400)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1000, 24))
    x[200:260] = x[100]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2050, [0.0] * 24), (2100, [float("nan")] * 24),
                                                         (2150, [None] + [1.0] * 23), (2200, []), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    out = got(ann.nearest(df, df.where("vec_id % 50 = 0"), 5))
    assert Counter(r["query_id"] for r in out) == {i: 5 for i in range(0, 1000, 50)}
    hit = 0
    norm = np.sqrt((x * x).sum(axis=1))
    for q in range(0, 1000, 50):
        cosine = (x * x[q]).sum(axis=1) / (norm * norm[q])
        cosine[q] = -9
        best = np.lexsort((np.arange(1000), -cosine))[:5]
        mine = sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(r["score"] == pytest.approx(cosine[r["vec_id"]], abs=1e-12) for r in mine)
        hit += len({r["vec_id"] for r in mine} & set(best.tolist()))
        if q in (100, 200, 250):
            assert [r["vec_id"] for r in mine] == best.tolist()
    assert hit >= 0.9 * 100
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert [(r["query_id"], r["vec_id"]) for r in got(ann.nearest(few, few.where("vec_id % 50 = 0"), 5))] == [(0, 1)]
    assert got(ann.nearest(few.limit(0), few.limit(0))) == []


# ---- 9 ------------------------------------------------------------------
def components(rows, percent=85):
    sets = defaultdict(set)
    for i, t in rows:
        if i is not None and shingles(t):
            sets[i].add(shingles(t))
    up = {i: i for i, _ in rows if i is not None}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                up[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in up}


def test_near_duplicates_against_brute_force(odd, none, spark):
    from murmur.llm import near_dedup as nd
    rng = np.random.default_rng(9)
    rows = [(r["doc_id"], r["text"]) for r in got(odd)]
    for g in range(6):  # groups around a base that isn't the least id: stars alone would miss links
        own = [f"g{g}w{j}" for j in rng.integers(0, 4000, 150)]
        for k in range(12):
            w = list(own)
            for at in rng.integers(0, 150, 0 if k == 7 else rng.integers(1, 5)):
                w[at] = f"new{rng.integers(1_000_000)}"
            rows.append((1000 + 100 * g + k, " ".join(w)))
    rows += [(5000 + k, " ".join(f"s{j}" for j in range(9 + k))) for k in range(12)]
    want = components(rows)
    out = got(nd.near_duplicates(frame(spark, [(i, t, "en", "s") for i, t in rows])))
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and not r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == want[r["doc_id"]])
    sizes = {i: len(shingles(t)) for i, t in rows}
    assert all(r["n_shingles"] == sizes[r["doc_id"]] for r in out)
    assert got(nd.near_duplicates(none)) == []


def test_one_permutation_estimates_jaccard():
    from murmur.llm import near_dedup as nd
    rng = np.random.default_rng(4)
    for n in (7, 60, 800):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: n * 9 // 10], rng.integers(0, 1 << 63, n - n * 9 // 10, dtype=np.uint64)]))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((nd.one_permutation(a) == nd.one_permutation(b)).mean() - j) < 0.25


# ---- 10 -----------------------------------------------------------------
def test_toxicity_on_gapped_insults(odd, none, spark):
    from murmur.llm import toxicity as tox
    rng = np.random.default_rng(10)
    plain = [w for w in "river stone market window garden letter simple yellow travel number morning winter".split()]
    make = lambda extra: " ".join(rng.permutation([*rng.choice(plain, 30), *extra]))
    bad = ["blockhead", "nitwit", "scoundrel"]
    rows = [(make([rng.choice(bad)]), 1) for _ in range(60)] + [(make([]), 0) for _ in range(200)]
    model = tox.fit(spark.createDataFrame(rows, "text string, toxic int"))
    test = frame(spark, [(1, make(["blockhead"]), "en", "s"), (2, make(["bl.ock-he*ad"]), "en", "s"),
                         (3, make(["nitxwit"]), "en", "s"), (4, make([]), "en", "s"), (5, make([]), "en", "s"),
                         (6, make([]) + " n i t w i t", "en", "s")])
    score = {r["doc_id"]: r["score"] for r in got(tox.score(test, model))}
    assert min(score[i] for i in (1, 2, 3, 6)) >= tox.THRESHOLD > max(score[4], score[5]), score
    seen = got(tox.score(odd, model))
    assert len(seen) == 14 and all(0 <= r["score"] <= 1 for r in seen)
    assert got(tox.score(none, model)) == []
    empty = tox.fit(spark.createDataFrame([], "text string, toxic int"))
    assert {r["score"] for r in got(tox.score(odd, empty))} == {0.0}
    one = tox.fit(spark.createDataFrame([("a", 1), ("b", None)], "text string, toxic int"))
    assert {r["score"] for r in got(tox.score(odd, one))} == {1.0}


def test_kernel_against_brute_force():
    from itertools import combinations
    from murmur.llm import toxicity as tox

    def kernel(s, t):
        def phi(w):
            out = Counter()
            for i, j, k in combinations(range(len(w)), 3):
                if k - i < tox.SPAN:
                    out[w[i] + w[j] + w[k]] += tox.DECAY ** (k - i - 2)
            return out
        a, b = phi(s), phi(t)
        dot = lambda x, y: sum(x[c] * y[c] for c in x)
        return dot(a, b) / math.sqrt(dot(a, a) * dot(b, b))

    marks = [b"blockhead", b"nitwit", b"abcabc"]
    model = tox.Model(marks, 0.5)
    code, starts, ends, _ = tox.letter_words([b"blockxhead nitwit abab banana"])
    out = model.word_features(code, starts, ends)
    for i, w in enumerate(["blockxhead", "nitwit", "abab", "banana"]):
        assert out[i] == pytest.approx([kernel(w, m.decode()) for m in marks], abs=1e-5)


# ---- the pipeline -------------------------------------------------------
def test_pipeline_stages_against_brute_force(odd, spark, tmp_path):
    import corpus_pipeline as P
    en, de = "the of and ing tion with", "der und sch ung nicht ein"
    rng = np.random.default_rng(11)
    rows = [(100 + i, " ".join(rng.choice((en if i % 2 else de).split(), 50)), "en" if i % 2 else "de", f"src{i % 4}")
            for i in range(80)]
    docs = odd.drop("score").unionByName(frame(spark, rows))
    kept = []
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, "")
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(path := str(tmp_path / name))
        before, docs = docs, spark.read.parquet(path)
        kept.append(docs)
        if name == "near_dedup":
            texts = [(r["doc_id"], r["text"]) for r in got(before)]
            want = {i for i, c in components(texts).items() if i == c}
            ids = [r["doc_id"] for r in got(docs) if r["doc_id"] is not None]
            assert sorted(ids) == sorted(want)
    first = {r["doc_id"]: r["text"] for r in got(kept[0])}
    assert not {4, 5, 6, 12} & set(first) and {1, 2, 3, 8, 10, None} <= set(first)
    clean = {r["doc_id"]: r for r in got(kept[2])}
    assert "[EMAIL]" in clean[8]["text"] and clean[8]["n_chars"] == len(clean[8]["text"])
    mixed = {r["doc_id"]: r["text"] for r in got(kept[3])}
    assert set(mixed) <= set(clean)
    for r in got(kept[4]):
        assert r["decoded_sha256"] == hashlib.sha256(mixed[r["doc_id"]].encode()).hexdigest()
    assert len(got(kept[4])) == len(got(kept[3]))


def test_pipeline_near_dedup_takes_pairs_from_080(spark):
    import corpus_pipeline as P
    rng = np.random.default_rng(12)
    rows = []
    for g in range(30):  # pairs around 0.80 and 0.85, and chains of them
        own = [f"g{g}w{j}" for j in range(200)]
        rows.append((10 * g, " ".join(own)))
        for k in range(1, 4):
            w = list(own)
            for at in rng.choice(np.arange(5, 195, 10), int(rng.integers(2, 7)), replace=False):
                w[at] = f"new{g}x{k}x{at}"
            rows.append((10 * g + k, " ".join(w)))
    want = {i for i, c in components(rows, percent=80).items() if i == c}
    assert len(want) < len({i for i, c in components(rows).items() if i == c})  # some links only from 0.80 to 0.85
    out = P.near_duplicates(spark, frame(spark, [(i, t, "en", "s") for i, t in rows]), "")
    assert sorted(r["doc_id"] for r in got(out)) == sorted(want)


def test_bands_for_080():
    import corpus_pipeline as P
    from murmur.llm import near_dedup as nd
    assert (1 - (P.NEAR / 100) ** P.ROWS) ** P.BANDS < 1e-6
    a = np.unique(np.random.default_rng(5).integers(0, 1 << 63, 90, dtype=np.uint64) * np.uint64(2))
    assert len(nd.band_hashes(a, P.BANDS, P.ROWS)) == P.BANDS and len(nd.band_hashes(a)) == nd.BANDS
