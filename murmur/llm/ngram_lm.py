"""Operator 4: scoring by an interpolated modified Kneser-Ney bigram model.

The model is spread over shards and no shard is ever whole on one machine's
driver. Documents are read in chunks of about ``CHUNK_WORDS`` words; a chunk
sends its distinct bigrams with their training counts to shards, as packed
arrays. A shard merges them into its part of the model: a sorted array of
64-bit bigram hashes and one of counts, written to a file that the worker maps
into memory and searches for every chunk's bigrams; it also counts, per
history, the bigrams seen once, twice, and more often, and per word the
histories it was seen after (continuations). Word shards merge those, and
chunks get back the counts they asked for and score their texts.

    P(w|h) = max(c(h,w) - D(c), 0) / c(h) + backoff(h) * P(w)
    P(w)   = max(cont(w) - D'(cont), 0) / types + backoff' / (V + 1)

D and D' are the modified Kneser-Ney discounts from counts of counts. Words
that make up much of the corpus are histories of many bigrams; a bounded
sample finds them and their bigrams are dealt by both words. (Which ones are
found changes where rows go, never a number.) Counts are of all documents.

A chunk's key is the digest of its contents, so when it is read a second time
for scoring the replies are matched by content, and a table that changed in
between is an error, not a wrong score. Lost executors recompute their chunks
or shards; the two tables kept in the shared checkpoint folder don't depend on
them. Words and bigrams are known by 64-bit hashes (some two of 10^8 words
collide with odds near 1 in 3000).

Defined results: null and empty texts have one token, the end; repeated rows
are scored and counted each; null ids train as the fold of ''; without any
training text every score is 0; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import blocks_of, documents, fold_of, mix, small_batches, to_bytes, word_hashes
from murmur.session import cut_lineage

CHUNK_WORDS = 1_500_000
HOT_SAMPLE = 2_000      # documents looked at to find very frequent words
END, START, _FIRST = np.uint64(1), np.uint64(2), np.uint64(3)
_SALT = np.uint64(0x9E3779B97F4A7C15)
_ROW = "key bigint, chunk string, kind string, data binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as zstd-compressed byte planes (small numbers cost little)."""
    import zstandard
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head + body)


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:4], "little")
    at, out = 4 + n, []
    for part in raw[4:4 + n].decode().split(";"):
        kind, size = part.split(",")
        kind, size = np.dtype(kind), int(size)
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += size * kind.itemsize
    return out


def steps(values: np.ndarray) -> np.ndarray:
    """Differences of a sorted array; ``np.cumsum`` undoes it."""
    return np.diff(values, prepend=values.dtype.type(0))


def shard_of(words: np.ndarray, n: int) -> np.ndarray:
    return (mix(words * _SALT) % np.uint64(n)).astype(np.int64)


def pair_hash(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(h + _SALT) + w)


class Chunk:
    """Tokens of some documents: distinct words, distinct bigrams (as word
    numbers), the bigram of every token, and counts in training documents."""

    def __init__(self, ids, held, words, sizes):
        ends = np.cumsum(sizes + 1)
        tokens = np.empty(ends[-1], np.uint64)
        last = ends - 1
        inner = np.ones(len(tokens), bool)
        inner[last] = False
        tokens[last], tokens[inner] = END, words
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[ends - sizes - 1] = START
        self.ids, self.held, self.sizes = ids, held, sizes + 1
        self.words, number = np.unique(np.concatenate([tokens, [START]]), return_inverse=True)
        w = number[:-1].astype(np.int64)
        h = np.searchsorted(self.words, before)
        train = np.repeat(~held, self.sizes).astype(float)
        self.word_counts = np.bincount(w, train, len(self.words)).astype(np.uint32)
        pairs, self.pair = np.unique(h << 32 | w, return_inverse=True)
        self.h, self.w = pairs >> 32, pairs & 0xFFFFFFFF
        self.pair_counts = np.bincount(self.pair, train, len(pairs)).astype(np.uint32)
        digest = hashlib.sha256()
        for a in (self.words, pairs, self.pair_counts, self.sizes, np.array([str(i) for i in ids])):
            digest.update(np.ascontiguousarray(a).tobytes())
        self.key = digest.hexdigest()[:32]

    def pair_shards(self, n: int, hot: np.ndarray) -> np.ndarray:
        """By the history, of very frequent histories by both words."""
        own = shard_of(self.words, n)[self.h]
        split = np.isin(self.words, hot)[self.h]
        both = pair_hash(self.words[self.h[split]], self.words[self.w[split]])
        own[split] = (both % np.uint64(n)).astype(np.int64)
        return own


def chunks(batches):
    """Chunks of (doc_id, text, held) batches, deterministic for a partition."""
    ids, held, words, sizes, total = [], [], [], [], 0

    def made():
        return Chunk(ids, np.array(held, bool), np.concatenate(words), np.concatenate(sizes).astype(np.int64))

    for b in batches:
        raw = [to_bytes(t) for t in b.column(1).to_pylist()]
        every_id, every_held = b.column(0).to_pylist(), b.column(2).to_pylist()
        for lo, hi in blocks_of(raw):
            got, first = word_hashes(raw[lo:hi])
            words.append(np.maximum(got, _FIRST))
            sizes.append(np.diff(first))
            ids += every_id[lo:hi]
            held += every_held[lo:hi]
            total += len(got) + hi - lo
            if total >= CHUNK_WORDS:
                yield made()
                ids, held, words, sizes, total = [], [], [], [], 0
    if ids:
        yield made()


def _split(shards: np.ndarray, n: int):
    """(shard, positions of its entries, in order), for shards with entries."""
    order = np.argsort(shards, kind="stable")
    cut = np.searchsorted(shards[order], np.arange(n + 1))
    for s in np.flatnonzero(np.diff(cut)):
        yield int(s), order[cut[s]:cut[s + 1]]


def ask(n: int, hot: np.ndarray):
    """mapInArrow: what chunks send to bigram shards and word shards."""

    def rows(chunk):
        for s, at in _split(chunk.pair_shards(n, hot), n):
            h, hn = np.unique(chunk.h[at], return_counts=True)  # in order of the words' hashes
            w, wi = np.unique(chunk.w[at], return_inverse=True)
            yield s, "pairs", pack(steps(chunk.words[h]), hn.astype(np.uint32), steps(chunk.words[w]),
                                   wi.astype(np.uint32), chunk.pair_counts[at])
        for s, at in _split(shard_of(chunk.words, n), n):
            yield s, "words", pack(steps(chunk.words[at]), chunk.word_counts[at])

    def run(batches):
        import pyarrow as pa
        for chunk in chunks(batches):
            out = list(rows(chunk))
            yield pa.RecordBatch.from_pydict({
                "key": pa.array([r[0] for r in out], pa.int64()), "chunk": [chunk.key] * len(out),
                "kind": [r[1] for r in out], "data": pa.array([r[2] for r in out], pa.binary())})

    return run


def _mapped(folder: str, name: str, values: np.ndarray) -> np.ndarray:
    """The array as a read-only memory map of a file."""
    if not len(values):
        return values
    path = os.path.join(folder, name)
    values.tofile(path)
    return np.memmap(path, values.dtype, "r")


def _frame(rows):
    import pandas as pd
    return pd.DataFrame(rows, columns=["key", "chunk", "kind", "data"])


def merge_pairs(n: int):
    """One bigram shard: its part of the model, and answers from it."""

    def run(key, rows):
        out = [tuple(r) for r in rows[rows["kind"] == "words"].itertuples(index=False)]
        asked, hs, ws, counts = [], [], [], []
        for r in rows[rows["kind"] == "pairs"].itertuples(index=False):
            h, hn, w, wi, c = unpack(r.data)
            h, w = np.repeat(np.cumsum(h), hn), np.cumsum(w)[wi]
            asked.append((r.chunk, pair_hash(h, w)))
            use = c > 0
            hs.append(h[use]), ws.append(w[use]), counts.append(c[use])
        if not asked:
            return _frame(out)
        h, w, c = np.concatenate(hs), np.concatenate(ws), np.concatenate(counts)
        keys, first, which = np.unique(pair_hash(h, w), return_index=True, return_inverse=True)
        c = np.bincount(which, c, len(keys)).astype(np.uint32)
        h, w = h[first], w[first]
        with tempfile.TemporaryDirectory() as folder:
            index, count = _mapped(folder, "hashes", keys), _mapped(folder, "counts", c)
            for chunk, pairs in asked:
                found = np.zeros(len(pairs), np.uint32)
                if len(keys):
                    at = np.minimum(np.searchsorted(index, pairs), len(index) - 1)
                    found = np.where(index[at] == pairs, count[at], 0).astype(np.uint32)
                out.append((int(key[0]), chunk, "pair counts", pack(found)))
            del index, count
        of_counts = np.bincount(np.minimum(c, 5), minlength=6)[1:5]
        out.append((int(key[0]), "", "discounts", pack(of_counts.astype(np.int64))))
        hist, which = np.unique(h, return_inverse=True)
        kinds = [np.bincount(which, x, len(hist)).astype(np.uint32) for x in (c == 1, c == 2, c > 2)]
        total = np.bincount(which, c, len(hist)).astype(np.uint64)
        for s, at in _split(shard_of(hist, n), n):
            out.append((s, "", "histories", pack(steps(hist[at]), *(x[at] for x in kinds), total[at])))
        after, cont = np.unique(w, return_counts=True)
        for s, at in _split(shard_of(after, n), n):
            out.append((s, "", "continuations", pack(steps(after[at]), cont[at].astype(np.uint32))))
        return _frame(out)

    return run


def merge_words(key, rows):
    """One word shard: totals of its words, and answers to the chunks."""
    parts = {k: [unpack(d) for d in rows[rows["kind"] == k]["data"]] for k in ("words", "histories", "continuations")}
    known = [np.cumsum(p[0]) for group in parts.values() for p in group]
    index = np.unique(np.concatenate(known)) if known else np.zeros(0, np.uint64)
    totals = np.zeros((6, len(index)))  # count, continuations, 3 kinds of bigrams after it, tokens after it
    for group, at in (("words", [0]), ("continuations", [1]), ("histories", [2, 3, 4, 5])):
        for p in parts[group]:
            pos = np.searchsorted(index, np.cumsum(p[0]))
            for t, x in zip(at, p[1:]):
                totals[t, pos] += x
    out = []
    for r in rows[rows["kind"] == "words"].itertuples(index=False):
        pos = np.searchsorted(index, np.cumsum(unpack(r.data)[0]))
        out.append((int(key[0]), r.chunk, "word counts", pack(*(t[pos].astype(np.uint64) for t in totals))))
    cont = totals[1].astype(np.int64)
    sums = [(totals[0] > 0).sum(), totals[0].sum(), cont.sum(), *np.bincount(np.minimum(cont, 5), minlength=6)[1:5],
            (cont > 2).sum()]
    out.append((int(key[0]), "", "sums", pack(np.array(sums, np.int64))))
    return _frame(out)


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 1, 2 and more, from the
    numbers of things counted 1, 2, 3 and 4 times."""
    n = np.asarray(n, float)
    plain = np.array([0.5, 1.0, 1.5])
    if (n <= 0).any():
        return plain
    y = n[0] / (n[0] + 2 * n[1])
    d = np.array([k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)])
    return np.where((d > 0) & (d < [1, 2, 3]), d, plain)


def score_chunk(chunk, pair_counts, words, totals, n_pairs, d2, d1):
    """Per document: tokens known, base score, model score."""
    vocabulary, tokens, types = totals
    count, cont, once, twice, more, follow = words.astype(float)
    step = lambda c, d: np.where(c > 2, d[2], np.where(c > 1, d[1], np.where(c > 0, d[0], 0.0)))
    low = np.full(len(count), 1 / (vocabulary + 1))
    if types:
        back = (d1 * n_pairs).sum() / types
        low = np.maximum(cont - step(cont, d1), 0) / types + back / (vocabulary + 1)
    c = pair_counts.astype(float)
    seen = np.maximum(follow, 1)
    back = np.where(follow > 0, (d2[0] * once + d2[1] * twice + d2[2] * more) / seen, 1.0)
    p = np.maximum(c - step(c, d2), 0) / seen[chunk.h] + back[chunk.h] * low[chunk.w]
    base = np.log10((count + 0.5) / (tokens + 0.5 * (vocabulary + 1)))
    first = np.cumsum(chunk.sizes) - chunk.sizes
    w = chunk.w[chunk.pair]
    return (np.add.reduceat((count > 0)[w].astype(np.int64), first), np.add.reduceat(base[w], first),
            np.add.reduceat(np.log10(p)[chunk.pair], first))


def scored(docs: DataFrame, folds: int = 5, held: int = 1, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Train on all folds but one and score every document. ``docs`` must be
    re-readable in the same order within its partitions (a scan is)."""
    spark = docs.sparkSession
    small_batches(spark)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    src = src.withColumn("held", fold_of(F.col("doc_id"), folds) == held)
    hot = frequent(src, n)
    one = cut_lineage(src.mapInArrow(ask(n, hot), _ROW).groupBy("key").applyInPandas(merge_pairs(n), _ROW))
    two = cut_lineage(one.where("kind IN ('words', 'histories', 'continuations')")
                      .groupBy("key").applyInPandas(merge_words, _ROW))
    of_counts = _total(one.where("kind = 'discounts'"), 4)
    sums = _total(two.where("kind = 'sums'"), 8)
    totals = (float(sums[0]), float(sums[1]), float(sums[2]))
    n_pairs = np.array([sums[3], sums[4], sums[7]], float)
    d2, d1 = discounts(of_counts), discounts(sums[3:7])
    train_tokens = int(sums[1])

    def again(batches):
        import pyarrow as pa
        for chunk in chunks(batches):
            data = pack(np.array([0 if i is None else i for i in chunk.ids], np.int64),
                        np.array([i is None for i in chunk.ids]), chunk.held, chunk.sizes, steps(chunk.words),
                        steps(chunk.h << 32 | chunk.w), chunk.pair.astype(np.uint32))
            yield pa.RecordBatch.from_pydict({"key": pa.array([0], pa.int64()), "chunk": [chunk.key],
                                              "kind": ["texts"], "data": pa.array([data], pa.binary())})

    def finish(key, rows):
        import pandas as pd
        texts = [unpack(d) for d in rows[rows["kind"] == "texts"]["data"]]
        answers = {k: rows[rows["kind"] == k].sort_values("key") for k in ("pair counts", "word counts")}
        frames = []
        for ids, null, held_out, sizes, words, pairs, pair in texts:
            chunk = Chunk.__new__(Chunk)
            chunk.sizes, chunk.words, pairs = sizes, np.cumsum(words), np.cumsum(pairs)
            chunk.h, chunk.w, chunk.pair = pairs >> 32, pairs & 0xFFFFFFFF, pair
            counts, word_totals = np.full(len(pairs), -1, np.int64), np.zeros((6, len(words)))
            for name, shards, put in (("pair counts", chunk.pair_shards(n, hot), counts[None, :]),
                                      ("word counts", shard_of(chunk.words, n), word_totals)):
                got = {r.key: r.data for r in answers[name].itertuples(index=False)}
                for s, at in _split(shards, n):
                    if s not in got:
                        raise RuntimeError("the documents changed between two reads")
                    put[:, at] = np.stack(unpack(got[s]))
            known, base, score = score_chunk(chunk, counts, word_totals, totals, n_pairs, d2, d1)
            frames.append(pd.DataFrame({
                "doc_id": pd.array(np.where(null, 0, ids), "Int64"), "held_out": held_out, "n_tokens": sizes,
                "n_known": known, "train_tokens": train_tokens, "base_score": base, "score": score}))
            frames[-1].loc[null, "doc_id"] = pd.NA
        if not frames:
            raise RuntimeError("the documents changed between two reads")
        return pd.concat(frames)

    replies = one.where("kind = 'pair counts'").unionAll(two.where("kind = 'word counts'"))
    # equal chunks have equal replies: one is enough
    replies = replies.dropDuplicates(["key", "chunk", "kind"])
    return src.mapInArrow(again, _ROW).unionAll(replies).groupBy("chunk").applyInPandas(
        finish, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint,"
                " base_score double, score double")


def frequent(src: DataFrame, n: int) -> np.ndarray:
    """Hashes of words that hold over 1/(4n) of the words of a sample; their
    bigrams are dealt by both words. At most 4n of them, and the start."""
    total = src.count()
    if not total:
        return np.array([START])

    def run(batches):
        import pyarrow as pa
        for b in batches:
            words, _ = word_hashes([to_bytes(t) for t in b.column(0).to_pylist()])
            word, count = np.unique(np.maximum(words, _FIRST), return_counts=True)
            often = count * 8 * n >= len(words)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(word[often], np.uint64(0)).view(np.int64)), pa.array(np.append(count[often], len(words)))],
                names=["word", "n"])

    some = src.select("text").sample(False, min(1.0, HOT_SAMPLE / total), seed=4)
    rows = some.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")) \
        .orderBy(F.desc("n")).limit(4 * n + 1).collect()
    every = max([r["n"] for r in rows if r["word"] == 0], default=0)
    words = np.array([r["word"] for r in rows if r["word"] and r["n"] * 4 * n >= every], np.int64)
    return np.unique(np.append(words.view(np.uint64), START))


def _total(rows: DataFrame, size: int) -> np.ndarray:
    """Sum of the packed rows' numbers."""

    def run(batches):
        import pyarrow as pa
        got = np.zeros(size, np.int64)
        for b in batches:
            for d in b.column(0).to_pylist():
                got += unpack(d)[0]
        yield pa.RecordBatch.from_pydict({f"c{i}": pa.array([x], pa.int64()) for i, x in enumerate(got)})

    sums = rows.select("data").mapInArrow(run, ", ".join(f"c{i} bigint" for i in range(size)))
    return np.array([x or 0 for x in sums.agg(*[F.sum(f"c{i}") for i in range(size)]).first()], np.int64)


QUERIES = {"op4_ngram_scores": lambda spark, sf_dir: scored(documents(spark, sf_dir))}
