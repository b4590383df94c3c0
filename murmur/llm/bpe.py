"""Operator 1: byte-level BPE encoding and decoding with DuckDB per partition.

Each Arrow batch is cut into words by the tokenizer's pattern; only words not
yet seen by the worker go to DuckDB. There, token-position rows join the merge
table for the rank of every neighbouring pair, and a recursive query contracts
each word's leftmost lowest-rank pair until no pair has a rank; the two new
pairs beside a contraction join the merge table again. Decoding joins ids with
the vocabulary and concatenates their bytes by an ordered aggregation.

Memory is bounded by the batch size and ``CACHE_WORDS``; there is no shuffle,
and a lost executor's partitions are simply encoded again.

Defined results: a null or empty text has no ids; lone surrogates are encoded
as their three bytes; rows are independent, so repeated rows and repeated or
null ids come out once per input row; columns other than the named ones are
ignored. Decoding null gives empty bytes; an id outside the vocabulary, or a
null among the ids, is an error.
"""

from __future__ import annotations

import base64
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.common import blocks_of, documents, run_hash_pairs, small_batches, to_bytes

CACHE_WORDS = 600_000  # words and segments a worker remembers; beyond it starts afresh
LONG_WORD = 4096         # bytes from which a word is contracted in position rows
NO_PAIR = 2147483647

_CONTRACT = f"""
WITH RECURSIVE state(w, toks, ranks, low) AS (
  SELECT w, toks, ranks, coalesce(list_min(ranks), {NO_PAIR}) FROM words
  UNION ALL
  (WITH cut AS (
     SELECT w, toks, ranks, low, list_position(ranks, low) AS i FROM state WHERE low < {NO_PAIR}),
   pair AS (
     SELECT *, toks[i - 1] AS before, toks[i + 2] AS after FROM cut),
   joined AS (
     SELECT p.w, p.toks[:p.i - 1] || [p.low] || p.toks[p.i + 2:] AS toks,
            CASE WHEN p.i > 1 THEN p.ranks[:p.i - 2] || [coalesce(l.rank, {NO_PAIR})] ELSE [] END
            || CASE WHEN p.after IS NOT NULL THEN [coalesce(r.rank, {NO_PAIR})] || p.ranks[p.i + 2:] ELSE [] END
              AS ranks
     FROM pair p
     LEFT JOIN merges l ON l.a = p.before AND l.b = p.low
     LEFT JOIN merges r ON r.a = p.low AND r.b = p.after)
   SELECT w, toks, ranks, coalesce(list_min(ranks), {NO_PAIR}) FROM joined)
)
SELECT w, toks FROM state WHERE low = {NO_PAIR} ORDER BY w
"""

# One round over the position rows of long words. All occurrences of a word's
# lowest pair may be contracted at once where that cannot change the outcome
# (``alone`` is false): the merged token neither overlaps itself nor opens a
# pair of a lower rank. Otherwise only the leftmost one is.
_ROUND = """
WITH pairs AS (
  SELECT w, pos, tok, lead(tok) OVER seq AS nxt, lead(pos) OVER seq AS npos
  FROM long_rows WINDOW seq AS (PARTITION BY w ORDER BY pos)),
ranked AS (
  SELECT p.*, m.rank, m.alone FROM pairs p LEFT JOIN merges m ON m.a = p.tok AND m.b = p.nxt),
lows AS (
  SELECT w, min(rank) AS low, arg_min(pos, (rank, pos)) AS at FROM ranked WHERE rank IS NOT NULL GROUP BY w),
hits AS (
  SELECT r.w, r.pos, r.npos, l.low FROM ranked r JOIN lows l ON l.w = r.w AND l.low = r.rank
  WHERE NOT r.alone OR r.pos = l.at)
SELECT r.w, r.pos, coalesce(h.low, r.tok) AS tok
FROM ranked r LEFT JOIN hits h ON h.w = r.w AND h.pos = r.pos
WHERE NOT EXISTS (SELECT 1 FROM hits g WHERE g.w = r.w AND g.npos = r.pos)
"""

_DECODE = """
SELECT piece, string_agg(bytes, '' ORDER BY pos) AS bytes
FROM piece_rows JOIN vocabulary USING (id) GROUP BY piece ORDER BY piece
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file (base64 token and rank per line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class Lists:
    """Lists of numbers one after another, by number of the list."""

    def __init__(self, dtype):
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, dtype), 0

    def add(self, sizes: np.ndarray, flat: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), self.flat.dtype)])
        self.flat[self.used:self.used + len(flat)] = flat
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.used += len(flat)

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lists of the slots one after another, size of each)."""
        return gathered(self.flat, self.starts[slots], self.sizes[slots]), self.sizes[slots]


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs ``flat[start:start + size]`` one after another."""
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    at += np.arange(len(at))
    return flat.take(at)


class Store:
    """Run of numbers -> list of numbers. Runs are found by a hash, in sorted
    arrays (about 50 bytes an entry), and held against a second one: a run
    that is found but is another run is learned by itself, so runs that share
    the first hash never share a list (both agree with odds near 2^-114)."""

    def __init__(self, dtype):
        self.dtype = dtype
        self.clear()

    def clear(self):
        self.keys, self.slots, self.seconds = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self.lists = Lists(self.dtype)

    def get(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, learn) -> tuple[np.ndarray, np.ndarray]:
        """(lists of the runs ``data[start:end]`` one after another, size of
        each). ``learn(firsts)`` gives (flat, sizes) for runs not seen yet."""
        first, second = run_hash_pairs(data, starts, ends)
        keys, at, which = np.unique(first, return_index=True, return_inverse=True)
        slots = self._find(keys)
        new = np.flatnonzero(slots < 0)
        if len(new) and len(self.keys) + len(new) > CACHE_WORDS:
            self.clear()
            new = np.arange(len(keys))
        if len(new):
            flat, sizes = learn(at[new])
            pos = np.searchsorted(self.keys, keys[new])
            self.slots = np.insert(self.slots, pos, len(self.lists.sizes) + np.arange(len(new)))
            self.keys = np.insert(self.keys, pos, keys[new])
            self.seconds = np.concatenate([self.seconds, second[at[new]]])
            self.lists.add(sizes, flat)
            slots = self._find(keys)
        own = slots[which]
        flat, n = self.lists.gather(own)
        other = np.flatnonzero(self.seconds[own] != second)
        return (flat, n) if not len(other) else self._apart(flat, n, other, learn)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(hashes), -1, np.int64)
        i = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[i] == hashes, self.slots[i], -1)

    def _apart(self, flat: np.ndarray, n: np.ndarray, other: np.ndarray, learn) -> tuple[np.ndarray, np.ndarray]:
        """Runs that have another run's first hash get lists of their own."""
        parts = np.split(flat, np.cumsum(n)[:-1])
        for i in other.tolist():
            parts[i] = np.asarray(learn(np.array([i]))[0])
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


class Coder:
    """What a Python worker keeps: the DuckDB tables and the word caches."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import pyarrow as pa
        import regex

        self.find = regex.compile(pattern).findall
        # Cutting at a space between two non-space characters first is only
        # right for patterns whose words never cross such a space.
        self.by_space = pattern == _split_pattern()
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.con = duckdb.connect(":memory:", config={
            "threads": 1, "memory_limit": "300MB", "temp_directory": tempfile.gettempdir()})
        a, b, rank = [], [], []
        opens = set()  # tokens that take part in a pair of a lower rank
        for token, r in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    a.append(left), b.append(right), rank.append(r)
                    opens.update(x for x in (left, right) if x > r)
        borders = {r for t, r in ranks.items() if any(t[:k] == t[-k:] for k in range(1, len(t)))}
        self._table("merges", pa.table({
            "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "rank": pa.array(rank, pa.int32()),
            "alone": [r in opens or r in borders for r in rank]}))
        self._table("vocabulary", pa.table({
            "id": pa.array(list(ranks.values()), pa.int32()), "bytes": [t.hex() for t in ranks]}))
        self.size = max(ranks.values()) + 1
        self.spaced = np.zeros(self.size, bool)  # tokens that begin with a space
        self.known = np.zeros(self.size, bool)
        self.known[list(ranks.values())] = True
        self.spaced[[r for t, r in ranks.items() if t[:1] == b" "]] = True
        self.segments, self.words, self.pieces = Store(np.int32), Store(np.int32), Store(np.uint8)

    def _table(self, name, rows):
        self.con.register("_rows", rows)
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM _rows")
        self.con.unregister("_rows")

    # -- words ------------------------------------------------------------
    def contract(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all words one after another, number of each)."""
        out: list = [None] * len(raw)
        part, cost = [], 0
        for i, b in enumerate(raw):
            if len(b) >= LONG_WORD:
                out[i] = self._contract_long(b)
                continue
            if part and (cost + len(b) ** 2 > 4e7 or len(part) == 50_000):
                self._contract_short(part, raw, out)
                part, cost = [], 0
            part.append(i)
            cost += len(b) ** 2
        if part:
            self._contract_short(part, raw, out)
        return (np.concatenate(out) if out else np.zeros(0, np.int32),
                np.fromiter(map(len, out), np.int64, len(out)))

    def _contract_short(self, part, every, out):
        import pyarrow as pa
        raw = [every[i] for i in part]
        n = np.fromiter(map(len, raw), np.int64, len(raw))
        off = np.concatenate([[0], np.cumsum(n)])
        tok = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        last = np.zeros(len(tok), bool)
        last[off[1:][n > 0] - 1] = True
        inner = np.flatnonzero(~last)  # positions with a right neighbour
        self.con.register("positions", pa.table({"pos": inner, "tok": tok[inner], "nxt": tok[inner + 1]}))
        got = self.con.execute("SELECT p.pos, m.rank FROM positions p JOIN merges m"
                               " ON m.a = p.tok AND m.b = p.nxt").fetchnumpy()
        rank = np.full(len(tok), NO_PAIR, np.int32)
        rank[got["pos"]] = got["rank"]
        lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(tok))
        pairs = np.concatenate([[0], np.cumsum(np.maximum(n - 1, 0))]).astype(np.int32)
        ranks = pa.ListArray.from_arrays(pa.array(pairs), pa.array(rank[inner]))
        self.con.register("words", pa.table({"w": np.arange(len(raw), dtype=np.int32),
                                             "toks": lists, "ranks": ranks}))
        toks = self.con.sql(_CONTRACT).to_arrow_table()["toks"].combine_chunks()
        flat, at = toks.flatten().to_numpy(), np.asarray(toks.offsets)
        at = (at - at[0]).tolist()
        for i, x, y in zip(part, at[:-1], at[1:]):
            out[i] = flat[x:y]

    def _contract_long(self, raw: bytes) -> np.ndarray:
        import pyarrow as pa
        tok = self.byte[np.frombuffer(raw, np.uint8)]
        self.con.register("_rows", pa.table({"w": np.zeros(len(tok), np.int32),
                                             "pos": np.arange(len(tok)), "tok": tok}))
        self.con.execute("CREATE OR REPLACE TABLE long_rows AS SELECT * FROM _rows")
        left = len(tok)
        while True:
            self.con.execute("CREATE OR REPLACE TABLE long_next AS " + _ROUND)
            self.con.execute("DROP TABLE long_rows")
            self.con.execute("ALTER TABLE long_next RENAME TO long_rows")
            now = self.con.execute("SELECT count(*) FROM long_rows").fetchall()[0][0]
            if now == left:
                break
            left = now
        got = self.con.execute("SELECT tok FROM long_rows ORDER BY pos").fetchnumpy()
        return np.asarray(got["tok"], np.int32)

    # -- texts ------------------------------------------------------------
    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where segments begin: at every text, and at every single space
        between two characters that are no white space; a word of the
        pattern never crosses one, nor depends on what lies beyond it."""
        begin = np.unique(offsets[:-1][np.diff(offsets) > 0])
        if not self.by_space or not len(data):
            return begin
        white = _WHITE[data]
        first = last = white  # white space as it begins, as it ends
        if np.isin(data, (0xC2, 0xE1, 0xE2, 0xE3)).any():
            first, last = white.copy(), white.copy()
            for seq in _WIDE:
                at = np.flatnonzero(data[:len(data) - len(seq) + 1] == seq[0])
                for k in range(1, len(seq)):
                    at = at[data[at + k] == seq[k]]
                first[at] = True
                last[at + len(seq) - 1] = True
        at = np.flatnonzero(data[1:-1] == 32) + 1
        at = at[~last[at - 1] & ~first[at + 1]]
        inside = np.ones(len(data) + 1, bool)   # not beside a boundary of texts
        inside[begin] = False
        at = at[inside[at] & inside[at + 1]]
        return np.union1d(begin, at)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of each)."""
        raw = [to_bytes(t) for t in texts]
        parts = [self._encode(raw[lo:hi]) for lo, hi in blocks_of(raw)]
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _encode(self, raw: list[bytes]):
        joined = b"".join(raw)
        data = np.frombuffer(joined, np.uint8)
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))])
        starts = self._cuts(data, offsets)
        ends = np.append(starts[1:], len(data))[:len(starts)]
        flat, n = self.segments.get(data, starts, ends, lambda at: self._learn(
            [joined[x:y] for x, y in zip(starts[at].tolist(), ends[at].tolist())]))
        total = np.concatenate([[0], np.cumsum(n)])
        return flat, np.diff(total[np.searchsorted(starts, offsets)])

    def _learn(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the segments one after another, number of each)."""
        found = [self.find(s.decode("utf-8", "surrogatepass")) for s in segments]
        words = [to_bytes(w) for f in found for w in f]
        n = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(n)
        flat, sizes = self.words.get(data, ends - n, ends, lambda at: self.contract([words[i] for i in at.tolist()]))
        upto = np.concatenate([[0], np.cumsum(sizes)])
        per = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
        return flat, np.diff(upto[per])

    def decode(self, flat: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Bytes of each id list ``flat[offsets[i]:offsets[i + 1]]``."""
        import pyarrow as pa
        if len(flat) and not (0 <= flat.min() and flat.max() < self.size and self.known[flat].all()):
            raise ValueError("an id is not in the vocabulary")
        cut = self.spaced[flat]  # equal runs of ids between such tokens are decoded once
        cut[offsets[:-1][offsets[:-1] < len(flat)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(flat))[:len(starts)]
        data, n = self.pieces.get(flat, starts, ends, lambda at: self._spell(flat, starts[at], (ends - starts)[at]))
        upto = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, offsets)]
        data = data.tobytes()
        return [data[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]

    def _spell(self, flat: np.ndarray, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the id runs one after another, number of each)."""
        import pyarrow as pa
        self.con.register("piece_rows", pa.table({
            "piece": np.repeat(np.arange(len(n), dtype=np.int32), n), "pos": np.arange(n.sum()), "id": gathered(flat, x, n)}))
        got = [bytes.fromhex(x) for x in self.con.sql(_DECODE).to_arrow_table()["bytes"].to_pylist()]
        return np.frombuffer(b"".join(got), np.uint8), np.fromiter(map(len, got), np.int64, len(got))


# White space of the tokenizer's pattern: one byte each, or these sequences.
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_WIDE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
                                   0x202F, 0x205F, 0x3000)]
_CODERS: dict = {}


def _split_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


def _coder(shared, pattern: str) -> Coder:
    key = (shared.id if hasattr(shared, "id") else id(shared), pattern)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(shared.value, pattern)
    return _CODERS[key]


def _settings(spark: SparkSession, rank_file, pattern):
    import public_tokenizers
    path = rank_file or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    # the vocabulary file is fixed and small (1 MB): a broadcast of known size
    key = (spark.sparkContext.applicationId, path)
    if key not in _SHARED:
        _SHARED[key] = spark.sparkContext.broadcast(read_ranks(path))
    return _SHARED[key], pattern or public_tokenizers.PATTERN


_SHARED: dict = {}


def encode(docs: DataFrame, rank_file: str | None = None, pattern: str | None = None,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every text, as the rank file's tokenizer
    without special tokens."""
    small_batches(docs.sparkSession)
    shared, pattern = _settings(docs.sparkSession, rank_file, pattern)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        import pyarrow as pa
        coder = _coder(shared, pattern)
        for batch in batches:
            flat, n = coder.encode(batch.column(1).to_pylist())
            off = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(flat, pa.int32()))],
                names=["doc_id", "ids"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, rank_file: str | None = None, pattern: str | None = None,
           id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded binary) of every id list."""
    small_batches(encoded.sparkSession)
    shared, pattern = _settings(encoded.sparkSession, rank_file, pattern)
    src = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches):
        import pyarrow as pa
        coder = _coder(shared, pattern)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            lists = batch.column(1)
            if lists.flatten().null_count:
                raise ValueError("an id is null")
            n = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
            off = np.concatenate([[0], np.cumsum(n)])
            texts = coder.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), off)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.binary())],
                                             names=["doc_id", "ids", "decoded"])

    return src.mapInArrow(
        run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")


def encode_and_decode(docs: DataFrame, rank_file: str | None = None, pattern: str | None = None,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded binary): ``decode(encode(docs))`` in one worker, so
    the ids don't travel twice and one process a task holds the tables."""
    small_batches(docs.sparkSession)
    shared, pattern = _settings(docs.sparkSession, rank_file, pattern)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        import pyarrow as pa
        coder = _coder(shared, pattern)
        for batch in batches:
            flat, n = coder.encode(batch.column(1).to_pylist())
            off = np.concatenate([[0], np.cumsum(n)])
            texts = coder.decode(flat, off)
            lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.binary())],
                                             names=["doc_id", "ids", "decoded"])

    return src.mapInArrow(
        run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, keep_ids: bool = False) -> DataFrame:
    """Digest of each document's ids and of what they decode to."""
    return encode_and_decode(docs).select(
        "doc_id", *["ids"] * keep_ids, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op1_byte_bpe": lambda spark, sf_dir: round_trip(documents(spark, sf_dir))}
