"""Shared pieces of the training-data operators: batching and word hashes."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.session import checkpoint_dir
from murmur.sources.tables import table

# One Arrow batch holds at most this many rows and (about) bytes, so a Python
# worker's memory does not depend on how long the texts of a table are.
BATCH_ROWS = 1000
BATCH_BYTES = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch carries to a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """The rows of ``df``, written to and read from the shared checkpoint folder.

    Unlike a checkpoint this computes the rows once, keeps them compressed,
    gives the planner their true size, and frees the shuffle files of the
    finished write; rows lost with an executor are read again from the table.
    With ``scratch`` the table's folder is noted there, for ``free``."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/rows-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREE, "false")
    spark.conf.set(_FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREE, before)
    if scratch is not None:
        scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """A reliable checkpoint, with its folder noted in ``scratch``."""
    checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    if scratch is not None:
        scratch.append(out._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get())
    return out


def free(spark: SparkSession, scratch: list[str]) -> None:
    """Delete an operator's own intermediate tables, once nothing that is
    still to run reads them."""
    while scratch:
        path = spark._jvm.org.apache.hadoop.fs.Path(scratch.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes not to
    be the name of a column (names differ in more than case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def fold_of(col: Column, n: int) -> Column:
    """crc32 of the column as text, modulo ``n`` (null ids: fold of '')."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


# ---- word hashes --------------------------------------------------------
# Words are maximal runs of bytes other than space and 0x09-0x0D, ASCII
# letters lower-cased. A word's hash is the sum over its bytes of a mixed value
# of the byte times a mixed factor of its place in the word, modulo 2^64, mixed
# again with its length. The factors have no structure that a text could repeat
# (a polynomial's powers do: Thue-Morse words collide under any odd base), so
# different words collide with odds near 2^-57, whatever they look like.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WINDOW = 1 << 16       # bytes whose products are held at a time
_PLACES = 1 << 16       # factors kept in a table; later ones are computed
_SEED, _SEED2, _STEP = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _computed(place: np.ndarray, seed: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(place.astype(np.uint64) * _STEP + seed)


_FACTORS = {seed: _computed(np.arange(_PLACES), seed) for seed in (_SEED, _SEED2)}
_VALUE = mix(np.arange(256).astype(np.uint64) + np.uint64(1))
_WORD_VALUE = np.where(_SPACE, np.uint64(0), _VALUE[_LOWER])


def _factors(place: np.ndarray, seed: np.uint64) -> np.ndarray:
    table = _FACTORS[seed]
    if not len(place) or place.max() < _PLACES:
        return table.take(place)
    return np.where(place < _PLACES, table[np.minimum(place, _PLACES - 1)], _computed(place, seed))


def in_a_row(starts: np.ndarray, ends: np.ndarray) -> bool:
    """Every run begins where the one before ends."""
    return bool(len(starts)) and np.array_equal(starts[1:], ends[:-1])


def _hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, value_of, lengths=None,
            seeds=(_SEED,)) -> list[np.ndarray]:
    """For each seed the hash of every run, in windows over the runs' places;
    ``lengths`` are mixed in where they are not the runs' own."""
    sizes = ends - starts
    stop = np.cumsum(sizes)
    out = [np.zeros(len(sizes), np.uint64) for _ in seeds]
    row = in_a_row(starts, ends)
    with np.errstate(over="ignore"):
        for lo in range(0, int(stop[-1]) if len(stop) else 0, _WINDOW):
            hi = min(int(stop[-1]), lo + _WINDOW)
            a, b = np.searchsorted(stop, [lo, hi - 1], side="right")
            runs = np.arange(a, b + 1)
            runs = runs[sizes[runs] > 0]
            first = stop[runs] - sizes[runs]
            begin = np.maximum(first, lo)
            held = np.minimum(stop[runs], hi) - begin
            at = np.arange(lo, hi)
            place = at - np.repeat(first, held)
            part = value_of(values[starts[0] + lo:starts[0] + hi] if row
                            else values.take(np.repeat(starts[runs] - first, held) + at))
            for o, seed in zip(out, seeds):
                o[runs] += np.add.reduceat(part * _factors(place, seed), begin - lo)
        size = (sizes if lengths is None else lengths).astype(np.uint64) * _STEP
        return [mix(o + size) for o in out]


def _value_of(values: np.ndarray):
    return (lambda v: _VALUE.take(v)) if values.dtype == np.uint8 else (lambda v: mix(v.astype(np.uint64) + np.uint64(1)))


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every run ``values[start:end]`` of small numbers."""
    return _hashes(values, starts, ends, _value_of(values))[0]


def run_hash_pairs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two independent hashes of every run, 128 bits in all."""
    return _hashes(values, starts, ends, _value_of(values), seeds=(_SEED, _SEED2))


def to_bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, first word of each text and the end)."""
    joined = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    word = ~_SPACE[joined]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    # a word with the white space after it, which adds nothing, is a run
    (hashes,) = _hashes(joined, starts, np.append(starts[1:], len(joined))[:len(starts)], lambda v: _WORD_VALUE.take(v),
                        ends - starts)
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    return hashes, np.searchsorted(starts, offsets)


def blocks_of(texts: list[bytes], limit: int = 1 << 20):
    """Consecutive slices of about ``limit`` bytes (a longer text alone)."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


_SLOT = [np.uint64(c) for c in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
                                0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def shingle_hashes(words: np.ndarray, first: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """Per text, the hashes of its n-word shingles in order; a text with
    fewer words has its whole sequence as one, one without words none."""
    total = max(len(words) - n + 1, 0)
    with np.errstate(over="ignore"):
        run = np.zeros(total, np.uint64)
        for k in range(n):
            run += words[k:k + total] * _SLOT[k]
        run = mix(run)
        out = []
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= n:
                out.append(run[a:b - n + 1])
            elif b > a:
                short = np.uint64(b - a)
                for k in range(b - a):
                    short = short + words[a + k] * _SLOT[k]
                out.append(mix(np.array([short], np.uint64)))
            else:
                out.append(run[:0])
    return out
