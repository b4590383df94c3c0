"""Operator 10: toxicity by a gapped-subsequence string kernel and an SVM.

Words are their letters only (ASCII lower-cased; other bytes fold into five
classes), so characters put between letters disappear, and a run of single
letters is read as one word. The kernel of two words counts common
subsequences of three letters, each weighted by ``DECAY`` to the power of the
gaps it spans (at most ``SPAN`` letters long), normalised to 1 for a word with
itself: one inserted or missing letter leaves most of it. A text's features are
its largest kernel values against each of ``LANDMARKS`` words. The Nystrom map
(inverse square root of the landmarks' own kernel) turns them into vectors for
a linear support vector machine, whose margin a logistic curve makes a score.

Landmarks, SVM and curve are learned on the driver from a bounded sample:
at most about ``PER_LABEL`` labels of either kind, picked by a hash of the id
(no more than three times that many texts). Scoring runs over whole texts of all rows in ``mapInArrow``: a word's
subsequences are looked up in one table of the landmarks', words of a batch
once each, no shuffle.

Defined results: null, empty or letterless texts get the score of no match;
without labels of both kinds every score is the share of label 1 (0 without
labels); rows labelled twice count once per label; repeated rows, null ids and
further columns change nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import blocks_of, documents, fold_of, run_hashes, small_batches, to_bytes
from murmur.sources.tables import table

SPAN = 6
POWER = 3                # of the kernel: a power of a kernel is one, and sets near words apart
DECAY = 0.85
RIDGE = 1e-4
LANDMARKS = 96
PER_LABEL = 1500
THRESHOLD = 0.3
# letters a-z are 1-26, bytes of other letters fold into 27-31, the rest is dropped
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27 + np.arange(128) % 5
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_OFFSETS = [(i, j, DECAY ** (j - 2)) for j in range(2, SPAN) for i in range(1, j)]


def letter_words(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters of all words in a row, start and end of each, its text)."""
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    owner_at = np.cumsum([1] + [len(t) + 1 for t in raw])[:-1]
    white = _WHITE[data]
    code = _CLASS[data]
    new = white.copy()  # a word begins after white space ...
    edge = np.flatnonzero(white)
    letters = np.concatenate([[0], np.cumsum(code > 0)])
    single = letters[edge[1:]] - letters[edge[:-1]] == 1
    # ... but between two words of one letter each it doesn't, within a text
    between = np.flatnonzero(single[:-1] & single[1:]) + 1
    between = between[~np.isin(edge[between], owner_at - 1)]
    new[edge[between]] = False
    keep = code > 0
    group = np.cumsum(new)[keep]
    code = code[keep]
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(code) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(code))[:len(starts)]
    owner = np.searchsorted(owner_at, np.flatnonzero(keep)[starts], side="right") - 1
    return code, starts, ends, owner


def subsequences(code, starts, ends):
    """(word, triple, weight) of all subsequences of three letters."""
    n = ends - starts
    word = np.repeat(np.arange(len(n)), n)
    left = np.repeat(ends, n) - np.arange(len(code))  # letters up to the word's end
    c = code.astype(np.int32)
    out = []
    for i, j, weight in _OFFSETS:
        at = np.flatnonzero(left > j)
        out.append((word[at], (c[at] << 10) | (c[at + i] << 5) | c[at + j], weight))
    return out


def dense(code, starts, ends):
    """Rows of the subsequence weights, for a few words."""
    rows = np.zeros((len(starts), 1 << 15))
    for word, triple, weight in subsequences(code, starts, ends):
        np.add.at(rows, (word, triple), weight)
    return rows


def norms(code, starts, ends) -> np.ndarray:
    """Square root of every word's kernel with itself."""
    parts = subsequences(code, starts, ends)
    key = np.concatenate([w.astype(np.int64) << 15 | t for w, t, _ in parts])
    weight = np.concatenate([np.full(len(w), x) for w, _, x in parts])
    key, at = np.unique(key, return_inverse=True)
    total = np.bincount(at, weight, len(key))
    return np.sqrt(np.bincount(key >> 15, total * total, len(starts)))


class Model:
    """Landmarks with their triples, Nystrom map, SVM weights and curve."""

    def __init__(self, landmarks: list[bytes], share: float):
        self.share, self.landmarks = share, landmarks
        self.weights = None
        if landmarks:
            code, starts, ends, _ = letter_words(landmarks)
            rows = dense(code, starts, ends)
            rows /= np.sqrt((rows * rows).sum(axis=1, keepdims=True))
            gram = (rows @ rows.T) ** POWER
            values, vectors = np.linalg.eigh(gram)
            values = np.maximum(values, 1e-3)
            self.nystrom = (vectors / np.sqrt(values)) @ vectors.T
            # per triple: its landmarks and weights, as slices of two arrays
            triple, landmark = np.nonzero(rows.T)
            self.first = np.searchsorted(triple, np.arange((1 << 15) + 1)).astype(np.int32)
            self.landmark = landmark.astype(np.int32)
            self.weight = rows.T[triple, landmark].astype(np.float32)

    def word_features(self, code, starts, ends) -> np.ndarray:
        """Kernel of every word with every landmark."""
        m = len(self.landmarks)
        out = np.zeros((len(starts), m), np.float32)
        for lo in range(0, len(starts), 20_000):
            hi = min(len(starts), lo + 20_000)
            a, b = starts[lo], ends[hi - 1]
            total = np.zeros((hi - lo) * m)
            own = code[a:b], starts[lo:hi] - a, ends[lo:hi] - a
            for word, triple, weight in subsequences(*own):
                x, n = self.first[triple], self.first[triple + 1] - self.first[triple]
                hit = np.flatnonzero(n)
                x, n, word = x[hit], n[hit], word[hit]
                at = np.repeat(x - (np.cumsum(n) - n), n) + np.arange(n.sum())
                total += np.bincount(np.repeat(word, n) * m + self.landmark[at], self.weight[at] * weight,
                                     len(total))
            some = np.flatnonzero(total.reshape(-1, m).any(axis=1))
            if len(some):
                part = norms(*_pick(*own, some))
                out[lo + some] = total.reshape(-1, m)[some] / np.maximum(part, 1e-9)[:, None]
        return out

    def features(self, raw: list[bytes]) -> np.ndarray:
        """Per text, the largest kernel value against every landmark."""
        out = np.zeros((len(raw), len(self.landmarks)), np.float32)
        code, starts, ends, owner = letter_words(raw)
        use = ends - starts >= 3
        starts, ends, owner = starts[use], ends[use], owner[use]
        if not len(starts):
            return out
        _, at, which = np.unique(run_hashes(code, starts, ends), return_index=True, return_inverse=True)
        words = self.word_features(*_pick(code, starts, ends, at))
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        for j, (x, y) in enumerate(zip(first, np.append(first[1:], len(owner)))):
            out[owner[x]] = words[which[x:y]].max(axis=0) ** POWER
        return out

    def margins(self, features: np.ndarray) -> np.ndarray:
        return (features @ self.nystrom) @ self.weights + self.intercept

    def scores(self, raw: list[bytes]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(raw), self.share)
        z = self.slope * self.margins(self.features(raw)) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def train(self, raw: list[bytes], label: np.ndarray, rounds: int = 100) -> None:
        """Squared-hinge SVM by Newton steps on its active texts, both labels
        weighing the same, then the logistic curve on its margins. Every text
        also comes with a letter put into each longer word, so the margin
        learns how much of the kernel such a word keeps."""
        raw, label = raw + disturbed(raw), np.concatenate([label, label])
        x = np.concatenate([self.features(raw[lo:hi]) for lo, hi in blocks_of(raw)]) @ self.nystrom
        y = np.where(label == 1, 1.0, -1.0)
        weight = np.where(label == 1, 0.5 / max(label.sum(), 1), 0.5 / max((label == 0).sum(), 1))
        x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
        ridge = RIDGE * np.eye(x1.shape[1])
        ridge[-1, -1] = 1e-6
        both = np.zeros(x1.shape[1])
        for _ in range(rounds):
            inside = weight * (y * (x1 @ both) < 1)  # the texts on the wrong side of their margin
            new = np.linalg.solve(ridge + x1.T @ (x1 * inside[:, None]), x1.T @ (inside * y))
            if np.abs(new - both).max() < 1e-9:
                break
            both = both + (new - both) * 0.7
        w, b = both[:-1], both[-1]
        self.weights, self.intercept = w, b
        # the curve keeps the labels' true shares, whatever the sample's are
        weight = np.where(label == 1, self.share / max(label.sum(), 1), (1 - self.share) / max((label == 0).sum(), 1))
        margin = np.stack([x @ w + b, np.ones(len(x))], axis=1)
        curve = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(margin @ curve, -30, 30)))
            step = (margin * (weight * p * (1 - p))[:, None]).T @ margin + 1e-4 * np.eye(2)
            curve = curve + np.linalg.solve(step, margin.T @ (weight * (label - p)) - 1e-4 * (curve - [1, 0]))
        self.slope, self.shift = max(curve[0], 1e-3), curve[1]


def _pick(code, starts, ends, at):
    """The chosen words alone."""
    n = ends[at] - starts[at]
    to = np.cumsum(n)
    return code[np.repeat(starts[at] - (to - n), n) + np.arange(n.sum())], to - n, to


def disturbed(raw: list[bytes], seed: int = 10) -> list[bytes]:
    """The texts with one letter inserted into every word of four letters up."""
    rng, out = np.random.default_rng(seed), []
    for text in raw:
        words = text.split()
        at, letter = rng.random(len(words)), rng.integers(97, 123, len(words))
        for i, w in enumerate(words):
            if len(w) >= 4 and w.isalpha():
                k = 1 + int(at[i] * (len(w) - 1))
                words[i] = w[:k] + bytes([letter[i]]) + w[k:]
        out.append(b" ".join(words))
    return out


def choose_landmarks(raw: list[bytes], label: np.ndarray) -> list[bytes]:
    """Half the landmarks are the words that lean most towards label 1, half
    words drawn by hash from all texts."""
    code, starts, ends, owner = letter_words(raw)
    use = (ends - starts >= 3) & (ends - starts <= 24)
    starts, ends, owner = starts[use], ends[use], owner[use]
    if not len(starts):
        return []
    key, at, which = np.unique(run_hashes(code, starts, ends), return_index=True, return_inverse=True)
    pairs = np.unique(which.astype(np.int64) * len(raw) + owner)
    word, text = pairs // len(raw), pairs % len(raw)
    ones = np.bincount(word, label[text], len(key))
    zeros = np.bincount(word, 1 - label[text], len(key))
    lean = (ones / max(label.sum(), 1)) * np.log((ones / max(label.sum(), 1) + 1e-4)
                                                 / (zeros / max((label == 0).sum(), 1) + 1e-4))
    top = np.lexsort((key, -lean))[:LANDMARKS // 2]
    top = top[lean[top] > 0]
    rest = np.setdiff1d(np.argsort(key)[::max(1, len(key) // (LANDMARKS - len(top)))], top)[:LANDMARKS - len(top)]
    letters = b"\0abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 133))
    # the five folded classes are written as bytes of the same class
    fold = {27 + b % 5: 128 + b for b in range(128)}
    spell = np.array([fold.get(i, letters[i]) for i in range(32)], np.uint8)
    return [spell[code[starts[i]:ends[i]]].tobytes() for i in at[np.concatenate([top, rest]).astype(int)]]


def fit(labelled: DataFrame) -> Model:
    """Learn from (text, toxic) rows; a bounded sample reaches the driver."""
    rows = labelled.select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic")) \
        .where("toxic IN (0, 1)")
    few, share = drawn(rows, "text")
    return trained([(r["text"], r["toxic"]) for r in few], share)


def fit_by_id(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the texts of (doc_id, toxic) rows. The draw reads the labels
    alone; the ids drawn are broadcast to one scan of the documents, so texts
    are neither joined by shuffle nor sorted."""
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1) AND doc_id IS NOT NULL")
    few, share = drawn(rows, "doc_id")
    if not few:
        return Model([], share)
    ids = labels.sparkSession.createDataFrame(few, rows.schema)
    got = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id") \
        .select("text", "toxic").distinct().orderBy(F.xxhash64("text"), "text", "toxic").limit(3 * PER_LABEL).collect()
    return trained([(r["text"], r["toxic"]) for r in got], share)


def drawn(rows: DataFrame, key: str) -> tuple[list, float]:
    """(distinct rows of about ``PER_LABEL`` of either label, by a hash of the
    key, at most 3 * PER_LABEL in all; the share of label 1). No rows where
    one label is missing."""
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    share = sizes.get(1, 0) / max(sum(sizes.values()), 1)
    if len(sizes) < 2:
        return [], share
    million = 1_000_000
    draw = F.when(F.col("toxic") == 1, min(million, -(-PER_LABEL * million // sizes[1]))) \
        .otherwise(min(million, -(-PER_LABEL * million // sizes[0])))
    return rows.where(F.pmod(F.xxhash64(key), F.lit(million)) < draw).distinct() \
        .orderBy(F.xxhash64(key), key, "toxic").limit(3 * PER_LABEL).collect(), share


def trained(rows: list[tuple[str, int]], share: float) -> Model:
    raw, label = [to_bytes(t) for t, _ in rows], np.array([x for _, x in rows], float)
    landmarks = choose_landmarks(raw, label) if rows else []
    if not landmarks or len(set(label)) < 2:
        return Model([], share)
    model = Model(landmarks, share)
    model.train(raw, label)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        import pyarrow as pa
        for b in batches:
            raw = [to_bytes(t) for t in b.column(1).to_pylist()]
            out = [model.scores(raw[lo:hi]) for lo, hi in blocks_of(raw)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], names=["doc_id", "score"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Learn on all folds but one and score every document."""
    fold = fold_of(F.col("doc_id"), folds)
    learn = labels.select("doc_id", "toxic").where(fold_of(F.col("doc_id"), folds) != held)
    return score(docs, fit_by_id(docs, learn)).select(
        "doc_id", (fold == held).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


QUERIES = {"op10_toxicity": lambda spark, sf_dir: toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))}
