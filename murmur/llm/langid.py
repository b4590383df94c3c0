"""Operator 5: language identification by a byte convolutional network.

A text is cut into windows of ``WINDOW`` bytes (ASCII letters lower-cased).
For every window, filters of several widths run over the bytes, each filter's
largest response is kept (max pooling, ReLU), and a softmax layer gives the
languages. A filter of width w over one-hot bytes is w table lookups per
position, so a batch of windows is a few vectorised gathers. A text's
probabilities are the mean over all its windows, weighted by their letters:
whole texts count, never prefixes.

The network is trained in numpy on at most ``PER_LANGUAGE`` texts of every
language, picked by a hash of the text, with at most ``TRAIN_BYTES`` bytes of
each, from a place that another hash picks in the whole text: a bounded sample,
fitted on the driver. Prediction runs over all rows in
``mapInArrow`` without a shuffle.

Defined results: a text that is null or has no letter is ``und`` with score 1;
without any training text everything is ``und``; one language alone is always
predicted with score 1; ties go to the language first in order; lone
surrogates and any other bytes are ordinary input; repeated rows, null ids and
further columns change nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.llm.common import blocks_of, documents, fold_of, fresh, small_batches, to_bytes

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12            # of each width
PER_LANGUAGE = 400      # training texts of each language, at most
TRAIN_BYTES = 1024      # of each, at most
EPOCHS = 12
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def windows(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows as rows of bytes padded by 0, text of each, letters of each)."""
    owner = np.repeat(np.arange(len(raw)), [-(-len(t) // WINDOW) for t in raw])
    rows = np.zeros((len(owner), WINDOW), np.uint8)
    at = 0
    for t in raw:
        k = -(-len(t) // WINDOW)
        rows[at:at + k].reshape(-1)[:len(t)] = np.frombuffer(t, np.uint8)
        at += k
    rows = _LOWER[rows]
    letters = ((rows >= 97) & (rows <= 122)) | (rows >= 128)
    return rows, owner, letters.sum(axis=1)


class Network:
    """Filters ``tables[w][k, byte, filter]``, biases, and the softmax layer."""

    def __init__(self, languages: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, (len(self.bias), len(languages))).astype(np.float32)
        self.base = np.zeros(len(languages), np.float32)

    def pooled(self, rows: np.ndarray, where: bool = False):
        """Largest response of every filter, and (for training) its place."""
        best, place = [], []
        for table in self.tables:
            w = len(table)
            span = rows.shape[1] - w + 1
            reply = table[0][rows[:, :span]]
            for k in range(1, w):
                reply += table[k][rows[:, k:k + span]]
            if where:
                at = reply.argmax(axis=1)
                place.append(at)
                best.append(np.take_along_axis(reply, at[:, None, :], axis=1)[:, 0])
            else:
                best.append(reply.max(axis=1))
        return np.concatenate(best, axis=1) + self.bias, place

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        parts = []
        for i in range(0, len(rows), 64):
            x, _ = self.pooled(rows[i:i + 64])
            z = np.maximum(x, 0) @ self.out + self.base
            z = np.exp(z - z.max(axis=1, keepdims=True))
            parts.append(z / z.sum(axis=1, keepdims=True))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), np.float32)

    def train(self, rows: np.ndarray, label: np.ndarray, seed: int = 5, rate: float = 0.02) -> None:
        """Adam on the cross-entropy; a max pool passes a filter's gradient to
        the w bytes of its best place only."""
        rng = np.random.default_rng(seed)
        params = [*self.tables, self.bias, self.out, self.base]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(rows))
            for i in range(0, len(rows), 64):
                pick = order[i:i + 64]
                x, place = self.pooled(rows[pick], where=True)
                hidden = np.maximum(x, 0)
                z = hidden @ self.out + self.base
                z = np.exp(z - z.max(axis=1, keepdims=True))
                z /= z.sum(axis=1, keepdims=True)
                z[np.arange(len(pick)), label[pick]] -= 1
                z /= len(pick)
                back = (z @ self.out.T) * (x > 0)
                grads = []
                for j, at in enumerate(place):
                    g = np.zeros_like(self.tables[j])
                    own = back[:, j * FILTERS:(j + 1) * FILTERS]
                    for k in range(len(g)):
                        byte = np.take_along_axis(rows[pick], at + k, axis=1)
                        np.add.at(g[k], (byte, np.arange(FILTERS)[None, :]), own)
                    grads.append(g)
                grads += [back.sum(axis=0), hidden.T @ z, z.sum(axis=0)]
                t += 1
                for p, g, a, b in zip(params, grads, m, v):
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    p -= rate * (a / (1 - 0.9 ** t)) / (np.sqrt(b / (1 - 0.99 ** t)) + 1e-6)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Train on a bounded sample of the labelled rows."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")) \
        .where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    million = 1_000_000
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items()
                           for x in (lang, min(million, -(-PER_LANGUAGE * million // n)))])
    texts = rows.select("text", "lang", F.pmod(F.xxhash64("text"), F.lit(million)).alias("draw")) \
        .where(F.col("draw") < share[F.col("lang")]) \
        .withColumn("at", F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - TRAIN_BYTES, F.lit(0)) + 1)) \
        .select(F.expr(f"substring(text, at + 1, {TRAIN_BYTES})").alias("text"), "lang").distinct() \
        .orderBy(F.xxhash64("text"), "text", "lang").limit(2 * PER_LANGUAGE * len(sizes)).collect()
    languages = sorted(sizes)
    net = Network(languages)
    x, owner, letters = windows([to_bytes(r["text"])[:TRAIN_BYTES] for r in texts])
    label = np.array([languages.index(r["lang"]) for r in texts], np.int64)[owner]
    use = letters > 0
    if len(languages) > 1 and use.any():
        net.train(x[use], label[use])
    return net


def with_language(docs: DataFrame, net: Network | None, text_col: str = "text",
                  names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The documents with two more columns: predicted language and score."""
    small_batches(docs.sparkSession)
    if set(names) & set(docs.columns):
        raise ValueError(f"the documents have a column named like one of {names}")
    (letter,) = fresh(docs, "_letter")
    src = docs.withColumn(letter, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))

    def run(batches):
        import pyarrow as pa
        for b in batches:
            has = b.column(b.num_columns - 1).to_pylist()
            raw = [to_bytes(t) if h else b"" for t, h in zip(b.column(text_col).to_pylist(), has)]
            found, scores = [], []
            for lo, hi in blocks_of(raw):
                if net is None:
                    mean = np.zeros((hi - lo, 1))
                else:
                    rows, owner, letters = windows(raw[lo:hi])
                    p = net.probabilities(rows) * letters[:, None]
                    mean = np.stack([np.bincount(owner, p[:, j], hi - lo) for j in range(p.shape[1])], axis=1).astype(float)
                    mean /= np.maximum(np.bincount(owner, letters, hi - lo), 1)[:, None]
                for i in range(hi - lo):
                    if net is None or not has[lo + i]:
                        found.append("und"), scores.append(1.0)
                    else:
                        j = int(mean[i].argmax())
                        found.append(net.languages[j]), scores.append(float(min(1.0, mean[i, j])))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                names=[*b.schema.names[:-1], *names])

    schema = docs.schema
    for name, kind in zip(names, (T.StringType(), T.DoubleType())):
        schema = T.StructType([*schema.fields, T.StructField(name, kind)])
    return src.mapInArrow(run, schema)


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_language(src, net).drop("text")


def language_of_documents(docs: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """Learn on all folds but one and predict every document."""
    fold = fold_of(F.col("doc_id"), folds)
    net = fit(docs.where(fold != held))
    return predict(docs, net).withColumn("held_out", fold == held) \
        .select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op5_language_id": lambda spark, sf_dir: language_of_documents(documents(spark, sf_dir))}
