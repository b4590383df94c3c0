"""Operator 13: how many tokens each document has, without its token ids.

A byte-level BPE splits a text into pre-tokens and encodes each by itself, so
a document's count is the sum, over its distinct pre-tokens, of frequency
times pieces. Pieces are counted once per distinct pre-token:

1. Pre-tokens that are frequent in a sample of documents form a dictionary of
   at most ``DICTIONARY`` entries of at most ``ENTRY_BYTES`` bytes, which is
   broadcast. It only spares rows: no count depends on what it holds.
2. One pass splits every text, sums what the dictionary has, and keeps the
   other (pre-token, frequency) pairs of the document.
3. Those are exploded; their distinct pre-tokens are counted once each, joined
   back on the pre-token and summed per document.

The pattern runs in Python where it is known to cut like the library's own
pre-tokenizer, else that pre-tokenizer does (``_ALIKE``). Very long texts are
cut before single spaces that follow a non-space, where a pre-token always
begins.

Defined results: null text counts as empty and has 0 bytes and tokens; special
tokens' strings inside a text are one token each, the library's default; every
input row gives one row, repeated or null ids included; an empty table gives
no rows; other columns are ignored. Row keys are written with the rows of
pass 2, so a lost executor never renumbers them.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import documents, small_batches, stored

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512               # tokens above which a document is over the limit
DICTIONARY = 100_000      # entries that are broadcast
ENTRY_BYTES = 64          # of one entry, at most
SAMPLE_DOCS = 20_000      # documents that propose entries, about
SLICE = 1 << 20           # characters of one text that are split at a time
ENCODED = 4096            # pre-tokens given to the library at once

# Code points whose classes (letter, number, space) are alike in the pattern
# engine and the tokenizer library, whatever their Unicode versions: Latin to
# Cyrillic, general punctuation, arrows, kana to unified ideographs, Hangul.
_ALIKE = re.compile("[^\x00-ԯ‐-‧‰-⁞←-⇿ぁ-ゖ゠-ヿ一-龥가-힣]")
_CUT = re.compile(r"(?<=\S) (?=\S)")


class Splitter:
    """Pre-tokens of a text, as the tokenizer of a JSON file cuts it."""

    def __init__(self, config: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer
        parts = json.loads(config)
        kind = parts["pre_tokenizer"] or {}
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex") \
                or parts["normalizer"] or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]
                                              for t in parts["added_tokens"]):
            raise ValueError("pre-tokens are counted apart for byte-level tokenizers without normalizer only")
        self.tokenizer = Tokenizer.from_str(config)
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        names = sorted((t["content"] for t in parts["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None

    def _slices(self, text: str):
        lo = 0
        while len(text) - lo > SLICE:
            cut = _CUT.search(text, lo + SLICE)
            if not cut:
                break
            yield text[lo:cut.start()]
            lo = cut.start()
        yield text[lo:]

    def counts(self, text: str) -> tuple[Counter, int]:
        """(frequency of every pre-token, special tokens)."""
        parts = self.special.split(text) if self.special else [text]
        out = Counter()
        for part in parts:
            for piece in self._slices(part):
                if _ALIKE.search(piece):
                    cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(piece)
                    out.update(piece[a:b] for _, (a, b) in cut)
                else:
                    out.update(self.find(piece))
        return out, len(parts) - 1

    def pieces(self, words: list[str]) -> list[int]:
        """Pieces of each pre-token by itself."""
        out = []
        for lo in range(0, len(words), ENCODED):
            out += [len(e.ids) for e in self.tokenizer.encode_batch(words[lo:lo + ENCODED], add_special_tokens=False)]
        return out


def _sampled(config):
    def run(batches):
        split, seen = Splitter(config.value), Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                              names=["word", "docs"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(split.counts(text or "")[0].keys())
            if len(seen) > 4 * DICTIONARY:
                yield rows()
                seen.clear()
        yield rows()
    return run


def _pieces(config):
    def run(batches):
        split = Splitter(config.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(split.pieces(batch.column(0).to_pylist()), pa.int64())], names=["word", "pieces"])
    return run


_KNOWN = "key bigint, doc_id {id}, n_bytes bigint, known bigint, rest map<string, bigint>"


def _known(config, dictionary, id_type):
    def run(batches):
        from pyspark import TaskContext
        split, pieces = Splitter(config.value), dictionary.value.get
        key = TaskContext.get().partitionId() << 36
        rest_type = pa.map_(pa.string(), pa.int64())
        for batch in batches:
            keys, sizes, sums, rests = [], [], [], []
            for text in batch.column(1).to_pylist():
                words, known = split.counts(text or "")
                rest = []
                for word, n in words.items():
                    p = pieces(word)
                    if p is None:
                        rest.append((word, n))
                    else:
                        known += n * p
                keys.append(key)
                key += 1
                sizes.append(len((text or "").encode("utf-8", "surrogatepass")))
                sums.append(known)
                rests.append(rest)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()),
                 pa.array(rests, rest_type)], names=["key", "doc_id", "n_bytes", "known", "rest"])
    return run


def frequent(docs: DataFrame, config) -> dict[str, int]:
    """Pieces of the pre-tokens found in most documents of a sample."""
    every = max(1, docs.count() // SAMPLE_DOCS)
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0).select("text")
    top = sample.mapInArrow(_sampled(config), "word string, docs bigint").groupBy("word").agg(F.sum("docs").alias("docs")) \
        .where((F.octet_length("word") <= ENTRY_BYTES) & (F.col("docs") > 1)) \
        .orderBy(F.desc("docs"), "word").limit(DICTIONARY).select("word")
    return {r["word"]: r["pieces"] for r in top.mapInArrow(_pieces(config), "word string, pieces bigint").collect()}


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) by the tokenizer JSON file
    ``vocabulary`` (a path; the public 50k byte-level one if none is given)."""
    import public_tokenizers
    spark = docs.sparkSession
    small_batches(spark)
    with open(vocabulary or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        config = spark.sparkContext.broadcast(f.read())
    docs = docs.select("doc_id", "text")
    dictionary = spark.sparkContext.broadcast(frequent(docs, config))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(docs.mapInArrow(_known(config, dictionary, id_type), _KNOWN.format(id=id_type)))
    rest = rows.select("key", F.explode("rest").alias("word", "n"))
    pieces = rest.select("word").distinct().mapInArrow(_pieces(config), "word string, pieces bigint")
    sums = rest.join(pieces, "word").groupBy("key").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    total = F.col("known") + F.coalesce("more", F.lit(0))
    return rows.drop("rest").join(sums, "key", "left").select(
        "doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))


QUERIES = {"op13_token_counts": lambda spark, sf_dir: token_counts(documents(spark, sf_dir))}
