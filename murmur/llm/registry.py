"""Queries of the training-data operators: name -> builder, name -> SQL."""

from __future__ import annotations

from murmur.llm import (ann, bpe, divergence, fingerprints, langid, licenses, mixing, near_dedup, ngram_lm,
                        pii, token_counts, toxicity, whitening)

QUERIES = {}
ORACLES = {}
for _m in (bpe, fingerprints, licenses, ngram_lm, langid, pii, mixing, ann, near_dedup, toxicity,
           divergence, whitening, token_counts):
    QUERIES.update(_m.QUERIES)
    ORACLES.update(getattr(_m, "ORACLES", {}))
