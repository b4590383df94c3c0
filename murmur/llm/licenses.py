"""Operator 3: licence scans by Dice coefficient over word bigrams.

A text is normalised (ASCII lower case, runs of other characters than letters
and digits, line breaks too, become one space) and every window of its words is
compared with licence templates by the Dice coefficient 2|A n B| / (|A| + |B|)
of the bags of word bigrams, so a notice is found alone on its line, wrapped
over lines or inside a paragraph. For a coefficient of t the sizes must lie
within a factor t / (2 - t), and so must the shared bigrams; the best window
begins and ends with a bigram of its template. The texts' bigrams are looked up
in the sorted bigram hashes of the fixed templates, and only where enough of a
template's lie close together are windows compared, never all against all.

Of windows over ``threshold`` that overlap the best one stays: highest
coefficient, then least template id, then shortest, then first. Texts are not
shuffled; only the notices found are, to drop repeated rows. Words are compared
by 64-bit hashes. The templates are notices; of a whole licence text those
sentences are found that are among them.

Defined results: null or empty texts and windows of fewer than two words match
nothing; ``line_no`` and ``word_no`` are those of a notice's first word, from
0; several notices on one line are several rows; repeated rows of one document
count once; null ids are kept as an id of their own; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from murmur.llm.common import blocks_of, documents, mix, small_batches, to_bytes, word_hashes

THRESHOLD = 0.8
_PLAIN = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256)).lower()
_GAP = 1 << 40  # between the positions of two texts
# Licence notices as their publishers word them (fixed values).
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file"
                   " except in compliance with the License."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
            " associated documentation files."],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the"
                " GNU General Public License."],
    "lgpl-2.1": ["Licensed under the GNU Lesser General Public License, version 2.1."],
    "bsd-3-clause": ["Licensed under the BSD 3-Clause License.",
                     "Redistribution and use in source and binary forms, with or without modification, are"
                     " permitted provided that the following conditions are met."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0"
                  " International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0."],
    "cc0-1.0": ["This work is dedicated to the public domain under CC0 1.0 Universal."],
}


def bigrams(text: str) -> Counter:
    words = re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).split()
    return Counter(f"{a} {b}" for a, b in zip(words, words[1:]))


def _bigram_hashes(words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(words[:-1] * np.uint64(0xA0761D6478BD642F) + words[1:] * np.uint64(0xE7037ED1A0B428DB))


class Scanner:
    def __init__(self, templates: dict[str, list[str]], threshold: float):
        self.threshold, self.templates = threshold, []
        hashes = {}
        for name, texts in templates.items():
            for k, text in enumerate(texts):
                seen = _bigram_hashes(word_hashes([to_bytes(text).translate(_PLAIN)])[0])
                if len(seen):
                    self.templates.append((f"{name}#{k}", name, Counter(
                        hashes.setdefault(int(h), len(hashes)) for h in seen)))
        self.templates.sort(key=lambda x: x[0])
        keys = np.array(list(hashes), np.uint64)
        order = np.argsort(keys)
        self.keys, self.codes = keys[order], order
        self.holds = np.zeros((len(self.templates), len(keys)), bool)
        for row, (_, _, bag) in zip(self.holds, self.templates):
            row[list(bag)] = True

    def windows(self, at: np.ndarray, code: np.ndarray):
        """(-dice, template, bigrams, first position) of every window that counts."""
        for k, (_, _, bag) in enumerate(self.templates):
            mine = self.holds[k, code]
            q, c = at[mine], code[mine]
            size, ratio = sum(bag.values()), self.threshold / (2 - self.threshold)
            least, most = max(math.ceil(size * ratio - 1e-9), 1), math.floor(size / ratio + 1e-9)
            if len(q) < least:
                continue
            for i in np.flatnonzero(q[least - 1:] - q[:len(q) - least + 1] < most).tolist():
                left, common = dict(bag), 0
                for j in range(i, len(q)):
                    n = int(q[j] - q[i]) + 1
                    if n > most:
                        break
                    if left[int(c[j])]:
                        left[int(c[j])] -= 1
                        common += 1
                        dice = 2.0 * common / (n + size)
                        if dice >= self.threshold:
                            yield -dice, k, n, int(q[i])

    def notices(self, texts: list[bytes]):
        """(text, line, word, notice, license, dice) of the notices in some texts."""
        plain = [t.translate(_PLAIN) for t in texts]
        words, first = word_hashes(plain)
        if len(words) < 2 or not len(self.keys):
            return
        found = _bigram_hashes(words)
        slot = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        hit = self.keys[slot] == found
        ends = first[1:-1]
        hit[ends[(ends > 0) & (ends < len(words))] - 1] = False  # across two texts
        at = np.flatnonzero(hit)
        text = np.searchsorted(first, at, "right") - 1
        best: dict[int, list] = {}
        for w in self.windows(at + text * _GAP, self.codes[slot[at]]):
            best.setdefault(w[3] // _GAP, []).append(w)
        for t, ws in sorted(best.items()):
            code = np.frombuffer(b" " + plain[t] + b" ", np.uint8) != 32
            edge = np.flatnonzero(code[1:] != code[:-1])
            starts, stops = edge[0::2], edge[1::2]
            taken = set()
            for dice, k, n, lo in sorted(ws):
                lo -= t * _GAP + int(first[t])
                if taken.isdisjoint(range(lo, lo + n)):
                    taken.update(range(lo, lo + n))
                    a, b = int(starts[lo]), int(stops[lo + n])
                    yield (t, texts[t].count(b"\n", 0, a), lo, b" ".join(plain[t][a:b].split()).decode(),
                           self.templates[k][1], -dice)


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None,
         threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, line_no, license, dice, word_no, notice) of every notice."""
    small_batches(docs.sparkSession)
    scanner = Scanner(templates or TEMPLATES, threshold)
    src = docs.select("doc_id", "text")

    def run(batches):
        import pyarrow as pa
        for b in batches:
            texts = [to_bytes(t) for t in b.column(1).to_pylist()]
            rows = [(lo + t, *r) for lo, hi in blocks_of(texts) for t, *r in scanner.notices(texts[lo:hi])]
            t, line, word, notice, name, dice = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(t, pa.int64())), pa.array(line, pa.int32()), pa.array(name, pa.string()),
                 pa.array(dice, pa.float64()), pa.array(word, pa.int64()), pa.array(notice, pa.string())],
                names=["doc_id", "line_no", "license", "dice", "word_no", "notice"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, line_no int, license string,"
                               " dice double, word_no bigint, notice string").distinct()


QUERIES = {"op3_license_scan": lambda spark, sf_dir: scan(documents(spark, sf_dir))}
