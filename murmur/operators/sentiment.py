"""Sentiment scoring as Spark jobs (SEN-1..7, LNG-3).

SEN-1 is a lexicon scorer implementing the rule set published with the
VADER paper (Hutto & Gilbert, ICWSM 2014): lexicon valence, booster
words with distance damping, negation within three tokens, ALL-CAPS
emphasis when capitalisation is differential, the contrastive "but" rule,
exclamation/question emphasis, and the compound normalisation
x / sqrt(x^2 + alpha). The lexicon is an *input table* (word, valence) of
any size: tokens are looked up in it, and each distinct text is scored from the
sums over its hits.

SEN-3/5 batch model scoring takes an injected predictor and runs it with
``mapInPandas`` (Arrow batches), optionally length-sorted within partitions.
"""

from __future__ import annotations

import os
from typing import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.functions.text import SPACE, token_count
from murmur.operators.common import fits_broadcast, join_back
from murmur.session import stored

# Rule constants from the published rule set.
B_INCR = 0.293
B_DECR = -0.293
C_INCR = 0.733
N_SCALAR = -0.74
ALPHA = 15.0
EXCLAIM_EACH, EXCLAIM_MAX = 0.292, 4
QUESTION_EACH, QUESTION_MAX = 0.18, 0.96
# Booster words (increment / decrement) and negations.
BOOST_UP = ["absolutely", "amazingly", "awfully", "completely", "considerable", "considerably", "decidedly",
            "deeply", "effing", "enormous", "enormously", "entirely", "especially", "exceptional",
            "exceptionally", "extreme", "extremely", "fabulously", "flipping", "flippin", "frackin", "fracking",
            "fricking", "frickin", "frigging", "friggin", "fully", "fuckin", "fucking", "fuggin", "fugging",
            "greatly", "hella", "highly", "hugely", "incredible", "incredibly", "intensely", "major", "majorly",
            "more", "most", "particularly", "purely", "quite", "really", "remarkably", "so", "substantially",
            "thoroughly", "total", "totally", "tremendous", "tremendously", "uber", "unbelievably", "unusually",
            "utter", "utterly", "very"]
BOOST_DOWN = ["almost", "barely", "hardly", "just enough", "kind of", "kinda", "kindof", "kind-of", "less",
              "little", "marginal", "marginally", "occasional", "occasionally", "partly", "scarce", "scarcely",
              "slight", "slightly", "somewhat", "sort of", "sorta", "sortof", "sort-of"]
NEGATIONS = ["aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt", "ain't", "aren't", "can't",
             "couldn't", "daren't", "didn't", "doesn't", "dont", "hadnt", "hasnt", "havent", "isnt", "mightnt",
             "mustnt", "neither", "don't", "hadn't", "hasn't", "haven't", "isn't", "mightn't", "mustn't",
             "neednt", "needn't", "never", "none", "nope", "nor", "not", "nothing", "nowhere", "oughtnt", "shant",
             "shouldnt", "uhuh", "wasnt", "werent", "oughtn't", "shan't", "shouldn't", "uh-uh", "wasn't",
             "weren't", "without", "wont", "wouldnt", "won't", "wouldn't", "rarely", "seldom", "despite"]
PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LEX_COLS = ["vader_negative", "vader_neutral", "vader_positive", "vader_compound", "vader_label"]


def _is_upper(w: Column) -> Column:
    """Python ``str.isupper``: has a cased character and no lower-case one."""
    return (w != F.lower(w)) & (w == F.upper(w))


def label_bands(compound: Column, lo: float = -0.05, hi: float = 0.05) -> Column:
    """SEN-2: <= lo negative, >= hi positive (inclusive), else neutral."""
    return (F.when(compound >= hi, F.lit("positive")).when(compound <= lo, F.lit("negative"))
            .otherwise(F.lit("neutral")))


def word_table(lexicon: DataFrame, word: str = "word", valence: str = "valence") -> DataFrame:
    """(k, v), one row per lower-cased word that has a valence."""
    return lexicon.select(F.lower(F.col(word)).alias("k"), F.col(valence).cast("double").alias("v")).where(
        "k <> ''").groupBy("k").agg(F.max("v").alias("v")).where("v IS NOT NULL")


# a token that is "but" without the punctuation around it
_BUT = rf"(?<![^{SPACE}])\p{{Punct}}*but\p{{Punct}}*(?![^{SPACE}])"


def _bare(raw: Column) -> Column:
    """A token without the punctuation around it, unless at most two characters stay."""
    bare = F.trim(raw, F.lit(PUNCT))
    return F.when(F.length(bare) <= 2, raw).otherwise(bare)


# What stands before a word: nothing, a booster up or down, the same in capitals, a negation.
_PLAIN, _UP, _DOWN, _LOUD_UP, _LOUD_DOWN, _NOT = range(6)
_ADDED = [0.0, B_INCR, B_DECR, B_INCR + C_INCR, B_DECR + C_INCR, 0.0]     # away from zero
_TIMES = [1.0, 1.0, 1.0, 1.0, 1.0, N_SCALAR]
_BUT_TIMES = [1.0, 0.5, 1.5]
KNOWN = 500_000             # words looked up by broadcast where the lexicon is too large for that
SAMPLE_CHARS = 64 << 20     # characters of text in which those are counted


def _states(df: DataFrame, valent: list[str]) -> DataFrame:
    """All that the rules need of a token but its valence: _up (in capitals
    among others), _s1 to _s3 (what stands before it) and _side of "but"
    (0 none, 1 before, 2 after). ``valent``: boosters that do not boost."""
    cap = F.col("_cap")
    ups, downs = ([w for w in words if w not in valent] for words in (BOOST_UP, BOOST_DOWN))
    df = df.withColumns({"_up": _is_upper(F.col("raw")) & cap, **{f"r{k}": _bare(F.col(f"t{k}")) for k in (1, 2, 3)}})
    for k in (1, 2, 3):
        p, s = F.col("_p"), F.col(f"_s{k}")
        df = df.withColumn("_p", F.lower(F.col(f"r{k}"))).withColumn(
            f"_s{k}", F.when(p.isin(downs), _DOWN).when(p.isin(ups), _UP)
            .when(p.isin(NEGATIONS) | p.contains("n't"), _NOT).otherwise(_PLAIN))
        df = df.withColumn(f"_s{k}", F.when(s.isin(_UP, _DOWN) & cap & _is_upper(F.col(f"r{k}")), s + 2).otherwise(s))
    but = F.nullif(F.col("_but"), F.lit(0))
    return df.withColumn("_side", F.when(F.col("pos") < but, 1).when(F.col("pos") > but, 2).otherwise(0))


def _ruled(df: DataFrame) -> DataFrame:
    """The valence v of a token after all rules, from its states. Constants
    are looked up by state: written out as conditions, the rules make a method
    beyond the 8000 bytes up to which the JVM compiles one."""
    of = lambda values, state: F.get(F.array(*[F.lit(x) for x in values]), F.col(state))
    v = F.col("v")
    df = df.withColumn("v", v + F.signum("v") * F.when(F.col("_up"), C_INCR).otherwise(0.0))
    for k, damp in ((1, 1.0), (2, 0.95), (3, 0.9)):
        df = df.withColumn("v", v + F.signum("v") * of([x * damp for x in _ADDED], f"_s{k}"))
        df = df.withColumn("v", v * of(_TIMES, f"_s{k}"))
    return df.withColumn("v", v * of(_BUT_TIMES, "_side"))


_SUMS = ["_hits", "_sum", "_pos", "_neg"]


def _summed(times: Column | None = None) -> list[Column]:
    """The sums over hits that each stand for ``times`` tokens."""
    v, n = F.col("v"), F.lit(1) if times is None else times
    of = lambda c: F.coalesce(F.sum(c * n), F.lit(0.0))
    return [F.coalesce(F.sum(F.when(v != 0, n).cast("long")), F.lit(0)).alias("_hits"), of(v).alias("_sum"),
            of(F.when(v > 0, v + 1)).alias("_pos"), of(F.when(v < 0, v - 1)).alias("_neg")]


def _common_words(df: DataFrame, text: Column, carriers: DataFrame) -> DataFrame:
    """(k, v, _seen) of the most frequent words, in ``carriers`` or not (v
    NULL). They are counted in a sample of the texts: it settles which words
    are looked up by broadcast, no score depends on it."""
    chars = df.agg(F.sum(F.length(text).cast("long")).alias("n")).first()["n"] or 0
    part = df if chars <= SAMPLE_CHARS else df.sample(SAMPLE_CHARS / chars, seed=7)
    words = part.select(F.explode(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+")).alias("t")).select(
        F.lower(_bare(F.col("t"))).alias("k")).where("k <> '' AND length(k) <= 64")
    top = words.groupBy("k").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "k").limit(KNOWN).select("k")
    return stored(top.join(carriers, "k", "left").select("k", "v", F.lit(True).alias("_seen")))


def lexicon_sums(df: DataFrame, text: Column, lexicon: DataFrame, **names) -> DataFrame:
    """One row per distinct text: _key (its digest), _rows (rows that hold
    it), counts of tokens and marks (_n, _ex, _qn), number _hits of its words
    that carry sentiment, and of their valences after all rules the sum _sum,
    and the sums _pos and _neg of those above and below zero, one added each.

    Each token is exploded with the three tokens before it and looked up once
    in the words that carry sentiment, by broadcast if they are measured to be
    few. Boosters, negations and "but" are fixed lists, so what a hit's
    predecessors do is known on its own row, and the rows of a text meet as
    sums: neither texts nor tokens are shuffled. Rows are added up one by one
    before copies of a text meet, so copies never add up.

    Of a lexicon too large for a broadcast the frequent words are looked up
    that way (``_common_words``); only the tokens of other words are shuffled,
    as a word, a row number and one number for the states around it."""
    held = stored(word_table(lexicon, **names))
    boosters = BOOST_UP + BOOST_DOWN
    # boosters with a valence of their own do not boost; no more than the list
    valent = [r["k"] for r in held.where(F.col("k").isin(boosters)).collect()]
    carriers = held.where((F.col("v") != 0) & ~F.col("k").isin(boosters))
    whole = fits_broadcast(carriers)

    plain = F.coalesce(text, F.lit(""))
    base = df.select(F.monotonically_increasing_id().alias("_row"), plain.alias("_t"))
    base = base.select("_row", "_t", F.unhex(F.sha2("_t", 256)).alias("_key"), F.regexp_count("_t", F.lit("!")).alias("_ex"),
                       F.regexp_count("_t", F.lit(r"\?")).alias("_qn"), F.array_remove(F.split("_t", f"[{SPACE}]+"), "").alias("_w"))
    nup = F.size(F.filter("_w", _is_upper))
    base = base.select("_row", "_key", "_ex", "_qn", F.size("_w").alias("_n"), ((nup > 0) & (nup < F.size("_w"))).alias("_cap"),
                       # only texts with "but" somewhere are searched for the word
                       F.when(F.lower("_t").rlike(_BUT), F.array_position(
                           F.transform("_w", lambda x: F.lower(_bare(x))), "but")).alias("_but"),
                       # position 0 is a mark that every text has, words or not
                       F.concat(F.array(F.lit("")), "_w").alias("_w0"))
    for k in (1, 2, 3):
        base = base.withColumn(f"_w{k}", F.concat(F.array_repeat(F.lit(""), k), "_w0"))
    per_row = ["_row", "_key", "_ex", "_qn", "_n", "_cap", "_but"]
    ex = base.select(*per_row, F.posexplode(F.arrays_zip("_w0", "_w1", "_w2", "_w3")).alias("pos", "z")).where(
        "pos <= _n").select(*per_row, "pos", *[F.col(f"z._w{k}").alias(f"t{k}") for k in range(4)])
    ex = ex.withColumn("raw", _bare(F.col("t0"))).withColumn("k", F.lower("raw"))
    counts = [F.max(c).alias(c) for c in ("_ex", "_qn", "_n")]
    if whole:
        hits = ex.join(F.broadcast(carriers), "k", "left").where((F.col("pos") == 0) | F.col("v").isNotNull())
        sums = _ruled(_states(hits, valent)).groupBy("_key", "_row").agg(*counts, *_summed())
    else:
        sums = _sums_of_many(df, text, ex, carriers, valent, counts)
    # copies have the same counts and, rounded, the same sums
    return sums.groupBy("_key").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.max(c).alias(c) for c in ("_ex", "_qn", "_n", "_hits")],
        *[F.max(F.round(c, 9)).alias(c) for c in ("_sum", "_pos", "_neg")])


def _sums_of_many(df: DataFrame, text: Column, ex: DataFrame, carriers: DataFrame, valent: list[str],
                  counts: list[Column]) -> DataFrame:
    """The sums per row over the tokens ``ex`` where ``carriers`` is too large
    for a broadcast (all words are looked up by shuffle where broadcasts are
    switched off)."""
    if df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").startswith("-"):
        seen = ex.withColumns({"v": F.lit(None).cast("double"), "_seen": F.lit(None).cast("boolean")})
    else:
        seen = ex.join(F.broadcast(_common_words(df, text, carriers)), "k", "left")
    # a token of an unknown word keeps its states in one number
    seen = seen.withColumn("_other", (F.col("pos") > 0) & F.col("_seen").isNull())
    rows = _ruled(_states(seen.where("_other OR v IS NOT NULL OR pos = 0"), valent))
    code = F.col("_up").cast("int")
    for c, n in (("_s1", 6), ("_s2", 6), ("_s3", 6), ("_side", 3)):
        code = code * n + F.col(c)
    other = F.col("_other")
    rows = stored(rows.groupBy("_row", F.when(~other, F.col("_key")).alias("_key"), F.when(other, F.col("k")).alias("_word"),
                               F.when(other, code).alias("_code")).agg(*counts, F.count(F.lit(1)).alias("_times"), *_summed()))
    found = rows.where("_word IS NOT NULL").select("_row", F.col("_word").alias("k"), "_code", "_times").join(carriers, "k")
    c = F.col("_code")
    for name, n in (("_side", 3), ("_s3", 6), ("_s2", 6), ("_s1", 6)):
        found = found.withColumn(name, (c % n).cast("int"))
        c = F.floor(c / n)
    found = _ruled(found.withColumn("_up", c == 1)).groupBy(F.col("_row").alias("_r")).agg(
        *[x.alias(f"{n}m") for x, n in zip(_summed(F.col("_times")), _SUMS)])
    both = rows.where("_word IS NULL").join(found, F.col("_row") == F.col("_r"), "left")
    return both.select("_key", "_row", "_ex", "_qn", "_n", *[(F.col(n) + F.coalesce(f"{n}m", F.lit(0))).alias(n) for n in _SUMS])


def lexicon_scores(df: DataFrame, text_col: str, lexicon: DataFrame, *, prefix: str = "vader_",
                   check_blank: bool = True, **names) -> DataFrame:
    """SEN-1 + SEN-2. Appends ``<prefix>negative/neutral/positive/compound/label``.
    Existing output columns are an error; blank text fails the job when
    ``check_blank`` (an empty frame keeps its schema). The scores of each
    distinct text (``lexicon_text_scores``) are joined back on the text's
    digest, those of a very common text by broadcast."""
    outs = [f"{prefix}{c}" for c in ("negative", "neutral", "positive", "compound", "label")]
    clash = [c for c in outs if c in df.columns]
    if clash:
        raise ValueError(f"output columns already exist: {clash}")
    if text_col not in df.columns:
        raise ValueError(f"missing text column {text_col}")
    scores = lexicon_text_scores(df, text_col, lexicon, prefix=prefix, check_blank=check_blank, **names)
    return join_back(df, scores, {"_key": text_key(text_col)}, "_rows")


def text_key(text_col: str) -> Column:
    """The digest under which a text's scores are kept."""
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def lexicon_text_scores(df: DataFrame, text_col: str, lexicon: DataFrame, *, prefix: str = "vader_",
                        check_blank: bool = True, **names) -> DataFrame:
    """The scores of ``lexicon_scores`` with one row per distinct text (_key,
    _rows), materialised.

    Hits first: only lexicon words can carry sentiment and only what stands up
    to three places before one can change it, so the rules run over the hits
    (``lexicon_sums``), never over all tokens. Sums are rounded to nine places
    before the published rounding, so the order of summation never shows."""
    outs = [f"{prefix}{c}" for c in ("negative", "neutral", "positive", "compound", "label")]
    text = F.col(text_col)
    checked = text
    if check_blank:
        checked = F.when(text.isNull() | (F.length(F.trim(text)) == 0),
                         F.raise_error(F.lit("lexicon text must be non-empty"))).otherwise(text)
    j = lexicon_sums(df, checked, lexicon, **names)
    ep = F.least(F.col("_ex"), F.lit(EXCLAIM_MAX)) * EXCLAIM_EACH
    qn = F.col("_qn")
    qm = F.when(qn > 1, F.when(qn <= 3, qn * QUESTION_EACH).otherwise(QUESTION_MAX)).otherwise(0.0)
    j = j.withColumns({"_emph": ep + qm, "_neu": (F.col("_n") - F.col("_hits")).cast("double")})
    tot_s = (F.when(F.col("_sum") > 0, F.col("_sum") + F.col("_emph"))
             .when(F.col("_sum") < 0, F.col("_sum") - F.col("_emph")).otherwise(F.col("_sum")))
    compound = F.least(F.greatest(tot_s / F.sqrt(tot_s * tot_s + ALPHA), F.lit(-1.0)), F.lit(1.0))
    pos2 = F.when(F.col("_pos") > F.abs("_neg"), F.col("_pos") + F.col("_emph")).otherwise(F.col("_pos"))
    neg2 = F.when(F.col("_pos") < F.abs("_neg"), F.col("_neg") - F.col("_emph")).otherwise(F.col("_neg"))
    j = j.withColumns({"_p2": pos2, "_n2": neg2})
    tot = F.col("_p2") + F.abs("_n2") + F.col("_neu")
    zero = (F.col("_n") == 0) | (tot == 0)
    share = lambda c: F.when(zero, 0.0).otherwise(F.round(F.round(F.abs(c / tot), 9), 3))
    j = j.withColumn("_cmp", F.when(F.col("_n") == 0, 0.0).otherwise(F.round(F.round(compound, 9), 4)))
    return stored(j.select(
        "_key", "_rows", share(F.col("_n2")).alias(outs[0]), share(F.col("_neu")).alias(outs[1]),
        share(F.col("_p2")).alias(outs[2]), F.col("_cmp").alias(outs[3]), label_bands(F.col("_cmp")).alias(outs[4])))


def derive_lexicon(words: DataFrame, *, doc_col: str, min_docs: int = 5, min_abs: float = 0.5) -> DataFrame:
    """Binding helper: a (word, valence) table learnt from the (document,
    word, quality, toxic) rows of labelled documents, valence =
    4*mean(quality) - 4*mean(toxic) - 2, words in >= ``min_docs`` documents."""
    w = words.groupBy("word").agg(
        F.count_distinct(doc_col).alias("docs"),
        (4.0 * F.avg("quality") - 4.0 * F.avg("toxic") - 2.0).alias("valence"))
    return w.where((F.col("docs") >= min_docs) & (F.abs("valence") >= min_abs)).select(
        "word", F.round(F.least(F.greatest("valence", F.lit(-4.0)), F.lit(4.0)), 3).alias("valence"))


# --- SEN-3/4/5/7: batch model scoring -------------------------------------------------
Predictor = Callable[[pd.Series], np.ndarray]


def model_scores(df: DataFrame, text_col: str, predictor: Predictor, *, classes: Sequence[str] =
                 ("negative", "neutral", "positive"), prefix: str = "roberta_", max_tokens: int = 128,
                 sort_by_length: bool = True) -> DataFrame:
    """SEN-3 (SEN-5 with two classes): probabilities per class, score =
    P(last) - P(first), arg-max label (first wins ties), whitespace token
    count and truncation flag. The predictor gets Arrow batches of texts
    and returns an (n, k) array; ``sort_by_length`` orders each partition
    by text length first (batches of similar length pad less)."""
    k = len(classes)
    prob_cols = [f"{prefix}{c}_probability" for c in classes]
    fields = df.schema.fields + [T.StructField(c, T.DoubleType()) for c in prob_cols]
    src = df.sortWithinPartitions(F.length(text_col)) if sort_by_length else df

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            probs = np.asarray(predictor(pdf[text_col].fillna("")), dtype=float).reshape(len(pdf), k)
            for i, c in enumerate(prob_cols):
                pdf[c] = probs[:, i]
            yield pdf

    out = src.mapInPandas(run, T.StructType(fields))
    arr = F.array(*[F.col(c) for c in prob_cols])
    best = F.array_max(arr)
    label_idx = F.array_position(arr, best)   # first maximum wins
    toks = token_count(F.col(text_col))
    return out.withColumns({
        f"{prefix}score": F.col(prob_cols[-1]) - F.col(prob_cols[0]),
        f"{prefix}label": F.when(label_idx > 0, F.get(F.array(*[F.lit(c) for c in classes]),
                                                      (label_idx - 1).cast("int"))),
        f"{prefix}token_count": toks.cast("int"),
        f"{prefix}truncated": toks > max_tokens})


def model_placeholders(df: DataFrame, prefix: str = "roberta_", status: str = "not_run") -> DataFrame:
    """SEN-7: typed NULL model columns plus a status when no model ran."""
    cols = {f"{prefix}{c}_probability": F.lit(None).cast("double") for c in ("negative", "neutral", "positive")}
    cols.update({f"{prefix}score": F.lit(None).cast("double"), f"{prefix}label": F.lit(None).cast("string"),
                 f"{prefix}status": F.lit(status)})
    return df.withColumns(cols)


def score_resumable(df: DataFrame, *, id_col: str, text_col: str, out_path: str, predictor: Predictor,
                    **kw) -> int:
    """SEN-4: resumable scoring. Ids already present under ``out_path`` are
    skipped (left anti join), the rest are scored and appended; a rerun
    after a failure continues where it stopped. Returns rows written."""
    from murmur.sources.sinks import write_parquet_counted
    spark = df.sparkSession
    todo = df
    try:
        done = spark.read.parquet(out_path).select(id_col)
        todo = df.join(done, id_col, "left_anti")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":  # a first run has nothing yet
            raise
    scored = model_scores(todo, text_col, predictor, **kw)
    try:
        return write_parquet_counted(scored, out_path, mode="append")
    except ValueError:
        return 0


def agreement_flags(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """SEN-6: pairwise and three-way label agreement flags across models
    (``labels`` maps a model prefix to its label column)."""
    names = list(labels)
    out = df
    for i in range(len(names)):
        for j in range(i + 1, len(names)):
            a, b = names[i], names[j]
            out = out.withColumn(f"agree_{a}_{b}", F.col(labels[a]) == F.col(labels[b]))
    if len(names) >= 3:
        first = F.col(labels[names[0]])
        allc = F.lit(True)
        for n in names[1:]:
            allc = allc & (F.col(labels[n]) == first)
        out = out.withColumn("agree_all", allc)
    return out


def char_profile_predictor(texts: pd.Series) -> np.ndarray:
    """A deterministic stand-in predictor (no model weights ship with the
    engine): softmax over three character-profile features. It exists so
    the batch-inference path can run end to end; real deployments inject a
    model."""
    s = texts.astype(str)
    n = s.str.len().clip(lower=1).to_numpy(dtype=float)
    excl = s.str.count("!").to_numpy(dtype=float)
    q = s.str.count(r"\?").to_numpy(dtype=float)
    caps = s.str.count("[A-Z]").to_numpy(dtype=float) / n
    logits = np.stack([q * 0.5 + caps, np.full_like(n, 0.5), excl * 0.5 + (1 - caps) * 0.3], axis=1)
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


# --- LNG-3: pluggable language identification ---------------------------------------------
def language_id(df: DataFrame, text_col: str, detector: Callable[[str], tuple[str, float]], *,
                min_tokens: int = 3) -> DataFrame:
    """LNG-3: (detected_language, language_confidence) from an injected
    per-text detector in Arrow batches; fewer than ``min_tokens`` tokens ->
    'und' with NULL confidence; a detector failure -> 'unknown'."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("conf", T.DoubleType())])

    @F.pandas_udf(schema)
    def detect(s: pd.Series) -> pd.DataFrame:
        langs, confs = [], []
        for v in s:
            text = "" if v is None else str(v).replace("\n", " ")
            if len(text.split()) < min_tokens:
                langs.append("und")
                confs.append(None)
                continue
            try:
                lang, conf = detector(text)
                langs.append(lang)
                confs.append(float(conf))
            except Exception:  # noqa: BLE001 - detector failure is data, not a crash
                langs.append("unknown")
                confs.append(None)
        return pd.DataFrame({"lang": langs, "conf": confs})

    return df.withColumn("_lid", detect(F.col(text_col))).withColumns({
        "detected_language": F.col("_lid.lang"), "language_confidence": F.col("_lid.conf")}).drop("_lid")


# Characteristic letters used by the stand-in detector.
_MARKERS = {"es": "ñ¿¡áíóú", "de": "äöüß", "fr": "èêçàùâîôûë"}


def script_detector(text: str) -> tuple[str, float]:
    """Stand-in detector: the language whose characteristic letters occur
    most often (English when none); confidence = share of those letters."""
    low = text.lower()
    counts = {k: sum(low.count(ch) for ch in v) for k, v in _MARKERS.items()}
    lang, c = max(counts.items(), key=lambda kv: (kv[1], kv[0]))
    total = sum(counts.values())
    if c == 0:
        return "en", 1.0
    return lang, c / total
