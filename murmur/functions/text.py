"""Scalar text functions (STR-*, FLT-4/5, LNG-2 helpers) as Spark Columns.

Everything is a JVM expression (regexp_replace, regexp_count, higher-order
array functions). Regex notes:

* Java's ``\\w``/``\\b``/``\\s`` are ASCII-only; the corpus is multilingual, so
  word characters are spelled ``[\\p{L}\\p{N}_]`` and whitespace as the
  Unicode set Python's ``str.split()`` uses. The same classes are valid RE2,
  which keeps the DuckDB oracles comparable.
* Word-boundary tests use look-arounds on that class instead of ``\\b``.
"""

from __future__ import annotations

import json
import zlib
from html.entities import html5
from typing import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- character classes --------------------------------------------------
WORD = r"\p{L}\p{N}_"
# Python str.split()/\s whitespace: ASCII controls, FS/GS/RS/US, NEL and the
# Unicode separator categories.
SPACE = r"\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}"
NB = rf"(?<![{WORD}])"   # no word char before
NA = rf"(?![{WORD}])"    # no word char after

# --- fixed patterns (values that must match the cleaning rules) ---------
TAG_PATTERN = r"<[^>]+>"
URL_PATTERN_LOOSE = rf"(?i)https?://[^{SPACE}]*|www\.[^{SPACE}]+"   # cleaner: scheme alone counts
URL_PATTERN = rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+"              # profilers
EMOJI_CLASS = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
INVALID_UNICODE = r"\x{FFFD}"
HASHTAG = rf"#[{WORD}]+"
MENTION = rf"@[{WORD}]+"
WORDS = rf"[{WORD}]+"
PUNCT = rf"[^{WORD}{SPACE}#@]"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- STR-1 ----------------------------------------------------------------
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_BUCKETS = 512
_PREFIXES = range(6, 1, -1)     # lengths of names that may stand without a semicolon


def _entity_table(names: Mapping[str, str]) -> Column:
    """Names by crc32 bucket, one constant: a lookup reads about four names."""
    rows: list[list] = [[] for _ in range(_BUCKETS)]
    for k, v in names.items():
        rows[zlib.crc32(k.encode()) % _BUCKETS].append({"k": k, "v": v})
    return F.from_json(F.lit(json.dumps(rows)), "array<array<struct<k:string,v:string>>>")


def _code_point(n: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def _numeric(s: Column) -> Column:
    """What ``#123;`` or ``#x7b`` stands for, by the HTML rules for numbers
    that no character has."""
    hexadecimal = F.lower(F.substring(s, 2, 1)) == "x"
    digits = F.regexp_replace(s, "^#[xX]?0*|;$", "")
    n = F.when(digits == "", F.lit(0)).when(F.length(digits) > 7, F.lit(0x110000)).otherwise(
        F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(F.conv(F.when(~hexadecimal, digits), 10, 10)).cast("int"))
    # numbers of the C1 range are read as Windows-1252
    c1 = F.array(*[F.lit(bytes([i]).decode("cp1252", "replace").replace("\ufffd", chr(i))) for i in range(0x80, 0xA0)])
    dropped = (n.between(1, 8) | (n == 0xB) | n.between(0xE, 0x1F) | (n == 0x7F) | n.between(0xFDD0, 0xFDEF)
               | (n.bitwiseAND(0xFFFE) == 0xFFFE))
    return (F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), F.lit("\ufffd")).when(n == 0xD, F.lit("\r"))
            .when(n.between(0x80, 0x9F), F.get(c1, n - 0x80)).when(dropped, F.lit(""))
            .when(n == 0xFEFF, F.lit("\ufeff")).otherwise(_code_point(n)))


def html_unescape(c, names: Mapping[str, str] = html5) -> Column:
    """STR-1: HTML entity decoding in native expressions. ``names`` maps entity
    names (with their semicolon, if they need one) to text: the HTML5 table
    unless another is given. As in HTML, a name that needs no semicolon is also
    read at the start of a longer word, the longest one first; what is no
    reference stays. Texts without an ampersand are passed through."""
    x = col_(c)
    table = _entity_table(names)

    def named(w):
        bucket = F.get(table, F.pmod(F.crc32(w.cast("binary")), F.lit(_BUCKETS)).cast("int"))
        return F.get(F.filter(bucket, lambda e: e["k"] == w), 0)["v"]

    def decoded(m):
        s = F.substring(m, 2, 40)
        opened = [F.when(F.length(s) > k, F.concat(named(F.substring(s, 1, k)), F.substring(s, k + 1, 40))) for k in _PREFIXES]
        return F.when(s.startswith("#"), _numeric(s)).otherwise(F.coalesce(named(s), *opened, m))

    pieces = F.split(x, REFERENCE, -1)
    found = F.transform(F.regexp_extract_all(x, F.lit(REFERENCE), 0), decoded)
    joined = F.array_join(F.zip_with(pieces, F.concat(found, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    return F.when(x.contains("&"), joined).otherwise(x)


def collapse_ws(c) -> Column:
    """Collapse whitespace runs to one space and trim (Python
    ``" ".join(x.split())``)."""
    return F.trim(F.regexp_replace(col_(c), rf"[{SPACE}]+", " "), F.lit(" "))


def strip_markup(c) -> Column:
    """STR-2 without decoding: tags -> space, URLs -> '', whitespace."""
    x = F.regexp_replace(col_(c), TAG_PATTERN, " ")
    x = F.regexp_replace(x, URL_PATTERN_LOOSE, "")
    return collapse_ws(x)


def clean_text(c, decode: bool = True) -> Column:
    """STR-2: decode entities, tags -> space, URLs removed, whitespace
    collapsed (in that order). Null stays null."""
    x = col_(c)
    if decode:
        x = html_unescape(x)
    return strip_markup(x)


def is_valid_text(c, decode: bool = True) -> Column:
    """FLT-4/FLT-5: cleaned text is non-empty and has no replacement char.

    The v1 controller applies this to text that is already cleaned, so a
    caller reproducing it passes the cleaned column here (a second decode).
    """
    cleaned = clean_text(c, decode)
    return F.coalesce((F.length(cleaned) > 0) & ~cleaned.rlike(INVALID_UNICODE), F.lit(False))


def has_valid_unicode(c) -> Column:
    """FLT-5 emoji-integrity check (Spark strings are UTF-8, so lone
    surrogates cannot occur; U+FFFD marks a lossy decode)."""
    return col_(c).isNotNull() & ~col_(c).rlike(INVALID_UNICODE)


# --- STR-3 / STR-4 / STR-5 ---------------------------------------------------
def duplicate_normal_form(c) -> Column:
    """STR-3: lower, URLs -> space, @handle -> @user, whitespace collapsed."""
    x = F.lower(F.coalesce(col_(c), F.lit("")))
    x = F.regexp_replace(x, URL_PATTERN, " ")
    x = F.regexp_replace(x, MENTION, "@user")
    return collapse_ws(x)


def near_signature(c, length: int | None = None) -> Column:
    """STR-4: on the whole normal form, #tag -> '#tag', digit runs -> '0';
    with ``length``, only its first code points."""
    x = F.regexp_replace(duplicate_normal_form(c), HASHTAG, "#tag")
    x = F.regexp_replace(x, r"\p{Nd}+", "0")
    return x if length is None else F.substring(x, 1, length)


def sha256(c) -> Column:
    """STR-5."""
    return F.sha2(col_(c), 256)


# --- STR-6/7/12/14: pattern counts and flags --------------------------------
def count_matches(c, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(col_(c), F.lit("")), F.lit(pattern)).cast("long")


def word_count(c) -> Column:
    return count_matches(c, WORDS)


def char_count(c) -> Column:
    """STR-7: code points, like Python ``len``."""
    return F.length(F.coalesce(col_(c), F.lit(""))).cast("long")


def hashtag_count(c) -> Column:
    return count_matches(c, HASHTAG)


def mention_count(c) -> Column:
    return count_matches(c, MENTION)


def url_count(c) -> Column:
    return count_matches(c, URL_PATTERN)


def emoji_count(c) -> Column:
    return count_matches(c, EMOJI_CLASS)


def punctuation_count(c) -> Column:
    return count_matches(c, PUNCT)


def safe_divide(a: Column, b: Column, fill: float | None = None) -> Column:
    """STR-13: division with zero/NULL denominators -> NULL (production) or
    ``fill`` (prototype behaviour, e.g. 0.0)."""
    q = F.try_divide(a.cast("double"), F.when(b != 0, b.cast("double")))
    return q if fill is None else F.coalesce(q, F.lit(float(fill)))


def only_pattern(c, pattern: str) -> Column:
    """STR-14: text made only of ``pattern`` occurrences (plus whitespace)."""
    stripped = F.trim(F.regexp_replace(F.trim(F.coalesce(col_(c), F.lit(""))), pattern, ""))
    return (F.length(stripped) == 0) & (count_matches(c, pattern) > 0)


def upper_word_share(c) -> Column:
    """STR-12: share of whitespace tokens that are all caps and longer than
    two characters (Python ``isupper``: has a cased char, none lower)."""
    toks = F.split(collapse_ws(F.coalesce(col_(c), F.lit(""))), " ")
    toks = F.filter(toks, lambda w: F.length(w) > 0)
    caps = F.size(F.filter(toks, lambda w: (F.length(w) > 2) & (w == F.upper(w)) & (w != F.lower(w))))
    return F.when(F.size(toks) > 0, caps / F.size(toks))


def upper_char_ratio(c) -> Column:
    """STR-12 char form: ``[A-Z]`` over ``[A-Za-z]`` (NULL without letters)."""
    return safe_divide(count_matches(c, "[A-Z]"), count_matches(c, "[A-Za-z]"))


# --- STR-8 / STR-9: extraction ------------------------------------------------
def hashtags(c) -> Column:
    """STR-8: lower-cased hashtags (ASCII body, not preceded by a word char)."""
    return F.transform(F.regexp_extract_all(F.coalesce(col_(c), F.lit("")),
                                            F.lit(rf"{NB}#([A-Za-z0-9_]+)"), 1), lambda t: F.lower(t))


# Stop words removed by the term extractor.
STOPWORDS = [
    "the", "and", "for", "you", "that", "this", "with", "are", "was", "from", "have", "not", "but",
    "all", "can", "our", "has", "his", "her", "she", "him", "they", "them", "your", "will", "just",
    "about", "what", "when", "who", "why", "how", "https", "http", "amp", "rt", "co", "www", "com",
    "donaldtrump", "joebiden", "trump", "biden", "election2020",
]


def terms(c, stopwords=STOPWORDS, min_len: int = 3) -> Column:
    """STR-9: alphabetic terms (letters and apostrophes, starting with a
    letter), lower-cased, at least ``min_len`` chars, stop words removed."""
    raw = F.regexp_extract_all(F.coalesce(col_(c), F.lit("")), F.lit("[A-Za-z][A-Za-z']+"), 0)
    stop = F.array(*[F.lit(w) for w in stopwords])
    return F.filter(F.transform(raw, lambda w: F.lower(w)),
                    lambda w: (F.length(w) >= min_len) & ~F.array_contains(stop, w))


# --- STR-10 / STR-11 / STR-15 ------------------------------------------------------
def model_text(c) -> Column:
    """STR-10: ``@\\S+`` -> @user, URL -> http."""
    x = F.regexp_replace(col_(c), rf"@[^{SPACE}]+", "@user")
    return F.regexp_replace(x, URL_PATTERN, "http")


def model_text_tokens(c) -> Column:
    """STR-11 (v3): split on single spaces; '@x' -> '@user', 'http*' -> 'http'."""
    toks = F.split(col_(c), " ", -1)
    return F.array_join(F.transform(
        toks, lambda t: F.when(t.startswith("@") & (F.length(t) > 1), F.lit("@user"))
        .when(t.startswith("http"), F.lit("http")).otherwise(t)), " ")


def preview(c, n: int = 80) -> Column:
    """STR-15."""
    return F.substring(col_(c), 1, n)


# --- LNG-2: Spanish indicator regex, evaluated without look-arounds ----------
# Spanish indicator words and characters of the two-class
# fallback detector.
SPANISH_WORDS = [
    "que", "para", "por", "con", "del", "las", "los", "una", "uno", "como", "mas", "pero", "este",
    "esta", "todos", "bien", "gracias", "voto", "elecciones", "presidente", "debatede", "latinos",
]
SPANISH_CHARS = "ÁáÉéÍíÓóÚúÑñ¿¡"


def spanish_hits(c) -> Column:
    """Number of indicator matches: whole-word indicator words
    (case-insensitive) plus accented characters. A whole-word match of a
    word made only of word characters is exactly a maximal word run equal to
    it, so this counts word runs instead of running a boundary regex."""
    x = F.coalesce(col_(c), F.lit(""))
    runs = F.regexp_extract_all(F.lower(x), F.lit(WORDS), 0)
    words = F.array(*[F.lit(w) for w in SPANISH_WORDS])
    return (F.size(F.filter(runs, lambda w: F.array_contains(words, w)))
            + F.regexp_count(x, F.lit(f"[{SPANISH_CHARS}]"))).cast("long")


def token_count(c) -> Column:
    """Whitespace tokens (Python ``len(x.split())``)."""
    s = collapse_ws(F.coalesce(col_(c), F.lit("")))
    return F.when(F.length(s) == 0, F.lit(0)).otherwise(F.size(F.split(s, " "))).cast("long")
