"""Region and language classification (GEO-1/2, LNG-1/2, PRO-6 helpers).

The gazetteer is a fixed 51-entry literal, so it is inlined as array/map
literals: no join at all, and every executor evaluates it inside codegen.
Name search uses one zero-width look-ahead regex per row that reports every
whole-word occurrence of every name (overlapping ones too, e.g. "virginia"
inside "west virginia"), then picks by explicit priority.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from murmur.functions.text import NA, NB, SPACE, col_, spanish_hits, token_count

# US state codes and names (50 states + DC) in gazetteer
# priority order (the order names are tried).
STATE_NAMES = [
    ("alabama", "AL"), ("alaska", "AK"), ("arizona", "AZ"), ("arkansas", "AR"),
    ("california", "CA"), ("colorado", "CO"), ("connecticut", "CT"), ("delaware", "DE"),
    ("florida", "FL"), ("georgia", "GA"), ("hawaii", "HI"), ("idaho", "ID"), ("illinois", "IL"),
    ("indiana", "IN"), ("iowa", "IA"), ("kansas", "KS"), ("kentucky", "KY"), ("louisiana", "LA"),
    ("maine", "ME"), ("maryland", "MD"), ("massachusetts", "MA"), ("michigan", "MI"),
    ("minnesota", "MN"), ("mississippi", "MS"), ("missouri", "MO"), ("montana", "MT"),
    ("nebraska", "NE"), ("nevada", "NV"), ("new hampshire", "NH"), ("new jersey", "NJ"),
    ("new mexico", "NM"), ("new york", "NY"), ("north carolina", "NC"), ("north dakota", "ND"),
    ("ohio", "OH"), ("oklahoma", "OK"), ("oregon", "OR"), ("pennsylvania", "PA"),
    ("rhode island", "RI"), ("south carolina", "SC"), ("south dakota", "SD"), ("tennessee", "TN"),
    ("texas", "TX"), ("utah", "UT"), ("vermont", "VT"), ("virginia", "VA"), ("washington", "WA"),
    ("west virginia", "WV"), ("wisconsin", "WI"), ("wyoming", "WY"), ("district of columbia", "DC"),
]
STATE_CODES = sorted(code for _, code in STATE_NAMES)
# Region codes that are explicitly outside the US.
NON_US_REGION_CODES = ["ENG", "IDF", "ON"]
# Country spellings that count as the US (blank included).
US_COUNTRY = ["US", "USA", "UNITED STATES", "UNITED STATES OF AMERICA", ""]
# Location classes of the spatial-validity profiler.
NATIONAL_RE = r"(?i)^(usa|u\.?s\.?a?\.?|united states|america|united states of america)$"
FICTIONAL_WORDS = ["earth", "moon", "mars", "universe", "internet", "nowhere", "middle of nowhere",
                   "maga country", "home"]
NON_US_WORDS = ["canada", "mexico", "united kingdom", "uk", "england", "france", "germany", "india",
                "australia", "vietnam"]
US_WORDS = ["usa", "us", "united states"]


def _alt(words) -> str:
    return "|".join(w.replace(" ", r"\ ") for w in words)


def _any_word(c: Column, words, ignore_case: bool = True) -> Column:
    flag = "(?i)" if ignore_case else ""
    return c.rlike(f"{flag}(?=[{''.join(sorted({w[0] for w in words}))}]){NB}({_alt(words)}){NA}")


def _by_initial(words) -> str:
    """The alternatives in groups by first letter, behind a test for any of
    those letters: few are tried at a place. No name begins another, so their
    order does not matter."""
    initials = sorted({w[0] for w in words})
    groups = "|".join(f"{i}(?:{_alt(w[1:] for w in words if w[0] == i)})" for i in initials)
    return f"(?=[{''.join(initials)}]){NB}(?:{groups}){NA}"


_NAME_SCAN = rf"(?=({_by_initial([n for n, _ in STATE_NAMES])}))"


# Column literals are built per call: a Column needs an active session.
def _name_to_code() -> Column:
    return F.create_map(*[x for n, c in STATE_NAMES for x in (F.lit(n), F.lit(c))])


def _name_priority() -> Column:
    return F.create_map(*[x for i, (n, _) in enumerate(STATE_NAMES) for x in (F.lit(n), F.lit(i))])


def _codes() -> Column:
    return F.array(*[F.lit(c) for c in STATE_CODES])


def state_names_found(c) -> Column:
    """Distinct state names occurring as whole words in lower(c), text order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col_(c), F.lit(""))),
                                                 F.lit(_NAME_SCAN), 1))


def _valid_codes(arr: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(arr, lambda t: F.array_contains(_codes(), t))))


def resolve_region(state_code, state, location, country, longest_match: bool = False) -> tuple[Column, Column]:
    """GEO-1: (resolved_code, source). First hit wins:

    1. ``state_code`` (trim, upper) is a US code            -> original_state_code
    2. ``state`` (trim, lower) is a state name              -> state_name_match
    3. non-US region code, or a country that is not the US  -> non_us
    4. a state name inside the location (priority order; ``longest_match``
       makes "west virginia" win over the embedded "virginia")
       or a code after a comma, or a bare code plus a US word -> user_location_gazetteer
    5. otherwise                                            -> unmapped

    Codes in step 4 are taken in alphabetical order (the priority is explicit
    so results never depend on set iteration order).
    """
    loc = F.trim(F.coalesce(col_(location).cast("string"), F.lit("")))
    found = state_names_found(loc)
    if longest_match:
        found = F.filter(found, lambda n: ~F.exists(found, lambda m: (F.length(m) > F.length(n)) & m.contains(n)))
    prio = F.array_min(F.transform(found, lambda n: F.element_at(_name_priority(), n)))
    # guarded: element_at with a NULL index does not reliably yield NULL
    by_name = F.when(prio.isNotNull(), F.get(F.array(*[F.lit(code) for _, code in STATE_NAMES]), prio))
    return resolved_from(by_name, _any_word(loc, US_WORDS), state_code, state, location, country)


def resolved_from(by_name: Column, has_us_word: Column, state_code, state, location, country) -> tuple[Column, Column]:
    """The steps of ``resolve_region``, given the code of the name found in
    the location (NULL if none) and whether a word for the country is in it."""
    sc = F.upper(F.trim(F.coalesce(col_(state_code).cast("string"), F.lit(""))))
    st = F.lower(F.trim(F.coalesce(col_(state).cast("string"), F.lit(""))))
    loc = F.trim(F.coalesce(col_(location).cast("string"), F.lit("")))
    ctry = F.upper(F.trim(F.coalesce(col_(country).cast("string"), F.lit(""))))
    ctry = F.when(ctry.isin("NAN", "NONE", "NULL"), F.lit("")).otherwise(ctry)
    is_us = ctry.isin(*US_COUNTRY)

    comma_codes = _valid_codes(F.regexp_extract_all(loc, F.lit(rf",[{SPACE}]*([A-Z]{{2}}){NA}"), 1))
    bare_codes = _valid_codes(F.regexp_extract_all(loc, F.lit(rf"{NB}([A-Z]{{2}}){NA}"), 1))
    # alphabetical first code satisfying either rule
    codes_ok = F.array_sort(F.array_union(comma_codes, F.when(has_us_word, bare_codes)
                                          .otherwise(F.array().cast("array<string>"))))
    by_code = F.get(codes_ok, 0)   # NULL when empty

    state_code_hit = F.array_contains(_codes(), sc)
    name_hit = F.element_at(_name_to_code(), st)
    non_us = sc.isin(*NON_US_REGION_CODES) | ~is_us
    from_loc = F.when(F.length(loc) > 0, F.coalesce(by_name, by_code))

    code = (F.when(state_code_hit, sc)
            .when(name_hit.isNotNull(), name_hit)
            .when(non_us, F.lit(None).cast("string"))
            .otherwise(from_loc))
    source = (F.when(state_code_hit, F.lit("original_state_code"))
              .when(name_hit.isNotNull(), F.lit("state_name_match"))
              .when(non_us, F.lit("non_us"))
              .when(from_loc.isNotNull(), F.lit("user_location_gazetteer"))
              .otherwise(F.lit("unmapped")))
    return code, source


def region_class(code) -> Column:
    """GEO-2: US_XX / Non_US / Unmapped."""
    c = F.upper(F.trim(col_(code).cast("string")))
    return (F.when(c.isNull() | (c == ""), F.lit("Unmapped"))
            .when(F.array_contains(_codes(), c), F.concat(F.lit("US_"), c))
            .otherwise(F.lit("Non_US")))


def language_class(lang) -> Column:
    """LNG-1: English / Spanish / Undetermined / Other / Unknown."""
    l = F.lower(F.trim(col_(lang).cast("string")))
    return (F.when(l.isNull() | (l == ""), F.lit("Unknown"))
            .when(l.isin("en", "english"), F.lit("English"))
            .when(l.isin("es", "spanish"), F.lit("Spanish"))
            .when(l.isin("und", "undetermined"), F.lit("Undetermined"))
            .otherwise(F.lit("Other")))


def heuristic_language(text) -> Column:
    """LNG-2: two-class fallback. Spanish when >= 2 indicator hits, or >= 1
    hit in a text of at most 6 tokens; blank text is English."""
    t = col_(text)
    hits = spanish_hits(t)
    blank = t.isNull() | (token_count(t) == 0)
    return (F.when(blank, F.lit("English"))
            .when((hits >= 2) | ((hits >= 1) & (token_count(t) <= 6)), F.lit("Spanish"))
            .otherwise(F.lit("English")))


def extract_states(location) -> Column:
    """PRO-6: sorted distinct codes from whole-word state names plus
    upper-case two-letter tokens (ASCII-letter bounded) that are US codes."""
    loc = F.coalesce(col_(location).cast("string"), F.lit(""))
    by_name = F.transform(state_names_found(loc), lambda n: F.element_at(_name_to_code(), n))
    tokens = F.regexp_extract_all(loc, F.lit(r"(?<![A-Za-z])([A-Z]{2})(?![A-Za-z])"), 1)
    return F.array_sort(F.array_distinct(F.concat(by_name, F.filter(tokens, lambda t: F.array_contains(_codes(), t)))))


def is_national(location) -> Column:
    return F.coalesce(F.trim(col_(location)), F.lit("")).rlike(NATIONAL_RE)


def is_fictional(location) -> Column:
    return _any_word(F.coalesce(F.trim(col_(location)), F.lit("")), FICTIONAL_WORDS)


def mentions_non_us(location) -> Column:
    return _any_word(F.coalesce(F.trim(col_(location)), F.lit("")), NON_US_WORDS)
