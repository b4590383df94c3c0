"""Operator 6: personal data by weak supervision, in DataFrame functions only.

Four base patterns (email, ip, card, phone) give the certain spans. Wider
candidate patterns (spelled-out or spaced addresses, numbers without a plus
sign, other separators) are judged by labelers that vote for, against or not:
strict pattern, shape, gazetteer (top-level domains, issuer and calling
prefixes, address ranges), context words before the span, and its neighbours.
Expectation-maximisation over the counts of vote patterns estimates every
labeler's reliability for each kind without labels; a logistic span classifier
is trained on the posteriors and, as an SQL expression, adds the candidates it
accepts. Base spans always stay.

Offsets are code points: the pieces between matches (``split``) and the
matches (``regexp_extract_all``) alternate, so running lengths give starts.
Everything that runs along a row's matches (starts, the characters before a
candidate, spans that cover others) is a scan in blocks (``_scan``), so a text
with very many matches takes time in proportion to them. The classifier knows
more than the votes: how long a candidate is and how many groups of digits it
has. All of it is per row; the one shuffle counts patterns of votes and
features (at most 4 kinds x 3^5 x 4 x 4 rows reach the driver), over all
documents.

Defined results: null texts are empty and have no spans; equal texts have
equal spans; repeated rows and null ids come out once per input row; other
columns are ignored by ``find`` and come through ``redact`` unchanged, whatever
their names; an empty table gives no rows and no votes.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import documents

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("strict", "shape", "gazetteer", "context", "neighbours")
ACCEPT = 0.9            # probability from which the classifier adds a span
ROUNDS = 50
FEATURES = ("size", "groups")   # of the span, each 0 to 3
BEFORE = 24             # characters of context
_BLOCK = 128            # elements of one block of a scan
_PIECE = 1024           # characters of one piece of a text

# The base patterns, written so that Java neither recurses nor backtracks over
# long runs: a match can only start where a run starts or the last match ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?=[0-9][ -]?[0-9])[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Candidates beyond them.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}"
             r"(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63}){1,5}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}(?![0-9.])",
    "card": r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
CUES = {
    "email": "mail|contact|write|address|reach", "ip": "ip|host|server|address|client|login",
    "card": "card|visa|master|credit|debit|pay", "phone": "phone|call|tel|fax|mobile|whatsapp|contact",
}
AGAINST = "version|isbn|token|sha|order no|build|release|section"
GAZETTEER = {
    "email": r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|us)$",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3]) ?\.",
    "card": r"^(?:4|5[1-5]|3[47]|6011|65)", "phone": r"^\(?[2-9][0-9]{2}",
}
SHAPE = {
    "email": r"^[A-Za-z0-9][^ ]*(?: ?@ ?|.at.).*[A-Za-z]{2,10}$", "ip": r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$",
    "card": r"^[0-9]{4}(?:([./_])[0-9]{4})(?:\1[0-9]{4}){2}$",
    "phone": r"^(?:\([0-9]{3}\) ?|[0-9]{3}([ .-]))[0-9]{3}[ .-][0-9]{4}$",
}


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "''") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``value`` computed once, also inside its lambdas."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _scan(rows: str, zero: str, lift, combine) -> str:
    """SQL: the array ``rows`` as structs (c, y) of every element y and of the
    number that all elements before it combine to (``combine`` is
    associative). An aggregate copies what it holds at every step, so it holds
    numbers only, of one block of ``_BLOCK`` or one of each block."""
    start = f"struct({zero} AS c, CAST(array() AS array<int>) AS out)"
    blocks = _let("g", rows, f"transform(sequence(0, CAST(greatest(size(g) - 1, 0) div {_BLOCK} AS int)),"
                             f" i -> slice(g, i * {_BLOCK} + 1, {_BLOCK}))")
    inside = f"aggregate(b, {start}, (a, y) -> struct({combine('a.c', lift('y'))} AS c, concat(a.out, array(a.c)) AS out))"
    before = f"aggregate(l, {start}, (a, p) -> struct({combine('a.c', 'p.s.c')} AS c, concat(a.out, array(a.c)) AS out), a -> a.out)"
    return _let("l", f"transform({blocks}, b -> struct(b AS b, {inside} AS s))",
                f"flatten(zip_with(l, {before}, (p, k) -> zip_with(p.b, p.s.out, (y, c) ->"
                f" struct({combine('k', 'c')} AS c, y AS y))))")


def _last(texts: str) -> str:
    """SQL: of every element of the array of strings, one for each match, the
    last ``BEFORE`` characters of it and of the seven before it together. A
    match of a wide pattern has at least five characters."""
    for k in (1, 2, 4):
        texts = _let(f"e{k}", texts, f"""slice(zip_with(concat(array_repeat('', {k}), e{k}), e{k},
            (a, b) -> right(concat(a, coalesce(b, '')), {BEFORE})), 1, size(_m))""")
    return texts


_NEAR = "struct<gap:int,n:int,s:string,before:string,after:string>"


def _matches(df: DataFrame, pattern: str, guard: str) -> DataFrame:
    """Adds _m, the matches, and _p, the pieces between them."""
    p = 'r"' + pattern + '"'
    return df.withColumn("_m", F.expr(f"IF({guard}, regexp_extract_all(text, {p}, 0), CAST(array() AS array<string>))")) \
        .withColumn("_p", F.expr(f"IF(size(_m) > 0, split(text, {p}, -1), CAST(array() AS array<string>))"))


def _luhn(digits: str) -> str:
    """SQL: the digit string passes the Luhn test."""
    return f"""(aggregate(transform(split(reverse({digits}), ''), (d, i) ->
        CASE WHEN i % 2 = 0 THEN CAST(d AS int) WHEN CAST(d AS int) > 4 THEN 2 * CAST(d AS int) - 9
             ELSE 2 * CAST(d AS int) END), 0, (a, d) -> a + d) % 10 = 0)"""


def _digits(s: str) -> str:
    return f"regexp_replace({s}, '[^0-9]', '')"


def _valid(kind: str, s: str) -> str:
    """SQL: a match of the base pattern counts."""
    if kind == "ip":
        octet = _quoted(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")
        return f"forall(split({s}, '[.]'), o -> o RLIKE {octet})"
    n = f"length({_digits(s)})"
    if kind == "card":
        return f"(CASE WHEN {n} BETWEEN 12 AND 19 THEN {_luhn(_digits(s))} ELSE false END)"
    return f"{n} BETWEEN 9 AND 15" if kind == "phone" else "true"


_GUARD = {"email": "contains(text, '@')", "ip": "_digit", "card": "_digit", "phone": "_digit AND contains(text, '+')"}
_WIDE_GUARD = {"email": "contains(text, '@') OR contains(text, '(at)') OR contains(text, '[at]')",
               "ip": "_digit", "card": "_digit", "phone": "_digit"}
_SPAN = "array<struct<start:int,kind:int,stop:int>>"


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds _base: (start, kind, stop) of the base spans, in order."""
    df = docs.withColumn("_digit", F.expr("text RLIKE '[0-9]'"))
    rows = "zip_with(slice(_p, 1, size(_m)), _m, (p, m) -> struct(length(p) AS gap, length(m) AS n, m AS s))"
    scan = _scan(rows, "0", lambda y: f"{y}.gap + {y}.n", lambda a, b: f"{a} + {b}")
    for k, kind in enumerate(KINDS):
        df = _matches(df, BASE[kind], _GUARD[kind]).withColumn(f"_{kind}", F.expr(
            f"transform(filter({scan}, x -> {_valid(kind, 'x.y.s')}),"
            f" x -> struct(x.c + x.y.gap AS start, {k} AS kind, x.c + x.y.gap + x.y.n AS stop))")).drop("_m", "_p")
    return df.withColumn("_base", F.array_sort(F.concat(*[f"_{k}" for k in KINDS]))) \
        .drop(*[f"_{k}" for k in KINDS])


def _by_kind(sql) -> str:
    return "CASE x.kind " + " ".join(f"WHEN {k} THEN {sql(kind)}" for k, kind in enumerate(KINDS)) + " END"


def _votes() -> str:
    """SQL struct of a candidate x with the labelers' votes (1, -1, 0) and
    the features of its span."""
    before = "lower(x.before)"
    tail = "regexp_extract(x.s, r'([A-Za-z]+)$', 1)"
    strict = {"email": "IF(x.s RLIKE r'^[^ ]+@[^ ]+$', 1, 0)",
              "ip": f"IF({_valid('ip', _squeezed('x.s'))}, 1, -1)",
              "card": f"IF({_luhn(_digits('x.s'))}, 1, -1)", "phone": "0"}
    return f"""struct(x.start AS start, x.kind AS kind, x.stop AS stop,
        {_by_kind(strict.get)} AS strict,
        IF({_by_kind(lambda k: f"x.s RLIKE {_quoted(SHAPE[k])}")}, 1, -1) AS shape,
        IF({_by_kind(lambda k: f"{tail if k == 'email' else 'x.s'} RLIKE {_quoted(GAZETTEER[k])}")}, 1, -1) AS gazetteer,
        CASE WHEN {before} RLIKE '{AGAINST}' THEN -1
             WHEN {_by_kind(lambda k: f"{before} RLIKE '{CUES[k]}'")} THEN 1 ELSE 0 END AS context,
        IF(concat(right(x.before, 1), x.after) RLIKE r'[A-Za-z0-9=_/]', -1, 0) AS neighbours,
        CAST(least(length(x.s) div 8, 3) AS int) AS size,
        CAST(least(regexp_count(x.s, '[0-9]+'), 3) AS int) AS groups)"""


def _squeezed(s: str) -> str:
    return f"replace({s}, ' ', '')"


def _clear_of(base: str, found: str) -> str:
    """SQL: the candidates that overlap no base span. In order of their starts
    the furthest stop of the base spans before a candidate and the start of
    the next one after it tell."""
    last = 2 ** 31 - 1
    every = f"""array_sort(concat(transform({base}, b -> struct(b.start AS start, 0 AS wide, b.kind AS kind,
        b.stop AS stop, '' AS s, '' AS before, '' AS after)), {found}))"""
    ahead = _scan(every, "0", lambda y: f"IF({y}.wide = 0, {y}.stop, 0)",
                  lambda a, b: f"greatest({a}, {b})")
    both = _scan(f"reverse({ahead})", str(last),
                 lambda y: f"IF({y}.y.wide = 0, {y}.y.start, {last})", lambda a, b: f"least({a}, {b})")
    return f"""IF(size({base}) = 0, {found}, transform(filter({both},
        x -> x.y.y.wide = 1 AND x.y.c <= x.y.y.start AND x.c >= x.y.y.stop), x -> x.y.y))"""


def candidates(docs: DataFrame) -> DataFrame:
    """Adds _wide: candidates outside the base spans, with their votes."""
    df = docs
    pieces = "slice(_p, 1, size(_m))"
    after = "zip_with(slice(_p, 2, size(_m)), concat(slice(_m, 2, size(_m)), array('')), (p, m) -> left(concat(p, m), 1))"
    tails = f"zip_with({pieces}, _m, (p, m) -> right(concat(p, m), {BEFORE}))"
    before = f"""slice(zip_with(concat(array(''), {_last(tails)}), {pieces},
        (a, p) -> right(concat(a, right(coalesce(p, ''), {BEFORE})), {BEFORE})), 1, size(_m))"""
    rows = f"""IF(size(_m) = 0, CAST(array() AS array<{_NEAR}>), zip_with(zip_with(
        zip_with({pieces}, _m, (p, m) -> struct(length(p) AS gap, length(m) AS n, m AS s)),
        {before}, (y, z) -> struct(y.gap AS gap, y.n AS n, y.s AS s, z AS before)),
        {after}, (y, z) -> struct(y.gap AS gap, y.n AS n, y.s AS s, y.before AS before, z AS after)))"""
    scan = _scan(rows, "0", lambda y: f"{y}.gap + {y}.n", lambda a, b: f"{a} + {b}")
    for k, kind in enumerate(KINDS):
        df = _matches(df, WIDE[kind], _WIDE_GUARD[kind]).withColumn(f"_{kind}", F.expr(f"""transform({scan}, x -> struct(
            x.c + x.y.gap AS start, 1 AS wide, {k} AS kind, x.c + x.y.gap + x.y.n AS stop, x.y.s AS s,
            x.y.before AS before, x.y.after AS after))""")).drop("_m", "_p")
    df = df.withColumn("_found", F.concat(*[f"_{k}" for k in KINDS])).drop(*[f"_{k}" for k in KINDS])
    return df.withColumn("_wide", F.expr(f"transform({_clear_of('_base', '_found')}, x -> {_votes()})")).drop("_found")


def estimate(patterns: list[tuple]) -> dict[int, list[float]]:
    """Weights of the span classifier of each kind: one of each labeler, an
    intercept, and one of each value of each feature. ``patterns`` holds
    (kind, votes..., features..., count); features may be missing.

    EM: a span is personal data with probability ``prior``; labeler j says
    right with reliability r_j whenever it votes, independently of the others.
    The logistic classifier is fitted to the posteriors from scratch, so the
    features share in what the votes say, and tell spans of equal votes apart."""
    out, m = {}, len(LABELERS)
    for kind in range(len(KINDS)):
        rows = [(r[1:1 + m], r[1 + m:-1], r[-1]) for r in patterns if r[0] == kind]
        total = sum(n for _, _, n in rows)
        prior, rely = 0.5, [0.9, 0.8, 0.7, 0.8, 0.7]
        post = []
        for _ in range(ROUNDS if total else 0):
            post = []
            for votes, _f, _n in rows:
                z = math.log(prior / (1 - prior)) + sum(v * math.log(r / (1 - r)) for v, r in zip(votes, rely))
                post.append(1 / (1 + math.exp(-z)))
            prior = min(0.95, max(0.05, (1 + sum(p * n for p, (_, _, n) in zip(post, rows))) / (2 + total)))
            for j in range(m):
                right = sum(n * (p if v[j] > 0 else 1 - p) for p, (v, _, n) in zip(post, rows) if v[j])
                voted = sum(n for v, _, n in rows if v[j])
                rely[j] = min(0.98, max(0.55, (right + 8) / (voted + 10)))  # a labeler beats a coin
        weights = [0.0] * (m + 1 + 4 * len(FEATURES))
        # the entries of each pattern that are not zero
        inputs = [[*((j, v) for j, v in enumerate(votes) if v), (m, 1), *((m + 1 + 4 * i + f, 1) for i, f in enumerate(features))]
                  for votes, features, _ in rows]
        for _ in range(500 if total else 0):
            grad = [0.0] * len(weights)
            for p, x, (_, _, n) in zip(post, inputs, rows):
                q = 1 / (1 + math.exp(-sum(weights[j] * v for j, v in x)))
                for j, v in x:
                    grad[j] += n * (p - q) * v / total
            weights = [w + 0.5 * (g - 1e-3 * w) for w, g in zip(weights, grad)]
        out[kind] = weights
    return out


def train(docs: DataFrame) -> dict[int, list[float]]:
    """Classifier weights from the patterns of all documents' candidates."""
    counts = candidates(base_spans(_texts(docs))).select(F.explode("_wide").alias("c")) \
        .groupBy("c.kind", *[f"c.{x}" for x in (*LABELERS, *FEATURES)]).agg(F.count("*").alias("n"))
    return estimate([tuple(r) for r in counts.collect()])  # at most 4 * 3^5 * 4^2 rows


def _texts(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.coalesce(F.col("text"), F.lit("")))


def with_personal_spans(docs: DataFrame, weights: dict[int, list[float]] | None = None) -> DataFrame:
    """The documents with _base and _spans: arrays of (start, kind, stop)."""
    weights = weights or train(docs)
    df = candidates(base_spans(_texts(docs)))
    m = len(LABELERS)

    def margin(w):
        parts = [f"c.{x} * {w[j]!r}D" for j, x in enumerate(LABELERS)] + [f"{w[m]!r}D"]
        parts += ["element_at(array(" + ", ".join(f"{x!r}D" for x in w[m + 1 + 4 * i:m + 5 + 4 * i]) + f"), c.{f} + 1)"
                  for i, f in enumerate(FEATURES)]
        return " + ".join(parts)
    every = " ".join(f"WHEN c.kind = {k} THEN {margin(w)}" for k, w in weights.items())
    line = math.log(ACCEPT / (1 - ACCEPT))
    added = f"transform(filter(_wide, c -> CASE {every} END >= {line!r}D)," \
            " c -> struct(c.start AS start, c.kind AS kind, c.stop AS stop))"
    return df.withColumn("_spans", F.expr(
        f"array_sort(concat(CAST(_base AS {_SPAN}), CAST({added} AS {_SPAN})))")).drop("_wide", "_digit")


def _written(name: str) -> str:
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({name}, s -> concat({kinds}[s.kind], ':', s.start, ':', s.stop)), ',')"


def find(docs: DataFrame) -> DataFrame:
    """Counts of base spans, digest of them, and all spans, per document."""
    df = with_personal_spans(docs.select("doc_id", "text"))
    return df.select(
        "doc_id", *[F.expr(f"CAST(size(filter(_base, s -> s.kind = {k})) AS bigint)").alias(f"n_{kind}")
                    for k, kind in enumerate(KINDS)],
        F.sha2(F.expr(_written("_base")), 256).alias("base_sha256"), F.expr(_written("_spans")).alias("spans"))


def _between(a: str, b: str) -> str:
    """SQL: code points a to b of the text whose pieces of ``_PIECE`` are t."""
    x, y = f"CAST(({a}) div {_PIECE} AS int)", f"CAST(({b}) div {_PIECE} AS int)"
    return f"""CASE WHEN {a} >= {b} THEN ''
        WHEN {x} = {y} THEN substring(t[{x}], ({a}) % {_PIECE} + 1, {b} - ({a}))
        ELSE concat(substring(t[{x}], ({a}) % {_PIECE} + 1), array_join(slice(t, {x} + 2, {y} - {x} - 1), ''),
                    substring(coalesce(get(t, {y}), ''), 1, ({b}) % {_PIECE})) END"""


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets.
    Overlapping spans become one replacement, named by the first."""
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    df = with_personal_spans(docs.select(F.struct(*docs.columns).alias("_row"), "text", F.col("text").isNull().alias("_null")))
    # a span that starts before the furthest stop so far belongs to the last replacement
    scan = _scan("_spans", "0", lambda y: f"{y}.stop", lambda a, b: f"greatest({a}, {b})")
    new = _let("t", f"regexp_extract_all(text, r'(?s).{{1,{_PIECE}}}', 0)", _let("s", scan, f"""concat(
        array_join(transform(filter(s, x -> x.y.start >= x.c),
            x -> concat({_between("x.c", "x.y.start")}, {names}[x.y.kind])), ''),
        {_let("e", "array_max(transform(s, x -> greatest(x.c, x.y.stop)))", _between("e", "length(text)"))})"""))
    text = F.when(~F.col("_null"), F.when(F.size("_spans") > 0, F.expr(new)).otherwise(F.col("text")))
    return df.withColumn("_new", text).select(
        *[F.col("_new").alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])


QUERIES = {"op6_personal_data": lambda spark, sf_dir: find(documents(spark, sf_dir))}
