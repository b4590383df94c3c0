"""Operator 7: mixing sources to target weights by hierarchical budgets.

Documents hang under a domain - language - source tree. Every node gets its
share of its parent's token budget by weight. A node can take at most its
capacity (``max_epochs`` times its tokens); what it can't take goes to its
siblings by their weights first, and only when a whole subtree is full does
the rest go to the ancestor's other children. With children in order of
capacity / weight this water level has a closed form over running sums, one
window per level, so no loop and nothing on the driver.

A leaf fills its budget by seeded epochs: whole epochs first, then the prefix
of the next one, whose order is the md5 of (seed, epoch, doc_id). The prefix's
end is found on sums per hash bucket; only the documents of the one bucket
that holds the end are ranked, so a source with a third of all rows is never
sorted in one task; the choice itself is a comparison with the leaf's limit.

Defined results: tokens are words ``[^\\x20\\x09-\\x0D]+``; null or wordless
texts have none and are taken in the first epoch of a leaf with a budget; null
lang or source is a branch '' of its own; unknown domains and languages weigh
``OTHER``; rows equal in id and text have one place and are taken together; an
empty table gives no rows; other columns are carried through, whatever their
names, and never used; the added columns are domain, epoch and tokens, each
with underscores before it where the documents have a column of that name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.common import documents, fresh, stored

SEED = 7
DOMAINS = {"web": 0.5, "books": 0.3, "code": 0.2}
LANGUAGES = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}
OTHER = 0.1
BUDGET_SHARE = 0.75     # of all tokens
MAX_EPOCHS = 2
SMALL = 8 << 20         # bytes up to which the measured leaf table is broadcast
DIGITS = 3              # hexadecimal digits of a hash bucket: 4096 a leaf
DOMAIN_SQL = ("CASE CAST(regexp_extract(coalesce(source, ''), '([0-9]*)$', 1) AS string) WHEN '' THEN 'web' ELSE"
              " element_at(array('web', 'books', 'code'),"
              " CAST(CAST(right(regexp_extract(source, '([0-9]*)$', 1), 9) AS int) % 3 + 1 AS int)) END")


def _weight(col, weights: dict[str, float]):
    out = F.lit(OTHER)
    for name, w in weights.items():
        out = F.when(F.col(col) == name, F.lit(w)).otherwise(out)
    return out


def _share(nodes: DataFrame, parent: list[str], weight, budget) -> DataFrame:
    """Adds ``share``: the parent's budget dealt by weight up to capacity."""
    up = Window.partitionBy(*parent).orderBy("_ratio", *[c for c in ("domain", "lang", "source") if c in nodes.columns])
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    df = nodes.withColumn("_w", weight).withColumn("_b", budget).withColumn("_ratio", F.col("capacity") / F.col("_w")) \
        .withColumn("_full", F.coalesce(F.sum("capacity").over(before), F.lit(0))) \
        .withColumn("_rest", F.sum("_w").over(Window.partitionBy(*parent))
                    - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    # full if the level at which it fills is within the budget; these are the
    # first ones, and the level of the others is that of the first of them
    df = df.withColumn("_over", F.col("_full") + F.col("_ratio") * F.col("_rest") <= F.col("_b") + 1e-6)
    level = F.min(F.when(~F.col("_over"), F.struct("_ratio", (-F.col("_rest")).alias("_last"), ((F.col("_b") - F.col("_full")) / F.col("_rest")).alias(
        "level")))).over(Window.partitionBy(*parent))["level"]
    return df.withColumn("_level", level).withColumn(
        "share", F.when(F.col("_over"), F.col("capacity").cast("double")).otherwise(F.col("_level") * F.col("_w"))) \
        .drop("_w", "_b", "_ratio", "_full", "_rest", "_over", "_level")


def budgets(leaves: DataFrame, share: float = BUDGET_SHARE, domains=None, languages=None) -> DataFrame:
    """(domain, lang, source, tokens, docs, budget) from (.., tokens, docs, capacity)."""
    key = ["domain", "lang", "source"]
    top = leaves.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("_own")) \
        .withColumn("_one", F.lit(1))
    whole = F.floor(F.sum("_own").over(Window.partitionBy("_one")) * F.lit(share)).cast("double")
    top = _share(top, ["_one"], _weight("domain", domains or DOMAINS), whole) \
        .select("domain", F.col("share").alias("_domain_share"))
    mid = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).join(top, "domain")
    mid = _share(mid, ["domain"], _weight("lang", languages or LANGUAGES), F.col("_domain_share")) \
        .select("domain", "lang", F.col("share").alias("_lang_share"))
    low = _share(leaves.join(mid, ["domain", "lang"]), ["domain", "lang"], F.lit(1.0), F.col("_lang_share"))
    return low.select(*key, "tokens", "docs", F.floor(F.col("share") + 1e-6).cast("bigint").alias("budget"))


def mix(docs: DataFrame, share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
        domains=None, languages=None, domain_sql: str = DOMAIN_SQL) -> DataFrame:
    """The documents chosen, with domain, epoch and tokens; a document comes
    once for each epoch that takes it."""
    key = ["_domain", "_lang", "_source"]
    # the documents' own columns ride in one struct, out of the way of all names
    added = fresh(docs, "domain", "epoch", "tokens")
    docs = docs.select(F.struct(*docs.columns).alias("_row"), *(c for c in ("doc_id", "lang", "source", "text")))
    df = docs.select(
        "_row", F.expr(domain_sql).alias("_domain"), F.coalesce("lang", F.lit("")).alias("_lang"),
        F.coalesce("source", F.lit("")).alias("_source"),
        F.coalesce(F.expr(r"regexp_count(text, r'[^\x20\x09-\x0D]+')"), F.lit(0)).cast("bigint").alias("_tokens"),
        F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                    F.coalesce(F.md5("text"), F.lit(""))).alias("_name"))
    # keys, tokens and names only: the texts are read twice, never moved
    thin = stored(df.select(*key, "_tokens", "_name"))
    leaves = thin.groupBy(*key).agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("docs")) \
        .withColumn("capacity", F.col("tokens") * max_epochs)
    named = leaves.select(F.col("_domain").alias("domain"), F.col("_lang").alias("lang"),
                          F.col("_source").alias("source"), "tokens", "docs", "capacity")
    plan = stored(budgets(named, share, domains, languages).where("budget > 0").select(
        F.col("domain").alias("_domain"), F.col("lang").alias("_lang"), F.col("source").alias("_source"),
        F.expr("CAST(budget div greatest(tokens, 1) AS int)").alias("_whole"),
        F.expr("budget % greatest(tokens, 1)").alias("_left")))
    # one row per leaf: broadcast where its measured size allows
    near = (lambda x: F.broadcast(x)) if plan.count() * 200 <= SMALL else (lambda x: x)
    order = F.md5(F.concat_ws("|", F.lit(seed), "_whole", "_name"))
    rows = thin.join(near(plan), key).where("_left > 0").withColumn("_md5", order) \
        .withColumn("_bucket", F.substring("_md5", 1, DIGITS))
    sums = rows.groupBy(*key, "_bucket", "_left").agg(F.sum("_tokens").alias("_sum"))
    leaf = Window.partitionBy(*key).orderBy("_bucket")  # at most 16^DIGITS rows
    ends = sums.withColumn("_end", F.sum("_sum").over(leaf)).withColumn("_begin", F.col("_end") - F.col("_sum"))
    cut = stored(ends.where("_end > _left").groupBy(*key).agg(
        F.min(F.struct(F.col("_bucket").alias("_cut"), "_begin")).alias("_at")).select(*key, "_at._cut", "_at._begin"))
    # rows that are equal in id and text have one place and go together
    place = Window.partitionBy(*key).orderBy("_md5").rangeBetween(Window.unboundedPreceding, 0)
    limit = rows.join(near(cut), key).where("_bucket = _cut") \
        .withColumn("_upto", F.col("_begin") + F.sum("_tokens").over(place)).where("_upto <= _left") \
        .groupBy(*key).agg(F.max("_md5").alias("_limit"))
    plan = stored(plan.join(cut.drop("_begin"), key, "left").join(limit, key, "left"))
    part = F.expr("_left > 0 AND (_tokens > 0 OR _whole = 0) AND (_cut IS NULL OR substring(_md5, 1, length(_cut)) < _cut"
                  " OR coalesce(_md5 <= _limit, false))")
    epochs = F.concat(
        F.expr("IF(_whole > 0, sequence(0, IF(_tokens > 0, _whole - 1, 0)), CAST(array() AS array<int>))"),
        F.when(part, F.array("_whole")).otherwise(F.expr("CAST(array() AS array<int>)")))
    return df.join(near(plan), key).withColumn("_md5", order).withColumn("_epoch", F.explode(epochs)).select(
        "_row.*", *[F.col(c).alias(a) for c, a in zip(("_domain", "_epoch", "_tokens"), added)])


def chosen(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "lang", "source", "text")).select(
        "doc_id", "domain", "lang", "source", "epoch", "tokens")


_LEVEL = """
{name}_r AS (SELECT *, capacity / w AS ratio FROM {name}_n),
{name}_s AS (SELECT *, coalesce(sum(capacity) OVER b, 0) AS before_c,
    sum(w) OVER (PARTITION BY {parent}) - coalesce(sum(w) OVER b, 0.0) AS rest FROM {name}_r
    WINDOW b AS (PARTITION BY {parent} ORDER BY ratio, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_o AS (SELECT *, before_c + ratio * rest <= budget + 1e-6 AS over_it FROM {name}_s),
{name} AS (SELECT *, CASE WHEN over_it THEN CAST(capacity AS DOUBLE) ELSE w * first_value(
    (budget - before_c) / rest) OVER (PARTITION BY {parent} ORDER BY over_it, ratio, {key}) END AS share FROM {name}_o)"""


def _case(col, weights):
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, w in weights.items()) \
        + f" ELSE {OTHER}::DOUBLE END"


_ORACLE = f"""
WITH docs AS (
  SELECT doc_id, lang, source, coalesce(lang, '') AS l, coalesce(source, '') AS s,
    CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]*)$', 1) = '' THEN 'web' ELSE
      ['web', 'books', 'code'][CAST(CAST(right(regexp_extract(source, '([0-9]*)$', 1), 9) AS INT) % 3 + 1 AS INT)]
    END AS domain,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS tokens,
    coalesce(md5(text), '') AS digest FROM documents),
leaves AS (SELECT domain, l, s, sum(tokens)::BIGINT AS tokens, sum(tokens)::DOUBLE * {MAX_EPOCHS} AS capacity
  FROM docs GROUP BY ALL),
top_n AS (SELECT 1 AS one, domain, sum(capacity) AS capacity, {_case('domain', DOMAINS)} AS w,
  (SELECT floor(sum(tokens) * {BUDGET_SHARE}::DOUBLE) FROM leaves) AS budget FROM leaves GROUP BY domain),
{_LEVEL.format(name='top', parent='one', key='domain')},
mid_n AS (SELECT x.domain, x.l, sum(x.capacity) AS capacity, {_case('x.l', LANGUAGES)} AS w, any_value(t.share) AS budget
  FROM leaves x JOIN top t ON t.domain = x.domain GROUP BY x.domain, x.l),
{_LEVEL.format(name='mid', parent='domain', key='l')},
low_n AS (SELECT x.domain, x.l, x.s, x.tokens, x.capacity, 1.0::DOUBLE AS w, m.share AS budget
  FROM leaves x JOIN mid m ON m.domain = x.domain AND m.l = x.l),
{_LEVEL.format(name='low', parent='domain, l', key='s')},
plan AS (SELECT domain, l, s, CAST(floor(share + 1e-6) AS BIGINT) // greatest(tokens, 1) AS whole,
  CAST(floor(share + 1e-6) AS BIGINT) % greatest(tokens, 1) AS remain FROM low WHERE floor(share + 1e-6) > 0),
keyed AS (SELECT d.*, p.whole, p.remain,
  md5('{SEED}|' || p.whole || '|' || coalesce(d.doc_id::VARCHAR, '') || '|' || d.digest) AS h
  FROM docs d JOIN plan p ON p.domain = d.domain AND p.l = d.l AND p.s = d.s),
run AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, l, s ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto FROM keyed),
picked AS (
  SELECT *, unnest(range(0, whole)) AS epoch FROM keyed
  UNION ALL
  SELECT * EXCLUDE (upto), whole AS epoch FROM run WHERE upto <= remain AND remain > 0 AND (tokens > 0 OR whole = 0))
SELECT doc_id, domain, lang, source, epoch::INT AS epoch, tokens FROM picked WHERE epoch = 0 OR tokens > 0
"""

QUERIES = {"op7_mix_sources": lambda spark, sf_dir: chosen(documents(spark, sf_dir))}
ORACLES = {"op7_mix_sources": _ORACLE}
