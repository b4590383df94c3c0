"""Sentiment, agreement, regression and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.operators import sampling as smp
from murmur.operators import sentiment as se
from murmur.operators import spatial as sp
from murmur.operators import stats as st
from murmur.operators import temporal as tm
from murmur.operators.common import fits_broadcast, spread
from murmur.plans import bindings as b
from murmur.plans.q_spatial import POSTS_SQL, _matrix_sql, exact

_MATRIX_SQL = exact(_matrix_sql("primary"))
from murmur.plans.registry import query, rounded
from murmur.sources.tables import table

W = r"[\p{L}\p{N}_]"
LABELS = 48 << 20     # measured bytes up to which the labels are broadcast


def lexicon(spark, sf):
    """Words of the labelled documents (joined before they are exploded; the
    labels, three numbers each, go to the texts by broadcast up to 2 million)."""
    labels = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    few = fits_broadcast(labels, LABELS)
    d = spread(table(spark, sf, "documents").select("doc_id", "text")).join(F.broadcast(labels) if few else labels, "doc_id")
    return se.derive_lexicon(d.select("doc_id", "quality", "toxic", F.explode(F.array_distinct(F.regexp_extract_all(
        F.lower(F.coalesce("text", F.lit(""))), F.lit(f"{W}+"), 0))).alias("word")), doc_col="doc_id")


@query("sen_00_derived_lexicon", oracle=f"""
WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{W}+')) AS word
           FROM documents),
a AS (SELECT word, count(DISTINCT w.doc_id) AS docs, 4.0 * avg(quality) - 4.0 * avg(toxic) - 2.0 AS valence
      FROM w JOIN labels l ON w.doc_id = l.doc_id GROUP BY word)
SELECT word, round(least(greatest(valence, -4.0), 4.0), 3) AS valence FROM a WHERE docs >= 5 AND abs(valence) >= 0.5""")
def sen_00_derived_lexicon(spark, sf):
    """Input lexicon for SEN-1 learnt from the labelled documents."""
    return lexicon(spark, sf)


def _lexicon_scores_sql() -> str:
    """SEN-1 in SQL: all tokens with their positions, the word table looked up
    for each, predecessors by self-join on the position, rules in order."""
    from murmur.plans.q_text import S
    from murmur.plans.registry import ORACLES
    q = lambda w: "'" + w.replace("'", "''") + "'"
    rules = ", ".join([f"({q(w)}, 1, false, false)" for w in se.BOOST_UP] + [f"({q(w)}, 2, false, false)" for w in se.BOOST_DOWN]
                      + [f"({q(w)}, 0, true, false)" for w in se.NEGATIONS] + ["('but', 0, false, true)"])
    punct = q(se.PUNCT)
    steps, v = [], "h0"
    for k, damp in ((1, 1.0), (2, 0.95), (3, 0.9)):
        up = f"(CASE p{k}cls WHEN 1 THEN {se.B_INCR}::DOUBLE WHEN 2 THEN {se.B_DECR}::DOUBLE ELSE 0.0::DOUBLE END)"
        steps.append(f"""
s{k} AS (SELECT *, CASE WHEN v < 0 THEN -{up} ELSE {up} END AS sc FROM {v}),
t{k} AS (SELECT * REPLACE (CASE WHEN p{k}cls > 0 AND p{k}up AND cap THEN CASE WHEN v > 0 THEN sc + {se.C_INCR}::DOUBLE
         ELSE sc - {se.C_INCR}::DOUBLE END ELSE sc END AS sc) FROM s{k}),
u{k} AS (SELECT * EXCLUDE (sc) REPLACE (CASE WHEN v <> 0 AND p{k}v IS NULL THEN v + sc * {damp}::DOUBLE ELSE v END AS v) FROM t{k}),
h{k} AS (SELECT * REPLACE (CASE WHEN v <> 0 AND p{k}neg THEN v * {se.N_SCALAR}::DOUBLE ELSE v END AS v) FROM u{k})""")
        v = f"h{k}"
    preds = ", ".join(f"p{k}.v AS p{k}v, coalesce(p{k}.cls, 0) AS p{k}cls, coalesce(p{k}.neg, false) AS p{k}neg, "
                      f"coalesce(p{k}.up, false) AS p{k}up" for k in (1, 2, 3))
    joins = " ".join(f"LEFT JOIN m p{k} ON p{k}.doc_id = m.doc_id AND p{k}.pos = m.pos - {k}" for k in (1, 2, 3))
    return f"""
WITH lex AS ({ORACLES["sen_00_derived_lexicon"]}),
rules(k, cls, neg, but) AS (VALUES {rules}),
kv AS (SELECT k, max(v) AS v, max(cls) AS cls, bool_or(neg) AS neg, bool_or(but) AS but FROM (
  SELECT lower(word) AS k, valence::DOUBLE AS v, 0 AS cls, false AS neg, false AS but FROM lex
  UNION ALL SELECT k, NULL, cls, neg, but FROM rules) GROUP BY k),
d AS (SELECT doc_id, coalesce(text, '') AS t,
        list_filter(string_split_regex(coalesce(text, ''), '[{S}]+'), lambda x: length(x) > 0) AS w FROM documents),
c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = upper(x) AND x <> lower(x))) AS nup,
        len(regexp_extract_all(t, '!')) AS ex, len(regexp_extract_all(t, '[?]')) AS qn FROM d),
tok AS (SELECT doc_id, unnest(w) AS raw, generate_subscripts(w, 1) AS pos FROM d),
nrm AS (SELECT doc_id, pos, CASE WHEN length(trim(raw, {punct})) <= 2 THEN raw ELSE trim(raw, {punct}) END AS w FROM tok),
m AS (SELECT n.doc_id, n.pos, n.w = upper(n.w) AND n.w <> lower(n.w) AS up, kv.v, coalesce(kv.cls, 0) AS cls,
        coalesce(kv.neg, false) OR contains(lower(n.w), 'n''t') AS neg, coalesce(kv.but, false) AS but
      FROM nrm n LEFT JOIN kv ON kv.k = lower(n.w)),
b AS (SELECT doc_id, min(pos) AS b FROM m WHERE but GROUP BY 1),
h0 AS (SELECT m.doc_id, m.pos, c.nup > 0 AND c.nup < c.n AS cap,
         CASE WHEN m.up AND c.nup > 0 AND c.nup < c.n THEN m.v + sign(m.v) * {se.C_INCR}::DOUBLE ELSE m.v END AS v, {preds}
       FROM m JOIN c ON c.doc_id = m.doc_id {joins} WHERE m.v <> 0 AND m.cls = 0),{",".join(steps)},
s AS (SELECT h.doc_id, CASE WHEN b.b IS NULL THEN v WHEN pos < b.b THEN v * 0.5::DOUBLE WHEN pos > b.b THEN v * 1.5::DOUBLE
        ELSE v END AS s FROM h3 h LEFT JOIN b ON b.doc_id = h.doc_id),
a AS (SELECT doc_id, round(sum(s), 9) AS sm, round(sum(CASE WHEN s > 0 THEN s + 1 ELSE 0.0 END), 9) AS pos,
        round(sum(CASE WHEN s < 0 THEN s - 1 ELSE 0.0 END), 9) AS neg, count(CASE WHEN s <> 0 THEN 1 END) AS hits FROM s GROUP BY 1),
e AS (SELECT c.doc_id, c.n, least(c.ex, {se.EXCLAIM_MAX}) * {se.EXCLAIM_EACH}::DOUBLE
        + CASE WHEN qn > 1 THEN CASE WHEN qn <= 3 THEN qn * {se.QUESTION_EACH}::DOUBLE ELSE {se.QUESTION_MAX}::DOUBLE END
          ELSE 0.0::DOUBLE END AS emph, coalesce(sm, 0) AS sm, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg,
        (c.n - coalesce(hits, 0))::DOUBLE AS neu FROM c LEFT JOIN a ON a.doc_id = c.doc_id),
f AS (SELECT *, CASE WHEN sm > 0 THEN sm + emph WHEN sm < 0 THEN sm - emph ELSE sm END AS ts,
        CASE WHEN pos > abs(neg) THEN pos + emph ELSE pos END AS p2, CASE WHEN pos < abs(neg) THEN neg - emph ELSE neg END AS n2 FROM e),
g AS (SELECT *, p2 + abs(n2) + neu AS tot,
        CASE WHEN n = 0 THEN 0.0 ELSE round(round(least(greatest(ts / sqrt(ts * ts + {se.ALPHA}), -1.0), 1.0), 9), 4) END AS cmp FROM f)
SELECT doc_id, CASE WHEN n = 0 OR tot = 0 THEN 0.0 ELSE round(round(abs(n2 / tot), 9), 3) END AS vader_negative,
  CASE WHEN n = 0 OR tot = 0 THEN 0.0 ELSE round(round(abs(neu / tot), 9), 3) END AS vader_neutral,
  CASE WHEN n = 0 OR tot = 0 THEN 0.0 ELSE round(round(abs(p2 / tot), 9), 3) END AS vader_positive,
  cmp AS vader_compound, CASE WHEN cmp >= 0.05 THEN 'positive' WHEN cmp <= -0.05 THEN 'negative' ELSE 'neutral' END AS vader_label
FROM g"""


LEXICON_SCORES_SQL = _lexicon_scores_sql()


@query("sen_01_lexicon_scores", oracle=LEXICON_SCORES_SQL)
def sen_01_lexicon_scores(spark, sf):
    """SEN-1 + SEN-2 over every document."""
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return se.lexicon_scores(d, "text", lexicon(spark, sf), check_blank=False).drop("text")


def _stand_in_sql():
    """The stand-in predictor's softmax written in SQL (the oracle for the
    batch-inference path)."""
    from murmur.plans.q_text import _sql_tokens
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations),
f AS (SELECT *, greatest(length(t), 1) AS n, len(regexp_extract_all(t, '!')) AS ex,
             len(regexp_extract_all(t, '\\?')) AS q, len(regexp_extract_all(t, '[A-Z]')) AS up FROM c),
l AS (SELECT *, q * 0.5 + up / n AS l0, 0.5 AS l1, ex * 0.5 + (1 - up / n) * 0.3 AS l2 FROM f),
m AS (SELECT *, greatest(l0, l1, l2) AS mx FROM l),
e AS (SELECT *, exp(l0 - mx) AS e0, exp(l1 - mx) AS e1, exp(l2 - mx) AS e2 FROM m),
p AS (SELECT *, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2,
             {_sql_tokens('t')} AS tk FROM e)
SELECT conv_id, turn, round(p0, 6) AS roberta_negative_probability, round(p1, 6) AS roberta_neutral_probability,
       round(p2, 6) AS roberta_positive_probability, round(p2 - p0, 6) AS roberta_score,
       CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'negative' WHEN p1 >= p2 THEN 'neutral' ELSE 'positive' END AS roberta_label,
       CAST(tk AS INTEGER) AS roberta_token_count, tk > 128 AS roberta_truncated FROM p"""


@query("sen_03_model_scores", oracle=_stand_in_sql())
def sen_03_model_scores(spark, sf):
    """SEN-3 batch inference over conversation turns with the stand-in
    predictor (Arrow batches, length-sorted partitions)."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return rounded(se.model_scores(c, "text", se.char_profile_predictor).drop("text"))


@query("lng_03_language_id")
def lng_03_language_id(spark, sf):
    """LNG-3 with the stand-in detector, next to the declared tag."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return se.language_id(d, "text", se.script_detector).drop("text")


# Two raters per labelled document: A from the labels, B from the length.
RATERS_SQL = """
SELECT l.doc_id, d.lang, (l.quality - l.toxic) * CAST(0.8 AS DOUBLE) AS a_score, tanh((d.n_chars - 2000.0) / 2000.0) AS b_score
FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""


def _band(x):
    return f"CASE WHEN {x} >= 0.05 THEN 'positive' WHEN {x} <= -0.05 THEN 'negative' ELSE 'neutral' END"


def _raters(spark, sf):
    lab = table(spark, sf, "labels")
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    r = lab.join(d, "doc_id").select(
        "doc_id", "lang", ((F.col("quality") - F.col("toxic")) * 0.8).alias("a_score"),
        F.tanh((F.col("n_chars") - 2000.0) / 2000.0).alias("b_score"))
    return r.withColumns({"a_label": se.label_bands(F.col("a_score")), "b_label": se.label_bands(F.col("b_score"))})


def _agreement_sql(group: str | None) -> str:
    g = f"{group}, " if group else ""
    pg = f"PARTITION BY {group}" if group else ""
    pga = f"PARTITION BY {group}, a_score" if group else "PARTITION BY a_score"
    pgb = f"PARTITION BY {group}, b_score" if group else "PARTITION BY b_score"
    cms = ", ".join(f"count(CASE WHEN a_label = '{la}' AND b_label = '{lb}' THEN 1 END) AS cm_{i}{j}"
                    for i, la in enumerate(st.LABELS) for j, lb in enumerate(st.LABELS))
    f1 = " + ".join(
        f"CASE WHEN (2 * cm_{L}{L} + {' + '.join(f'cm_{L}{j}' for j in range(3) if j != L)} + "
        f"{' + '.join(f'cm_{i}{L}' for i in range(3) if i != L)}) > 0 THEN 2.0 * cm_{L}{L} / (2 * cm_{L}{L} + "
        f"{' + '.join(f'cm_{L}{j}' for j in range(3) if j != L)} + "
        f"{' + '.join(f'cm_{i}{L}' for i in range(3) if i != L)}) ELSE 0.0 END" for L in range(3))
    rowm = [" + ".join(f"cm_{i}{j}" for j in range(3)) for i in range(3)]
    colm = [" + ".join(f"cm_{i}{j}" for i in range(3)) for j in range(3)]
    pe = " + ".join(f"({rowm[i]}) * ({colm[i]})" for i in range(3)) + " / 1.0"
    po = "(cm_00 + cm_11 + cm_22) * 1.0 / record_count"
    pes = f"(({pe}) / (record_count * record_count))"
    return f"""
WITH r AS ({RATERS_SQL}),
l AS (SELECT *, {_band('a_score')} AS a_label, {_band('b_score')} AS b_label,
             rank() OVER ({pg} ORDER BY a_score) + (count(*) OVER ({pga}) - 1) / 2.0 AS ra,
             rank() OVER ({pg} ORDER BY b_score) + (count(*) OVER ({pgb}) - 1) / 2.0 AS rb FROM r),
s AS (SELECT {g}count(*) AS record_count, corr(a_score, b_score) AS pearson_r, corr(ra, rb) AS spearman_rho,
             avg(CASE WHEN a_label = b_label THEN 1.0 ELSE 0.0 END) AS label_agreement_rate,
             avg(abs(a_score - b_score)) AS mean_absolute_score_difference, {cms}
      FROM l {"GROUP BY " + group if group else ""})
SELECT {g}record_count, round(pearson_r, 6) AS pearson_r,
       round(tanh(atanh(least(greatest(pearson_r, -0.999999), 0.999999)) - 1.959963984540054 / sqrt(record_count - 3)), 6)
         AS pearson_ci_low,
       round(tanh(atanh(least(greatest(pearson_r, -0.999999), 0.999999)) + 1.959963984540054 / sqrt(record_count - 3)), 6)
         AS pearson_ci_high,
       round(spearman_rho, 6) AS spearman_rho, round(label_agreement_rate, 6) AS label_agreement_rate,
       round(({f1}) / 3.0, 6) AS macro_f1_agreement,
       round(CASE WHEN {pes} < 1 THEN ({po} - {pes}) / (1 - {pes}) END, 6) AS cohen_kappa,
       round(mean_absolute_score_difference, 6) AS mean_absolute_score_difference,
       cm_00, cm_01, cm_02, cm_10, cm_11, cm_12, cm_20, cm_21, cm_22
FROM s WHERE record_count >= 4"""


@query("sta_01_agreement_overall", oracle=_agreement_sql(None))
def sta_01_agreement_overall(spark, sf):
    """STA-1..8: Pearson, Fisher CI, Spearman, agreement, macro-F1, kappa,
    MAE and the 3x3 confusion counts for two raters."""
    return rounded(st.agreement(_raters(spark, sf), a_score="a_score", b_score="b_score", a_label="a_label",
                                b_label="b_label"))


@query("sta_09_agreement_by_lang", oracle=_agreement_sql("lang"))
def sta_09_agreement_by_lang(spark, sf):
    """STA-9: the same bundle per language group (groups with >= 4 rows)."""
    return rounded(st.agreement(_raters(spark, sf), a_score="a_score", b_score="b_score", a_label="a_label",
                                b_label="b_label", group_cols=["lang"]))


def _t_tail_sql(r: str, n: str) -> str:
    """Two-sided p of a correlation, Student's t with n - 2 degrees of freedom:
    with t = sqrt(df) tan(a) the density is proportional to cos(a)^(df - 1)."""
    a = f"atan(abs({r}) / sqrt(1 - {r} * {r}))"
    return f"""CASE WHEN abs({r}) >= 1 THEN 0.0 ELSE greatest(0.0, 1 - 2 * exp(lgamma(({n} - 1) / 2.0) - lgamma(({n} - 2) / 2.0)) / sqrt(pi())
  * {a} / 6000 * list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
  * power(cos({a} * i / 2000), {n} - 3)))) END"""


def _p_values_sql():
    inner = _agreement_sql("lang").replace("round(pearson_r, 6) AS pearson_r", "pearson_r").replace(
        "round(spearman_rho, 6) AS spearman_rho", "spearman_rho")
    return f"""
SELECT lang, record_count, round(pearson_r, 6) AS pearson_r, round({_t_tail_sql('pearson_r', 'record_count')}, 6) AS pearson_p_value,
  round(spearman_rho, 6) AS spearman_rho, round({_t_tail_sql('spearman_rho', 'record_count')}, 6) AS spearman_p_value FROM ({inner})"""


@query("sta_01_correlation_p_values", oracle=_p_values_sql())
def sta_01_correlation_p_values(spark, sf):
    """STA-1/2 p-values (t test via the regularised incomplete beta)."""
    a = st.agreement(_raters(spark, sf), a_score="a_score", b_score="b_score", a_label="a_label",
                     b_label="b_label", group_cols=["lang"], with_p=True)
    return rounded(a.select("lang", "record_count", "pearson_r", "pearson_p_value", "spearman_rho",
                            "spearman_p_value"))


def ols_sql(source: str, y: str, xs: list[str], group: list[str], min_rows: int = 1) -> str:
    """OLS with HC1 errors by successive residuals: for each term, what is
    left of it and of y after all other terms gives its coefficient and error.
    Full-rank groups only. Columns as ``stats.ols_hc1`` names them."""
    terms = ["const", *xs]
    g = ", ".join(group) + (", " if group else "")
    w = f"(PARTITION BY {', '.join(group)})" if group else "()"
    k, parts = len(terms), []
    for j, target in enumerate(terms):
        order = [t for t in terms if t != target]
        for step, t in enumerate(order):
            rest = [*order[step + 1:], target, "y_"]
            cols = ", ".join(f"{c} - {t} * (sum({c} * {t}) OVER {w}) / nullif(sum({t} * {t}) OVER {w}, 0) AS {c}" for c in rest)
            parts.append(f"o{j}_{step} AS (SELECT {g}row_id, {cols} FROM {'o_rows' if step == 0 else f'o{j}_{step - 1}'})")
        parts.append(f"""b{j} AS (SELECT *, sum({target} * y_) OVER {w} / nullif(sum({target} * {target}) OVER {w}, 0) AS b
  FROM o{j}_{k - 2})""")
        parts.append(f"""s{j} AS (SELECT {g}count(*) AS n, any_value(b) AS b, sum((y_ - b * {target}) * (y_ - b * {target})) AS ssr,
    sqrt(count(*) * 1.0 / nullif(count(*) - {k}, 0) * sum({target} * {target} * (y_ - b * {target}) * (y_ - b * {target}))
         / (sum({target} * {target}) * sum({target} * {target}))) AS se FROM b{j} {'GROUP BY ' + ', '.join(group) if group else ''})""")
    on = lambda j: " AND ".join(f"s{j}.{c} = s0.{c}" for c in group) or "true"
    joins = " ".join(f"JOIN s{j} ON {on(j)}" for j in range(1, k))
    outs = ", ".join(f"s{j}.b AS b_{t}, s{j}.se AS se_{t}, {P_SQL.format(z=f'abs(s{j}.b / s{j}.se)')} AS p_{t}"
                     for j, t in enumerate(terms))
    same = " AND ".join(f"t_.{c} = s0.{c}" for c in group) or "true"
    return f"""
WITH o_all AS (SELECT {g}CAST({y} AS DOUBLE) AS y_, {', '.join(f'CAST({x} AS DOUBLE) AS {x}' for x in xs)} FROM ({source})),
o_rows AS (SELECT *, CAST(1 AS DOUBLE) AS const, row_number() OVER () AS row_id FROM o_all
  WHERE y_ IS NOT NULL AND {' AND '.join(f'{x} IS NOT NULL' for x in xs)} QUALIFY count(*) OVER {w} >= {min_rows}),
{", ".join(parts)},
t_ AS (SELECT {g}var_pop(y_) * count(*) AS sst FROM o_rows {'GROUP BY ' + ', '.join(group) if group else ''})
SELECT {', '.join(f's0.{c}' for c in group) + (', ' if group else '')}s0.n, {k} AS rank, true AS has_const,
  1 - s0.ssr / sst AS r_squared, 1 - (s0.n - 1) * 1.0 / nullif(s0.n - {k}, 0) * (s0.ssr / sst) AS adj_r_squared, {outs}
FROM s0 {joins} JOIN t_ ON {same}"""


# two-sided normal tail of z, the integral by Simpson's rule
P_SQL = """greatest(0.0, 1 - sqrt(2 / pi()) * least({z}, 8.0) / 6000 * list_sum(list_transform(range(0, 2001),
  lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
            * exp(-0.5 * (least({z}, 8.0) * i / 2000) * (least({z}, 8.0) * i / 2000)))))"""


def _rounded_sql(sql: str, columns: list[str], more: str = "") -> str:
    return f"SELECT {', '.join(f'round({c}, 6) AS {c}' for c in columns)}{more} FROM ({sql})"


def _windows(spark, sf):
    m = tm.time_matrix(b.events(spark, sf), "ts", "value", id_col="event_id")
    return tm.event_windows(m, b.registry(spark, sf), hours=48, events_bounded=True)


_WINDOWS_SQL = """
SELECT m.*, r.event_name, (epoch_us(m.hour) - epoch_us(r.ts)) / 3600000000.0 AS time_elapsed_hours,
       CAST(m.hour >= r.ts AS INTEGER) AS post_event_dummy,
       (epoch_us(m.hour) - epoch_us(r.ts)) / 3600000000.0 * CAST(m.hour >= r.ts AS INTEGER) AS _td
FROM (SELECT date_trunc('hour', ts) AS hour, avg(value) AS mean_sentiment FROM events WHERE ts IS NOT NULL GROUP BY 1) m
JOIN (SELECT 'error_' || event_id AS event_name, ts FROM events WHERE event_type = 'error' ORDER BY value DESC, event_id LIMIT 4) r
  ON m.hour BETWEEN r.ts - INTERVAL 48 HOUR AND r.ts + INTERVAL 48 HOUR"""


@query("sta_13_itsa_per_event", oracle=f"""
WITH w AS ({_WINDOWS_SQL}),
c AS (SELECT event_name, count(CASE WHEN time_elapsed_hours < 0 THEN 1 END) AS pre_period_n,
        count(CASE WHEN time_elapsed_hours >= 0 THEN 1 END) AS post_period_n FROM w GROUP BY 1),
f AS ({ols_sql('SELECT * FROM w', 'mean_sentiment', ['time_elapsed_hours', 'post_event_dummy', '_td'], ['event_name'], 10)})
SELECT f.event_name, n, pre_period_n, post_period_n, round(b_const, 6) AS beta_0_baseline,
       round(b_time_elapsed_hours, 6) AS beta_1_pre_slope, round(b_post_event_dummy, 6) AS beta_2_immediate_shock,
       round(b__td, 6) AS beta_3_post_slope_change, round(p_post_event_dummy, 6) AS p_value_immediate_shock,
       round(p__td, 6) AS p_value_post_slope_change, round(r_squared, 6) AS r_squared,
       round(least(1.0, 4 * p_post_event_dummy), 6) AS bonferroni_adj_p_value,
       least(1.0, 4 * p_post_event_dummy) < 0.05 AS significant
FROM f JOIN c ON c.event_name = f.event_name""")
def sta_13_itsa_per_event(spark, sf):
    """STA-12/13: segmented regression with HC1 per event window."""
    return rounded(st.itsa(_windows(spark, sf)))


def _matrix(spark, sf, mode="primary", score="value"):
    posts = b.posts(spark, sf)
    if score == "props_value":  # the numeric member of the JSON payload
        posts = posts.withColumn("props_value", F.get_json_object("props", "$.k").cast("double"))
    return sp.region_matrix(posts, b.returns(spark, sf), region_col="state_code",
                            candidate_col="candidate_resolved", scores=score, regions=b.regions(spark, sf),
                            a_pattern="candidate_a", b_pattern="candidate_b", mode=mode, id_col="event_id")


REGRESSORS = ["state_sentiment_margin_Xi", *b.CONTROLS]
SUBGROUPS_SQL = """SELECT 'national' AS subgroup, * FROM ({m})
UNION ALL SELECT 'battleground', * FROM ({m}) WHERE historical_classification = 'battleground'
UNION ALL SELECT 'safe', * FROM ({m}) WHERE historical_classification IN ('safe_red', 'safe_blue')"""


def _stratified_ols(m, keys=(), min_rows=5):
    sub = F.explode(F.array_compact(F.array(
        F.lit("national"),
        F.when(F.col("historical_classification") == "battleground", F.lit("battleground")),
        F.when(F.col("historical_classification").isin("safe_red", "safe_blue"), F.lit("safe")))))
    return st.ols_hc1(m.withColumn("subgroup", sub), "democratic_margin_pct", REGRESSORS, [*keys, "subgroup"],
                      min_rows=min_rows)


_FIT_COLUMNS = ["r_squared", "adj_r_squared"] + [f"{c}_{t}" for t in ["const", *REGRESSORS] for c in ("b", "se", "p")]


@query("sta_16_region_ols_stratified", oracle=_rounded_sql(
    ols_sql(SUBGROUPS_SQL.format(m=_MATRIX_SQL), "democratic_margin_pct", REGRESSORS, ["subgroup"], 5),
    _FIT_COLUMNS, ", subgroup, n, rank, has_const"))
def sta_16_region_ols_stratified(spark, sf):
    """STA-14/15/16: margin ~ Xi + controls with HC1, national /
    battleground / safe; subgroups under 5 rows give no result."""
    return rounded(_stratified_ols(_matrix(spark, sf)))


def _grid_sql():
    parts = []
    for score in ("value", "props_value"):
        for mode in ("primary", "split"):
            m = exact(_matrix_sql(mode, score))
            for name, cond in (("all", "true"), ("min100", "a_tweet_count + b_tweet_count >= 100")):
                parts.append(f"SELECT '{score}' AS score, '{mode}_{name}' AS scenario, * FROM ({m}) WHERE {cond}")
    grid = " UNION ALL ".join(parts)
    return _rounded_sql(ols_sql(SUBGROUPS_SQL.format(m=grid), "democratic_margin_pct", REGRESSORS,
                                ["score", "scenario", "subgroup"], 5),
                        _FIT_COLUMNS, ", score, scenario, subgroup, n, rank, has_const")


@query("sta_17_scenario_grid", oracle=_grid_sql())
def sta_17_scenario_grid(spark, sf):
    """STA-17: two scores x (primary / split) x (all regions / regions with
    >= 100 rows), every fit of the grid in one grouped regression."""
    out = None
    for score in ("value", "props_value"):
        for mode in ("primary", "split"):
            m = _matrix(spark, sf, mode, score).withColumn("score", F.lit(score))
            for name, cond in (("all", F.lit(True)), ("min100", (F.col("a_tweet_count") + F.col("b_tweet_count")) >= 100)):
                part = m.where(cond).withColumn("scenario", F.lit(f"{mode}_{name}"))
                out = part if out is None else out.unionByName(part)
    return rounded(_stratified_ols(out, ["score", "scenario"]))


@query("sta_18_bivariate_fit", oracle=f"""
WITH m AS ({_MATRIX_SQL}),
s AS (SELECT count(CASE WHEN state_sentiment_margin_Xi IS NOT NULL AND democratic_margin_pct IS NOT NULL THEN 1 END) AS n,
       regr_slope(democratic_margin_pct, state_sentiment_margin_Xi) AS slope,
       regr_intercept(democratic_margin_pct, state_sentiment_margin_Xi) AS intercept,
       regr_r2(democratic_margin_pct, state_sentiment_margin_Xi) AS r_squared,
       regr_sxx(democratic_margin_pct, state_sentiment_margin_Xi) AS sxx, regr_avgx(democratic_margin_pct, state_sentiment_margin_Xi) AS ax
     FROM m),
e AS (SELECT sum((democratic_margin_pct - intercept - slope * state_sentiment_margin_Xi) ** 2) AS ssr FROM m, s),
h AS ({ols_sql('SELECT * FROM m', 'democratic_margin_pct', ['state_sentiment_margin_Xi'], [])})
SELECT s.n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(s.r_squared, 6) AS r_squared,
       round(sqrt(ssr / (s.n - 2) / sxx), 6) AS se_slope, round(sqrt(ssr / (s.n - 2) * (1.0 / s.n + ax * ax / sxx)), 6) AS se_intercept,
       round(h.se_state_sentiment_margin_Xi, 6) AS se_slope_hc1, round(h.se_const, 6) AS se_intercept_hc1 FROM s, e, h""")
def sta_18_bivariate_fit(spark, sf):
    """STA-18: fit line of margin on Xi with classical and HC1 errors."""
    return rounded(st.bivariate_fit(_matrix(spark, sf), "democratic_margin_pct", "state_sentiment_margin_Xi"))


@query("smp_01_simple_sample", oracle="""
SELECT event_id, user_id, event_type FROM events ORDER BY md5('2020|' || CAST(event_id AS VARCHAR)), event_id LIMIT 500""")
def smp_01_simple_sample(spark, sf):
    ev = b.events(spark, sf).select("event_id", "user_id", "event_type")
    return smp.simple_sample(ev, 500, id_col="event_id", seed=2020)


ALLOC_SQL = f"""
WITH p AS (SELECT candidate_resolved, date_trunc('day', ts) AS utc_day, event_id FROM ({POSTS_SQL})),
c AS (SELECT candidate_resolved, utc_day, count(*) AS source_records FROM p GROUP BY 1, 2),
e AS (SELECT *, source_records * 1.0 / sum(source_records) OVER () * 500 AS exact_allocation FROM c),
f AS (SELECT *, floor(exact_allocation) AS fl, exact_allocation - floor(exact_allocation) AS fractional_remainder FROM e),
g AS (SELECT *, 500 - sum(fl) OVER () AS lft,
             row_number() OVER (ORDER BY fractional_remainder DESC, candidate_resolved, utc_day) AS prio FROM f)
SELECT candidate_resolved, utc_day, source_records, exact_allocation, fractional_remainder,
       CAST(fl + CASE WHEN prio <= lft THEN 1 ELSE 0 END AS BIGINT) AS allocated_records,
       100.0 * source_records / sum(source_records) OVER () AS source_share_pct,
       100.0 * (fl + CASE WHEN prio <= lft THEN 1 ELSE 0 END) / 500 AS sample_share_pct FROM g"""


def _strat(spark, sf):
    p = b.posts(spark, sf).select("event_id", "candidate_resolved", F.date_trunc("day", "ts").alias("utc_day"))
    return smp.stratified_sample(p, 500, ["candidate_resolved", "utc_day"], id_col="event_id", seed=2020)


@query("smp_02_allocation", oracle=f"""
SELECT candidate_resolved, utc_day, source_records, round(exact_allocation, 6) AS exact_allocation,
       round(fractional_remainder, 6) AS fractional_remainder, allocated_records,
       round(source_share_pct, 6) AS source_share_pct, round(sample_share_pct, 6) AS sample_share_pct
FROM ({ALLOC_SQL})""")
def smp_02_allocation(spark, sf):
    return rounded(_strat(spark, sf)[1])


SAMPLE_SQL = f"""
WITH a AS ({ALLOC_SQL}),
p AS (SELECT candidate_resolved, date_trunc('day', ts) AS utc_day, event_id FROM ({POSTS_SQL}))
SELECT p.event_id, p.candidate_resolved, p.utc_day FROM p JOIN a USING (candidate_resolved, utc_day)
QUALIFY row_number() OVER (PARTITION BY p.candidate_resolved, p.utc_day
                           ORDER BY md5('2020|' || CAST(p.event_id AS VARCHAR)), p.event_id) <= any_value(a.allocated_records)
                           OVER (PARTITION BY p.candidate_resolved, p.utc_day)"""


@query("smp_02_stratified_sample", oracle=SAMPLE_SQL)
def smp_02_stratified_sample(spark, sf):
    return _strat(spark, sf)[0]


@query("smp_03_sample_checksum", oracle=f"""
WITH i AS (SELECT CAST(event_id AS VARCHAR) AS id, row_number() OVER (ORDER BY CAST(event_id AS VARCHAR)) - 1 AS pos FROM ({SAMPLE_SQL})),
a AS (SELECT pos // 64 AS pos, sha256(string_agg(id, ',' ORDER BY pos)) AS h FROM i GROUP BY 1)
SELECT (SELECT count(*) FROM i) AS sample_rows, sha256(string_agg(h, ',' ORDER BY pos)) AS checksum_sha256 FROM a""")
def smp_03_sample_checksum(spark, sf):
    return smp.sample_checksum(_strat(spark, sf)[0], "event_id")


@query("agg_37_stratum_sizes", oracle=f"""
WITH c AS (SELECT candidate_resolved, date_trunc('day', ts) AS d, count(*) AS n FROM ({POSTS_SQL}) GROUP BY 1, 2)
SELECT count(*) AS strata, min(n) AS min_stratum, max(n) AS max_stratum FROM c""")
def agg_37_stratum_sizes(spark, sf):
    p = b.posts(spark, sf).withColumn("utc_day", F.date_trunc("day", "ts"))
    return smp.stratum_sizes(p, ["candidate_resolved", "utc_day"])


@query("agg_44_sample_vs_source", oracle=f"""
WITH s AS ({SAMPLE_SQL}), p AS ({POSTS_SQL}),
t AS (SELECT candidate_resolved, count(*) AS source_n FROM p GROUP BY 1),
u AS (SELECT candidate_resolved, count(*) AS sample_n FROM s GROUP BY 1),
j AS (SELECT t.candidate_resolved, t.source_n, coalesce(u.sample_n, 0) AS sample_n FROM t LEFT JOIN u USING (candidate_resolved))
SELECT candidate_resolved, source_n, sample_n, round(100.0 * source_n / sum(source_n) OVER (), 6) AS source_pct,
       round(100.0 * sample_n / sum(sample_n) OVER (), 6) AS sample_pct FROM j""")
def agg_44_sample_vs_source(spark, sf):
    sample = _strat(spark, sf)[0]
    return rounded(smp.share_vs_source(sample, b.posts(spark, sf), "candidate_resolved"))
