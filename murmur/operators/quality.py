"""Data-quality checks (CHK-1..10). Each check set is ONE aggregate over
the frame it inspects; the results come back as rows (check, status,
detail) built with an ``explode`` of the aggregate row."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.operators.common import with_scalars


def check_rows(df: DataFrame, checks: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """``checks`` maps a name to (passed, detail) aggregate expressions."""
    aggs = []
    for i, (ok, detail) in enumerate(checks.values()):
        aggs += [ok.alias(f"_ok{i}"), detail.cast("string").alias(f"_d{i}")]
    s = df.agg(*aggs)
    return s.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("check"),
                 F.when(F.col(f"_ok{i}"), F.lit("pass")).otherwise(F.lit("fail")).alias("status"),
                 F.col(f"_d{i}").alias("detail")) for i, name in enumerate(checks)])).alias("r")).select("r.*")


def _bad(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def input_contract(df: DataFrame, *, required: Sequence[str], text_col: str, ts_col: str, stream_col: str,
                   streams: Sequence[str], expected_rows: Column | int | None = None,
                   strata_min: int = 1) -> DataFrame:
    """CHK-1: columns present, row count, non-null / non-blank text, valid
    Unicode, timestamps present, stream domain."""
    missing = [c for c in required if c not in df.columns]
    checks = {"columns_present": (F.lit(not missing), F.lit(",".join(missing) or "ok"))}
    n = F.count(F.lit(1))
    if expected_rows is not None:
        checks["row_count"] = (n == F.lit(expected_rows), n)
    t = F.col(text_col)
    checks.update({
        "text_non_null": (_bad(t.isNull()) == 0, _bad(t.isNull())),
        "text_non_blank": (_bad(F.length(F.trim(t)) == 0) == 0, _bad(F.length(F.trim(t)) == 0)),
        "text_valid_unicode": (_bad(t.rlike(r"\x{FFFD}")) == 0, _bad(t.rlike(r"\x{FFFD}"))),
        "timestamps_present": (_bad(F.col(ts_col).isNull()) == 0, _bad(F.col(ts_col).isNull())),
        "stream_domain": (_bad(~F.col(stream_col).isin(*streams) | F.col(stream_col).isNull()) == 0,
                          _bad(~F.col(stream_col).isin(*streams) | F.col(stream_col).isNull())),
    })
    out = check_rows(df, checks)
    strata = df.groupBy(stream_col).agg(F.count(F.lit(1)).alias("n")).agg(
        F.min("n").alias("_mn"), F.count(F.lit(1)).alias("_k"))
    srow = strata.select(F.lit("strata_min_size").alias("check"),
                         F.when(F.col("_mn") >= strata_min, "pass").otherwise("fail").alias("status"),
                         F.concat_ws("/", F.col("_k").cast("string"), F.col("_mn").cast("string")).alias("detail"))
    return out.unionByName(srow)


def input_warnings(df: DataFrame, *, text_col: str, location_col: str | None = None, max_chars: int = 512
                   ) -> DataFrame:
    """CHK-2: warnings (never failures): repeated texts, long texts, blank
    locations. Status is 'warn' when the count is non-zero."""
    t = F.col(text_col)
    dup = df.groupBy(t.alias("_t")).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n") - 1)), F.lit(0)).alias("_dups"))
    long = df.agg(_bad(F.length(t) > max_chars).alias("_long"),
                  *([_bad(F.col(location_col).isNull() | (F.trim(F.col(location_col)) == "")).alias("_blank")]
                    if location_col else []))
    j = with_scalars(dup, long)
    rows = [("duplicate_texts", "_dups"), (f"texts_over_{max_chars}_chars", "_long")]
    if location_col:
        rows.append(("blank_locations", "_blank"))
    return j.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.when(F.col(c) > 0, "warn")
                                                 .otherwise("pass").alias("status"), F.col(c).cast("string")
                                                 .alias("detail")) for n, c in rows])).alias("r")).select("r.*")


def lexicon_output(scored: DataFrame, source_rows: DataFrame, prefix: str = "vader_") -> DataFrame:
    """CHK-3: row count preserved, complete, proportions in [0,1], compound
    in [-1,1], proportions sum to 1 within 0.0011, label domain and label
    consistent with the compound bands."""
    neg, neu, pos, cmp, lab = (F.col(f"{prefix}{c}") for c in ("negative", "neutral", "positive", "compound",
                                                                "label"))
    src = source_rows.agg(F.count(F.lit(1)).alias("_src"))
    sc = with_scalars(scored, src)
    expected = (F.when(cmp >= 0.05, "positive").when(cmp <= -0.05, "negative").otherwise("neutral"))
    incomplete = neg.isNull() | neu.isNull() | pos.isNull() | cmp.isNull() | lab.isNull()
    checks = {
        "rows_preserved": (F.count(F.lit(1)) == F.first("_src"), F.count(F.lit(1))),
        "complete": (_bad(incomplete) == 0, _bad(incomplete)),
        "proportions_in_unit_interval": (_bad(~(neg.between(0, 1) & neu.between(0, 1) & pos.between(0, 1))) == 0,
                                         _bad(~(neg.between(0, 1) & neu.between(0, 1) & pos.between(0, 1)))),
        "compound_in_range": (_bad(~cmp.between(-1, 1)) == 0, _bad(~cmp.between(-1, 1))),
        "proportions_sum_to_one": (_bad((F.abs(neg + neu + pos - 1) > 0.0011) & ((neg + neu + pos) > 0)) == 0,
                                   _bad((F.abs(neg + neu + pos - 1) > 0.0011) & ((neg + neu + pos) > 0))),
        "label_domain": (_bad(~lab.isin("negative", "neutral", "positive")) == 0,
                         _bad(~lab.isin("negative", "neutral", "positive"))),
        "label_matches_thresholds": (_bad(lab != expected) == 0, _bad(lab != expected)),
    }
    return check_rows(sc, checks)


def model_output(scored: DataFrame, prefix: str = "roberta_", classes=("negative", "neutral", "positive")
                 ) -> DataFrame:
    """CHK-4: complete, probabilities in [0,1] summing to 1 (1e-5), score in
    [-1,1], label domain."""
    ps = [F.col(f"{prefix}{c}_probability") for c in classes]
    total = sum(ps, F.lit(0.0))
    inc = ps[0].isNull()
    for p in ps[1:]:
        inc = inc | p.isNull()
    unit = F.lit(True)
    for p in ps:
        unit = unit & p.between(0, 1)
    sc, lab = F.col(f"{prefix}score"), F.col(f"{prefix}label")
    return check_rows(scored, {
        "complete": (_bad(inc) == 0, _bad(inc)),
        "unit_interval": (_bad(~unit) == 0, _bad(~unit)),
        "sum_to_one": (_bad(F.abs(total - 1) >= 1e-5) == 0, _bad(F.abs(total - 1) >= 1e-5)),
        "score_range": (_bad(~sc.between(-1, 1)) == 0, _bad(~sc.between(-1, 1))),
        "label_domain": (_bad(~lab.isin(*classes)) == 0, _bad(~lab.isin(*classes))),
    })


def sample_checks(sample: DataFrame, allocation: DataFrame, source: DataFrame, *, id_col: str, n: int,
                  strata: Sequence[str]) -> DataFrame:
    """CHK-5: exact size, unique ids, ids drawn from the source, every
    allocated stratum present with its allocated count."""
    size = sample.agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(id_col).alias("_u"))
    outside = sample.join(source.select(id_col), id_col, "left_anti").agg(F.count(F.lit(1)).alias("_out"))
    got = sample.groupBy(*strata).agg(F.count(F.lit(1)).alias("_got"))
    cmp = allocation.join(got, list(strata), "left").agg(
        _bad(F.coalesce(F.col("_got"), F.lit(0)) != F.col("allocated_records")).alias("_mis"),
        _bad((F.col("allocated_records") > 0) & F.col("_got").isNull()).alias("_absent"))
    j = with_scalars(with_scalars(size, outside), cmp)
    rows = [("exact_size", F.col("_n") == n, F.col("_n")), ("unique_ids", F.col("_u") == F.col("_n"), F.col("_u")),
            ("ids_in_source", F.col("_out") == 0, F.col("_out")),
            ("all_strata_present", F.col("_absent") == 0, F.col("_absent")),
            ("allocation_matches", F.col("_mis") == 0, F.col("_mis"))]
    return j.select(F.explode(F.array(*[F.struct(F.lit(a).alias("check"), F.when(ok, "pass").otherwise("fail")
                                                 .alias("status"), d.cast("string").alias("detail"))
                                        for a, ok, d in rows])).alias("r")).select("r.*")


def canonical_unchanged(before: DataFrame, after: DataFrame, cols: Sequence[str]) -> DataFrame:
    """CHK-7: the canonical columns are the same multiset of rows before and
    after profiling. Compared by row count plus an order-free fingerprint
    (sum of 64-bit row hashes, exact modulo 2^64) - one pass each side, no
    shuffle of the rows themselves."""
    def fp(df):
        return df.agg(F.count(F.lit(1)).alias("n"),
                      F.sum(F.xxhash64(*[F.col(c) for c in cols]).cast("decimal(38,0)")).alias("h"))
    a = fp(before).withColumnsRenamed({"n": "_na", "h": "_ha"})
    b = fp(after).withColumnsRenamed({"n": "_nb", "h": "_hb"})
    j = with_scalars(a, b)
    same = (F.col("_na") == F.col("_nb")) & (F.col("_ha") == F.col("_hb"))
    return j.select(F.lit("canonical_columns_unchanged").alias("check"),
                    F.when(same, "pass").otherwise("fail").alias("status"),
                    F.concat_ws("/", F.col("_na").cast("string"), F.col("_nb").cast("string")).alias("detail"))


def risk_bounds(df: DataFrame, risk_cols: Sequence[str]) -> DataFrame:
    """CHK-8: every risk score in [0, 1] or NULL."""
    return check_rows(df, {f"{c}_in_unit_interval": (_bad(F.col(c).isNotNull() & ~F.col(c).between(0, 1)) == 0,
                                                      _bad(F.col(c).isNotNull() & ~F.col(c).between(0, 1)))
                           for c in risk_cols})


def rescoring_matches(stored: DataFrame, rescored: DataFrame, *, id_col: str, score: str, label: str,
                      eps: float = 1e-12) -> DataFrame:
    """CHK-9: re-scoring reproduces the stored score (within eps) and label."""
    j = stored.select(id_col, F.col(score).alias("_s1"), F.col(label).alias("_l1")).join(
        rescored.select(id_col, F.col(score).alias("_s2"), F.col(label).alias("_l2")), id_col, "full")
    bad = F.col("_s1").isNull() | F.col("_s2").isNull() | (F.abs(F.col("_s1") - F.col("_s2")) > eps)
    return check_rows(j, {"score_reproduced": (_bad(bad) == 0, _bad(bad)),
                          "label_reproduced": (_bad(~F.col("_l1").eqNullSafe(F.col("_l2"))) == 0,
                                               _bad(~F.col("_l1").eqNullSafe(F.col("_l2"))))})


def validate_run_config(cfg: Mapping) -> None:
    """CHK-10: run configuration rules, checked before any job starts."""
    for section in ("inputs", "mode", "seed"):
        if section not in cfg:
            raise ValueError(f"missing config section: {section}")
    if cfg["mode"] not in ("smoke", "sample", "full"):
        raise ValueError("mode must be smoke, sample or full")
    if not isinstance(cfg["seed"], int) or cfg["seed"] < 0:
        raise ValueError("seed must be a non-negative integer")
    if cfg.get("apply_mitigation", False):
        raise ValueError("mitigation must stay disabled in the profiling run")
    if not cfg["inputs"]:
        raise ValueError("at least one input is required")
