"""Profiles, reference data and validation."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from premia.functions.special import chi2_tail, gamma_cdf, gamma_ppf, normal_ppf, _lgamma
from premia.operators import profile as prof
from premia.operators import reference as ref
from premia.operators import validate as val
from premia.operators.validate import Context, Rule
from tests.conftest import rows


def test_special_functions():
    import math

    import numpy as np

    assert normal_ppf(0.975) == pytest.approx(1.959963984540054, abs=1e-12)
    assert chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert gamma_ppf(0.025, np.array([9.0]))[0] == pytest.approx(4.115373, abs=1e-5)  # 9 claims, exact lower limit
    assert gamma_ppf(0.975, np.array([10.0]))[0] == pytest.approx(17.084803, abs=1e-5)
    for a, x in ((0.5, 0.2), (3.0, 9.0), (250.0, 260.0)):
        p = gamma_cdf(np.array([a]), np.array([x]))[0]
        assert gamma_ppf(p, np.array([a]))[0] == pytest.approx(x, rel=1e-9)
    for x in (0.1, 1.0, 2.5, 7.9, 8.0, 50.0, 1e6):
        assert _lgamma(x) == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize(
    "name, kind, distinct, n, want",
    [
        ("premium_minor", "double", 400, 400, "money"), ("flag", "boolean", 2, 400, "boolean"), ("start", "date", 300, 400, "date"), ("policy_id", "string", 400, 400, "identifier"),
        ("driver_age", "bigint", 40, 40, "continuous"), ("ncd", "int", 9, 400, "ordinal"), ("area", "string", 9, 400, "categorical"), ("score", "double", 5, 400, "continuous"),
    ],
)
def test_semantic_types(spark, name, kind, distinct, n, want):
    dtype = spark.range(1).select(F.lit(None).cast(kind).alias("x")).schema["x"].dataType
    assert prof.semantic_type(name, dtype, distinct, n) == want


def _book(spark):
    return spark.createDataFrame(
        [("a", 1.0, 2, 200), ("a", 1.0, 0, 0), ("b", 0.5, 1, 70), (None, 0.25, 0, 0), ("z", 0.0, 0, 0)],
        "area string, exposure_years double, claim_count int, claim_amount_minor int",
    )


def test_one_way_ratios(spark):
    got = {r["level"]: r for r in prof.one_way(_book(spark), "area", confidence=0.95).collect()}
    assert (got["a"]["frequency"], got["a"]["mean_severity"], got["a"]["mean_burning_cost"]) == (1.0, 100.0, 100.0)
    assert got[None]["exposure_years"] == 0.25 and got[None]["mean_severity"] is None
    assert got["z"]["frequency"] is None and got["z"]["frequency_low"] is None
    assert got["b"]["severity_low"] is None  # one claim carries no interval
    assert got["a"]["severity_low"] < 100 < got["a"]["severity_high"]
    assert got["a"]["frequency_low"] < 1.0 < got["a"]["frequency_high"]
    assert got[None]["frequency_low"] == 0.0


def test_histogram_keeps_empty_bins_and_constants(spark):
    df = spark.createDataFrame([(0.0, 5), (10.0, 5), (10.0, 5), (None, 5)], "x double, c int")
    got = rows(prof.histograms(df, ["x", "c"]))
    x = [r for r in got if r[0] == "x"]
    assert len(x) == 20 and sum(r[4] for r in x) == 3
    assert next(r for r in x if r[1] == 19)[2:] == (9.5, 10.0, 2)
    assert [r for r in got if r[0] == "c"] == [("c", 0, 5.0, 6.0, 4)]


def test_top_levels_break_ties_by_name_and_null_last(spark):
    df = spark.createDataFrame([(x,) for x in ["b", "a", None, "c", "c"]], "x string")
    got = [(r["rank"], r["level"]) for r in prof.top_levels(df, ["x"]).orderBy("rank").collect()]
    assert got == [(1, "c"), (2, "a"), (3, "b"), (4, None)]


def test_psi_of_equal_and_one_sided_levels(spark):
    a = spark.createDataFrame([("x", "p", 10), ("x", "q", 10)], "column string, level string, n int")
    assert prof.psi(a, a).first()["psi"] == pytest.approx(0.0)
    b = spark.createDataFrame([("x", "p", 20)], "column string, level string, n int")
    import math

    want = (0.5 - 1.0) * math.log(0.5 / 1.0) + (0.5 - 1e-6) * math.log(0.5 / 1e-6)
    assert prof.psi(a, b).first()["psi"] == pytest.approx(want)
    nothing = b.where("n < 0")
    assert prof.psi(a, nothing).first()["psi"] is None


def test_lookup_is_half_open(spark):
    table = spark.createDataFrame(
        [("N", date(2025, 1, 1), date(2026, 1, 1), 1), ("N", date(2026, 1, 1), None, 2)], "key string, effective_from date, effective_to date, load int"
    )
    asked = spark.createDataFrame(
        [("N", date(2025, 12, 31)), ("N", date(2026, 1, 1)), ("N", date(2024, 1, 1)), ("S", date(2026, 1, 1))], "key string, d date"
    )
    assert rows(ref.lookup_as_at(asked, table, ["key"], "d"), "key", "d", "load") == [
        ("N", date(2024, 1, 1), None), ("N", date(2025, 12, 31), 1), ("N", date(2026, 1, 1), 2), ("S", date(2026, 1, 1), None)]
    found, missing = ref.resolve_all(asked, table, "key", "d")
    assert found.count() == 2 and missing.count() == 2
    assert ref.version_stats(table).first()["covers_to"] is None


def test_overlapping_rows_are_refused(spark):
    table = spark.createDataFrame(
        [("N", date(2025, 1, 1), None), ("N", date(2026, 1, 1), None), ("S", date(2025, 1, 1), date(2025, 2, 1)), ("S", date(2025, 2, 1), None)],
        "key string, effective_from date, effective_to date",
    )
    assert rows(ref.overlaps(table, ["key"])) == [("N", date(2026, 1, 1), 1)]
    with pytest.raises(ref.ReferenceError):
        ref.refuse_overlaps(table, ["key"])


def _run(tables, *rules, **context):
    return {r.rule.slug: r for r in val.run_validation(Context(tables, **context), rules)}


def test_structural_rules(spark):
    df = spark.createDataFrame([("P1", "AD"), ("P1", "XX"), (None, "AD")], "policy_id string, peril string")
    got = _run(
        {"t": df},
        Rule("nulls", "not_null", "t", "policy_id"),
        Rule("key", "unique_key", "t", params={"columns": ["policy_id"]}),
        Rule("domain", "allowed_values", "t", "peril", {"values": ["AD", "TP"]}),
        Rule("present", "column_presence", "t", params={"columns": ["policy_id", "missing"]}),
    )
    assert {k: (r.outcome, r.violating) for k, r in got.items()} == {"nulls": ("fail", 1), "key": ("fail", 1), "domain": ("fail", 1), "present": ("fail", 1)}


def test_quarantined_cells_are_counted(spark):
    clean = spark.createDataFrame([("a", 1.5, None)], "k string, claim_amount double, start_date date")
    rejected = spark.createDataFrame([("b", "claim_amount", "cast"), ("c", "claim_amount", "cast"), ("d", "start_date", "parse_date"), ("e", "k", "required_non_null")],
                                     "k string, _reject_column string, _reject_step string")
    got = _run(
        {"t": clean, "_rejected": rejected},
        Rule("types", "dtype_match", "t", params={"columns": {"claim_amount": "float64", "start_date": "date", "k": "string"}}),
        Rule("dates", "date_parsed", "t", params={"columns": ["start_date"]}),
    )
    assert got["types"].violating == 3 and got["types"].measured["coerced_cells"] == {"claim_amount": 2, "start_date": 1}
    assert got["dates"].violating == 1


def test_a_broken_rule_stops_no_other(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    got = _run(
        {"t": df},
        Rule("broken", "expression", "t", params={"predicate": "nothing > 1"}),
        Rule("raises", "expression", "t", params={"predicate": "cast(b as int) > 1"}),
        Rule("unknown", "no such check", "t"),
        Rule("table", "not_null", "u", "a"),
        Rule("good", "range", "t", "a", {"min_inclusive": 2}),
    )
    assert {k: r.outcome for k, r in got.items()} == {"broken": "error", "raises": "error", "unknown": "error", "table": "error", "good": "fail"}
    assert val.overall(list(got.values())) == "fail"
    assert val.overall([got["broken"]]) == "error"


def test_a_null_is_not_out_of_range_and_tolerance_counts(spark):
    df = spark.createDataFrame([(None,), (5.0,), (-0.1,)], "x double")
    got = _run({"t": df}, Rule("r", "range", "t", "x", {"min_inclusive": 0}, max_violating_rows=1), Rule("s", "range", "t", "x", {"min_inclusive": 0}))
    assert got["r"].outcome == "pass" and got["s"].violating == 1


def test_nothing_to_compare_with_is_skipped(spark):
    df = spark.createDataFrame([(1,)], "a int")
    for check in ("volume_shift", "psi_column", "new_level", "null_rate_shift", "mean_shift"):
        assert _run({"t": df}, Rule("r", check, "t", "a"))["r"].outcome == "skipped"


def test_distribution_rules_answer_from_a_stored_profile(spark):
    now = spark.createDataFrame([(None if i % 4 == 0 else "G",) for i in range(200)], "g string")
    got = _run(
        {"t": now}, Rule("nulls", "null_rate_shift", "t", "g", severity="warn"), Rule("volume", "volume_shift", "t", severity="warn"),
        reference_profile={"g": {"null_rate": 0.01, "n_rows": 400}},
    )
    assert got["nulls"].outcome == "warn" and got["nulls"].measured["reference_null_rate"] == 0.01
    assert got["volume"].outcome == "warn" and got["volume"].measured["reference_rows"] == 400


@pytest.mark.parametrize(
    "text", ["DROP TABLE exposure", "CREATE TABLE evil AS SELECT 1", "SELECT 1; DROP TABLE exposure", "INSERT INTO exposure VALUES (1)", "", "SELECT * FROM exposure", "SELECT count(*) FROM elsewhere"]
)
def test_only_one_reading_query_is_accepted(spark, text):
    df = spark.createDataFrame([(1.0,), (-0.5,)], "e double")
    assert _run({"exposure": df}, Rule("r", "sql", "exposure", params={"query": text}))["r"].outcome == "error"


def test_a_query_may_not_read_files(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "other"))
    df = spark.createDataFrame([(1.0,)], "e double")
    assert _run({"exposure": df}, Rule("r", "sql", "exposure", params={"query": f"SELECT count(*) FROM parquet.`{tmp_path}/other`"}))["r"].outcome == "error"


def test_sql_counts_and_assertions(spark):
    df = spark.createDataFrame([(1.0,), (-0.5,)], "e double")
    got = _run(
        {"exposure": df}, Rule("count", "sql", "exposure", params={"query": "SELECT count(*) FROM exposure WHERE e <= 0"}), Rule("holds", "sql", "exposure", params={"query": "SELECT max(e) <= 1 FROM exposure"}),
        Rule("fails", "sql", "exposure", params={"query": "SELECT min(e) > 0 FROM exposure"}),
    )
    assert (got["count"].violating, got["holds"].violating, got["fails"].violating) == (1, 0, 1)


def test_a_check_name_is_used_once_and_severity_only_rises():
    with pytest.raises(ValueError):
        val.check("not_null")(lambda rule, ctx: None)
    rule = Rule("r", "not_null", severity="warn")
    assert rule.raised("fail").severity == "fail"
    with pytest.raises(ValueError):
        rule.raised("info")
    assert val.empty_layers([rule]) == ["referential", "actuarial", "distributional"]
