"""Rating steps, dislocation, rate tables and regression suites."""

from datetime import date
from decimal import Decimal
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from premia.operators import dislocation as dl
from premia.operators import rate_tables as rt
from premia.operators import rating as ra
from premia.operators import regression as rg
from tests.conftest import rows


@pytest.fixture(scope="module")
def parts(spark):
    bands = spark.createDataFrame([("young", Decimal("2.0000")), ("old", Decimal("1.1000"))], "band string, relativity decimal(10,4)")
    areas = spark.createDataFrame(
        [("n", date(2025, 1, 1), date(2026, 1, 1), Decimal("1.50")), ("n", date(2026, 1, 1), None, Decimal("1.25")), ("s", date(2025, 1, 1), None, Decimal("1.00"))],
        "area string, effective_from date, effective_to date, loading decimal(10,4)",
    )
    quotes = spark.createDataFrame(
        [("q1", 1000, "young", "n", date(2025, 6, 1), "new_business"), ("q2", 1000, "young", "n", date(2026, 1, 1), "renewal"), ("q3", 1000, "middle", "s", date(2026, 1, 1), "renewal"),
         ("q4", None, "old", "s", date(2026, 1, 1), "renewal"), ("q5", 99999, "old", "s", date(2026, 1, 1), "renewal"), ("q6", 10, "old", "s", date(2026, 1, 1), "renewal"), ("q7", 1000, "old", "s", date(2024, 1, 1), "renewal")],
        "quote_id string, base int, band string, area string, d date, purpose string",
    )
    return bands, areas, quotes


def _algorithm(parts, **changes):
    bands, areas, _ = parts
    rungs = (
        ra.Rung("risk_premium", "start", lambda n: n("risk")),
        ra.Rung("expense_loading", "multiply", "1.05"),
        ra.Rung("profit_loading", "add", "10", purposes=("new_business",)),
        ra.Rung("constraints", "clamp", minimum="50", maximum="2500.5", reason="LIMIT"),
        ra.Rung("payable_premium", "none"),
    )
    return ra.Algorithm(
        "a@1",
        changes.get("fields", (ra.Field("base", "int", minimum="0"), ra.Field("purpose", "enum", domain=("new_business", "renewal")))),
        (
            ra.Lookup("loading", areas, {"area": "area"}, "d", "loading"),
            ra.Table("relativity", changes.get("bands", bands), {"band": "band"}, on_miss=changes.get("on_miss", "error"), default=changes.get("default")),
            ra.Expression("risk", lambda n: n("base").cast("decimal(12,0)") * n("relativity") * n("loading")),
            ra.Decline("REFER", lambda n: n("base") > 50000),
        ),
        changes.get("rungs", rungs),
        purpose="purpose",
    )


def test_one_bad_row_stops_no_other(parts):
    got = {r["quote_id"]: r for r in ra.score(parts[2], _algorithm(parts)).collect()}
    assert {k: r["outcome"] for k, r in got.items()} == {"q1": "quoted", "q2": "quoted", "q3": "error", "q4": "error", "q5": "declined", "q6": "quoted", "q7": "error"}
    assert got["q1"]["premium_minor"] == 2500  # 1000 * 2 * 1.5 * 1.05 + 10, held at 2500.5, rounded half even
    assert got["q2"]["premium_minor"] == 2500 and list(got["q2"]["reasons"]) == ["LIMIT"]
    assert got["q6"]["premium_minor"] == 50
    assert list(got["q3"]["error_codes"]) == ["table_miss:relativity"]
    assert list(got["q4"]["error_codes"]) == ["input_null:base"]
    assert list(got["q7"]["error_codes"]) == ["lookup_miss:loading"]
    assert "99999" not in str(got["q5"]["error_codes"]) and got["q5"]["premium_minor"] is None and got["q5"]["ladder"] is None


def test_the_ladder_shows_every_rung_and_replays(parts):
    scored = ra.score(parts[2], _algorithm(parts))
    ladder = scored.where("quote_id = 'q6'").first()["ladder"]
    assert [(r["rung"], float(r["unrounded"])) for r in ladder] == [
        ("risk_premium", 11.0), ("expense_loading", 11.55), ("profit_loading", 11.55), ("constraints", 50.0), ("payable_premium", 50.0)]
    assert float(sum(r["contribution"] for r in ladder)) == 50.0
    ok = scored.where("outcome = 'quoted'").select(ra.ladder_reconciles("ladder", "premium_minor").alias("ok"), ra.ladder_reconciles("ladder", F.col("premium_minor") + 1).alias("off")).collect()
    assert all(r["ok"] and not r["off"] for r in ok)


def test_a_table_miss_may_have_a_default(parts):
    got = dict(rows(ra.score(parts[2], _algorithm(parts, on_miss="default", default="1.00")).where("quote_id = 'q3'"), "quote_id", "premium_minor"))
    assert got == {"q3": 1050}


def test_a_repeated_cell_is_refused(parts):
    with pytest.raises(ra.RatingError):
        ra.score(parts[2], _algorithm(parts, bands=parts[0].unionAll(parts[0])))
    with pytest.raises(ra.RatingError):
        ra.score(parts[2], _algorithm(parts, rungs=(ra.Rung("no such rung", "start", lambda n: n("risk")),)))


def test_the_batch_stops_above_its_threshold(parts):
    scored = ra.score(parts[2], _algorithm(parts))
    assert ra.refuse_failures(scored, 0.5) is scored
    with pytest.raises(ra.RatingError):
        ra.refuse_failures(scored, 0.3)
    assert rows(ra.error_tallies(scored)) == [("input_null:base", 1, "q4"), ("lookup_miss:loading", 1, "q7"), ("table_miss:relativity", 1, "q3")]


def test_declines_and_errors_are_always_traced(parts):
    scored = ra.score(parts[2], _algorithm(parts))
    assert rows(ra.sample_traces(scored, 0.0, 1), "quote_id", "sample_reason") == [("q3", "error"), ("q4", "error"), ("q5", "decline"), ("q7", "error")]
    assert ra.sample_traces(scored, 1.0, 1).count() == 7


def test_digits_of_an_input(spark):
    df = spark.createDataFrame([("0.000012345",), ("123456789012345",), ("1234567890123456",), ("100000000000000000000",), ("x",), (None,)], "v string")
    codes = F.filter(F.array(*[F.when(c, F.lit(k)) for c, k in ra.input_errors(df, [ra.Field("v", required=False)])]), lambda x: x.isNotNull())
    got = [tuple(r["c"]) for r in df.select(codes.alias("c")).collect()]
    assert got == [(), (), ("input_digits:v",), (), ("input_type:v",), ()]
    missing = ra.input_errors(df, [ra.Field("w")])
    assert missing[0][1] == "input_missing:w"


def _versions(parts):
    raised = parts[0].withColumn("relativity", F.when(F.col("band") == "old", Decimal("1.2")).otherwise(F.col("relativity")).cast("decimal(10,4)"))
    return _algorithm(parts), _algorithm(parts, bands=raised)


def test_dislocation_counts_every_policy_once(parts):
    a, b = _versions(parts)
    extra = parts[2].union(parts[2].sparkSession.createDataFrame([("q8", 1000, "old", "s", date(2026, 1, 1), "renewal")], parts[2].schema))
    f = dl.dislocation_frame(extra, a, b, keep=["area"])
    o = dl.outcomes(f).first()
    assert o["policy_count"] == 8 == sum(o[k] for k in ("quoted_both", "quoted_to_declined", "declined_to_quoted", "declined_both", "error"))
    assert (o["quoted_both"], o["error"], o["declined_both"]) == (4, 3, 1)
    t = dl.totals(f).first()
    assert t["candidate_premium_minor"] - t["baseline_premium_minor"] == 1260 - 1155
    assert dl.abs_change_quantiles(f)["1"] == "9.090910"  # 105 / 1155, rounded up
    assert dl.abs_change_quantiles(f)["0.5"] == "0.000000"
    assert rows(dl.movers(f, "5"), "quote_id", "change_minor") == [("q8", 105)]
    assert [(r["band"], r["policies"]) for r in dl.change_bands(f, ["0", "5"]).orderBy("position").collect()] == [("0 to 5", 3), ("5 and above", 1)]
    with pytest.raises(dl.DislocationError):
        dl.dislocation_frame(parts[2].union(parts[2]), a, b)
    with pytest.raises(dl.DislocationError):
        dl.change_bands(f, ["5", "0"])


def test_nothing_banded_has_no_quantiles(parts):
    a, b = _versions(parts)
    f = dl.dislocation_frame(parts[2].where("quote_id = 'q3'"), a, b)
    assert set(dl.abs_change_quantiles(f).values()) == {None}
    assert dl.totals(f).first()["change_pct"] is None


def test_shapley_against_all_orders(spark):
    df = spark.createDataFrame([(100, 2, 3, 5, 7, 1, 4), (70, 1, 2, 2, 3, 6, 2)], "base int, a0 int, a1 int, b0 int, b1 int, c0 int, c1 int")
    groups = {g: {g: (f"{g}0", f"{g}1")} for g in "abc"}

    def price(c):
        return F.col("base") * c["a"] * c["b"] + c["c"] * c["a"]

    done = dl.attribute_change(df, groups, price)
    data = [r.asDict() for r in df.collect()]

    def value(new):
        return sum(r["base"] * r["a1" if "a" in new else "a0"] * r["b1" if "b" in new else "b0"] + r["c1" if "c" in new else "c0"] * r["a1" if "a" in new else "a0"] for r in data)

    want = {g: 0 for g in "abc"}
    for order in permutations("abc"):
        for i, g in enumerate(order):
            want[g] += value(order[: i + 1]) - value(order[:i])
    assert {i["group"]: i["shapley_minor"] for i in done["items"]} == {g: round(v / 6) for g, v in want.items()}
    assert done["total_change_minor"] == value("abc") - value("") and abs(done["residual_minor"]) <= 2
    with pytest.raises(dl.DislocationError):
        dl.attribute_change(df, {f"g{i}": {} for i in range(7)}, price)


def test_change_groups_must_partition():
    got = dl.check_groups({"x": ["1", "2"], "y": ["2", "9"]}, ["1", "2", "3"])
    assert got == {"left_out": ["3"], "placed_twice": ["2"], "unknown": ["9"]}


BEFORE = [("17-20", "1.00"), ("21-24", "2.00"), ("25-29", "3.00"), ("zero", "0.00")]
AFTER = [("17-20", "1.10"), ("21-24", "2.00"), ("30-39", "3.30"), ("zero", "0.50")]


def _cells(spark, data):
    return spark.createDataFrame([(k, Decimal(v)) for k, v in data], "band string, relativity decimal(10,4)")


def test_cell_diffs(spark):
    d = rt.diff_cells(_cells(spark, BEFORE), _cells(spark, AFTER), ["band"])
    assert [(r["band"], r["change"], r["pct_change"]) for r in d.orderBy("band").collect()] == [
        ("17-20", "changed", pytest.approx(10.0)), ("25-29", "removed", None), ("30-39", "added", None), ("zero", "changed", None)]
    weights = spark.createDataFrame([("17-20", 100.0), ("zero", 5.0)], "band string, exposure_years double")
    s = rt.diff_summary(d, ["band"], weights).first()
    assert (s["changed_cells"], s["max_abs_change_pct"], s["exposure_weighted_mean_change_pct"]) == (4, pytest.approx(10.0), pytest.approx(10.0))
    same = rt.diff_summary(rt.diff_cells(_cells(spark, BEFORE), _cells(spark, BEFORE), ["band"]), ["band"]).first()
    assert tuple(same) == (0, None, None)


def test_bulk_operations(spark):
    cells = _cells(spark, BEFORE)
    value = lambda df: {r["band"]: float(r["relativity"]) for r in df.collect()}
    assert value(rt.uplift(cells, "5"))["25-29"] == 3.15
    assert value(rt.uplift(cells, "-10", filters={"band": ["21-24"]})) == {"17-20": 1.0, "21-24": 1.8, "25-29": 3.0, "zero": 0.0}
    assert value(rt.floor_and_cap(cells, "0.5", "2.5")) == {"17-20": 1.0, "21-24": 2.0, "25-29": 2.5, "zero": 0.5}
    assert value(rt.rebase(cells, {"band": ["21-24"]})) == {"17-20": 0.5, "21-24": 1.0, "25-29": 1.5, "zero": 0.0}
    missing = cells.withColumn("relativity", F.when(F.col("band") != "zero", F.col("relativity")))
    assert {r["band"]: r["relativity"] for r in rt.floor_and_cap(missing, "0.5", "2.5").collect()}["zero"] is None
    for bad in (
        lambda: rt.uplift(cells, "NaN"), lambda: rt.uplift(cells, 5.0), lambda: rt.uplift(cells, "x"), lambda: rt.uplift(cells, "5", value="count"), lambda: rt.floor_and_cap(cells, "2", "1"),
        lambda: rt.rebase(cells, {"band": ["zero"]}), lambda: rt.rebase(cells, {"band": ["nope"]}), lambda: rt.rebase(cells, {"band": ["17-20"]}, value="amount"), lambda: rt.seed_cells(cells, "x", approved=False),
    ):
        with pytest.raises(rt.RateTableError):
            bad()


def test_seeding_skips_levels_without_a_relativity(spark):
    r = spark.createDataFrame([("age", "17-20 x north", 1.1), ("age", "21-24 x north", None), ("area", "n", 1.3)], "factor string, level string, relativity double")
    assert [(x[0], float(x[1])) for x in rows(rt.seed_cells(r, "age", approved=True))] == [("17-20 x north", 1.1)]


def test_typed_keys(spark):
    portfolio = spark.createDataFrame([(3.0, "TRUE", "2026-01-01", 1.0), (3.5, "true", "2026-01-01", 2.0), (None, "yes", "soon", 4.0)], "n double, b string, d string, exposure_years double")
    cells = spark.createDataFrame([("3", "true", "2026-01-01")], "n string, b string, d string")
    weights, totals = rt.exposure_weights(portfolio, cells, {"n": ("n", "int"), "b": ("b", "bool"), "d": ("d", "date")})
    assert weights.count() == 1 and float(totals.first()["matched_exposure"]) == 1.0 and float(totals.first()["portfolio_exposure"]) == 7.0


def test_golden_quotes(spark):
    expected = spark.createDataFrame(
        [("a", "quoted", 100, 1), ("b", "quoted", 100, 1), ("c", "declined", None, 0), ("d", "quoted", 100, 5), ("e", "declined", None, 0)],
        "quote_id string, expected_outcome string, expected_minor long, tolerance_minor long",
    )
    scored = spark.createDataFrame([("a", "quoted", 101), ("b", "quoted", 102), ("c", "declined", None), ("e", "error", None)], "quote_id string, outcome string, premium_minor long")
    got = rg.golden(expected, scored)
    assert dict(rows(got, "quote_id", "status")) == {"a": "pass", "b": "fail", "c": "pass", "d": "fail", "e": "fail"}
    with pytest.raises(rg.SuiteError):
        rg.replay(got, got, recorded_hash="x", current_hash="y")


def test_monotony_is_compared_across_declined_gaps(spark):
    contexts = spark.createDataFrame([("a", 0), ("b", 0)], "quote_id string, x int")

    def rate(df):
        premium = F.when(F.col("quote_id") == "b", F.col("x")).otherwise(F.when(F.col("x") >= 4, F.lit(1)).otherwise(F.col("x")))
        outcome = F.when((F.col("quote_id") == "a") & F.col("x").isin(2, 3), "declined").otherwise("quoted")
        return df.withColumns({"premium_minor": premium, "outcome": outcome}).withColumn("premium_minor", F.when(F.col("outcome") == "quoted", F.col("premium_minor")))

    points = [0, 1, 2, 3, 4, 5]
    got = {r["quote_id"]: r for r in rg.monotone_sweep(contexts, "x", points, rate, strict=True).collect()}
    assert (got["a"]["quoted_points"], got["a"]["breaks"], got["a"]["broken_from"], got["a"]["broken_to"]) == (4, 2, "1", "4")
    assert got["b"]["breaks"] == 0
    assert rg.monotone_verdict(rg.monotone_sweep(contexts, "x", points, rate)).first()["verdict"] == "pass"
    assert rg.monotone_verdict(rg.monotone_sweep(contexts, "x", [0], rate)).first()["verdict"] == "not_checked"
    assert rg.monotone_grid(0, 100, integer=True, seed=1, name="x") == rg.monotone_grid(0, 100, integer=True, seed=1, name="x")
    grid = rg.monotone_grid("0", "10", integer=False, seed=1, name="x")
    assert grid[0] == 0 and grid[-1] == 10 and len(grid) >= 21
