import hashlib
import hmac
from datetime import date

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from premia.functions import scalar
from premia.functions.hashing import hash_unit, hmac_sha256
from premia.operators import ingest, prepare, splits
from premia.sources import files, sinks
from tests.conftest import rows


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Policy ID", "policy_id"),
        ("  vehicle-group (ABI)  ", "vehicle_group_abi"),
        ("GrossPremium£", "gross_premium"),
        ("2026_exposure", "col_2026_exposure"),
        ("PolicyID", "policy_id"),
        ("HTTPStatus", "http_status"),
        ("prämie", "pramie"),
    ],
)
def test_column_names(raw, want):
    assert ingest.normalise_name(raw) == want


def test_colliding_names_are_refused():
    with pytest.raises(ingest.ColumnNameCollision):
        ingest.normalise_columns(["Policy ID", "policy_id"])
    with pytest.raises(ValueError):
        ingest.normalise_name("££")


def test_delimited_text_stays_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n007,NA\n008,1.5\n")
    df = files.read_delimited(spark, str(tmp_path / "a.csv"))
    assert df.dtypes == [("id", "string"), ("v", "string")]
    assert rows(df) == [("007", None), ("008", "1.5")]


def test_a_ragged_row_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,2\n3\n")
    with pytest.raises(Exception):
        files.read_delimited(spark, str(tmp_path / "a.csv")).collect()


def test_unknown_sources_are_refused(spark):
    with pytest.raises(ValueError):
        files.read_source(spark, "carrier pigeon", {})
    with pytest.raises(ValueError):
        files.read_source(spark, "upload", {"path": "x.xlsx"})


def test_a_version_is_written_once(spark, tmp_path):
    df = spark.range(3)
    path = sinks.write_table(df, sinks.version_path(str(tmp_path), "book", 1, "policy"))
    with pytest.raises(Exception):
        sinks.write_table(df, path)
    assert files.footer_schema(spark, path).names == ["id"]


def test_fingerprint_ignores_order_and_sees_changes(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    f = lambda df: files.content_fingerprint(df).first()["fingerprint"]
    assert f(a) == f(a.orderBy(F.col("a").desc()))
    assert f(a) != f(a.withColumn("b", F.lit("x")))
    assert f(a) != f(a.unionAll(a))


def test_ambiguous_dates_are_read_as_british_first(spark):
    df = spark.createDataFrame([("03/04/2026",), (None,)], "d string")
    assert ingest.sniff_date_format(df, "d") == "%d/%m/%Y"
    assert ingest.sniff_date_format(spark.createDataFrame([("12/25/2026",)], "d string"), "d") == "%m/%d/%Y"
    assert ingest.sniff_date_format(spark.createDataFrame([(None,)], "d string"), "d") is None


def test_a_single_row_has_no_candidate_key(spark):
    one = spark.createDataFrame([("a",)], "k string")
    two = spark.createDataFrame([("a",), ("b",)], "k string")
    assert ingest.infer_schema(one).first()["is_candidate_key"] is False
    assert ingest.infer_schema(two).first()["is_candidate_key"] is True


def test_reject_rate_of_nothing_is_zero(spark):
    empty = spark.createDataFrame([], "a int")
    clean, rejected = ingest.partition_rejects(empty, ["a"])
    assert ingest.reject_rate(clean, rejected).first()["reject_rate"] == 0.0
    with pytest.raises(ValueError):
        ingest.partition_rejects(empty, ["b"])


def test_totals_are_null_without_an_exposure(spark):
    row = ingest.version_totals(spark.createDataFrame([(3,)], "claim_count int")).first()
    assert tuple(row) == (None, None, None)
    row = ingest.version_totals(spark.createDataFrame([(0.1, 1), (0.2, 2)], "exposure_years double, claim_count int")).first()
    assert tuple(row) == ("0.300000", 3, None)


def test_quarantine_holds_the_input_text_once(spark):
    df = spark.createDataFrame([(1, "x", "5"), (2, "y", "six"), (3, "z", "7")], "k int, a string, n string")
    steps = [
        {"step": "normalise_case", "params": {"columns": ["a"], "case": "upper"}},
        {"step": "cast", "params": {"columns": {"n": "int", "a": "string"}}},
        {"step": "deduplicate", "params": {}},
    ]
    done = prepare.apply_recipe({"t": df}, steps, row_keys={"t": "k"}, observe=True)
    assert rows(done.tables["t"]) == [(1, "X", 5), (3, "Z", 7)]
    bad = done.rejected["t"].collect()
    assert [(r["k"], r["a"], r["n"], r["_reject_column"], r["_reject_step"]) for r in bad] == [("2", "y", "six", "n", "cast")]
    counts = done.step_counts()
    assert [(c["rows_before"], c["rows_after"], c["rows_rejected"]) for c in counts] == [(3, 3, 0), (3, 2, 1), (2, 2, 0)]
    read, rejected = 3, sum(c["rows_rejected"] for c in counts)
    assert read - rejected - sum(c["rows_removed"] for c in counts) + sum(c["rows_added"] for c in counts) == 2


def test_all_rows_of_a_source_row_leave_together(spark):
    a = spark.createDataFrame([(1, "p")], "k int, x string")
    b = spark.createDataFrame([(1, "5"), (1, "bad")], "k int, n string")
    steps = [
        {"step": "join_table", "table": "a", "params": {"other": "b", "on": ["k"], "how": "left"}},
        {"step": "cast", "table": "a", "params": {"columns": {"n": "int"}}},
    ]
    done = prepare.apply_recipe({"a": a, "b": b}, steps, row_keys={"a": "k"})
    assert done.tables["a"].count() == 0
    assert done.rejected["a"].count() == 1


def test_unknown_steps_and_tables_are_refused(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(prepare.RecipeError):
        prepare.apply_recipe({"t": df}, [{"step": "eval"}])
    with pytest.raises(prepare.RecipeError):
        prepare.apply_recipe({"t": df}, [{"step": "rename", "table": "u", "params": {"columns": {}}}])
    with pytest.raises(ValueError):
        prepare.apply_recipe({"t": df}, [{"step": "cast", "params": {"columns": {"a": "money"}}}])


def test_deduplicate_keeps_the_first_in_order(spark):
    df = spark.createDataFrame([(3, "a", "late"), (1, "a", "early"), (2, None, "n1"), (4, None, "n2")], "i int, k string, v string")
    assert rows(prepare.deduplicate(df, ["k"], order_by="i")) == [(1, "a", "early"), (2, None, "n1")]


def test_explode_keeps_the_exposure_exactly(spark):
    df = spark.createDataFrame(
        [("P1", date(2026, 1, 1), date(2027, 1, 1), 0.999316), ("P2", date(2026, 2, 1), date(2026, 3, 1), 0.076660)],
        "policy_id string, exposure_start date, exposure_end date, exposure_years double",
    )
    out = prepare.explode_period(df, ["2026-04-01", "2026-07-01", "2030-01-01"])
    assert [(str(r[1]), str(r[2])) for r in rows(out.where("policy_id = 'P1'"))] == [
        ("2026-01-01", "2026-04-01"), ("2026-04-01", "2026-07-01"), ("2026-07-01", "2027-01-01")]
    balance = prepare.exposure_balance(df, out).first()
    assert balance["preserved"] and balance["exposure_before"] == "1.075976"


def test_a_loss_on_the_renewal_date_belongs_to_the_new_term(spark):
    exposure = spark.createDataFrame(
        [(1, "P1", date(2025, 1, 1), date(2026, 1, 1)), (2, "P1", date(2026, 1, 1), date(2027, 1, 1)), (3, "P2", date(2026, 1, 1), date(2026, 6, 1)),
         (4, "P2", date(2026, 3, 1), date(2026, 9, 1)), (5, "P3", date(2026, 5, 1), date(2026, 4, 1))],
        "period_id int, policy_id string, exposure_start date, exposure_end date",
    )
    claims = spark.createDataFrame(
        [("C1", "P1", date(2026, 1, 1)), ("C2", "P9", date(2026, 1, 1)), ("C3", "P2", date(2026, 4, 1)), ("C4", "P1", None), ("C5", "P1", date(2027, 1, 1)), ("C6", "P3", date(2026, 4, 15))],
        "claim_id string, policy_id string, date_of_loss date",
    )
    done = prepare.attach_claims(exposure, claims)
    assert rows(done.linked, "claim_id", "period_id") == [("C1", 2)]
    assert rows(done.unlinked, "claim_id") == [("C2",), ("C4",), ("C5",), ("C6",)]
    assert rows(done.multi_linked, "claim_id", "n_periods") == [("C3", 2)]
    assert rows(prepare.covering_pairs(exposure, claims), "claim_id", "period_id") == [("C1", 2), ("C3", 3), ("C3", 4)]


@pytest.mark.parametrize("key", ["k", "a longer workspace key" * 5])
def test_tokens_are_the_standard_hmac(spark, key):
    df = spark.createDataFrame([("alice",), (None,), ("Zoë",)], "id string")
    got = [r["id"] for r in prepare.pseudonymise(df, "id", key).collect()]
    want = [None if v is None else hmac.new(key.encode(), v.encode(), hashlib.sha256).hexdigest()[:32] for v in ("alice", None, "Zoë")]
    assert got == want
    full = df.select(hmac_sha256("id", key).alias("h")).first()["h"]
    assert full == hmac.new(key.encode(), b"alice", hashlib.sha256).hexdigest()


def test_an_empty_key_is_refused(spark):
    df = spark.createDataFrame([("a",)], "id string")
    with pytest.raises(prepare.RecipeError):
        prepare.pseudonymise(df, "id", "")
    with pytest.raises(prepare.RecipeError):
        prepare.pseudonymise(df, "other", "k")


def test_identifiers_do_not_reach_modelling(spark):
    df = spark.createDataFrame([("a", 1)], "name string, n int")
    with pytest.raises(prepare.RecipeError):
        prepare.refuse_identifiers(df, {"name": "direct_identifier"})
    assert prepare.refuse_identifiers(df, {"name": "direct_identifier"}, ["name"]) is df


def test_scalar_edges(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    assert value(scalar.divide(F.lit(1), F.lit(0))) is None
    assert value(scalar.floor_mod(F.lit(-7), F.lit(3))) == 2
    assert value(scalar.floor_mod(F.lit(7), F.lit(-3))) == -2
    assert value(scalar.floor_mod(F.lit(7), F.lit(0))) is None
    assert value(scalar.horizontal_max(F.lit(None).cast("int"), F.lit(2))) == 2
    assert value(scalar.clip(F.lit(None).cast("int"), 0, 5)) is None
    assert value(scalar.strip(F.lit("\t a b \n"))) == "a b"
    assert value(scalar.parse_date(F.lit("31 Dec 2026"), "%d %b %Y")) == date(2026, 12, 31)
    assert value(scalar.parse_date(F.lit("2026-02-30"), "%Y-%m-%d")) is None
    with pytest.raises(ValueError):
        scalar.round_exact(F.lit(1), "sideways")
    with pytest.raises(ValueError):
        scalar.java_pattern("%Q")


@pytest.mark.parametrize(
    "mode, want", [("half_even", [2, 2, 4, -2, -2]), ("half_up", [2, 3, 4, -2, -3]), ("ceiling", [2, 3, 4, -1, -2]), ("floor", [1, 2, 3, -2, -3]), ("down", [1, 2, 3, -1, -2])]
)
def test_rounding_modes(spark, mode, want):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["1.5", "2.5", "3.5", "-1.5", "-2.5"])], "i int, v string")
    got = df.orderBy("i").select(scalar.round_exact(F.col("v").cast("decimal(10,4)"), mode).cast("int").alias("x")).collect()
    assert [r["x"] for r in got] == want


def test_change_in_percent_is_rounded_up(spark):
    df = spark.createDataFrame([(1, 3), (-1, 3), (0, 7), (1, 1_000_000_000_000)], "c long, b long")
    got = [r["x"] for r in df.select(scalar.ceiling_change_pct("c", "b").alias("x")).collect()]
    assert got == ["33.333334", "33.333334", "0.000000", "0.000001"]


def test_splits_do_not_depend_on_row_order(spark):
    df = spark.createDataFrame([(i, f"k{i % 40}") for i in range(400)], "id long, k string")
    how = {"method": "grouped_by_key", "seed": 3, "key": "k", "fractions": {"train": 0.7, "test": 0.3}}
    a = dict(rows(splits.assign_parts(df, **how), "id", "part"))
    b = dict(rows(splits.assign_parts(df.orderBy(F.col("id").desc()).repartition(5), **how), "id", "part"))
    assert a == b
    assert all(a[i] == a[i + 40] for i in range(360))
    parts = splits.partition(df, **how)
    assert sum(p.count() for p in parts.values()) == 400
    assert splits.assign_folds(df, method="random", folds=4, seed=1, key="id").select("fold").distinct().count() == 4


def test_a_null_date_is_held_out(spark):
    df = spark.createDataFrame([(1, date(2025, 1, 1)), (2, None), (3, date(2026, 1, 1))], "id int, d date")
    assert rows(splits.assign_parts(df, method="temporal", time="d", cutoff="2026-01-01"), "id", "part") == [(1, "train"), (2, "test"), (3, "test")]


@pytest.mark.parametrize(
    "how",
    [
        {"method": "shuffled"}, {"method": "temporal"}, {"method": "temporal", "time": "d", "cutoff": "not a date"}, {"method": "grouped_by_key", "key": "nope"},
        {"method": "random", "key": "id", "fractions": {"a": 0.5, "b": 0.4}}, {"method": "random", "key": "id", "fractions": {"a": 1.5, "b": -0.5}},
    ],
)
def test_splits_that_cannot_be_made_are_refused(spark, how):
    df = spark.createDataFrame([(1, date(2025, 1, 1))], "id int, d date")
    with pytest.raises(splits.SplitError):
        splits.assign_parts(df, **how).count()


def test_samples(spark):
    df = spark.createDataFrame([(i,) for i in range(100)], "id long")
    assert splits.seeded_sample(df, "id", 17, 1).count() == 17
    assert rows(splits.seeded_sample(df, "id", 17, 1)) == rows(splits.seeded_sample(df.repartition(7), "id", 17, 1))
    assert rows(splits.evenly_spaced_sample(df, "id", 4)) == sorted([(0,), (25,), (50,), (75,)], key=str)
    units = [r["u"] for r in df.select(hash_unit("id", 2).alias("u")).collect()]
    assert min(units) >= 0 and max(units) < 1 and 0.4 < sum(units) / 100 < 0.6


def test_claims_to_policy_keeps_unknown_apart_from_zero(spark):
    policies = spark.createDataFrame([("A", 2), ("B", 1), ("C", 0)], "policy_id string, claim_count int")
    amounts = spark.createDataFrame([("A", 100), ("A", 50)], "policy_id string, claim_amount_minor long")
    assert rows(prepare.claims_to_policy(policies, amounts), "policy_id", "claim_amount_minor", "mean_severity") == [("A", 150, 75.0), ("B", None, None), ("C", 0, None)]


def test_map_from_table(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    mapping = spark.createDataFrame([("a", "A")], "s string, t string")
    assert rows(prepare.map_from_table(df, "x", mapping, source="s", target="t")) == [("A",), ("b",), (None,)]


def test_unknown_cast_of_a_recipe_raises_at_build(spark):
    with pytest.raises((ValueError, PySparkException)):
        scalar.cast_to("x", "decimal")


def test_positions_fall_into_parts_by_name(spark):
    at = spark.createDataFrame([(u,) for u in (0.0, 0.1999, 0.2, 0.45, 0.5, 0.99, 1.0, None)], "u double")
    got = [r.part for r in at.select(splits.part_at(F.col("u"), {"c": 0.5, "a": 0.2, "b": 0.3, "none": 0.0}).alias("part")).collect()]
    assert got == ["a", "a", "b", "b", "c", "c", "none", "none"]
    stretched = at.select(splits.part_at(F.col("u"), {"a": 0.5, "b": 0.5005}).alias("part")).collect()
    assert [r.part for r in stretched] == ["a", "a", "a", "a", "b", "b", "b", "b"]
