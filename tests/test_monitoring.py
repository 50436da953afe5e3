"""Governance, monitoring kernels, streams and optimisation."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from premia.operators import governance as gv
from premia.operators import monitor as mo
from premia.operators import optimise as op
from premia.streaming import monitors as st
from tests.conftest import rows

CORE = ["id", "what"]


def _chain(spark, n=6):
    import hashlib
    import json

    out, prev = [], gv.GENESIS
    for i in range(1, n + 1):
        core = json.dumps({"id": i, "what": f"w{i}"}, separators=(",", ":"))
        digest = hashlib.sha256((prev + core).encode()).hexdigest()
        out.append(("ws", i, i, f"w{i}", prev, digest))
        prev = digest
    return spark.createDataFrame(out, "workspace string, sequence long, id int, what string, prev_hash string, event_hash string")


def test_an_intact_chain_verifies_whole_and_in_part(spark):
    chain = _chain(spark)
    assert gv.verify_chain(chain, CORE).count() == 0
    assert gv.verify_chain(chain, CORE, first=3, last=5).count() == 0


def test_every_kind_of_break_is_found(spark):
    chain = _chain(spark)
    edited = chain.withColumn("what", F.when(F.col("id") == 3, "other").otherwise(F.col("what")))
    assert rows(gv.verify_chain(edited, CORE)) == [("ws", 3, "content does not match its hash")]
    assert rows(gv.verify_chain(chain.where("id <> 4"), CORE)) == [("ws", 5, "sequence gap")]
    relinked = chain.withColumn("prev_hash", F.when(F.col("id") == 2, gv.GENESIS).otherwise(F.col("prev_hash")))
    assert rows(gv.verify_chain(relinked, CORE)) == [("ws", 2, "previous hash does not match")]
    assert rows(gv.chain_summary(chain, gv.verify_chain(edited, CORE))) == [("ws", 6, 1, 3, "content does not match its hash")]


def test_field_diff(spark):
    df = spark.createDataFrame([('{"a": {"b": 1, "c": [1, 2]}, "d": "x"}', '{"a": {"b": 2, "c": [1, 2]}, "e": null}'), (None, '{"k": 1}')], "x string, y string")
    assert rows(gv.field_diff(df, "x", "y")) == sorted([("a.b", "1", "2"), ("d", "x", None), ("k", None, "1")], key=str)


def test_lineage_of_a_diamond(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)], "parent int, child int")
    assert rows(gv.lineage(edges, [5])) == [(1, 3), (2, 2), (3, 2), (4, 1)]
    assert rows(gv.lineage(edges, [1], up=False)) == [(2, 1), (3, 1), (4, 2), (5, 3)]
    assert gv.lineage(edges, [1]).count() == 0


def test_breaches_in_a_row(spark):
    data = [("m", i, s) for i, s in enumerate(["breach", "breach", "ok", "breach", "breach", "breach", "warn"])]
    out = mo.consecutive(spark.createDataFrame(data, "k string, t int, status string"), ["k"], "t", 3)
    assert [(r["run"], r["alert"]) for r in out.orderBy("t").collect()] == [(1, False), (2, False), (0, False), (1, False), (2, False), (3, True), (0, False)]


def test_one_open_alert_per_key(spark):
    data = [("m", i, "warn") for i in range(10)] + [("n", 0, "ok"), ("n", 1, "breach"), ("o", 0, "ok")]
    got = {r["k"]: r for r in mo.open_alerts(spark.createDataFrame(data, "k string, t int, status string"), ["k"], "t").collect()}
    assert set(got) == {"m", "n"}
    assert got["m"]["always_firing"] and got["m"]["level"] == "warn" and not got["n"]["always_firing"] and got["n"]["level"] == "breach"


def test_rate_and_mix_add_up_to_the_gap(spark):
    a = spark.createDataFrame([("x", 60.0, 2.0), ("y", 40.0, 1.0)], "s string, premium double, change_pct double")
    b = spark.createDataFrame([("x", 30.0, 2.5), ("z", 70.0, 0.5)], "s string, premium double, change_pct double")
    r = mo.rate_achieved(a, b, "s").first()
    assert r["rate_intended_pct"] == pytest.approx(1.6) and r["rate_achieved_pct"] == pytest.approx(1.1)
    assert r["pure_rate_pct"] + r["mix_pct"] == pytest.approx(r["gap_pct"]) == pytest.approx(-0.5)


def test_an_immature_cohort_is_not_judged(spark):
    df = spark.createDataFrame([("2025", 90, 50.0, 10.0), ("2026", 90, 50.0, 10.0)], "c string, a int, x double, e double")
    got = {r["cohort"]: r for r in mo.cohort_ae(df, F.col("c"), [], actual="a", expected="x", exposure="e", mature_before="2026").collect()}
    assert got["2025"]["status"] == "breach" and got["2026"]["status"] is None and got["2025"]["low"] > 1


def test_drift_on_a_vanished_level(spark):
    now = spark.createDataFrame([(1, "c", "p", 10, 10.0)], "period int, column string, level string, n int, weight double")
    base = spark.createDataFrame([("c", "p", 5, 5.0), ("c", "q", 5, 5.0)], "column string, level string, n int, weight double")
    want = (1 - 0.5) * math.log(2) + (1e-6 - 0.5) * math.log(1e-6 / 0.5)
    assert mo.drift(now, base).first()["psi"] == pytest.approx(want)
    assert [r["s"] for r in spark.createDataFrame([(0.05,), (0.2,), (0.3,), (None,)], "x double").select(mo.status(F.col("x"), 0.1, 0.25).alias("s")).collect()] == ["ok", "warn", "breach", None]


def test_a_run_goes_on_over_micro_batches(spark, tmp_path):
    """Three breaches in a row alert once, also when they arrive in different batches."""
    schema = "k string, ts timestamp, v double"
    at = lambda m: datetime(2026, 1, 1, 0, m)
    folder = str(tmp_path / "in")
    for m, v in enumerate([5.0, 5.0, 5.0, 5.0, 1.0, 5.0]):
        spark.createDataFrame([("a", at(m), v), ("b", at(m), 1.0)], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    found = st.consecutive_breaches(stream, key="k", time="ts", value="v", limit=3.0, needed=3)
    assert [(r["key"], r["since"], r["at"], r["run"]) for r in st.run_to_table(found, "runs").collect()] == [("a", at(0), at(2), 3)]


def test_late_rows_are_left_to_backfill(spark, tmp_path):
    schema = "ts timestamp, t string"
    folder = str(tmp_path / "in")
    day = lambda d, h=0: datetime(2026, 1, d, h)
    for data in ([(day(1, 1), "a"), (day(1, 2), "a")], [(day(3), "b")], [(day(5), "c")], [(day(1, 3), "late")], [(day(7), "d")]):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    levels = st.run_to_table(st.windowed_levels(stream, ["t"], time="ts", width="1 day", late="6 hours"), "late")
    assert rows(levels, "period", "level", "n") == [(day(1), "a", 2), (day(3), "b", 1), (day(5), "c", 1)]
    batch = mo.backfill(spark.read.parquet(folder), F.to_date("ts"), ["2026-01-01"], lambda df: df.groupBy("t").count())
    assert rows(batch) == [("a", 2), ("late", 1)]


def test_elasticity_methods_agree_and_flag_defects(spark):
    df = spark.createDataFrame([("s", 10.0, 1.0), ("s", 12.0, 0.5)], "g string, price double, base double")
    a = op.elasticity(df, op.Demand("base", -0.9, 0.1), "price", ["g"]).first()
    b = op.elasticity(df, op.Demand("base", -0.9, 0.1), "price", ["g"], method="finite_difference").first()
    assert a["elasticity"] == pytest.approx(b["elasticity"], abs=1e-4) and a["low"] < a["elasticity"] < a["high"] and not a["defect"]
    assert op.elasticity(df, op.Demand("base", 0.2), "price", ["g"]).first()["defect"]
    with pytest.raises(op.OptimiseError):
        op.elasticity(df, op.Demand("base", -1.0), "price", ["g"], method="guess")


def test_the_search_holds_its_constraint(spark):
    df = spark.createDataFrame([(f"s{i % 3}", 100.0 + i, 5.0, 60.0) for i in range(90)], "seg string, price double, base double, cost double")
    demand = op.Demand("base", -1.2)
    how = {"segment": "seg", "price": "price", "cost": "cost", "factors": [0.9, 1.0, 1.1], "multipliers": [0.0, 100.0, 1000.0, 5000.0]}
    free, loose = op.search(df, demand, min_volume_share=0.0, **how)
    tight, held = op.search(df, demand, min_volume_share=1.0, **how)
    assert not loose["volume_binding"] and held["volume_binding"]
    assert held["volume"] >= held["baseline_volume"] - 1e-9 and loose["profit"] >= held["profit"]
    assert free.count() == tight.count() == 3
    with pytest.raises(op.OptimiseError):
        op.search(df, demand, min_volume_share=2.0, **how)


def test_renewals_above_new_business_fail(spark):
    df = spark.createDataFrame([(100, 100, 1.0), (101, 100, 2.0), (90, 100, 1.0), (None, 100, 1.0)], "renewal_minor long, equivalent_minor long, e double")
    r = op.renewal_check(df, exposure="e").first()
    assert (r["checked"], r["failing"], r["verdict"], r["failing_exposure"]) == (3, 1, "fail", 2.0)
    assert op.renewal_check(df, tolerance=0.02).first()["verdict"] == "pass"


def test_extrapolation_is_refused(spark):
    seen = spark.createDataFrame([("a", 100.0), ("a", 200.0)], "s string, p double")
    asked = spark.createDataFrame([("a", 219.0)], "s string, proposed_price double").union(spark.createDataFrame([("a", 221.0), ("b", 100.0)], "s string, proposed_price double"))
    assert rows(op.extrapolation_guard(seen, asked, "s", "p"), "s", "proposed_price", "refused") == [("a", 219.0, False), ("a", 221.0, True), ("b", 100.0, True)]


def test_stream_reads_a_table_stored_as_a_folder(spark, sf, tmp_path):
    from premia.streaming.monitors import read_stream

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    for folder in (str(tmp_path), sf):
        query = read_stream(spark, folder, "events", events.schema).writeStream.format("memory").queryName("whole_events").trigger(availableNow=True).start()
        query.awaitTermination()
        assert spark.table("whole_events").count() == events.count()
        spark.catalog.dropTempView("whole_events")
