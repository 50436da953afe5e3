"""Validation rules as one compiled action: jobs, isolation of failures, thresholds, exposure and keys."""

import json

from premia.operators import validate as val
from premia.operators.validate import Context, Rule
from premia.plans import catalogue


def _jobs(spark, work):
    context = spark.sparkContext
    context.setJobGroup("counted", "counted")
    try:
        out = work()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    return out, len(context.statusTracker().getJobIdsForGroup("counted"))


def _tables(spark):
    book = spark.createDataFrame([("a", 1, 0.5, 1, "x"), ("a", 1, 0.25, 0, "y"), ("b", 2, 0.25, 0, None), ("c", 3, 1.0, 4, "z")], "id string, n int, exposure_years double, claim_count int, cur string")
    claim = spark.createDataFrame([("c1", "a", -5), ("c2", "q", 7), ("c2", "b", 9)], "claim_id string, id string, amount int")
    return {"book": book, "claim": claim}


RULES = [
    Rule("key", "unique_key", "book", params={"columns": ["id", "n"]}),
    Rule("null", "not_null", "book", "cur"),
    Rule("one", "currency_consistency", "book", "cur"),
    Rule("freq", "frequency_plausible", "book", params={"by": "id", "max_frequency": 3.0}),
    Rule("all", "frequency_plausible", "book", params={"max_frequency": 2.0}),
    Rule("claims", "unique_key", "claim", params={"columns": ["claim_id"]}),
    Rule("sign", "claim_amount_sign", "claim", "amount", {"max_negative_share": 0.1}),
    Rule("known", "cross_table_key", "claim", "id", {"references_table": "book", "references_column": "id"}),
]


def test_rules_are_one_action(spark):
    got, jobs = _jobs(spark, lambda: {r.rule.slug: r for r in val.run_validation(Context(_tables(spark)), RULES)})
    assert {k: r.violating for k, r in got.items()} == {"key": 1, "null": 1, "one": 3, "freq": 1, "all": 1, "claims": 1, "sign": 1, "known": 1}
    # each shuffle and broadcast of the one plan is a job where plans adapt
    assert jobs <= 10
    assert got["key"].exposure_fraction == 0.375 and got["freq"].exposure_fraction == 0.5 and got["null"].exposure_fraction == 0.125
    assert got["claims"].exposure_fraction is None
    assert got["freq"].threshold == {"max_frequency": 3.0, "max_violating_rows": 0} and got["all"].measured["max_frequency"] == 2.5


def test_a_rule_that_fails_at_run_time_is_alone(spark):
    bad = Rule("bad", "expression", "book", params={"predicate": "cast(cur as int) > 1"})
    worse = Rule("worse", "frequency_plausible", "claim", params={"by": "claim_id"})  # no such columns
    got = {r.rule.slug: r for r in val.run_validation(Context(_tables(spark)), [*RULES, bad, worse])}
    assert got["bad"].outcome == got["worse"].outcome == "error"
    assert {k: got[k].violating for k in ("key", "null", "sign", "known")} == {"key": 1, "null": 1, "sign": 1, "known": 1}


def test_empty_tables(spark):
    empty = {k: df.limit(0) for k, df in _tables(spark).items()}
    got = {r.rule.slug: r for r in val.run_validation(Context(empty), RULES)}
    assert {r.outcome for r in got.values()} == {"pass"} and {r.violating for r in got.values()} == {0}
    assert val.offending_samples(Context(empty), RULES, {"book": ["id"], "claim": ["claim_id"]}).count() == 0


def test_samples_keep_the_smallest_keys_before_they_meet(spark, monkeypatch):
    monkeypatch.setattr(val, "SAMPLE", 3)
    many = spark.range(1000, numPartitions=8).selectExpr("1000 - id as id", "cast(null as string) as cur", "1.0D as exposure_years", "id % 100 as g")
    rules = [Rule("null", "not_null", "t", "cur"), Rule("key", "unique_key", "t", params={"columns": ["g"]})]
    found = val.offending_samples(Context({"t": many}), rules, {"t": ["id"]})
    got = sorted((r.rule, r.place, json.loads(r.key)) for r in found.collect())
    assert got[3:] == [("null", k, {"id": k}) for k in (1, 2, 3)]
    assert [k["k0"] for _, _, k in got[:3]] == sorted(range(100), key=lambda k: f"{k}}}")[:3]
    assert "WindowGroupLimit" in found._jdf.queryExecution().optimizedPlan().toString()


def test_the_whole_catalogue_takes_few_jobs(spark, sf):
    report, jobs = _jobs(spark, lambda: catalogue.REGISTRY["validation_report"].build(spark, sf))
    assert report.count() == 26
    assert jobs <= 110  # 140 before; table footers, quantiles, links and user rules have jobs of their own
