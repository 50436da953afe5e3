"""`sql` rules: what is answered, what is refused, and that nothing of the session is touched."""

import pytest
from pyspark.sql import functions as F

from premia.operators import sql_rules
from premia.operators import validate as val
from premia.operators.sql_rules import SqlRuleError
from premia.operators.validate import Context, Rule


@pytest.fixture(scope="module")
def tables(spark):
    exposure = spark.createDataFrame([("p1", 1.0, 0, "2024-01-31"), ("p2", -0.5, 1, "2024-02-29"), ("p3", 0.0, 2, None)], "policy_id string, exposure_years double, claim_count int, start string")
    claim = spark.createDataFrame([("p1", 10), ("p9", 20)], "policy_id string, amount int")
    return {"exposure": exposure, "claim": claim}


@pytest.mark.parametrize(
    ("text", "violating"),
    [
        ("SELECT count(*) FROM exposure WHERE exposure_years <= 0", 2),
        ("SELECT min(exposure_years) > 0 FROM exposure", 1),
        ("SELECT max(exposure_years) <= 1 FROM EXPOSURE -- a remark", 0),
        ("SELECT count(*) FROM claim c WHERE NOT EXISTS (SELECT 1 FROM exposure e WHERE e.policy_id = c.policy_id)", 1),
        ("SELECT count(*) FROM claim WHERE policy_id NOT IN (SELECT policy_id FROM exposure)", 1),
        ("WITH x AS (SELECT policy_id, sum(amount) AS a FROM claim GROUP BY 1) SELECT count(*) FROM x JOIN exposure USING (policy_id) WHERE a > 5", 1),
        ("WITH claim AS (SELECT * FROM exposure) SELECT count(*) FROM claim", 3),
        ("SELECT count(*) FROM (SELECT row_number() OVER (PARTITION BY claim_count ORDER BY exposure_years) AS n FROM exposure) WHERE n > 1", 0),
        ("SELECT sum(CASE WHEN upper(substring(policy_id, 1, 1)) = 'P' AND coalesce(year(to_date(start)), 0) < 2024 THEN 1 ELSE 0 END) FROM exposure", 1),
        ("SELECT count(*) FROM exposure WHERE round(exposure_years, 1) BETWEEN 0 AND 1 UNION ALL SELECT count(*) FROM claim WHERE false HAVING count(*) > 5", 2),
        ("SELECT CAST(max(amount) AS DECIMAL(10,0)) FROM claim", 20),
        ("SELECT NULL > 1 FROM claim LIMIT 1", 1),
    ],
)
def test_answers(tables, text, violating):
    assert sql_rules.answer(tables, text) == violating


@pytest.mark.parametrize(
    "text",
    [
        "", "SELECT 1; DROP TABLE exposure", "SELECT 1 /* hidden */ ; DELETE FROM exposure", "DROP TABLE exposure", "CREATE TABLE evil AS SELECT 1",
        "UPDATE exposure SET exposure_years = 1", "INSERT INTO exposure VALUES (1)", "SHOW TABLES", "SET spark.sql.ansi.enabled=false", "SELECT 1) UNION (SELECT 2",
        "SELECT count(*) FROM range(10)", "SELECT count(*) FROM secret", "SELECT count(*) FROM global_temp.shared", "SELECT count(*) FROM parquet.`/tmp`",
        "SELECT count(*) FROM csv.`/etc/passwd`", "SELECT java_method('java.lang.System', 'exit', '0') IS NULL FROM claim", "SELECT reflect('java.util.UUID', 'randomUUID') IS NULL",
        "SELECT TRANSFORM(policy_id) USING 'cat' FROM claim", "SELECT count(*) FROM claim WHERE rand() < 0.5", "SELECT uuid() IS NULL FROM claim", "SELECT current_date() IS NULL",
        "SELECT count(*) FROM claim WHERE input_file_name() <> ''", "SELECT count(*) FROM claim WHERE current_user() = 'x'", "SELECT count(*) FROM exposure TABLESAMPLE (10 PERCENT)",
        "SELECT count(*) FROM (SELECT explode(sequence(1, 1000000)) FROM claim)", "SELECT secret_function(amount) > 0 FROM claim",
        "SELECT policy_id, amount FROM claim", "SELECT amount FROM claim", "SELECT count(*) FROM claim HAVING count(*) > 5", "SELECT avg(amount) FROM claim", "SELECT 0.7", "SELECT 'yes'",
        "SELECT sum(amount) FROM claim WHERE false", "SELECT -1", "SELECT no_such_column > 1 FROM claim", "SELEKT 1",
    ],
)
def test_refusals(spark, tables, text):
    spark.createDataFrame([(1,)], "x int").createOrReplaceTempView("secret")
    spark.createDataFrame([(1,)], "x int").createOrReplaceGlobalTempView("shared")
    spark.udf.register("secret_function", lambda x: x, "int")
    before = {t.name for t in spark.catalog.listTables()}
    with pytest.raises(SqlRuleError):
        sql_rules.answer(tables, text)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_the_sessions_views_stay(spark, tables):
    spark.createDataFrame([(5,)], "mine int").createOrReplaceTempView("exposure")
    assert sql_rules.answer(tables, "SELECT count(*) FROM exposure WHERE claim_count = 0") == 1
    assert spark.table("exposure").columns == ["mine"]
    spark.catalog.dropTempView("exposure")


def test_an_answer_has_a_budget(spark):
    many = spark.range(0, 20_000_000, numPartitions=8).select("id", F.crc32(F.col("id").cast("string").cast("binary")).alias("h"))
    with pytest.raises(SqlRuleError, match="budget"):
        sql_rules.answer({"t": many}, "SELECT count(*) FROM t a JOIN t b ON a.h < b.h AND a.id + b.id < 7", 2.0)
    assert spark.range(5).count() == 5  # jobs of the session go on


def test_a_refused_rule_is_an_error_and_others_run(tables):
    rules = [Rule("bad", "sql", "exposure", params={"query": "SELECT 1; DROP TABLE exposure"}), Rule("good", "sql", "exposure", params={"query": "SELECT count(*) FROM exposure WHERE claim_count < 0"})]
    got = {r.rule.slug: r for r in val.run_validation(Context(tables), rules)}
    assert got["bad"].outcome == "error" and got["bad"].detail and got["good"].outcome == "pass"
