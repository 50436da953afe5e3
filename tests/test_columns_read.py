"""Columns that expressions, steps and factors read."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from premia.operators import factors as fc
from premia.operators import prepare
from premia.operators.banding import Banding
from premia.operators.columns_read import columns_of, recipe_columns, recipe_lineage


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(1, 2.0, "a", [1, 2], 3)], "max int, premium double, `odd name` string, parts array<int>, c int")


@pytest.mark.parametrize(
    ("expression", "reads"),
    [
        ("premium * 2 + 1", ["premium"]),
        ("max(max)", ["max"]),  # a column called like a function
        ("greatest(C, PREMIUM)", ["premium", "c"]),
        ("`odd name` = 'premium'", ["odd name"]),  # a literal is no column
        ("transform(parts, c -> c + max)", ["max", "parts"]),  # a lambda's variable is none
        ("case when premium > 0 then 1 end", ["premium"]),
        ("(select count(*) from range(3) where id < c) > 1", ["c"]),
        ("sum(premium) over (partition by c order by max)", ["max", "premium", "c"]),
        ("1 + 1", []),
    ],
)
def test_expressions(df, expression, reads):
    assert columns_of(df, expression) == reads


def test_columns_of_column_objects_and_derived_tables(df):
    assert columns_of(df, F.col("premium") + F.sum("max").over(Window.partitionBy("c"))) == ["max", "premium", "c"]
    later = df.withColumn("rate", F.col("premium") / F.col("max")).where("c > 1")
    assert columns_of(later, "rate * c") == ["c", "rate"]  # of the table it is asked on, not of its sources


def test_steps_and_lineage(spark):
    orders = spark.createDataFrame([(1, " A ", "10", "x")], "k int, level string, premium string, code string")
    other = spark.createDataFrame([("x", 1.5)], "code string, load double")
    steps = [
        {"step": "trim_whitespace", "table": "orders", "params": {"columns": ["level"]}},
        {"step": "cast", "table": "orders", "params": {"columns": {"premium": "int"}}},
        {"step": "join_table", "table": "orders", "params": {"other": "other", "on": ["code"]}},
        {"step": "derive_expression", "table": "orders", "params": {"column": "loaded", "expression": "premium * load"}},
        {"step": "filter_rows", "table": "orders", "params": {"expression": "loaded > 1 and level is not null"}},
        {"step": "rename", "table": "orders", "params": {"columns": {"level": "grade"}}},
        {"step": "derive_expression", "table": "orders", "params": {"column": "premium", "expression": "loaded + k"}},
        {"step": "deduplicate", "table": "orders", "params": {"columns": ["grade"]}},
    ]
    tables = {"orders": orders, "other": other}
    got = [(s.kind, s.reads, s.writes) for s in recipe_columns(tables, steps)]
    assert got == [
        ("trim_whitespace", ("level",), ("level",)), ("cast", ("premium",), ("premium",)), ("join_table", ("code",), ("load",)), ("derive_expression", ("premium", "load"), ("loaded",)),
        ("filter_rows", ("level", "loaded"), ()), ("rename", ("level",), ("grade",)), ("derive_expression", ("k", "loaded"), ("premium",)), ("deduplicate", ("grade",), ()),
    ]
    found = recipe_lineage(tables, steps)
    assert found["orders", "loaded"] == {("orders", "premium"), ("other", "load")}
    assert found["orders", "premium"] == {("orders", "premium"), ("other", "load"), ("orders", "k")}
    assert found["orders", "grade"] == {("orders", "level")} and ("orders", "level") not in found
    done = prepare.apply_recipe(tables, steps).tables["orders"]
    assert {c for t, c in found if t == "orders"} == set(done.columns)


def test_factors_name_what_their_expressions_read(df):
    odd = fc.Factor("odd", "expression", expression="concat(`odd name`, cast(c as string))")
    price = fc.Factor("price", "expression", expression=F.col("premium") / F.col("max"), banding=Banding("price", "unit", (0.0, 9.0), ("0-9",)))
    pair = fc.Factor("pair", "interaction", operands=("odd", "price"))
    assert fc.needed_columns([odd, price, pair], ["base"], df) == ["base", "odd name", "c", "max", "premium"]
    with pytest.raises(fc.FactorError, match="gone"):
        fc.resolve_factors(df, [fc.Factor("gone", "expression", expression="nowhere + 1")])
