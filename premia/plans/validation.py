"""Queries: the validation catalogue over the pricing views."""

from __future__ import annotations

from pyspark.sql import functions as F

from premia.operators import prepare
from premia.operators import validate as val
from premia.operators.validate import Context, Rule
from premia.plans.preparation import _RECIPE, _RECIPE_SOURCE, _recipe_source
from premia.plans.profiling import _REFERENCE, reference_rows
from premia.plans.registry import query
from premia.session import stored
from premia.plans.views import BOOK, CLAIM, POLICY_EXPOSURE, VERSION_CUT, book, claim, policy_exposure, table, versions, with_sql


def _tables(spark, sf):
    b = book(spark, sf, "part", "nation").withColumn("segment", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")))
    return {"book": b, "claim": claim(spark, sf), "policy_exposure": policy_exposure(spark, sf)}


_ROW_RULES = [
    (Rule("known-segment", "not_null", "book", "segment"), "segment IS NULL"),
    (Rule("known-flag", "allowed_values", "book", "l_returnflag", {"values": ["A", "N"]}), "l_returnflag NOT IN ('A','N')"),
    (Rule("exposure-positive", "range", "book", "exposure_years", {"min_exclusive": 0}, layer="actuarial"), "exposure_years <= 0"),
    (Rule("exposure-plausible", "range", "book", "exposure_years", {"max_inclusive": 0.95}, layer="actuarial"), "exposure_years > 0.95"),
    (Rule("claims-whole", "range", "book", "claim_count", {"min_inclusive": 0, "integer": True}, layer="actuarial"), "claim_count < 0"),
    (Rule("encoding", "encoding", "book", "n_name", severity="warn"), "FALSE"),
    (Rule("tax-below-discount", "expression", "book", params={"predicate": "l_tax <= l_discount"}), "NOT (l_tax <= l_discount)"),
    (Rule("small-price", "range", "book", "l_extendedprice", {"max_exclusive": 100000}, severity="warn", max_violating_rows=10**9), "l_extendedprice >= 100000"),
]


@query(
    "validate_rows_one_pass",
    with_sql(BOOK, "src AS (SELECT *, nullif(c_mktsegment, 'BUILDING') AS segment FROM book)")
    + " UNION ALL ".join(
        f"""SELECT '{r.slug}' AS rule, CAST(count(*) FILTER ({p}) AS BIGINT) AS violating_rows,
        round(coalesce(sum(exposure_years) FILTER ({p}), 0) / sum(exposure_years), 9) AS exposure_fraction FROM src"""
        for r, p in _ROW_RULES
    ),
)
def validate_rows_one_pass(spark, sf):
    rules = [r for r, _ in _ROW_RULES]
    row = val.row_violations(Context(_tables(spark, sf)), rules)
    entries = [
        F.struct(
            F.lit(r.slug).alias("rule"),
            F.col(f"v{i}").alias("violating_rows"),
            F.round(F.coalesce(F.col(f"e{i}"), F.lit(0.0)) / F.col("total_exposure"), 9).alias("exposure_fraction"),
        )
        for i, r in enumerate(rules)
    ]
    return row.select(F.inline(F.array(*entries)))


_LINK_SQL = """(SELECT c.claim_id, count(p.period_id) AS k FROM claim c LEFT JOIN policy_exposure p ON c.policy_id = p.policy_id
   AND date_of_loss >= exposure_start AND date_of_loss < exposure_end GROUP BY 1)"""

_RULES = [
    (Rule("columns-there", "column_presence", "book", params={"columns": ["policy_id", "peril", "cover"]}), "SELECT 2", "fail"),
    (Rule("columns-known", "no_unexpected_columns", "claim", params={"columns": ["claim_id", "policy_id", "date_of_loss"]}, severity="warn"), "SELECT 2", "warn"),
    (Rule("claim-key", "unique_key", "claim", params={"columns": ["claim_id"]}), "SELECT count(*) - count(DISTINCT claim_id) FROM claim", None),
    (Rule("line-key", "unique_key", "book", params={"columns": ["l_orderkey", "l_linenumber"]}),
     "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM book)) FROM book", None),
    (Rule("resolves", "reference_lookup", "book", "n_name", {"reference": "nation", "as_at": "start_date"}, layer="referential"),
     "SELECT count(*) FROM book LEFT JOIN refrows ON n_name = key AND effective_from <= start_date AND (effective_to IS NULL OR start_date < effective_to) WHERE key IS NULL", None),
    (Rule("covered", "reference_coverage", "book", "n_name", {"reference": "nation"}, "warn", "referential"), "SELECT 0", None),
    (Rule("dates-covered", "effective_date_in_range", "book", "start_date", {"reference": "closed"}, layer="referential"),
     "SELECT count(*) FROM book WHERE start_date >= DATE '1998-01-01'", None),
    (Rule("policy-known", "cross_table_key", "claim", "policy_id", {"references_table": "recent", "references_column": "policy_id"}, layer="referential"),
     f"SELECT count(*) FROM claim WHERE policy_id NOT IN (SELECT policy_id FROM policy_exposure WHERE exposure_start >= DATE '{VERSION_CUT}')", None),
    (Rule("codes-known", "code_list_drift", "book", "n_name", {"reference": "closed_codes"}, "warn", "referential"), "SELECT count(*) FROM nation WHERE n_nationkey >= 20", None),
    (Rule("period", "period_consistent", "policy_exposure", params={"start": "exposure_start", "end": "exposure_end", "exposure": "exposure_years"}, layer="actuarial"), "SELECT 0", None),
    (Rule("no-overlap", "no_overlap", "policy_exposure", params={"key": "policy_id", "start": "exposure_start", "end": "exposure_end"}, layer="actuarial"),
     """SELECT count(*) FROM (SELECT max(exposure_end) OVER (PARTITION BY policy_id ORDER BY exposure_start, period_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        > exposure_start AS x FROM policy_exposure) WHERE x""", None),
    (Rule("policy-year", "policy_year_exposure", "policy_exposure", params={"key": "policy_id", "start": "exposure_start"}, layer="actuarial"),
     "SELECT count(*) FROM (SELECT policy_id, year(exposure_start), sum(exposure_years) AS e FROM policy_exposure GROUP BY ALL) WHERE e > 1.05", None),
    (Rule("loss-in-period", "claim_date_in_exposure", "claim", params={"exposure": "policy_exposure"}, layer="actuarial"), f"SELECT count(*) FROM {_LINK_SQL} WHERE k = 0", None),
    (Rule("linkage", "claim_linkage_complete", "claim", params={"exposure": "policy_exposure"}, layer="actuarial"), f"SELECT count(*) FROM {_LINK_SQL} WHERE k = 0", None),
    (Rule("single-link", "claim_not_multi_linked", "claim", params={"exposure": "policy_exposure"}, layer="actuarial"), f"SELECT count(*) FROM {_LINK_SQL} WHERE k > 1", None),
    (Rule("amount-sign", "claim_amount_sign", "claim", "claim_amount_minor", severity="warn", layer="actuarial"), "SELECT 0", None),
    (Rule("outliers", "severity_outlier", "claim", "claim_amount_minor", severity="warn", layer="actuarial"),
     "SELECT count(*) FROM claim WHERE claim_amount_minor > (SELECT quantile_cont(claim_amount_minor, 0.995) FROM claim WHERE claim_amount_minor > 0)", None),
    (Rule("frequency-band", "frequency_plausible", "book", params={"by": "p_brand", "min_frequency": 0.64, "max_frequency": 0.67}, severity="warn", layer="actuarial"),
     "SELECT count(*) FROM (SELECT sum(claim_count)/sum(exposure_years) AS f FROM book GROUP BY p_brand) WHERE f < 0.64 OR f > 0.67", None),
    (Rule("severity-band", "severity_plausible", "book", params={"by": "p_brand", "min_severity": 260000, "max_severity": 270000}, severity="warn", layer="actuarial"),
     "SELECT count(*) FROM (SELECT sum(claim_amount_minor)/sum(claim_count) AS f FROM book GROUP BY p_brand) WHERE f < 260000 OR f > 270000", None),
    (Rule("maturity", "development_maturity", "book", "start_date", severity="warn", layer="actuarial"),
     """SELECT CASE WHEN sum(exposure_years) FILTER (start_date > c) / sum(exposure_years) > 0.05 THEN count(*) FILTER (start_date > c) ELSE 0 END
        FROM book, (SELECT CAST(max(start_date) - INTERVAL 3 MONTH AS DATE) AS c FROM book)""", None),
    (Rule("one-currency", "currency_consistency", "book", "l_linestatus", layer="actuarial"), "SELECT count(DISTINCT l_linestatus) - 1 FROM book", None),
    (Rule("duplicate-claims", "duplicate_claim", "claim", params={"columns": ["policy_id", "date_of_loss", "peril"]}, severity="warn", layer="actuarial"),
     "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT policy_id, date_of_loss, peril FROM claim)) FROM claim", None),
    (Rule("no-reference", "volume_shift", "claim", severity="warn", layer="distributional"), "SELECT NULL", "skipped"),
    (Rule("user-sql", "sql", "claim", params={"query": "SELECT count(*) FROM claim WHERE claim_amount_minor < 1000"}, severity="warn"),
     "SELECT count(*) FROM claim WHERE claim_amount_minor < 1000", None),
    (Rule("user-sql-holds", "sql", "claim", params={"query": "SELECT min(claim_amount_minor) >= 0 FROM claim"}), "SELECT 0", None),
    (Rule("broken", "expression", "claim", params={"predicate": "no_such_column > 1"}), "SELECT NULL", "error"),
]


def _report_sql(rules) -> str:
    parts = []
    for r, sql, outcome in rules:
        if outcome in ("skipped", "error"):
            parts.append(f"SELECT '{r.slug}' AS rule, '{r.layer}' AS layer, '{r.severity}' AS severity, '{outcome}' AS outcome, CAST(NULL AS BIGINT) AS violating_rows")
        else:
            parts.append(
                f"""SELECT '{r.slug}' AS rule, '{r.layer}' AS layer, '{r.severity}' AS severity,
                CASE WHEN n > {r.max_violating_rows} THEN '{r.severity}' ELSE 'pass' END AS outcome, n AS violating_rows FROM (SELECT CAST(({sql}) AS BIGINT) AS n)"""
            )
    return " UNION ALL ".join(parts)


#: What the rules of the report read of the book.
_REPORT_COLUMNS = (
    "l_orderkey", "l_linenumber", "l_linestatus", "policy_id", "start_date", "n_name", "p_brand", "exposure_years", "claim_count", "claim_amount_minor",
)


@query("validation_report", with_sql(BOOK, CLAIM, POLICY_EXPOSURE, _REFERENCE) + _report_sql(_RULES))
def validation_report(spark, sf):
    tables = _tables(spark, sf)
    # many rules pass over both joins, some by themselves
    tables |= {"book": stored(tables["book"], *_REPORT_COLUMNS), "claim": stored(tables["claim"])}
    tables["recent"] = tables["policy_exposure"].where(F.col("exposure_start") >= F.lit(VERSION_CUT).cast("date"))
    rows = reference_rows(spark, sf)
    codes = table(spark, sf, "nation").where("n_nationkey < 20").select(F.col("n_name").alias("key"))
    ctx = Context(tables, {"nation": rows, "closed": rows.where("effective_to is not null"), "closed_codes": codes})
    return val.report_frame(spark, val.run_validation(ctx, [r for r, _, _ in _RULES]))


@query(
    "validation_of_quarantine",
    with_sql(_RECIPE_SOURCE)
    + """, r AS (SELECT count(*) FILTER (premium = 'n/k') AS casts, count(*) FILTER (premium <> 'n/k' AND start_date = 'soon') AS dates FROM src)
       SELECT 'types' AS rule, 'fail' AS outcome, CAST(casts + dates AS BIGINT) AS violating_rows FROM r
       UNION ALL SELECT 'dates', 'fail', CAST(dates AS BIGINT) FROM r UNION ALL SELECT 'rate', 'fail', CAST(casts + dates AS BIGINT) FROM r""",
)
def validation_of_quarantine(spark, sf):
    done = prepare.apply_recipe({"orders": _recipe_source(spark, sf)}, _RECIPE, row_keys={"orders": "k"})
    ctx = Context({"orders": done.tables["orders"], "_rejected": done.rejected["orders"]})
    rules = [
        Rule("types", "dtype_match", "orders", params={"columns": {"premium": "int64", "start_date": "date"}}),
        Rule("dates", "date_parsed", "orders", params={"columns": ["start_date"]}),
        Rule("rate", "reject_rate", "orders"),
    ]
    return val.report_frame(spark, val.run_validation(ctx, rules)).select("rule", "outcome", "violating_rows")


def _cur_prev(column: str) -> str:
    return f"""(SELECT {column} AS level, sum(exposure_years) FILTER (cur) AS ea, sum(exposure_years) FILTER (NOT cur) AS eb, count(*) FILTER (cur) AS a, count(*) FILTER (NOT cur) AS b FROM two GROUP BY 1)"""


def _psi_over(column: str, a: str, b: str) -> str:
    x, y = f"greatest(coalesce({a},0)/(SELECT sum({a}) FROM {_cur_prev(column)}), 1e-6)", f"greatest(coalesce({b},0)/(SELECT sum({b}) FROM {_cur_prev(column)}), 1e-6)"
    return f"SELECT CASE WHEN sum(({x} - {y}) * ln({x} / {y})) > 0.1 THEN 1 ELSE 0 END FROM {_cur_prev(column)}"


_DRIFT_RULES = [
    (Rule("psi", "psi_column", "book", "mixed", severity="warn", layer="distributional"), _psi_over("mixed", "a", "b"), None),
    (Rule("psi-calm", "psi_column", "book", "p_type", severity="warn", layer="distributional"), _psi_over("p_type", "a", "b"), None),
    (Rule("mix", "mix_shift_exposure", "book", "mixed", severity="warn", layer="distributional"), _psi_over("mixed", "ea", "eb"), None),
    (Rule("new", "new_level", "book", "mixed", severity="warn", layer="distributional"), f"SELECT count(*) FROM {_cur_prev('mixed')} WHERE a > 0 AND b = 0 AND level IS NOT NULL", None),
    (Rule("gone", "vanished_level", "book", "mixed", severity="warn", layer="distributional"),
     f"SELECT count(*) FROM {_cur_prev('mixed')} WHERE a = 0 AND eb >= 0.01 * (SELECT sum(eb) FROM {_cur_prev('mixed')}) AND level IS NOT NULL", None),
    (Rule("nulls", "null_rate_shift", "book", "tax_known", severity="warn", layer="distributional"), "SELECT CASE WHEN abs(avg((tax_known IS NULL)::INT) FILTER (cur) - avg((tax_known IS NULL)::INT) FILTER (NOT cur)) > 0.05 THEN 1 ELSE 0 END FROM two", None),
    (Rule("volume", "volume_shift", "book", severity="warn", layer="distributional"), "SELECT CASE WHEN abs(count(*) FILTER (cur) / count(*) FILTER (NOT cur) - 1) > 0.2 THEN 1 ELSE 0 END FROM two", None),
    (Rule("mean", "mean_shift", "book", "shifted", severity="warn", layer="distributional"),
     "SELECT CASE WHEN abs(avg(shifted) FILTER (cur) - avg(shifted) FILTER (NOT cur)) / (stddev_samp(shifted) FILTER (NOT cur) / sqrt(count(shifted) FILTER (NOT cur))) > 5 THEN 1 ELSE 0 END FROM two", None),
    (Rule("target", "target_rate_shift", "book", severity="warn", layer="distributional"),
     """SELECT (abs(fa/fb-1) > 0.15)::INT + (abs(sa/sb-1) > 0.15)::INT + (abs(ba/bb-1) > 0.15)::INT FROM (SELECT
        sum(claim_count) FILTER (cur)/sum(exposure_years) FILTER (cur) AS fa, sum(claim_count) FILTER (NOT cur)/sum(exposure_years) FILTER (NOT cur) AS fb,
        sum(claim_amount_minor) FILTER (cur)/sum(claim_count) FILTER (cur) AS sa, sum(claim_amount_minor) FILTER (NOT cur)/sum(claim_count) FILTER (NOT cur) AS sb,
        sum(claim_amount_minor) FILTER (cur)/sum(exposure_years) FILTER (cur) AS ba, sum(claim_amount_minor) FILTER (NOT cur)/sum(exposure_years) FILTER (NOT cur) AS bb FROM two)""", None),
    (Rule("cold", "zero_claim_cohort", "book", "cooled", severity="warn", layer="actuarial"),
     """SELECT count(*) FROM (SELECT cooled, sum(claim_count) FILTER (cur) AS a, sum(claim_count) FILTER (NOT cur) AS b, sum(exposure_years) FILTER (cur) AS e FROM two GROUP BY 1)
        WHERE a = 0 AND b > 0 AND e > 0.01 * (SELECT sum(exposure_years) FROM two WHERE cur)""", None),
]

#: What the rules read of the book, and what their columns are made from.
_DRIFT_COLUMNS = ("exposure_years", "claim_count", "claim_amount_minor", "o_orderpriority", "p_type", "l_tax", "l_quantity", "l_linestatus")

_TWO = f"""two AS (SELECT *, start_date >= DATE '{VERSION_CUT}' AS cur,
   CASE WHEN start_date >= DATE '{VERSION_CUT}' THEN replace(o_orderpriority, '1-URGENT', '6-NEW') ELSE o_orderpriority END AS mixed,
   CASE WHEN start_date >= DATE '{VERSION_CUT}' THEN nullif(l_tax, 0) ELSE l_tax END AS tax_known,
   CASE WHEN start_date >= DATE '{VERSION_CUT}' THEN l_quantity + 1 ELSE l_quantity END AS shifted,
   CASE WHEN claim_count = 0 OR start_date < DATE '{VERSION_CUT}' THEN l_linestatus ELSE 'hot' END AS cooled FROM book)"""


@query("validation_against_version", with_sql(BOOK, _TWO) + _report_sql(_DRIFT_RULES))
def validation_against_version(spark, sf):
    cur, prev = versions(spark, sf, "part", keep=_DRIFT_COLUMNS)
    cur = cur.withColumns(
        {
            "mixed": F.replace(F.col("o_orderpriority"), F.lit("1-URGENT"), F.lit("6-NEW")),
            "tax_known": F.nullif(F.col("l_tax"), F.lit(0.0)),
            "shifted": F.col("l_quantity") + 1,
            "cooled": F.when(F.col("claim_count") == 0, F.col("l_linestatus")).otherwise("hot"),
        }
    )
    prev = prev.withColumns(
        {"mixed": F.col("o_orderpriority"), "tax_known": F.col("l_tax"), "shifted": F.col("l_quantity"), "cooled": F.col("l_linestatus")}
    )
    ctx = Context({"book": cur}, reference_frames={"book": prev})
    return val.report_frame(spark, val.run_validation(ctx, [r for r, _, _ in _DRIFT_RULES]))


@query(
    "validation_offending_keys",
    with_sql(BOOK)
    + "SELECT l_orderkey, l_linenumber FROM book WHERE l_tax > l_discount ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 100",
)
def validation_offending_keys(spark, sf):
    rule = _ROW_RULES[6][0]
    ctx = Context({"book": book(spark, sf)})
    return val.offending_sample(ctx, rule, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber")


_GROUP_RULES = [
    # rule, threshold, table, key, predicate of a group
    (Rule("line-key", "unique_key", "book", params={"columns": ["l_orderkey", "l_linenumber"]}), '{"max_violating_rows": 0}', "book", ("l_orderkey", "l_linenumber"), "count(*) > 1", "sum(n - 1)"),
    (Rule("policy-year", "policy_year_exposure", "policy_exposure", params={"key": "policy_id", "start": "exposure_start", "max": 2.4}, severity="warn", layer="actuarial"),
     '{"max": 2.4, "max_violating_rows": 0}', "policy_exposure", ("policy_id", "year(exposure_start)"), "sum(exposure_years) > 2.4", "count(*)"),
    (Rule("frequency-band", "frequency_plausible", "book", params={"by": "p_brand", "min_frequency": 0.64, "max_frequency": 0.67}, severity="warn", layer="actuarial"),
     '{"max_frequency": 0.67, "max_violating_rows": 0, "min_frequency": 0.64}', "book", ("p_brand",), "sum(claim_count) / sum(exposure_years) NOT BETWEEN 0.64 AND 0.67", "count(*)"),
]
_THRESHOLDS = (
    '{"max_violating_rows": 0}', '{"max_violating_rows": 0, "values": ["A", "N"]}', '{"max_violating_rows": 0, "min_exclusive": 0}', '{"max_inclusive": 0.95, "max_violating_rows": 0}',
    '{"integer": true, "max_violating_rows": 0, "min_inclusive": 0}', '{"max_violating_rows": 0}', '{"max_violating_rows": 0}', '{"max_exclusive": 100000, "max_violating_rows": 1000000000}',
)


def _details_sql() -> str:
    parts = [
        f"""SELECT '{r.slug}' AS rule, CASE WHEN count(*) FILTER ({p}) > {r.max_violating_rows} THEN '{r.severity}' ELSE 'pass' END AS outcome, '{t}' AS threshold,
        CAST(count(*) FILTER ({p}) AS BIGINT) AS violating_rows, round(coalesce(sum(exposure_years) FILTER ({p}), 0) / sum(exposure_years), 9) AS exposure_fraction FROM src"""
        for (r, p), t in zip(_ROW_RULES, _THRESHOLDS, strict=True)
    ]
    parts += [
        f"""SELECT '{r.slug}', CASE WHEN coalesce({n}, 0) > 0 THEN '{r.severity}' ELSE 'pass' END, '{t}', CAST(coalesce({n}, 0) AS BIGINT),
        round(coalesce(sum(e), 0) / (SELECT sum(exposure_years) FROM {table}), 9) FROM (SELECT count(*) AS n, sum(exposure_years) AS e FROM {table} GROUP BY {", ".join(keys)} HAVING {bad})"""
        for r, t, table, keys, bad, n in _GROUP_RULES
    ]
    return " UNION ALL ".join(parts)


@query("validation_details", with_sql(BOOK, POLICY_EXPOSURE, "src AS (SELECT *, nullif(c_mktsegment, 'BUILDING') AS segment FROM book)") + _details_sql())
def validation_details(spark, sf):
    """Threshold, affected rows and affected exposure of rules on rows and on groups, from one action."""
    rules = [r for r, _ in _ROW_RULES] + [g[0] for g in _GROUP_RULES]
    found = val.detailed_frame(spark, val.run_validation(Context(_tables(spark, sf)), rules))
    return found.withColumn("exposure_fraction", F.round("exposure_fraction", 9))


_BOOK_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _samples_sql() -> str:
    text = lambda names: " || ',' || ".join(f"'\"{name}\":' || {value}" for name, value in names)
    row = "'{' || " + text([(c, c) for c in _BOOK_KEYS]) + " || '}'"
    parts = [
        f"""SELECT '{r.slug}' AS rule, CAST(row_number() OVER (ORDER BY {", ".join(_BOOK_KEYS)}, key) AS INTEGER) AS place, key FROM (SELECT *, {row} AS key FROM src WHERE {p})"""
        for r, p in (_ROW_RULES[0], _ROW_RULES[6])
    ]
    for r, _, table, keys, bad, _ in _GROUP_RULES:
        shown = "'{' || " + text([(f"k{j}", f"'\"' || {c} || '\"'" if c == "p_brand" else c) for j, c in enumerate(keys)]) + " || '}'"
        parts.append(f"SELECT '{r.slug}', CAST(row_number() OVER (ORDER BY key) AS INTEGER), key FROM (SELECT {shown} AS key FROM {table} GROUP BY {', '.join(keys)} HAVING {bad})")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE place <= 100"


@query("validation_samples", with_sql(BOOK, POLICY_EXPOSURE, "src AS (SELECT *, nullif(c_mktsegment, 'BUILDING') AS segment FROM book)") + _samples_sql())
def validation_samples(spark, sf):
    """Up to 100 offending keys of each rule, smallest first."""
    rules = [_ROW_RULES[0][0], _ROW_RULES[6][0], *[g[0] for g in _GROUP_RULES]]
    return val.offending_samples(Context(_tables(spark, sf)), rules, {"book": _BOOK_KEYS, "policy_exposure": ("period_id",)})
