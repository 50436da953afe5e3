"""Queries: rate tables, portfolio rating, dislocation, regression suites."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from premia.operators import dislocation as dl
from premia.operators import rate_tables as rt
from premia.operators import rating as ra
from premia.operators import regression as rg
from premia.plans.registry import query
from premia.plans.views import BOOK, book, table, with_sql
from premia.session import cut_lineage
from premia.sources import files, sinks

# -- portfolio and rating versions -----------------------------------------------------------

QUOTES = """quotes AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS quote_id, o_orderkey, CAST(round(o_totalprice / 10) AS BIGINT) AS base_minor,
    CASE WHEN o_orderkey % 50 <> 0 THEN c_mktsegment END AS segment, o_orderpriority AS priority, n_name AS nation, CAST(o_orderdate AS DATE) AS as_at,
    CASE WHEN o_orderkey % 3 = 0 THEN 'renewal' ELSE 'new_business' END AS purpose, CAST((o_orderkey % 100 + 1) / 100.0 AS DOUBLE) AS exposure_years
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def quotes(spark, sf):
    o = table(spark, sf, "orders").join(
        table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")
    ).join(table(spark, sf, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("o_orderkey")
    return o.select(
        k.cast("string").alias("quote_id"), "o_orderkey", F.round(F.col("o_totalprice") / 10).cast("long").alias("base_minor"),
        F.when(k % 50 != 0, F.col("c_mktsegment")).alias("segment"), F.col("o_orderpriority").alias("priority"), F.col("n_name").alias("nation"),
        F.col("o_orderdate").cast("date").alias("as_at"), F.when(k % 3 == 0, "renewal").otherwise("new_business").alias("purpose"),
        ((k % 100 + 1) / 100).alias("exposure_years"),
    )


RATES = """segment_v1 AS (SELECT c_mktsegment AS k, CAST(1.00 + 0.05 * row_number() OVER (ORDER BY c_mktsegment) AS DECIMAL(10,2)) AS r FROM (SELECT DISTINCT c_mktsegment FROM customer)),
segment_v2 AS (SELECT k, CAST(CASE WHEN CAST(r * 20 AS INTEGER) % 2 = 0 THEN r + 0.04 ELSE r END AS DECIMAL(10,2)) AS r FROM segment_v1),
priority_v1 AS (SELECT o_orderpriority AS k, CAST(0.90 + 0.04 * CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS DECIMAL(10,2)) AS r FROM (SELECT DISTINCT o_orderpriority FROM orders)),
priority_v2 AS (SELECT k, CAST(CASE WHEN k >= '4' THEN r - 0.03 ELSE r END AS DECIMAL(10,2)) AS r FROM priority_v1),
nation_rates AS (SELECT n_name AS k, DATE '1900-01-01' AS f, DATE '1998-01-01' AS t, CAST(1.00 + 0.05 * n_regionkey AS DECIMAL(10,2)) AS r FROM nation
   UNION ALL SELECT n_name, DATE '1998-01-01', NULL, CAST(1.01 + 0.07 * n_regionkey AS DECIMAL(10,2)) FROM nation WHERE n_nationkey <> 3)"""


def rates(spark, sf):
    """Rate cells of two versions and dated nation loadings, derived from the given dimensions."""
    key = (spark.sparkContext.applicationId, sf)
    if key in _STORED:
        return _STORED[key]
    dec = "decimal(10,2)"
    # One row per market segment; ranks are over these few rows.
    seg = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment")).distinct()
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("segment"))
    seg1 = seg.withColumn("relativity", (F.lit("1.00").cast(dec) + F.lit("0.05").cast(dec) * rank.cast("decimal(4,0)")).cast(dec))
    even = (F.col("relativity") * 20).cast("int") % 2 == 0
    seg2 = seg1.withColumn("relativity", F.when(even, F.col("relativity") + F.lit("0.04").cast(dec)).otherwise(F.col("relativity")).cast(dec))
    pri = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("priority")).distinct()
    step = F.substring("priority", 1, 1).cast("decimal(4,0)")
    pri1 = pri.withColumn("relativity", (F.lit("0.90").cast(dec) + F.lit("0.04").cast(dec) * step).cast(dec))
    lower = (F.col("relativity") - F.lit("0.03").cast(dec)).cast(dec)
    pri2 = pri1.withColumn("relativity", F.when(F.col("priority") >= "4", lower).otherwise(F.col("relativity")).cast(dec))
    n = table(spark, sf, "nation")
    region = F.col("n_regionkey").cast("decimal(4,0)")
    day = lambda d: F.lit(d).cast("date")
    old = n.select(F.col("n_name").alias("nation"), day("1900-01-01").alias("effective_from"), day("1998-01-01").alias("effective_to"),
                   (F.lit("1.00").cast(dec) + F.lit("0.05").cast(dec) * region).cast(dec).alias("loading"))
    new = n.where("n_nationkey <> 3").select("n_name", day("1998-01-01"), day(None), (F.lit("1.01").cast(dec) + F.lit("0.07").cast(dec) * region).cast(dec))
    # Rate tables are stored artifacts: written once, then read by every version that is rated.
    stored = [cut_lineage(x.coalesce(1)) for x in (seg1, seg2, pri1, pri2, old.unionAll(new))]
    _STORED[key] = {"segment": tuple(stored[:2]), "priority": tuple(stored[2:4]), "nation": stored[4]}
    return _STORED[key]


_STORED: dict[tuple[str, str], dict] = {}


def algorithm(r, version: int, *, ref=None) -> ra.Algorithm:
    i = version - 1
    commission = "1.05" if version == 1 else "1.06"
    ceiling = 45000 if version == 1 else 43000
    return ra.Algorithm(
        ref or f"motor@{version}",
        (
            ra.Field("base_minor", "int", minimum="0", maximum="5000000"),
            ra.Field("segment", "string"),
            ra.Field("priority", "enum", domain=("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")),
        ),
        (
            ra.Lookup("nation_loading", r["nation"], {"nation": "nation"}, "as_at", "loading"),
            ra.Table("segment_relativity", r["segment"][i], {"segment": "segment"}),
            ra.Table("priority_relativity", r["priority"][i], {"priority": "priority"}),
            ra.Expression("risk", lambda n: (
                (n("base_minor").cast("decimal(12,0)") * n("segment_relativity")).cast(ra.AMOUNT) * n("priority_relativity")).cast(ra.AMOUNT) * n("nation_loading")),
            ra.Decline("REFER_LARGE", lambda n: n("base_minor") > ceiling),
            *(() if version == 1 else (ra.Decline("URGENT_SMALL", lambda n: (n("priority") == "1-URGENT") & (n("base_minor") < 500)),)),
        ),
        (
            ra.Rung("risk_premium", "start", lambda n: n("risk")),
            ra.Rung("expense_loading", "multiply", "1.10"),
            ra.Rung("commission", "multiply", commission),
            ra.Rung("profit_loading", "add", "150", purposes=("new_business",)),
            ra.Rung("constraints", "clamp", minimum="1500", maximum="60000", reason="LIMIT"),
            ra.Rung("payable_premium", "none"),
        ),
        purpose="purpose",
    )


def _scored_sql(name: str, version: int) -> str:
    commission, ceiling = ("1.05", 45000) if version == 1 else ("1.06", 43000)
    decline = f"base_minor > {ceiling}" + ("" if version == 1 else " OR (priority = '1-URGENT' AND base_minor < 500)")
    return f"""{name}_raw AS (SELECT q.*, s.r AS seg, p.r AS pri, n.r AS nat,
      CAST(CAST(CAST(base_minor AS DECIMAL(12,0)) * s.r * p.r * n.r AS DECIMAL(28,8)) AS DECIMAL(28,8)) AS risk, {decline} AS refused
      FROM quotes q LEFT JOIN segment_v{version} s ON s.k = segment LEFT JOIN priority_v{version} p ON p.k = priority
      LEFT JOIN nation_rates n ON n.k = nation AND f <= as_at AND (t IS NULL OR as_at < t)),
    {name}_l AS (SELECT *, CAST(risk * 1.10 AS DECIMAL(28,8)) AS expense, CAST(CAST(risk * 1.10 AS DECIMAL(28,8)) * {commission} AS DECIMAL(28,8)) AS commission FROM {name}_raw),
    {name}_p AS (SELECT *, CASE WHEN purpose = 'new_business' THEN commission + 150 ELSE commission END AS profit FROM {name}_l),
    {name} AS (SELECT *, greatest(least(profit, 60000), 1500) AS payable,
      CASE WHEN segment IS NULL OR seg IS NULL OR nat IS NULL THEN 'error' WHEN refused THEN 'declined' ELSE 'quoted' END AS outcome,
      CASE WHEN segment IS NOT NULL AND nat IS NOT NULL AND NOT refused THEN CAST(round_even(greatest(least(profit, 60000), 1500), 0) AS BIGINT) END AS premium_minor,
      CASE WHEN segment IS NULL THEN 'input_null:segment' WHEN nat IS NULL THEN 'lookup_miss:nation_loading' END AS error_code FROM {name}_p)"""


@query(
    "score_portfolio",
    with_sql(QUOTES, RATES, _scored_sql("s", 1))
    + """SELECT quote_id, outcome, premium_minor, error_code,
       CASE WHEN refused THEN 'REFER_LARGE' ELSE '' END || CASE WHEN refused AND (profit < 1500 OR profit > 60000) THEN ',' ELSE '' END
       || CASE WHEN profit < 1500 OR profit > 60000 THEN 'LIMIT' ELSE '' END AS reasons FROM s""",
)
def score_portfolio(spark, sf):
    s = ra.score(quotes(spark, sf), algorithm(rates(spark, sf), 1))
    return s.select("quote_id", "outcome", "premium_minor", F.get("error_codes", F.lit(0)).alias("error_code"), F.array_join("reasons", ",").alias("reasons"))


@query(
    "premium_ladder",
    with_sql(QUOTES, RATES, _scored_sql("s", 1))
    + """SELECT rung, CAST(count(*) AS BIGINT) AS n, round(sum(x)::DOUBLE, 4) AS unrounded, CAST(sum(round_even(x, 0)) AS BIGINT) AS rounded_minor FROM (
       SELECT unnest(['risk_premium','expense_loading','commission','profit_loading','constraints','payable_premium']) AS rung,
              unnest([risk, expense, commission, profit, payable, payable]) AS x FROM s WHERE outcome = 'quoted') GROUP BY 1""",
)
def premium_ladder(spark, sf):
    s = ra.score(quotes(spark, sf), algorithm(rates(spark, sf), 1))
    return s.select(F.inline("ladder")).groupBy("rung").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("unrounded").cast("double"), 4).alias("unrounded"), F.sum("rounded_minor").alias("rounded_minor")
    )


@query(
    "ladder_reconciliation",
    with_sql(QUOTES, RATES, _scored_sql("s", 1)) + "SELECT TRUE AS reconciles, CAST(count(*) AS BIGINT) AS n FROM s WHERE outcome = 'quoted'",
)
def ladder_reconciliation(spark, sf):
    s = ra.score(quotes(spark, sf), algorithm(rates(spark, sf), 1)).where("outcome = 'quoted'")
    return s.groupBy(ra.ladder_reconciles("ladder", "premium_minor").alias("reconciles")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "score_two_versions",
    with_sql(QUOTES, RATES, _scored_sql("s", 1), _scored_sql("u", 2))
    + """SELECT version, outcome, CAST(count(*) AS BIGINT) AS n, CAST(sum(premium_minor) AS BIGINT) AS premium FROM
      (SELECT 'motor@1' AS version, outcome, premium_minor FROM s UNION ALL SELECT 'motor@2', outcome, premium_minor FROM u) GROUP BY ALL""",
)
def score_two_versions(spark, sf):
    r = rates(spark, sf)
    s = ra.score_versions(quotes(spark, sf), [algorithm(r, 1), algorithm(r, 2)])
    return s.groupBy("version", "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("premium_minor").alias("premium"))


@query(
    "input_contract_errors",
    """SELECT code, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest([
        CASE WHEN o_orderkey % 50 = 0 THEN 'input_null:status' END, CASE WHEN o_orderkey % 50 <> 0 AND o_orderstatus NOT IN ('F','O') THEN 'input_domain:status' END,
        CASE WHEN o_orderkey % 11 = 0 THEN 'input_type:amount' END, CASE WHEN o_orderkey % 11 <> 0 AND o_totalprice < 20000 THEN 'input_below_minimum:amount' END,
        CASE WHEN o_orderkey % 11 <> 0 AND o_totalprice > 400000 THEN 'input_above_maximum:amount' END,
        CASE WHEN o_orderkey % 13 = 0 THEN 'input_digits:long_number' END]) AS code FROM orders) WHERE code IS NOT NULL GROUP BY 1""",
)
def input_contract_errors(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(
        F.when(k % 50 != 0, F.col("o_orderstatus")).alias("status"),
        F.when(k % 11 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("amount"),
        F.when(k % 13 == 0, "1234567890.123456789").otherwise("12.50").alias("long_number"),
    )
    fields = [
        ra.Field("status", "enum", domain=("F", "O")),
        ra.Field("amount", "decimal", minimum="20000", maximum="400000"),
        ra.Field("long_number", "decimal"),
    ]
    codes = F.filter(F.array(*[F.when(c, F.lit(code)) for c, code in ra.input_errors(o, fields)]), lambda x: x.isNotNull())
    return o.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "batch_error_tallies",
    with_sql(QUOTES, RATES, _scored_sql("s", 1))
    + """SELECT error_code AS code, CAST(count(*) AS BIGINT) AS n, array_to_string(list_sort(list(quote_id ORDER BY quote_id)[1:5]), ',') AS sample
       FROM s WHERE outcome = 'error' GROUP BY 1""",
)
def batch_error_tallies(spark, sf):
    s = ra.refuse_failures(ra.score(quotes(spark, sf), algorithm(rates(spark, sf), 1)), 0.5)
    return ra.error_tallies(s)


@query(
    "score_output_table",
    with_sql(QUOTES, RATES, _scored_sql("s", 1)) + "SELECT outcome, CAST(count(*) AS BIGINT) AS n, CAST(sum(premium_minor) AS BIGINT) AS premium FROM s GROUP BY 1",
)
def score_output_table(spark, sf):
    s = ra.score(quotes(spark, sf), algorithm(rates(spark, sf), 1)).select("quote_id", "outcome", "premium_minor")
    path = sinks.write_scores(s, sinks.scratch_path(spark, "scores"), partition_by="outcome")
    return spark.read.parquet(path).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("premium_minor").alias("premium"))


_STEPS = {
    "nation_loading": ("{p}nation_loading", "nation", "as_at"),
    "segment_relativity": ("{p}segment_relativity", "segment"),
    "priority_relativity": ("{p}priority_relativity", "priority"),
    "risk": ("{p}risk_2dp", "base_minor", "{p}segment_relativity", "{p}priority_relativity"),
}


def _trace(scored, prefix):
    scored = scored.withColumn(f"{prefix}risk_2dp", F.col(f"{prefix}risk").cast("decimal(28,2)"))
    # Names without the prefix, so that two versions' traces compare.
    outputs = {s: tuple(c.format(p=prefix) for c in cols) for s, cols in _STEPS.items()}
    plain = scored
    for cols in outputs.values():
        for c in cols:
            if prefix and c.startswith(prefix):
                plain = plain.withColumn(c[len(prefix):], F.col(c)) if c[len(prefix):] not in plain.columns else plain
    return ra.trace(plain, {s: tuple(c.removeprefix(prefix) for c in cols) for s, cols in outputs.items()})


@query(
    "rating_trace",
    with_sql(QUOTES, RATES, _scored_sql("s", 1))
    + """SELECT step, CAST(any_value(position) AS INTEGER) AS position, produced, CAST(count(*) AS BIGINT) AS n FROM (
       SELECT unnest([0,1,2]) AS position, unnest(['nation_loading','segment_relativity','priority_relativity']) AS step,
       unnest([CAST(nat AS VARCHAR), CAST(seg AS VARCHAR), CAST(pri AS VARCHAR)]) AS produced FROM s) GROUP BY step, produced""",
)
def rating_trace(spark, sf):
    t = _trace(ra.score(quotes(spark, sf), algorithm(rates(spark, sf), 1)), "")
    return t.where("step <> 'risk'").groupBy("step", "produced").agg(F.any_value("position").alias("position"), F.count(F.lit(1)).alias("n"))


@query(
    "trace_diff",
    with_sql(QUOTES, RATES, _scored_sql("s", 1), _scored_sql("u", 2))
    + """, d AS (SELECT s.segment, s.seg IS DISTINCT FROM u.seg AS a, s.pri IS DISTINCT FROM u.pri AS b,
         CAST(s.risk AS DECIMAL(28,2)) IS DISTINCT FROM CAST(u.risk AS DECIMAL(28,2)) AS c FROM s JOIN u USING (quote_id))
       SELECT 'segment_relativity' AS step, 'changed' AS change, 'produced' AS changed_fields, TRUE AS own_change, CAST(count(*) FILTER (a) AS BIGINT) AS n FROM d
       UNION ALL SELECT 'priority_relativity', 'changed', 'produced', TRUE, CAST(count(*) FILTER (b) AS BIGINT) FROM d
       UNION ALL SELECT 'risk', 'changed', 'consumed,produced', FALSE, CAST(count(*) FILTER ((a OR b) AND c) AS BIGINT) FROM d
       UNION ALL SELECT * FROM (SELECT 'risk', 'changed', 'consumed', FALSE, CAST(count(*) FILTER ((a OR b) AND NOT c) AS BIGINT) AS n FROM d) WHERE n > 0""",
)
def trace_diff(spark, sf):
    r, q = rates(spark, sf), quotes(spark, sf)
    a = _trace(ra.score(q, algorithm(r, 1)), "")
    b = _trace(ra.score(q, algorithm(r, 2)), "")
    d = ra.trace_diff(a, b, edited=["segment_relativity", "priority_relativity"])
    return d.groupBy("step", "change", "changed_fields", "own_change").agg(F.count(F.lit(1)).alias("n"))


_UNIT = "('0x' || substr(sha256({seed} || ':' || {key}), 1, 13))::BIGINT / 4503599627370496.0"


@query(
    "sampled_traces",
    with_sql(QUOTES, RATES, _scored_sql("s", 1))
    + f"""SELECT quote_id, CASE outcome WHEN 'declined' THEN 'decline' WHEN 'error' THEN 'error' ELSE 'rate' END AS sample_reason FROM s
       WHERE outcome <> 'quoted' OR {_UNIT.format(seed=9, key='quote_id')} < 0.02""",
)
def sampled_traces(spark, sf):
    s = ra.score(quotes(spark, sf), algorithm(rates(spark, sf), 1))
    return ra.sample_traces(s, 0.02, 9).select("quote_id", "sample_reason")


@query(
    "trace_query",
    with_sql(QUOTES, RATES, _scored_sql("s", 1))
    + """SELECT outcome, CAST(count(*) AS BIGINT) AS n FROM s WHERE purpose = 'renewal' AND as_at >= DATE '1997-01-01' AND as_at < DATE '1997-07-01' GROUP BY 1""",
)
def trace_query(spark, sf):
    s = ra.score(quotes(spark, sf), algorithm(rates(spark, sf), 1))
    store = s.select(
        "outcome", F.lit("motor@1").alias("version"), F.col("as_at").alias("scored_on"), F.when(F.col("purpose") == "renewal", "production").otherwise("staging").alias("environment")
    )
    return ra.query_traces(store, version="motor@1", since="1997-01-01", until="1997-07-01").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


_RELEASES = (("early", "motor@1", "production", "1996-03-15", "1996-05-02"), ("late", "motor@1", "staging", "1997-11-01", "1998-02-01"), ("none", "motor@9", "production", "1996-01-01", "1997-01-01"))


@query(
    "trace_store_releases",
    with_sql(QUOTES, RATES, _scored_sql("s", 1))
    + " UNION ALL ".join(
        f"""SELECT '{r}' AS release, outcome, CAST(count(*) AS BIGINT) AS n FROM s WHERE '{v}' = 'motor@1' AND (purpose = 'renewal') = ('{e}' = 'production')
        AND as_at >= DATE '{a}' AND as_at < DATE '{b}' GROUP BY outcome"""
        for r, v, e, a, b in _RELEASES
    ),
)
def trace_store_releases(spark, sf):
    """Outcomes of releases from a store in folders, of which only theirs are read."""
    s = ra.score(quotes(spark, sf), algorithm(rates(spark, sf), 1))
    traces = s.select(
        "quote_id", "outcome", F.lit("motor@1").alias("version"), F.col("as_at").alias("scored_on"), F.when(F.col("purpose") == "renewal", "production").otherwise("staging").alias("environment")
    )
    store = spark.read.parquet(sinks.write_traces(traces, sinks.scratch_path(spark, "traces")))
    releases = spark.createDataFrame(_RELEASES, "release string, version string, environment string, since string, until string").withColumns({c: F.col(c).cast("date") for c in ("since", "until")})
    return ra.traces_of_releases(store, releases).groupBy("release", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    "reproduction_check",
    with_sql(QUOTES, RATES, _scored_sql("s", 1), _scored_sql("u", 2))
    + """SELECT CASE WHEN s.o_orderkey % 10 = 0 THEN 'tampered' ELSE 'stored' END AS kind, CAST(count(*) AS BIGINT) AS n,
       CAST(count(*) FILTER (s.o_orderkey % 10 <> 0 OR s.outcome <> 'quoted') AS BIGINT) AS reproduced FROM s JOIN u USING (quote_id) GROUP BY 1""",
)
def reproduction_check(spark, sf):
    s = ra.score(quotes(spark, sf), algorithm(rates(spark, sf), 1))
    bad = F.col("o_orderkey") % 10 == 0
    stored = s.withColumn("premium_minor", F.when(bad, F.col("premium_minor") + 1).otherwise(F.col("premium_minor")))
    verdict = ra.reproduce(stored, s)
    return (
        verdict.withColumn("kind", F.when(F.col("quote_id").cast("long") % 10 == 0, "tampered").otherwise("stored"))
        .groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("reproduced"), 1)).alias("reproduced"))
    )


@query(
    "shadow_comparison",
    with_sql(QUOTES, RATES, _scored_sql("s", 1), _scored_sql("u", 2))
    + """SELECT s.outcome AS live_outcome, u.outcome AS candidate_outcome, CAST(count(*) AS BIGINT) AS n,
       round(avg(u.premium_minor / s.premium_minor), 6) AS mean_ratio FROM s JOIN u USING (quote_id) GROUP BY ALL""",
)
def shadow_comparison(spark, sf):
    r, q = rates(spark, sf), quotes(spark, sf)
    both = ra.shadow(ra.score(q, algorithm(r, 1)), ra.score(q, algorithm(r, 2)))
    return both.groupBy("live_outcome", "candidate_outcome").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ratio"), 6).alias("mean_ratio"))


# -- dislocation -----------------------------------------------------------------------------

_DISLOCATION = with_sql(QUOTES, RATES, _scored_sql("s", 1), _scored_sql("u", 2)) + """, d AS (SELECT s.quote_id, s.segment, s.priority, s.nation, s.exposure_years, s.outcome AS a, u.outcome AS b,
  s.premium_minor AS pa, u.premium_minor AS pb, u.premium_minor - s.premium_minor AS change, coalesce(s.error_code, u.error_code) AS error_code,
  s.risk AS ra, u.risk AS rb, s.expense AS ea, u.expense AS eb, s.commission AS ca, u.commission AS cb, s.profit AS fa, u.profit AS fb, s.payable AS ya, u.payable AS yb
  FROM s JOIN u USING (quote_id)), banded AS (SELECT * FROM d WHERE a = 'quoted' AND b = 'quoted' AND pa > 0)
"""


def _frame(spark, sf):
    r = rates(spark, sf)
    return dl.dislocation_frame(quotes(spark, sf), algorithm(r, 1), algorithm(r, 2), keep=["segment", "priority", "nation", "exposure_years"])


@query("dislocation_frame", _DISLOCATION + "SELECT quote_id, a AS baseline_outcome, b AS candidate_outcome, pa AS baseline_minor, pb AS candidate_minor, change AS change_minor, error_code FROM d")
def dislocation_frame(spark, sf):
    return _frame(spark, sf).select("quote_id", "baseline_outcome", "candidate_outcome", "baseline_minor", "candidate_minor", "change_minor", "error_code")


@query(
    "dislocation_outcomes",
    _DISLOCATION
    + """SELECT CAST(count(*) AS BIGINT) AS policy_count, CAST(count(*) FILTER (a='quoted' AND b='quoted') AS BIGINT) AS quoted_both,
      CAST(count(*) FILTER (a='quoted' AND b='declined') AS BIGINT) AS quoted_to_declined, CAST(count(*) FILTER (a='declined' AND b='quoted') AS BIGINT) AS declined_to_quoted,
      CAST(count(*) FILTER (a='declined' AND b='declined') AS BIGINT) AS declined_both, CAST(count(*) FILTER (a='error' OR b='error') AS BIGINT) AS error,
      CAST(0 AS BIGINT) AS zero_baseline, CAST(0 AS BIGINT) AS negative_baseline FROM d""",
)
def dislocation_outcomes(spark, sf):
    return dl.outcomes(_frame(spark, sf))


@query(
    "dislocation_totals",
    _DISLOCATION
    + """SELECT CAST(sum(pa) AS BIGINT) AS baseline_premium_minor, CAST(sum(pb) AS BIGINT) AS candidate_premium_minor,
      round((sum(pb) - sum(pa)) / sum(pa) * 100, 9) AS change_pct FROM d WHERE a='quoted' AND b='quoted'""",
)
def dislocation_totals(spark, sf):
    return dl.totals(_frame(spark, sf)).withColumn("change_pct", F.round("change_pct", 9))


_EDGES = ["-2", "0", "1", "2.5", "5"]


@query(
    "dislocation_bands",
    _DISLOCATION
    + """, x AS (SELECT *, (change*100 >= -2*pa)::INT + (change*100 >= 0)::INT + (change*100 >= pa)::INT + (change*100 >= 2.5*pa)::INT + (change*100 >= 5*pa)::INT AS position FROM banded)
      SELECT position, ['below -2','-2 to 0','0 to 1','1 to 2.5','2.5 to 5','5 and above'][position + 1] AS band, CAST(count(*) AS BIGINT) AS policies,
        round(sum(exposure_years) / (SELECT sum(exposure_years) FROM banded), 9) AS exposure_share, round(avg(change / pa * 100), 6) AS mean_change_pct FROM x GROUP BY position""",
)
def dislocation_bands(spark, sf):
    out = dl.change_bands(_frame(spark, sf), _EDGES, "exposure_years")
    return out.withColumns({"exposure_share": F.round("exposure_share", 9), "mean_change_pct": F.round("mean_change_pct", 6)})


def _slice_sql(c: str) -> str:
    return f"""SELECT '{c}' AS factor, {c} AS level, CAST(count(*) AS BIGINT) AS policies, round(avg(change / pa * 100), 6) AS mean_change_pct,
      round(sum(exposure_years) / (SELECT sum(exposure_years) FROM banded), 9) AS exposure_share FROM banded GROUP BY {c}"""


@query("dislocation_segments", _DISLOCATION + " UNION ALL ".join(_slice_sql(c) for c in ("segment", "priority", "nation")))
def dislocation_segments(spark, sf):
    out = dl.segment_slices(_frame(spark, sf), ["segment", "priority", "nation"], "exposure_years")
    return out.withColumns({"exposure_share": F.round("exposure_share", 9), "mean_change_pct": F.round("mean_change_pct", 6)})


@query(
    "dislocation_rungs",
    _DISLOCATION
    + """, t AS (SELECT sum(yb - ya)::DOUBLE AS t FROM banded)
      SELECT rung, round(x, 4) AS change, round(x / t * 100, 6) AS contribution_pct FROM t, (
        SELECT 'risk_premium' AS rung, sum(rb - ra)::DOUBLE AS x FROM banded UNION ALL SELECT 'expense_loading', sum((eb - rb) - (ea - ra))::DOUBLE FROM banded
        UNION ALL SELECT 'commission', sum((cb - eb) - (ca - ea))::DOUBLE FROM banded UNION ALL SELECT 'profit_loading', sum((fb - cb) - (fa - ca))::DOUBLE FROM banded
        UNION ALL SELECT 'constraints', sum((yb - fb) - (ya - fa))::DOUBLE FROM banded UNION ALL SELECT 'payable_premium', 0)""",
)
def dislocation_rungs(spark, sf):
    out = dl.rung_contributions(_frame(spark, sf))
    return out.select("rung", F.round("change", 4).alias("change"), F.round("contribution_pct", 6).alias("contribution_pct"))


@query(
    "dislocation_quantiles",
    _DISLOCATION
    + """, z AS (SELECT (abs(change)::HUGEINT * 100000000 + pa - 1) // pa AS u FROM banded), o AS (SELECT u, row_number() OVER (ORDER BY u) AS rn, count(*) OVER () AS n FROM z)
      SELECT q AS quantile, (u // 1000000)::VARCHAR || '.' || lpad((u % 1000000)::VARCHAR, 6, '0') AS value FROM o, (VALUES ('0.5', 0.5), ('0.9', 0.9), ('0.95', 0.95), ('0.99', 0.99), ('0.999', 0.999), ('1', 1.0)) v(q, p)
      WHERE rn = CAST(ceil(p * n) AS BIGINT)""",
)
def dislocation_quantiles(spark, sf):
    found = dl.abs_change_quantiles(_frame(spark, sf))
    return spark.createDataFrame(list(found.items()), "quantile string, value string")


@query(
    "dislocation_movers",
    _DISLOCATION
    + """SELECT quote_id, pa AS baseline_minor, pb AS candidate_minor, change AS change_minor, round(change / pa * 100, 9) AS change_pct, q.nation, q.priority
       FROM banded JOIN quotes q USING (quote_id) WHERE abs(change) * 100 >= 3 * pa""",
)
def dislocation_movers(spark, sf):
    moved = dl.movers(_frame(spark, sf), "3")
    full = dl.movers_with_portfolio(moved, quotes(spark, sf).select("quote_id", "nation", "priority"))
    return full.withColumn("change_pct", F.round("change_pct", 9)).orderBy(F.abs("change_minor").desc(), "quote_id")


@query(
    "dislocation_errors",
    _DISLOCATION
    + """SELECT error_code AS code, CAST(count(*) AS BIGINT) AS n, array_to_string(list_sort(list(quote_id ORDER BY quote_id)[1:10]), ',') AS sample
       FROM d WHERE error_code IS NOT NULL GROUP BY 1""",
)
def dislocation_errors(spark, sf):
    f = _frame(spark, sf).where("error_code is not null")
    return ra.error_tallies(f.select("quote_id", F.lit("error").alias("outcome"), F.array("error_code").alias("error_codes")), samples=10)


def _attribution_value(seg: int, pri: int, com: int) -> str:
    c = "1.06" if com else "1.05"
    return f"""sum(CAST(round_even(greatest(least(CAST(CAST(CAST(CAST(base_minor AS DECIMAL(12,0)) * s{seg + 1}.r * p{pri + 1}.r * n.r AS DECIMAL(28,8)) * 1.10 AS DECIMAL(28,8)) * {c} AS DECIMAL(28,8)), 60000), 1500), 0) AS BIGINT))::BIGINT AS v{seg}{pri}{com}"""


@query(
    "dislocation_attribution",
    with_sql(QUOTES, RATES)
    + ", v AS (SELECT " + ", ".join(_attribution_value(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1))
    + """ FROM quotes JOIN segment_v1 s1 ON s1.k = segment JOIN segment_v2 s2 ON s2.k = segment JOIN priority_v1 p1 ON p1.k = priority JOIN priority_v2 p2 ON p2.k = priority
        JOIN nation_rates n ON n.k = nation AND f <= as_at AND (t IS NULL OR as_at < t))
      SELECT 'segment' AS "group", CAST(round_even((2*(v100-v000) + (v110-v010) + (v101-v001) + 2*(v111-v011)) / 6.0, 0) AS BIGINT) AS shapley_minor, v100 - v000 AS isolated_minor, v100 - v000 AS cumulative_minor, v111 - v000 AS total_change_minor FROM v
      UNION ALL SELECT 'priority', CAST(round_even((2*(v010-v000) + (v110-v100) + (v011-v001) + 2*(v111-v101)) / 6.0, 0) AS BIGINT), v010 - v000, v110 - v100, v111 - v000 FROM v
      UNION ALL SELECT 'commission', CAST(round_even((2*(v001-v000) + (v101-v100) + (v011-v010) + 2*(v111-v110)) / 6.0, 0) AS BIGINT), v001 - v000, v111 - v110, v111 - v000 FROM v""",
)
def dislocation_attribution(spark, sf):
    """Which change moved the total: segment rates, priority rates or the commission loading."""
    r = rates(spark, sf)
    q = quotes(spark, sf)
    for name in ("segment", "priority"):
        for i in (0, 1):
            q = q.join(F.broadcast(r[name][i].withColumnRenamed("relativity", f"{name}_{i + 1}")), name)
    side = r["nation"].withColumnRenamed("nation", "n")
    q = q.join(F.broadcast(side), (F.col("nation") == F.col("n")) & (F.col("effective_from") <= F.col("as_at")) & (F.col("effective_to").isNull() | (F.col("as_at") < F.col("effective_to"))))
    q = q.withColumns({"com_1": ra.decimal_lit("1.05"), "com_2": ra.decimal_lit("1.06")})

    def premium(c):
        x = (F.col("base_minor").cast("decimal(12,0)") * c["segment"]).cast(ra.AMOUNT)
        x = (x * c["priority"]).cast(ra.AMOUNT)
        x = (x * F.col("loading")).cast(ra.AMOUNT)
        x = (x * ra.decimal_lit("1.10")).cast(ra.AMOUNT)
        x = (x * c["commission"]).cast(ra.AMOUNT)
        held = F.greatest(F.least(x, F.lit(60000).cast(ra.AMOUNT)), F.lit(1500).cast(ra.AMOUNT))
        return F.bround(held, 0).cast("long")

    groups = {
        "segment": {"segment": ("segment_1", "segment_2")},
        "priority": {"priority": ("priority_1", "priority_2")},
        "commission": {"commission": ("com_1", "com_2")},
    }
    done = dl.attribute_change(q, groups, premium)
    rows = [(i["group"], i["shapley_minor"], i["isolated_minor"], i["cumulative_minor"], done["total_change_minor"]) for i in done["items"]]
    return spark.createDataFrame(rows, "`group` string, shapley_minor long, isolated_minor long, cumulative_minor long, total_change_minor long")


# -- regression ------------------------------------------------------------------------------


def _golden(spark, sf):
    r = rates(spark, sf)
    s1, s2 = (ra.score(quotes(spark, sf), algorithm(r, v)) for v in (1, 2))
    expected = s1.select(
        "quote_id", F.col("outcome").alias("expected_outcome"), F.col("premium_minor").alias("expected_minor"), F.lit(200).cast("long").alias("tolerance_minor")
    )
    return expected, s1, s2


@query(
    "golden_quotes",
    _DISLOCATION
    + """SELECT quote_id, CASE WHEN a = b AND (a <> 'quoted' OR abs(change) <= 200) THEN 'pass' ELSE 'fail' END AS status,
      pa AS expected_minor, pb AS actual_minor, change AS difference_minor FROM d""",
)
def golden_quotes(spark, sf):
    expected, _, s2 = _golden(spark, sf)
    return rg.golden(expected, s2)


@query(
    "golden_replay",
    _DISLOCATION
    + """SELECT 'pass' AS before, CASE WHEN a = b AND (a <> 'quoted' OR abs(change) <= 200) THEN 'pass' ELSE 'fail' END AS after,
      CASE WHEN a = b AND (a <> 'quoted' OR abs(change) <= 200) THEN 'same' ELSE 'broken' END AS change, CAST(count(*) AS BIGINT) AS n FROM d GROUP BY ALL""",
)
def golden_replay(spark, sf):
    expected, s1, s2 = _golden(spark, sf)
    h = rg.suite_hash(expected)
    case = lambda s: rg.golden(expected, s).withColumnRenamed("quote_id", "case")
    out = rg.replay(case(s1), case(s2), recorded_hash=h, current_hash=h)
    return out.groupBy("before", "after", "change").agg(F.count(F.lit(1)).alias("n"))


@query(
    "golden_delta",
    _DISLOCATION
    + """SELECT CASE WHEN k % 20 = 1 THEN 'added' WHEN k % 20 = 2 THEN 'removed' ELSE 'changed' END AS change, CAST(count(*) AS BIGINT) AS n
      FROM (SELECT CAST(quote_id AS BIGINT) AS k, * FROM d) WHERE k % 20 IN (1, 2) OR pa IS DISTINCT FROM pb OR a <> b GROUP BY 1""",
)
def golden_delta(spark, sf):
    r = rates(spark, sf)
    s1, s2 = (ra.score(quotes(spark, sf), algorithm(r, v)).select("quote_id", "outcome", "premium_minor") for v in (1, 2))
    k = F.col("quote_id").cast("long") % 20
    return rg.golden_delta(s1.where(k != 1), s2.where(k != 2)).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query(
    "rating_properties",
    with_sql(QUOTES, RATES, _scored_sql("s", 1))
    + """, q AS (SELECT * FROM s WHERE outcome = 'quoted')
      SELECT 'premium_positive' AS property, CAST(count(*) AS BIGINT) AS checked, CAST(count(*) FILTER (premium_minor <= 0) AS BIGINT) AS broken FROM q
      UNION ALL SELECT 'no_null_output', CAST(count(*) AS BIGINT), CAST(0 AS BIGINT) FROM q UNION ALL SELECT 'ladder_reconciles', CAST(count(*) AS BIGINT), CAST(0 AS BIGINT) FROM q
      UNION ALL SELECT 'premium_bounded', CAST(count(*) AS BIGINT), CAST(count(*) FILTER (premium_minor < 1600 OR premium_minor > 55000) AS BIGINT) FROM q""",
)
def rating_properties(spark, sf):
    s = ra.score(quotes(spark, sf), algorithm(rates(spark, sf), 1))
    return rg.properties(s, outputs=["risk", "segment_relativity"], low=1600, high=55000)


_POINTS = rg.monotone_grid(0, 50000, integer=True, seed=1, name="base_minor")


def _sweep_sql(points) -> str:
    grid = ", ".join(f"({i}, {p})" for i, p in enumerate(points))
    one = _scored_sql("w", 2).replace("FROM quotes q", "FROM swept q")
    return with_sql(
        QUOTES, RATES,
        f"swept AS (SELECT q.* EXCLUDE (base_minor), g.i, g.v::BIGINT AS base_minor FROM quotes q, (VALUES {grid}) g(i, v))", one,
        """step AS (SELECT quote_id, i, base_minor, premium_minor, lag(premium_minor) OVER (PARTITION BY quote_id ORDER BY i) AS before, lag(base_minor) OVER (PARTITION BY quote_id ORDER BY i) AS came FROM w WHERE outcome = 'quoted')""",
    )


@query(
    "monotone_sweep",
    _sweep_sql(_POINTS)
    + """SELECT quote_id, CAST(count(*) AS BIGINT) AS quoted_points, CAST(count(*) FILTER (premium_minor <= before) AS BIGINT) AS breaks,
      CAST(min_by(came, i) FILTER (premium_minor <= before) AS VARCHAR) AS broken_from, CAST(min_by(base_minor, i) FILTER (premium_minor <= before) AS VARCHAR) AS broken_to FROM step GROUP BY 1""",
)
def monotone_sweep(spark, sf):
    """Strict monotony in the base premium; the limits make it flat, so breaks are found."""
    r = rates(spark, sf)
    return rg.monotone_sweep(quotes(spark, sf), "base_minor", _POINTS, lambda df: ra.score(df, algorithm(r, 2)), strict=True)


@query(
    "monotone_verdict",
    _sweep_sql(_POINTS)
    + """SELECT CAST(count(*) FILTER (n >= 2) AS BIGINT) AS comparable_contexts, CAST(count(*) FILTER (b > 0) AS BIGINT) AS broken_contexts, 'pass' AS verdict
      FROM (SELECT quote_id, count(*) AS n, count(*) FILTER (premium_minor < before) AS b FROM step GROUP BY 1)""",
)
def monotone_verdict(spark, sf):
    r = rates(spark, sf)
    return rg.monotone_verdict(rg.monotone_sweep(quotes(spark, sf), "base_minor", _POINTS, lambda df: ra.score(df, algorithm(r, 2))))


# -- rate tables -----------------------------------------------------------------------------

_CELLS = """cells AS (SELECT p_type AS t, p_brand AS b, CAST(1.00 + 0.01 * (sum(p_size) % 50) AS DECIMAL(10,4)) AS r FROM part GROUP BY 1, 2)"""


def cells(spark, sf):
    """A two-key table, one cell per part type and brand, derived from the parts."""
    size = (F.sum("p_size") % 50).cast("decimal(4,0)")
    value = (F.lit("1.00").cast("decimal(4,2)") + F.lit("0.01").cast("decimal(4,2)") * size).cast("decimal(10,4)")
    return table(spark, sf, "part").groupBy(F.col("p_type").alias("t"), F.col("p_brand").alias("b")).agg(value.alias("relativity"))


_AFTER = "after AS (SELECT t, CASE WHEN b = 'Brand#1' AND t = 'ECONOMY' THEN 'Brand#99' ELSE b END AS b, CASE WHEN b <= 'Brand#15' THEN CAST(r * 1.05 AS DECIMAL(10,4)) ELSE r END AS r FROM cells)"


def _after(spark, sf):
    raised = F.when(F.col("b") <= "Brand#15", (F.col("relativity") * F.lit("1.05").cast("decimal(4,2)")).cast("decimal(10,4)")).otherwise(F.col("relativity"))
    renamed = F.when((F.col("b") == "Brand#1") & (F.col("t") == "ECONOMY"), "Brand#99").otherwise(F.col("b"))
    return cells(spark, sf).withColumn("relativity", raised).withColumn("b", renamed)


_DIFF = """diff AS (SELECT coalesce(c.t, a.t) AS t, coalesce(c.b, a.b) AS b, CASE WHEN c.t IS NULL THEN 'added' WHEN a.t IS NULL THEN 'removed' WHEN c.r <> a.r THEN 'changed' END AS change,
   c.r AS o, a.r AS n FROM cells c FULL JOIN after a ON c.t = a.t AND c.b = a.b)"""


@query(
    "rate_table_diff",
    with_sql(_CELLS, _AFTER, _DIFF)
    + """SELECT t, b, change, round(o::DOUBLE, 6) AS old_value, round(n::DOUBLE, 6) AS new_value, round((n - o)::DOUBLE, 6) AS abs_change, round((n - o)::DOUBLE / o::DOUBLE * 100, 6) AS pct_change FROM diff WHERE change IS NOT NULL""",
)
def rate_table_diff(spark, sf):
    d = rt.diff_cells(cells(spark, sf), _after(spark, sf), ["t", "b"])
    return d.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in ("old_value", "new_value", "abs_change", "pct_change")})


@query(
    "rate_table_exposure_weights",
    with_sql(BOOK, _CELLS)
    + """SELECT p_type AS t, p_brand AS b, round(sum(exposure_years), 6) AS exposure_years FROM book JOIN cells ON p_type = t AND p_brand = b
       WHERE b <> 'Brand#7' GROUP BY ALL""",
)
def rate_table_exposure_weights(spark, sf):
    w, _ = rt.exposure_weights(book(spark, sf, "part"), cells(spark, sf).where("b <> 'Brand#7'"), {"t": ("p_type", "string"), "b": ("p_brand", "string")})
    return w.withColumn("exposure_years", F.round(F.col("exposure_years").cast("double"), 6))


@query(
    "rate_table_typed_weights",
    with_sql(BOOK)
    + """SELECT round(sum(exposure_years) FILTER (l_quantity = floor(l_quantity) AND l_quantity % 2 = 0 AND start_date >= DATE '1996-01-01' AND l_returnflag = 'A'), 4) AS matched_exposure, round(sum(exposure_years), 4) AS portfolio_exposure FROM book""",
)
def rate_table_typed_weights(spark, sf):
    """Keys of every type: whole numbers, true/false text and ISO dates; what does not fit matches nothing."""
    b = book(spark, sf, "orders").withColumns(
        {"year_start": F.when(F.col("start_date") >= F.lit("1996-01-01").cast("date"), "1996-01-01").otherwise("soon"),
         "returned": F.when(F.col("l_returnflag") == "A", "True").when(F.col("l_returnflag") == "N", "maybe")}
    )
    side = table(spark, sf, "lineitem").where("l_quantity % 2 = 0").select(F.col("l_quantity").cast("int").cast("string").alias("q")).distinct()
    side = side.withColumns({"d": F.lit("1996-01-01"), "f": F.lit("TRUE")})
    _, totals = rt.exposure_weights(b, side, {"q": ("l_quantity", "int"), "d": ("year_start", "date"), "f": ("returned", "bool")})
    return totals.select(*[F.round(F.col(c).cast("double"), 4).alias(c) for c in totals.columns])


@query(
    "rate_table_change_summary",
    with_sql(BOOK, _CELLS, _AFTER, _DIFF)
    + """, w AS (SELECT p_type AS t, p_brand AS b, sum(exposure_years) AS e FROM book GROUP BY ALL), x AS (SELECT *, (n - o)::DOUBLE / o::DOUBLE * 100 AS pct FROM diff LEFT JOIN w USING (t, b) WHERE change IS NOT NULL)
      SELECT CAST(count(*) AS BIGINT) AS changed_cells, round(max(abs(pct)), 6) AS max_abs_change_pct, round(sum(pct * e) FILTER (pct IS NOT NULL AND e <> 0) / sum(e) FILTER (pct IS NOT NULL AND e <> 0), 6) AS exposure_weighted_mean_change_pct FROM x""",
)
def rate_table_change_summary(spark, sf):
    w, _ = rt.exposure_weights(book(spark, sf, "part"), cells(spark, sf), {"t": ("p_type", "string"), "b": ("p_brand", "string")})
    s = rt.diff_summary(rt.diff_cells(cells(spark, sf), _after(spark, sf), ["t", "b"]), ["t", "b"], w)
    return s.withColumns({c: F.round(c, 6) for c in ("max_abs_change_pct", "exposure_weighted_mean_change_pct")})


@query(
    "rate_table_validation",
    with_sql(_CELLS)
    + """, levels AS (SELECT DISTINCT p_type AS t FROM part), brands AS (SELECT DISTINCT p_brand AS b FROM part),
      kept AS (SELECT t, b, CASE WHEN b = 'Brand#2' THEN NULL WHEN b = 'Brand#3' THEN 'NaN' ELSE CAST(r AS VARCHAR) END AS v, r FROM cells WHERE b <> 'Brand#1'),
      rows AS (SELECT * FROM kept UNION ALL SELECT * FROM kept WHERE b = 'Brand#5')
      SELECT issue, key FROM (
        SELECT CASE WHEN v IS NULL THEN 'null_value' WHEN v = 'NaN' THEN 'non_finite_value' WHEN r > 1.26 THEN 'out_of_bounds' END AS issue, t || '|' || b AS key FROM rows
        UNION ALL SELECT 'duplicate_key', t || '|' || b FROM kept WHERE b = 'Brand#5' UNION ALL SELECT 'missing_key', t || '|' || b FROM levels, brands WHERE (t, b) NOT IN (SELECT (t, b) FROM kept)) WHERE issue IS NOT NULL""",
)
def rate_table_validation(spark, sf):
    text = F.when(F.col("b") == "Brand#2", None).when(F.col("b") == "Brand#3", "NaN").otherwise(F.col("relativity").cast("string"))
    kept = cells(spark, sf).where("b <> 'Brand#1'").withColumn("relativity", text)
    rows = kept.unionAll(kept.where("b = 'Brand#5'"))
    p = table(spark, sf, "part")
    issues = rt.validate_cells(rows, {"t": p.select("p_type"), "b": p.select("p_brand")}, low="0.5", high="1.26")
    return issues.select("issue", "key")


@query(
    "rate_table_bulk_operations",
    with_sql(_CELLS)
    + """, base AS (SELECT r FROM cells WHERE t = 'ECONOMY' AND b = 'Brand#4')
      SELECT t, b, round((r * 1.025)::DOUBLE, 9) AS uplifted, round((CASE WHEN b IN ('Brand#1', 'Brand#2') THEN r * 0.9 ELSE r END)::DOUBLE, 9) AS filtered,
       round(least(greatest(r, 1.2), 1.28)::DOUBLE, 9) AS clamped, round(r::DOUBLE / (SELECT r::DOUBLE FROM base), 9) AS rebased FROM cells""",
)
def rate_table_bulk_operations(spark, sf):
    base = cells(spark, sf)
    named = {
        "uplifted": rt.uplift(base, "2.5"),
        "filtered": rt.uplift(base, "-10", filters={"b": ["Brand#1", "Brand#2"]}),
        "clamped": rt.floor_and_cap(base, "1.2", "1.28"),
        "rebased": rt.rebase(base, {"t": ["ECONOMY"], "b": ["Brand#4"]}),
    }
    out = None
    for name, df in named.items():
        side = df.select("t", "b", F.round(F.col("relativity").cast("double"), 9).alias(name))
        out = side if out is None else out.join(side, ["t", "b"])
    return out


@query(
    "rate_table_edits",
    with_sql(_CELLS)
    + """SELECT t, b, round((CASE WHEN b = 'Brand#6' THEN 1.5 ELSE r END)::DOUBLE, 6) AS relativity, CAST(NULL AS VARCHAR) AS issue FROM cells
      UNION ALL SELECT t, b, NULL, 'non_finite_value' FROM cells WHERE b = 'Brand#8' UNION ALL SELECT t, 'none', NULL, 'unknown_key' FROM cells WHERE b = 'Brand#9'""",
)
def rate_table_edits(spark, sf):
    c = cells(spark, sf)
    edits = (
        c.where("b = 'Brand#6'").select("t", "b", F.lit("1.5").alias("relativity"))
        .unionAll(c.where("b = 'Brand#8'").select("t", "b", F.lit("Infinity")))
        .unionAll(c.where("b = 'Brand#9'").select("t", F.lit("none"), F.lit("1.1")))
    )
    out, issues = rt.apply_edits(c, edits, ["t", "b"])
    return out.select("t", "b", F.round(F.col("relativity").cast("double"), 6).alias("relativity"), F.lit(None).cast("string").alias("issue")).unionAll(
        issues.select("t", "b", F.lit(None).cast("double"), "issue")
    )


@query(
    "rate_table_round_trip",
    with_sql(_CELLS) + "SELECT t, b, round(r::DOUBLE, 6) AS relativity FROM cells",
)
def rate_table_round_trip(spark, sf):
    path = sinks.write_rate_table_csv(cells(spark, sf), sinks.scratch_path(spark, "cells"))
    back = files.read_delimited(spark, path)
    return back.select("t", "b", F.round(F.col("relativity").try_cast("decimal(28,12)").cast("double"), 6).alias("relativity"))


@query(
    "rate_table_pairs",
    """SELECT coalesce(a.slug, b.slug) AS slug, a.version AS old_version, b.version AS new_version, CASE WHEN a.slug IS NULL THEN 'added' WHEN b.slug IS NULL THEN 'removed' WHEN a.version <> b.version THEN 'changed' ELSE 'same' END AS change
      FROM (SELECT p_type AS slug, CAST(count(*) % 3 AS BIGINT) AS version FROM part WHERE p_type <> 'PROMO' GROUP BY 1) a FULL JOIN (SELECT p_type AS slug, CAST(count(*) % 2 AS BIGINT) AS version FROM part WHERE p_type <> 'SMALL' GROUP BY 1) b ON a.slug = b.slug""",
)
def rate_table_pairs(spark, sf):
    p = table(spark, sf, "part").withColumnRenamed("p_type", "slug")
    side = lambda gone, k: p.where(F.col("slug") != gone).groupBy("slug").agg((F.count(F.lit(1)) % k).alias("version"))
    return rt.pair_versions(side("PROMO", 3), side("SMALL", 2))
