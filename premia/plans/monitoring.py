"""Queries: governance data, monitoring kernels, streams, optimisation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from premia.operators import governance as gv
from premia.operators import monitor as mo
from premia.operators import optimise as op
from premia.operators import rate_tables as rt
from premia.operators import rating as ra
from premia.operators.prepare import explode_period
from premia.plans.models import scored
from premia.plans.rating import QUOTES, RATES, _scored_sql, algorithm, quotes, rates
from premia.plans.registry import query
from premia.plans.views import BOOK, VERSION_CUT, book, table, versions, with_sql
from premia.streaming import monitors as st

# -- governance -------------------------------------------------------------------------------

_CORE = ["event_id", "event_type", "value"]


def _chain(spark, sf):
    """Hash chains of at most 64 events each, built inside a row per chain."""
    e = table(spark, sf, "events").withColumn("workspace", F.concat_ws("-", "user_id", F.floor(F.col("event_id") / 64).cast("string")))
    lists = e.groupBy("workspace").agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type", "value"))).alias("xs"))
    kind = "array<struct<sequence:long,event_id:long,event_type:string,value:double,prev_hash:string,event_hash:string>>"

    def add(acc, x):
        prev = F.coalesce(F.try_element_at(acc, F.lit(-1))["event_hash"], F.lit(gv.GENESIS))
        core = F.to_json(F.struct(x["event_id"].alias("event_id"), x["event_type"].alias("event_type"), x["value"].alias("value")), {"ignoreNullFields": "false"})
        new = F.struct(
            (F.size(acc) + 1).cast("long").alias("sequence"), x["event_id"].alias("event_id"), x["event_type"].alias("event_type"), x["value"].alias("value"),
            prev.alias("prev_hash"), F.sha2(F.concat(prev, core), 256).alias("event_hash"),
        )
        return F.concat(acc, F.array(new)).cast(kind)

    return lists.select("workspace", F.inline(F.aggregate("xs", F.array().cast(kind), add)))


def _tampered(spark, sf):
    chain = _chain(spark, sf)
    return chain.where(F.col("event_id") % 101 != 7).withColumn("value", F.when(F.col("event_id") % 97 == 5, F.col("value") + 1).otherwise(F.col("value")))


_CHAIN_SQL = """c AS (SELECT user_id || '-' || (event_id // 64) AS workspace, event_id, row_number() OVER (PARTITION BY user_id, event_id // 64 ORDER BY event_id) AS sequence FROM events),
  k AS (SELECT * FROM c WHERE event_id % 101 <> 7),
  b AS (SELECT k.workspace, k.sequence, CASE WHEN k.sequence > 1 AND p.sequence IS NULL THEN 'sequence gap' WHEN k.event_id % 97 = 5 THEN 'content does not match its hash' END AS problem
     FROM k LEFT JOIN k p ON p.workspace = k.workspace AND p.sequence = k.sequence - 1)"""


@query("audit_chain_breaks", with_sql(_CHAIN_SQL) + "SELECT workspace, sequence, problem FROM b WHERE problem IS NOT NULL")
def audit_chain_breaks(spark, sf):
    return gv.verify_chain(_tampered(spark, sf), _CORE)


@query(
    "audit_chain_summary",
    with_sql(_CHAIN_SQL)
    + """SELECT k.workspace, CAST(count(*) AS BIGINT) AS n_events, CAST(count(problem) AS BIGINT) AS n_broken, min(b.sequence) FILTER (problem IS NOT NULL) AS first_break,
      arg_min(problem, b.sequence) FILTER (problem IS NOT NULL) AS problem FROM k JOIN b ON k.workspace = b.workspace AND k.sequence = b.sequence GROUP BY 1""",
)
def audit_chain_summary(spark, sf):
    events = _tampered(spark, sf)
    return gv.chain_summary(events, gv.verify_chain(events, _CORE))


@query(
    "audit_field_diff",
    """SELECT event_id, 'outer.k' AS path, json_extract_string(props, '$.k') AS before, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS VARCHAR) AS after FROM events WHERE event_id % 3 = 0
       UNION ALL SELECT event_id, 'added', NULL, event_type FROM events WHERE event_id % 5 = 0""",
)
def audit_field_diff(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf, "events")
    before = F.concat(F.lit('{"outer": '), "props", F.lit(', "same": 1}'))
    changed = F.when(F.col("event_id") % 3 == 0, k + 1).otherwise(k).cast("string")
    extra = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit(', "added": "'), "event_type", F.lit('"'))).otherwise("")
    after = F.concat(F.lit('{"outer": {"k": '), changed, F.lit('}, "same": 1'), extra, F.lit("}"))
    return gv.field_diff(e.select("event_id", before.alias("b"), after.alias("a")), "b", "a", keep=["event_id"])


@query("artifact_history", "SELECT event_id, event_type FROM events WHERE user_id = 7 ORDER BY event_id")
def artifact_history(spark, sf):
    e = table(spark, sf, "events").withColumn("entity_ref", F.concat(F.lit("model:"), F.col("user_id").cast("string")))
    return gv.history(e, "model:7", order="event_id").select("event_id", "event_type")


_EDGES = "edges AS (SELECT c_custkey AS child, c_custkey // 3 AS parent FROM customer WHERE c_custkey > 0)"


def _edges(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").where(k > 0).select(k.alias("child"), F.floor(k / 3).alias("parent"))


@query(
    "lineage_up",
    "WITH RECURSIVE " + _EDGES + """, up AS (SELECT parent AS node, 1 AS distance FROM edges WHERE child IN (100, 140) UNION SELECT e.parent, distance + 1 FROM up JOIN edges e ON e.child = node)
      SELECT node, CAST(min(distance) AS INTEGER) AS distance FROM up GROUP BY 1""",
)
def lineage_up(spark, sf):
    return gv.lineage(_edges(spark, sf), [100, 140])


@query(
    "lineage_down",
    "WITH RECURSIVE " + _EDGES + """, down AS (SELECT child AS node, 1 AS distance FROM edges WHERE parent = 2 UNION SELECT e.child, distance + 1 FROM down JOIN edges e ON e.parent = node)
      SELECT node, CAST(min(distance) AS INTEGER) AS distance FROM down GROUP BY 1""",
)
def lineage_down(spark, sf):
    return gv.lineage(_edges(spark, sf), [2], up=False)


@query("artifact_usage", "SELECT l_partkey, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS referenced_by FROM lineitem GROUP BY 1")
def artifact_usage(spark, sf):
    return gv.usage_counts(table(spark, sf, "lineitem"), "l_partkey", "l_suppkey")


# -- monitoring kernels -----------------------------------------------------------------------


def _quarter():
    return F.date_format(F.date_trunc("quarter", F.col("start_date")), "yyyy-MM-dd")


_QUARTER = "strftime(date_trunc('quarter', start_date), '%Y-%m-%d')"


def _psi_by_period_sql(column: str, weight: str) -> str:
    base = f"(SELECT {column} AS level, {weight} / sum({weight}) OVER () AS s FROM book WHERE start_date < DATE '{VERSION_CUT}' GROUP BY 1)"
    now = f"(SELECT {_QUARTER} AS period, {column} AS level, {weight} / sum({weight}) OVER (PARTITION BY {_QUARTER}) AS s FROM book WHERE start_date >= DATE '{VERSION_CUT}' GROUP BY 1, 2)"
    return f"""(SELECT period, sum((greatest(coalesce(a, 0), 1e-6) - greatest(coalesce(b, 0), 1e-6)) * ln(greatest(coalesce(a, 0), 1e-6) / greatest(coalesce(b, 0), 1e-6))) AS psi FROM
       (SELECT p.period, l.level, n.s AS a, l.s AS b FROM (SELECT DISTINCT period FROM {now}) p CROSS JOIN {base} l LEFT JOIN {now} n ON n.period = p.period AND n.level = l.level) GROUP BY 1)"""


@query(
    "input_drift",
    with_sql(BOOK)
    + " UNION ALL ".join(
        f"""SELECT x.period, '{c}' AS "column", round(x.psi, 9) AS psi_count, round(y.psi, 9) AS psi_weight, CASE WHEN greatest(x.psi, y.psi) > 0.25 THEN 'breach' WHEN greatest(x.psi, y.psi) > 0.1 THEN 'warn' ELSE 'ok' END AS status
        FROM {_psi_by_period_sql(c, 'count(*)::DOUBLE')} x JOIN {_psi_by_period_sql(c, 'sum(exposure_years)')} y ON x.period = y.period"""
        for c in ("p_brand", "o_orderpriority")
    ),
)
def input_drift(spark, sf):
    cur, prev = versions(spark, sf, "part")
    out = mo.input_drift(cur, _quarter(), ["p_brand", "o_orderpriority"], prev, "exposure_years")
    return out.withColumns({c: F.round(c, 9) for c in ("psi_count", "psi_weight")})


@query(
    "drift_against_prior_period",
    with_sql(BOOK)
    + f""", n AS (SELECT year(start_date)::BIGINT AS period, p_brand AS level, count(*)::DOUBLE AS n FROM book GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY period) AS s FROM n)
      SELECT a.period, 'p_brand' AS "column", round(sum((greatest(coalesce(a.s,0),1e-6) - greatest(coalesce(b.s,0),1e-6)) * ln(greatest(coalesce(a.s,0),1e-6) / greatest(coalesce(b.s,0),1e-6))), 9) AS psi
      FROM s a JOIN s b ON b.period + 1 = a.period AND a.level = b.level GROUP BY 1""",
)
def drift_against_prior_period(spark, sf):
    levels = mo.period_levels(book(spark, sf, "orders", "part"), F.year("start_date").cast("long"), ["p_brand"])
    return mo.drift_against_prior(levels, F.col("period") + 1).withColumn("psi", F.round("psi", 9))


@query(
    "drift_by_importance",
    with_sql(BOOK)
    + " UNION ALL ".join(
        f"""SELECT x.period, '{c}' AS "column", round(x.psi * {w}, 9) AS priority FROM {_psi_by_period_sql(c, 'count(*)::DOUBLE')} x""" for c, w in (("p_brand", 0.7), ("p_type", 0.3))
    ),
)
def drift_by_importance(spark, sf):
    cur, prev = versions(spark, sf, "part")
    drifted = mo.input_drift(cur, _quarter(), ["p_brand", "p_type"], prev, "exposure_years")
    importance = table(spark, sf, "region").where("r_regionkey < 2").select(
        F.when(F.col("r_regionkey") == 0, "p_brand").otherwise("p_type").alias("column"), F.when(F.col("r_regionkey") == 0, 0.7).otherwise(0.3).alias("importance")
    )
    out = mo.drift_with_importance(drifted, importance)
    return out.select("period", "column", F.round("priority", 9).alias("priority")).orderBy(F.col("priority").desc())


@query(
    "cohort_actual_expected",
    with_sql(BOOK)
    + f"""SELECT {_QUARTER} AS cohort, p_type, sum(claim_count)::DOUBLE AS actual, round(sum(exposure_years * 0.65), 6) AS expected, round(sum(exposure_years), 6) AS exposure_years,
      round(sum(claim_count) / sum(exposure_years * 0.65), 6) AS ratio, {_QUARTER} < '1998-01-01' AS mature FROM book GROUP BY 1, 2""",
)
def cohort_actual_expected(spark, sf):
    b = book(spark, sf, "orders", "part").withColumn("expected", F.col("exposure_years") * 0.65)
    out = mo.cohort_ae(b, _quarter(), ["p_type"], actual="claim_count", expected="expected", exposure="exposure_years", mature_before="1998-01-01")
    return out.select("cohort", "p_type", "actual", F.round("expected", 6).alias("expected"), "exposure_years", F.round("ratio", 6).alias("ratio"), "mature")


@query(
    "gini_by_cohort",
    with_sql(BOOK)
    + """, g AS (SELECT year(start_date)::VARCHAR AS cohort, (0.4 + p_size / 100.0::DOUBLE + l_tax) AS o, sum(exposure_years) AS e, sum(claim_count)::DOUBLE AS y FROM book GROUP BY 1, 2),
      w AS (SELECT cohort, e, y, sum(y) OVER (PARTITION BY cohort ORDER BY o) AS cy FROM g)
      SELECT cohort, round(1 - 2 * sum(e * (cy - y / 2)) / (sum(e) * sum(y)), 8) AS gini, round(1 - 2 * sum(e * (cy - y / 2)) / (sum(e) * sum(y)) - 0.1, 8) AS change FROM w WHERE cohort < '1999' GROUP BY 1""",
)
def gini_by_cohort(spark, sf):
    rows = scored(spark, sf, "orders").withColumn("rate", 0.4 + F.col("p_size") / 100.0 + F.col("l_tax"))
    out = mo.gini_by_cohort(rows, F.year("start_date").cast("string"), actual="claim_count", order="rate", exposure="exposure_years", fitted=0.1, mature_before="1999")
    return out.withColumns({c: F.round(c, 8) for c in ("gini", "change")})


@query(
    "conversion_by_segment",
    with_sql(QUOTES)
    + """SELECT priority, purpose, CAST(count(*) AS BIGINT) AS quotes, CAST(count(w.k) AS BIGINT) AS converted, round(avg(0.2 + exposure_years / 2), 9) AS expected_rate,
      round(count(w.k) / count(*), 9) AS realised_rate, round(count(w.k) / count(*) - avg(0.2 + exposure_years / 2), 9) AS gap
      FROM quotes LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A') w ON k = o_orderkey GROUP BY 1, 2""",
)
def conversion_by_segment(spark, sf):
    q = quotes(spark, sf).withColumn("expected", 0.2 + F.col("exposure_years") / 2)
    won = table(spark, sf, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    out = mo.conversion(q, won, ["priority", "purpose"], quote="o_orderkey")
    return out.withColumns({c: F.round(c, 9) for c in ("expected_rate", "realised_rate", "gap")})


_BOTH = with_sql(QUOTES, RATES, _scored_sql("s", 1), _scored_sql("u", 2))


@query(
    "rate_achieved",
    _BOTH
    + """, d AS (SELECT s.nation, s.as_at, s.premium_minor AS a, u.premium_minor AS b FROM s JOIN u USING (quote_id) WHERE s.outcome = 'quoted' AND u.outcome = 'quoted'),
      g AS (SELECT nation, sum(a) FILTER (as_at < DATE '1997-01-01') AS p0, sum(b) FILTER (as_at >= DATE '1997-01-01') AS p1, avg((b - a) / a * 100) FILTER (as_at < DATE '1997-01-01') AS r0, avg((b - a) / a * 100) FILTER (as_at >= DATE '1997-01-01') AS r1 FROM d GROUP BY 1),
      w AS (SELECT p0 / sum(p0) OVER () AS w0, p1 / sum(p1) OVER () AS w1, r0, r1 FROM g)
      SELECT round(sum(w0 * r0), 6) AS rate_intended_pct, round(sum(w1 * r1), 6) AS rate_achieved_pct, round(sum(w0 * (r1 - r0)), 6) AS pure_rate_pct, round(sum((w1 - w0) * r1), 6) AS mix_pct, round(sum(w1 * r1) - sum(w0 * r0), 6) AS gap_pct FROM w""",
)
def rate_achieved(spark, sf):
    r = rates(spark, sf)
    both = ra.score(ra.score(quotes(spark, sf), algorithm(r, 1), "a__"), algorithm(r, 2), "b__").where("a__outcome = 'quoted' and b__outcome = 'quoted'")
    change = F.avg((F.col("b__premium_minor") - F.col("a__premium_minor")) / F.col("a__premium_minor") * 100).alias("change_pct")
    cut = F.lit("1997-01-01").cast("date")
    intended = both.where(F.col("as_at") < cut).groupBy("nation").agg(F.sum("a__premium_minor").alias("premium"), change)
    achieved = both.where(F.col("as_at") >= cut).groupBy("nation").agg(F.sum("b__premium_minor").alias("premium"), change)
    out = mo.rate_achieved(intended, achieved, "nation")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(
    "premium_by_period",
    with_sql(QUOTES)
    + """SELECT strftime(date_trunc('month', as_at), '%Y-%m-%d') AS period, priority, CAST(count(*) AS BIGINT) AS policies, CAST(sum(base_minor) AS BIGINT) AS premium, round(avg(base_minor), 6) AS mean_premium,
      round(count(*) / sum(count(*)) OVER (PARTITION BY date_trunc('month', as_at)), 9) AS mix FROM quotes GROUP BY date_trunc('month', as_at), 2""",
)
def premium_by_period(spark, sf):
    month = F.date_format(F.date_trunc("month", F.col("as_at")), "yyyy-MM-dd")
    out = mo.premium_by_period(quotes(spark, sf), month, ["priority"], "base_minor")
    return out.withColumns({"mean_premium": F.round("mean_premium", 6), "mix": F.round("mix", 9)})


@query(
    "loss_ratio_by_cohort",
    """WITH p AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 182 AS e, CAST(round(o_totalprice) AS BIGINT) AS premium FROM orders),
      w AS (SELECT year(s)::VARCHAR AS cohort, CAST(sum(premium) AS BIGINT) AS written_premium FROM p GROUP BY 1),
      y AS (SELECT unnest([1995,1996,1997,1998,1999,2000,2001,2002]) AS y),
      er AS (SELECT y::VARCHAR AS cohort, sum(premium * (least(e, make_date(y + 1, 1, 1)) - greatest(s, make_date(y, 1, 1))) / 182.0::DOUBLE) AS earned_premium FROM p JOIN y ON s < make_date(y + 1, 1, 1) AND e > make_date(y, 1, 1) GROUP BY 1),
      c AS (SELECT year(l_shipdate)::VARCHAR AS cohort, CAST(sum(CAST(round(l_extendedprice * l_discount) AS BIGINT)) AS BIGINT) AS claim_amount FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
      SELECT cohort, written_premium, round(earned_premium, 0) AS earned_premium, claim_amount, CASE cohort WHEN '2000' THEN 1.2 WHEN '2001' THEN 1.5 ELSE 1.0 END::DOUBLE AS development_factor, cohort NOT IN ('2000', '2001') AS mature,
        round(claim_amount * CASE cohort WHEN '2000' THEN 1.2 WHEN '2001' THEN 1.5 ELSE 1.0 END::DOUBLE / written_premium, 9) AS written_loss_ratio,
        round(claim_amount * CASE cohort WHEN '2000' THEN 1.2 WHEN '2001' THEN 1.5 ELSE 1.0 END::DOUBLE / earned_premium, 6) AS earned_loss_ratio
      FROM w LEFT JOIN er USING (cohort) LEFT JOIN c USING (cohort)""",
)
def loss_ratio_by_cohort(spark, sf):
    """Written by start year, earned by days in each calendar year, claims by loss year."""
    start = F.col("o_orderdate").cast("date")
    p = table(spark, sf, "orders").select(
        "o_orderkey", start.alias("exposure_start"), F.date_add(start, 182).alias("exposure_end"), F.round("o_totalprice").cast("long").alias("premium"), F.lit(0.5).alias("exposure_years")
    )
    written = p.groupBy(F.year("exposure_start").cast("string").alias("cohort")).agg(F.sum("premium").alias("written_premium"))
    parts = explode_period(p, [f"{y}-01-01" for y in range(1995, 2003)])
    share = F.datediff("exposure_end", "exposure_start") / 182.0
    earned = parts.groupBy(F.year("exposure_start").cast("string").alias("cohort")).agg(F.sum(F.col("premium") * share).alias("earned_premium"))
    claims = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.year("l_shipdate").cast("string").alias("cohort")).agg(
        F.sum(F.round(F.col("l_extendedprice") * F.col("l_discount")).cast("long")).alias("claim_amount")
    )
    out = mo.loss_ratio(written, earned, claims, {"2000": 1.2, "2001": 1.5})
    return out.withColumns({"earned_premium": F.round("earned_premium", 0), "written_loss_ratio": F.round("written_loss_ratio", 9), "earned_loss_ratio": F.round("earned_loss_ratio", 6)})


@query(
    "constraint_activation",
    _BOTH
    + """, f AS (SELECT year(as_at)::VARCHAR AS period, unnest([CASE WHEN refused THEN 'REFER_LARGE' END, CASE WHEN profit < 1500 OR profit > 60000 THEN 'LIMIT' END]) AS reason FROM s)
      SELECT f.period, reason, CAST(count(*) AS BIGINT) AS n, CAST(any_value(t) AS BIGINT) AS quotes, round(count(*) / any_value(t), 9) AS rate FROM f JOIN (SELECT year(as_at)::VARCHAR AS period, count(*) AS t FROM s GROUP BY 1) q ON q.period = f.period WHERE reason IS NOT NULL GROUP BY 1, 2""",
)
def constraint_activation(spark, sf):
    s = ra.score(quotes(spark, sf), algorithm(rates(spark, sf), 1))
    return mo.activation_rates(s, F.year("as_at").cast("string")).withColumn("rate", F.round("rate", 9))


@query(
    "lookup_miss_rates",
    _BOTH
    + """SELECT year(as_at)::VARCHAR AS period, 'lookup_miss:nation_loading' AS reason, CAST(count(*) FILTER (nat IS NULL) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS quotes, round(count(*) FILTER (nat IS NULL) / count(*), 9) AS rate FROM s GROUP BY 1 HAVING n > 0
      UNION ALL SELECT year(as_at)::VARCHAR, 'table_miss:segment_relativity', CAST(count(*) FILTER (seg IS NULL) AS BIGINT), CAST(count(*) AS BIGINT), round(count(*) FILTER (seg IS NULL) / count(*), 9) FROM s GROUP BY 1 HAVING count(*) FILTER (seg IS NULL) > 0""",
)
def lookup_miss_rates(spark, sf):
    s = ra.score(quotes(spark, sf), algorithm(rates(spark, sf), 1))
    return mo.miss_rates(s, F.year("as_at").cast("string")).withColumn("rate", F.round("rate", 9))


@query(
    "shadow_price_distribution",
    _BOTH
    + """, r AS (SELECT year(s.as_at)::VARCHAR AS period, u.premium_minor / s.premium_minor AS ratio FROM s JOIN u USING (quote_id) WHERE s.outcome = 'quoted' AND u.outcome = 'quoted')
      SELECT period, CAST(count(*) AS BIGINT) AS n, round(avg(ratio), 9) AS mean_ratio, round(min(ratio), 9) AS lowest, round(max(ratio), 9) AS highest FROM r GROUP BY 1""",
)
def shadow_price_distribution(spark, sf):
    r, q = rates(spark, sf), quotes(spark, sf)
    both = ra.shadow(ra.score(q, algorithm(r, 1)), ra.score(q, algorithm(r, 2))).where("ratio is not null")
    dated = both.join(q.select("quote_id", F.year("as_at").cast("string").alias("period")), "quote_id")
    return dated.groupBy("period").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("ratio"), 9).alias("mean_ratio"), F.round(F.min("ratio"), 9).alias("lowest"), F.round(F.max("ratio"), 9).alias("highest")
    )


_DAY = "strftime(ts, '%Y-%m-%d')"


def _day():
    return F.date_format("ts", "yyyy-MM-dd")


def _requests(spark, sf):
    outcome = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "declined").otherwise("quoted")
    return table(spark, sf, "events").withColumns({"outcome": outcome, "version": (F.col("user_id") % 2).cast("string")})


@query(
    "operational_metrics",
    f"""SELECT {_DAY} AS period, (user_id % 2)::VARCHAR AS version, CAST(count(*) AS BIGINT) AS requests, round(avg((event_type = 'error')::INT), 9) AS error_rate, round(avg((event_type = 'click')::INT), 9) AS decline_rate,
      quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1, 2""",
)
def operational_metrics(spark, sf):
    out = mo.operational(_requests(spark, sf), _day(), ["version"], latency="value", outcome="outcome")
    return out.withColumns({c: F.round(c, 9) for c in ("error_rate", "decline_rate")})


@query(
    "replica_divergence",
    f"SELECT {_DAY} AS period, (user_id % 2)::VARCHAR AS version, CAST(count(DISTINCT event_type) AS BIGINT) AS bundles, CASE WHEN count(DISTINCT event_type) > 1 THEN 'breach' ELSE 'ok' END AS status FROM events WHERE value > 40 GROUP BY 1, 2",
)
def replica_divergence(spark, sf):
    return mo.replica_divergence(_requests(spark, sf).where("value > 40"), _day(), "event_type", ["version"])


_STATUS_SQL = f"""r AS (SELECT {_DAY} AS period, event_type, avg(value) AS v FROM events GROUP BY 1, 2), s AS (SELECT period, event_type, CASE WHEN v > 20.5 THEN 'breach' WHEN v > 19 THEN 'warn' ELSE 'ok' END AS status FROM r)"""


def _statuses(spark, sf):
    daily = table(spark, sf, "events").groupBy(_day().alias("period"), "event_type").agg(F.avg("value").alias("v"))
    return daily.select("period", "event_type", mo.status(F.col("v"), 19.0, 20.5).alias("status"))


@query(
    "consecutive_breaches",
    with_sql(_STATUS_SQL)
    + """, i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY period) - sum((status = 'breach')::INT) OVER (PARTITION BY event_type ORDER BY period) AS island FROM s),
      k AS (SELECT *, CASE WHEN status = 'breach' THEN row_number() OVER (PARTITION BY event_type, island, status ORDER BY period) ELSE 0 END AS run FROM i)
      SELECT period, event_type, status, CAST(run AS INTEGER) AS run, run >= 2 AS alert FROM k""",
)
def consecutive_breaches(spark, sf):
    return mo.consecutive(_statuses(spark, sf), ["event_type"], "period", 2)


@query(
    "open_alerts",
    with_sql(_STATUS_SQL)
    + """SELECT event_type, CAST(count(*) AS BIGINT) AS periods, CAST(count(*) FILTER (status <> 'ok') AS BIGINT) AS fired, min(period) FILTER (status <> 'ok') AS first_fired, max(period) FILTER (status <> 'ok') AS last_fired,
      CASE WHEN bool_or(status = 'breach') THEN 'breach' ELSE 'warn' END AS level, count(*) FILTER (status <> 'ok') = count(*) AND count(*) >= 10 AS always_firing FROM s GROUP BY 1 HAVING fired > 0""",
)
def open_alerts(spark, sf):
    return mo.open_alerts(_statuses(spark, sf), ["event_type"], "period")


@query(
    "backfill_periods",
    f"SELECT {_DAY} AS period, event_type, CAST(count(*) AS BIGINT) AS n FROM events WHERE CAST(ts AS DATE) IN (DATE '2024-01-05', DATE '2024-01-17') GROUP BY 1, 2",
)
def backfill_periods(spark, sf):
    compute = lambda df: df.groupBy(_day().alias("period"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return mo.backfill(table(spark, sf, "events"), F.col("ts").cast("date"), ["2024-01-05", "2024-01-17"], compute)


@query(
    "approximation_error",
    _BOTH
    + """SELECT CAST(count(*) AS BIGINT) AS quotes, round(avg(abs(u.premium_minor - s.premium_minor) / s.premium_minor * 100), 6) AS mean_abs_pct, round(max(abs(u.premium_minor - s.premium_minor) / s.premium_minor * 100), 6) AS max_abs_pct
      FROM s JOIN u USING (quote_id) WHERE s.outcome = 'quoted' AND u.outcome = 'quoted'""",
)
def approximation_error(spark, sf):
    r, q = rates(spark, sf), quotes(spark, sf)
    out = mo.approximation_error(ra.score(q, algorithm(r, 1)), ra.score(q, algorithm(r, 2)))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_abs_pct", "max_abs_pct")})


# -- streams ----------------------------------------------------------------------------------


def _stream(spark, sf):
    schema = table(spark, sf, "events").schema
    e = st.read_stream(spark, sf, "events", schema)
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


_CLOSED = "period + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


def _text(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


@query(
    "stream_windowed_levels",
    f"""SELECT strftime(period, '%Y-%m-%d %H:%M:%S') AS period, 'event_type' AS "column", event_type AS level, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS weight
      FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS period, event_type, value FROM events) WHERE {_CLOSED} GROUP BY period, event_type""",
)
def stream_windowed_levels(spark, sf):
    out = st.run_to_table(st.windowed_levels(_stream(spark, sf), ["event_type"], time="ts", width="6 hours", late="1 hour", weight="value"), "levels")
    return out.select(_text("period"), "column", "level", "n", F.round("weight", 4).alias("weight"))


@query(
    "stream_operations",
    f"""SELECT strftime(period, '%Y-%m-%d %H:%M:%S') AS period, CAST(count(*) AS BIGINT) AS requests, round(avg((event_type = 'error')::INT), 9) AS error_rate, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95
      FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS period, event_type, value FROM events) WHERE {_CLOSED} GROUP BY period""",
)
def stream_operations(spark, sf):
    e = _stream(spark, sf).withColumn("error", F.col("event_type") == "error")
    out = st.run_to_table(st.windowed_operations(e, time="ts", width="6 hours", late="1 hour", error="error", latency="value"), "operations")
    return out.select(_text("period"), "requests", F.round("error_rate", 9).alias("error_rate"), "p50", "p95")


@query(
    "stream_drift",
    f"""WITH l AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS period, event_type AS level, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2),
      c AS (SELECT *, n / sum(n) OVER (PARTITION BY period) AS s FROM l WHERE {_CLOSED}), b AS (SELECT event_type AS level, count(*) / sum(count(*)) OVER () AS s FROM events GROUP BY 1),
      x AS (SELECT p.period, c.s AS a, b.s AS b FROM (SELECT DISTINCT period FROM c) p CROSS JOIN b LEFT JOIN c ON c.period = p.period AND c.level = b.level)
      SELECT strftime(period, '%Y-%m-%d %H:%M:%S') AS period, round(sum((greatest(coalesce(a,0),1e-6) - greatest(b,1e-6)) * ln(greatest(coalesce(a,0),1e-6) / greatest(b,1e-6))), 9) AS psi FROM x GROUP BY period""",
)
def stream_drift(spark, sf):
    """The batch drift kernel inside `foreachBatch`, on closed windows against the stored baseline."""
    from premia.operators.ingest import level_counts

    baseline = level_counts(table(spark, sf, "events"), ["event_type"])
    levels = st.windowed_levels(_stream(spark, sf), ["event_type"], time="ts", width="6 hours", late="1 hour")
    out = st.run_batches(levels, "drift", lambda batch: mo.drift(batch, baseline), "period timestamp, column string, psi double")
    return out.select(_text("period"), F.round("psi", 9).alias("psi"))


@query(
    "stream_conversion",
    """SELECT q.event_id AS quote_event, o.event_id AS outcome_event FROM events q JOIN events o ON o.event_id = q.event_id + 1 AND q.event_type = 'view' AND o.event_type = 'purchase'
       AND o.ts >= q.ts AND o.ts <= q.ts + INTERVAL 6 HOUR""",
)
def stream_conversion(spark, sf):
    """A purchase answers the view numbered just before it; a quote has one outcome at most."""
    q = _stream(spark, sf).where("event_type = 'view'").select(F.col("event_id").alias("quote_id"), "event_id", F.col("ts").alias("quoted_at"))
    o = _stream(spark, sf).where("event_type = 'purchase'").select((F.col("event_id") - 1).alias("quote_id"), "event_id", F.col("ts").alias("bought_at"))
    joined = st.converted_quotes(q, o, key="quote_id", quote_time="quoted_at", outcome_time="bought_at", within="6 hours", late="1 hour")
    return st.run_to_table(joined.select(F.col("q.event_id").alias("quote_event"), F.col("o.event_id").alias("outcome_event")), "conversion")


@query(
    "stream_sampled_traces",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'always' ELSE 'rate' END AS sample_reason FROM events
       WHERE event_type = 'error' OR ('0x' || substr(sha256(4 || ':' || event_id), 1, 13))::BIGINT / 4503599627370496.0 < 0.05""",
)
def stream_sampled_traces(spark, sf):
    out = st.run_to_table(st.sampled_stream(_stream(spark, sf), "event_type = 'error'", 0.05, 4, "event_id"), "traces")
    return out.select("event_id", "sample_reason")


@query("stream_first_alerts", "SELECT user_id, event_type, CAST(1 AS BIGINT) AS alerts FROM events WHERE event_type = 'error' GROUP BY 1, 2")
def stream_first_alerts(spark, sf):
    """Alerts of one batch are within one quiet period: one per key comes out."""
    alerts = _stream(spark, sf).where("event_type = 'error'")
    out = st.run_to_table(st.first_alerts(alerts, time="ts", keys=["user_id", "event_type"], quiet="60 days"), "alerts")
    return out.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("alerts"))


@query(
    "stream_consecutive_breaches",
    f"""WITH w AS (SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS period, sum(value) / count(*) > 18 AS hit FROM events GROUP BY 1, 2),
      e AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY period) AS rn FROM w WHERE {_CLOSED}),
      i AS (SELECT *, rn - sum(hit::INT) OVER (PARTITION BY event_type ORDER BY rn) AS island FROM e),
      r AS (SELECT *, row_number() OVER (PARTITION BY event_type, island, hit ORDER BY rn) AS run, first(period) OVER (PARTITION BY event_type, island, hit ORDER BY rn) AS since FROM i WHERE hit)
      SELECT event_type AS key, strftime(since, '%Y-%m-%d %H:%M:%S') AS since, strftime(period, '%Y-%m-%d %H:%M:%S') AS at, run FROM r WHERE run = 3""",
)
def stream_consecutive_breaches(spark, sf):
    """Three closed windows in a row above a limit: state per metric, fed by the windowed values."""
    levels = st.windowed_levels(_stream(spark, sf), ["event_type"], time="ts", width="6 hours", late="1 hour", weight="value")
    values = levels.select("level", "period", (F.col("weight") / F.col("n")).alias("mean"))
    results = st.read_results(spark, st.write_results(values, "values"), values.schema)
    found = st.consecutive_breaches(results, key="level", time="period", value="mean", limit=18.0, needed=3)
    out = st.run_to_table(found, "consecutive")
    return out.select("key", _text("since"), _text("at"), "run")


# -- optimisation -----------------------------------------------------------------------------

_DEMAND_SQL = """risks AS (SELECT *, base_minor::DOUBLE AS price, 6.0 + 0.5 * exposure_years AS base, base_minor * 0.6 + 100 * exposure_years AS cost, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'web' ELSE 'broker' END AS channel,
   CAST(o_orderkey % 6 AS INTEGER) AS tenure FROM quotes WHERE base_minor > 0)"""
_P = "1 / (1 + exp(-(base - 0.8 * ln({price}))))"
DEMAND = op.Demand("base", -0.8, 0.05)


def risks(spark, sf):
    k = F.col("o_orderkey")
    return quotes(spark, sf).where("base_minor > 0").withColumns(
        {
            "price": F.col("base_minor").cast("double"), "base": 6.0 + 0.5 * F.col("exposure_years"), "cost": F.col("base_minor") * 0.6 + 100 * F.col("exposure_years"),
            "channel": F.when(k % 7 == 0, None).when(k % 2 == 0, "web").otherwise("broker"), "tenure": (k % 6).cast("int"),
        }
    )


@query(
    "price_variation",
    with_sql(QUOTES, _DEMAND_SQL)
    + "SELECT nation, CAST(count(*) AS BIGINT) AS n, round(avg(price), 4) AS mean_price, round(stddev_samp(price) / avg(price), 6) AS variation, stddev_samp(price) / avg(price) < 0.58 AS too_low FROM risks GROUP BY 1",
)
def price_variation(spark, sf):
    out = op.price_variation(risks(spark, sf), ["nation"], "price", low=0.58)
    return out.withColumns({"mean_price": F.round("mean_price", 4), "variation": F.round("variation", 6)})


_FACTORS = [0.8, 0.9, 1.0, 1.1, 1.2]
_GRID = "(VALUES " + ", ".join(f"({f}::DOUBLE)" for f in _FACTORS) + ")"


@query(
    "demand_curve",
    with_sql(QUOTES, _DEMAND_SQL)
    + f"SELECT priority, f AS price_factor, CAST(count(*) AS BIGINT) AS n, round(avg({_P.format(price='price * f')}), 9) AS probability FROM risks, {_GRID} g(f) GROUP BY 1, 2",
)
def demand_curve(spark, sf):
    return op.demand_curve(risks(spark, sf), DEMAND, "price", _FACTORS, ["priority"]).withColumn("probability", F.round("probability", 9))


@query(
    "price_elasticity",
    with_sql(QUOTES, _DEMAND_SQL)
    + f"""SELECT priority, 'analytic' AS method, CAST(count(*) AS BIGINT) AS n, round(avg(-0.8 * (1 - {_P.format(price='price')})), 8) AS elasticity, round(avg(-0.8 * (1 - {_P.format(price='price')})) - avg(1.959963984540054 * 0.05 * (1 - {_P.format(price='price')})), 8) AS low, FALSE AS defect FROM risks GROUP BY 1
      UNION ALL SELECT priority, 'finite_difference', CAST(count(*) AS BIGINT), round(avg(ln(({_P.format(price='price * 1.01::DOUBLE')}) / ({_P.format(price='price * 0.99::DOUBLE')})) / ln(1.01::DOUBLE / 0.99::DOUBLE)), 8),
        round(avg(ln(({_P.format(price='price * 1.01::DOUBLE')}) / ({_P.format(price='price * 0.99::DOUBLE')})) / ln(1.01::DOUBLE / 0.99::DOUBLE)) - avg(1.959963984540054 * 0.05 * (1 - {_P.format(price='price')})), 8), FALSE FROM risks GROUP BY 1""",
)
def price_elasticity(spark, sf):
    r = risks(spark, sf)
    both = op.elasticity(r, DEMAND, "price", ["priority"]).unionAll(op.elasticity(r, DEMAND, "price", ["priority"], method="finite_difference"))
    return both.select("priority", "method", "n", F.round("elasticity", 8).alias("elasticity"), F.round("low", 8).alias("low"), "defect")


@query(
    "extrapolation_guard",
    with_sql(QUOTES, _DEMAND_SQL)
    + """, o AS (SELECT nation, min(price) AS lo, max(price) AS hi FROM risks GROUP BY 1), p AS (SELECT n_name AS nation, 30000.0 + 2000.0 * n_nationkey AS proposed FROM nation)
      SELECT nation, proposed::DOUBLE AS proposed_price, lo AS lowest, hi AS highest, proposed < lo - 0.2 * (hi - lo) OR proposed > hi + 0.2 * (hi - lo) AS refused FROM p JOIN o USING (nation)""",
)
def extrapolation_guard(spark, sf):
    proposed = table(spark, sf, "nation").select(F.col("n_name").alias("nation"), (30000.0 + 2000.0 * F.col("n_nationkey")).alias("proposed_price"))
    return op.extrapolation_guard(risks(spark, sf), proposed, "nation", "price")


_SPACE = f"""space AS (SELECT nation, f AS factor, sum(p) AS volume, sum(p * price * f) AS premium, sum(p * (price * f - cost)) AS profit FROM (SELECT *, {_P.format(price='price * f')} AS p FROM risks, {_GRID} g(f)) GROUP BY 1, 2)"""


@query(
    "segment_outcomes",
    with_sql(QUOTES, _DEMAND_SQL, _SPACE) + "SELECT nation, factor, round(volume, 6) AS volume, round(premium, 3) AS premium, round(profit, 3) AS profit FROM space",
)
def segment_outcomes(spark, sf):
    out = op.outcomes(risks(spark, sf), DEMAND, segment="nation", price="price", cost="cost", factors=_FACTORS)
    return out.select("nation", "factor", F.round("volume", 6).alias("volume"), F.round("premium", 3).alias("premium"), F.round("profit", 3).alias("profit"))


_MULTIPLIERS = [0.0, 20000.0, 30000.0, 40000.0, 60000.0, 120000.0]
_MULT_SQL = "(VALUES " + ", ".join(f"({m}::DOUBLE)" for m in _MULTIPLIERS) + ")"
_BEST = f"""best AS (SELECT m, nation, arg_max(factor, (profit + m * volume, -factor)) AS factor, max(profit + m * volume) AS s FROM space, {_MULT_SQL} g(m) GROUP BY 1, 2),
  ans AS (SELECT m, nation, factor, volume, premium, profit FROM best JOIN space USING (nation, factor)), tot AS (SELECT m, sum(volume) AS v, sum(profit) AS p FROM ans GROUP BY 1)"""


@query(
    "segment_search",
    with_sql(QUOTES, _DEMAND_SQL, _SPACE, _BEST)
    + """SELECT nation, factor, round(volume, 6) AS volume, round(profit, 3) AS profit, factor IN (0.8::DOUBLE, 1.2::DOUBLE) AS at_bound FROM ans
      WHERE m = (SELECT min(m) FROM tot WHERE v >= 0.98 * (SELECT sum(volume) FROM space WHERE factor = 1.0))""",
)
def segment_search(spark, sf):
    out, _ = op.search(risks(spark, sf), DEMAND, segment="nation", price="price", cost="cost", factors=_FACTORS, min_volume_share=0.98, multipliers=_MULTIPLIERS)
    return out.select("nation", "factor", F.round("volume", 6).alias("volume"), F.round("profit", 3).alias("profit"), "at_bound")


@query(
    "efficient_frontier",
    with_sql(QUOTES, _DEMAND_SQL, _SPACE, _BEST)
    + """SELECT m AS multiplier, round(v, 6) AS volume, round(p, 3) AS profit, coalesce(max(p) OVER (ORDER BY v DESC, p DESC, m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= p, FALSE) AS dominated FROM (SELECT m, round(v, 6) AS v, round(p, 3) AS p FROM tot)""",
)
def efficient_frontier(spark, sf):
    space = op.outcomes(risks(spark, sf), DEMAND, segment="nation", price="price", cost="cost", factors=_FACTORS)
    out = op.efficient_frontier(space, "nation", _MULTIPLIERS)
    return out.withColumns({"volume": F.round("volume", 6), "profit": F.round("profit", 3)})


_DRAWS = "(VALUES " + ", ".join(f"({b!r}::DOUBLE)" for b in np.random.default_rng(12).normal(-0.8, 0.05, 50).tolist()) + ")"


@query(
    "outcome_ranges",
    with_sql(QUOTES, _DEMAND_SQL)
    + f""", d AS (SELECT segment, b, sum(1 / (1 + exp(-(base + b * ln(price))))) AS v, sum((price - cost) / (1 + exp(-(base + b * ln(price))))) AS p FROM risks, {_DRAWS} g(b) GROUP BY 1, 2)
      SELECT segment, round(quantile_cont(v, 0.05), 4) AS volume_low, round(quantile_cont(v, 0.5), 4) AS volume_mid, round(quantile_cont(v, 0.95), 4) AS volume_high,
        round(quantile_cont(p, 0.05), 2) AS profit_low, round(quantile_cont(p, 0.5), 2) AS profit_mid, round(quantile_cont(p, 0.95), 2) AS profit_high FROM d GROUP BY 1""",
)
def outcome_ranges(spark, sf):
    """Seeded draws of the price coefficient: ranges of volume and profit per segment."""
    out = op.outcome_ranges(risks(spark, sf), DEMAND, segment="segment", price="price", cost="cost", draws=50, seed=12)
    return out.select("segment", *[F.round(F.get(c, F.lit(i)), places).alias(f"{c}_{n}") for c, places in (("volume", 4), ("profit", 2)) for i, n in enumerate(("low", "mid", "high"))])


@query(
    "optimisation_run_comparison",
    with_sql(QUOTES, _DEMAND_SQL, _SPACE, _BEST)
    + """SELECT a.nation, a.factor AS factor_a, b.factor AS factor_b, round(b.factor - a.factor, 6) AS factor_change, round(b.profit - a.profit, 3) AS profit_change
      FROM (SELECT * FROM ans WHERE m = 0) a JOIN (SELECT * FROM ans WHERE m = 60000) b USING (nation)""",
)
def optimisation_run_comparison(spark, sf):
    space = op.outcomes(risks(spark, sf), DEMAND, segment="nation", price="price", cost="cost", factors=_FACTORS)
    best = op.best_factors(space, "nation", [0.0, 60000.0])
    out = op.compare_runs(best.where("multiplier = 0"), best.where("multiplier = 60000"), "nation")
    return out.select("nation", "factor_a", "factor_b", F.round("factor_change", 6).alias("factor_change"), F.round("profit_change", 3).alias("profit_change"))


@query(
    "renewal_price_check",
    with_sql(QUOTES, _DEMAND_SQL, RATES)
    + """, f AS (SELECT channel FROM risks WHERE purpose = 'new_business' AND channel IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
      x AS (SELECT r.*, coalesce(r.channel, f.channel) AS used, r.channel IS NULL AS fell_back FROM risks r, f WHERE purpose = 'renewal'),
      y AS (SELECT used, fell_back, CAST(round_even(CAST(base_minor AS DECIMAL(12,0)) * (CASE WHEN tenure > 3 THEN 1.06 ELSE 1.02 END), 0) AS BIGINT) AS ren,
         CAST(round_even(CAST(base_minor AS DECIMAL(12,0)) * (CASE WHEN used = 'web' THEN 1.01 ELSE 1.05 END), 0) AS BIGINT) AS eq FROM x)
      SELECT used AS channel, fell_back, CAST(count(*) AS BIGINT) AS checked, CAST(count(*) FILTER (ren / eq > 1) AS BIGINT) AS failing, round(max(ren / eq), 9) AS worst_ratio, round(avg(ren / eq), 9) AS mean_ratio,
        CASE WHEN count(*) FILTER (ren / eq > 1) = 0 THEN 'pass' ELSE 'fail' END AS verdict FROM y GROUP BY 1, 2""",
)
def renewal_price_check(spark, sf):
    """Renewal prices against what the same risk would pay as new business, through its own channel
    or, where that is unknown, the most common one."""
    r = risks(spark, sf)
    common = op.fallback_channel(r.where("purpose = 'new_business'"), "channel")
    renewals = r.where("purpose = 'renewal'").withColumns({"fell_back": F.col("channel").isNull(), "channel": F.coalesce("channel", F.lit(common))})
    lit = lambda x: F.lit(x).cast("decimal(4,2)")
    amount = F.col("base_minor").cast("decimal(12,0)")

    def price(purpose: str):
        factor = (
            F.when(F.col("tenure") > 3, lit("1.06")).otherwise(lit("1.02")) if purpose == "renewal" else F.when(F.col("channel") == "web", lit("1.01")).otherwise(lit("1.05"))
        )
        return F.bround(amount * factor, 0).cast("long")

    priced = renewals.withColumns({"renewal_minor": price("renewal"), "equivalent_minor": price("new_business")})
    out = None
    for channel in ("web", "broker"):
        for fell_back in (True, False):
            part = priced.where((F.col("channel") == channel) & (F.col("fell_back") == fell_back))
            row = op.renewal_check(part).select(
                F.lit(channel).alias("channel"), F.lit(fell_back).alias("fell_back"), "checked", "failing", F.round("worst_ratio", 9).alias("worst_ratio"), F.round("mean_ratio", 9).alias("mean_ratio"), "verdict"
            )
            out = row if out is None else out.unionAll(row)
    return out.where("checked > 0")


@query(
    "price_walking",
    with_sql(QUOTES, _DEMAND_SQL)
    + """SELECT tenure, CAST(count(*) AS BIGINT) AS n, round(avg((price + 50 * tenure) / cost), 6) AS mean_margin, round((SELECT regr_slope((price + 50 * tenure) / cost, tenure) FROM risks), 6) AS slope, TRUE AS rising FROM risks GROUP BY 1""",
)
def price_walking(spark, sf):
    r = risks(spark, sf).withColumn("charged", F.col("price") + 50 * F.col("tenure"))
    by_tenure, slope = op.price_walking(r, tenure="tenure", price="charged", technical="cost")
    s = slope.first()
    return by_tenure.select("tenure", "n", F.round("mean_margin", 6).alias("mean_margin"), F.round(F.lit(s["slope"]), 6).alias("slope"), F.lit(s["rising"]).alias("rising"))


@query(
    "proposal_adjacency",
    with_sql(QUOTES, _DEMAND_SQL, _SPACE, _BEST)
    + """, s AS (SELECT nation, factor, factor - lag(factor) OVER (ORDER BY nation) AS step FROM ans WHERE m = 40000)
      SELECT nation, factor, round(step, 6) AS step, coalesce(abs(step) > 0.15, FALSE) AS too_rough, coalesce(step < 0, FALSE) AS wrong_way FROM s""",
)
def proposal_adjacency(spark, sf):
    space = op.outcomes(risks(spark, sf), DEMAND, segment="nation", price="price", cost="cost", factors=_FACTORS)
    best = op.best_factors(space, "nation", [40000.0]).select("nation", "factor")
    return op.adjacency(best, "nation", max_step=0.15, increasing=True).withColumn("step", F.round("step", 6))


@query(
    "proposals_to_rate_table",
    with_sql(QUOTES, _DEMAND_SQL, _SPACE, _BEST)
    + """SELECT nation, change, round(old_value, 6) AS old_value, round(new_value, 6) AS new_value FROM (SELECT n_name AS nation, 'changed' AS change, (1.0 + 0.05 * n_regionkey)::DOUBLE AS old_value, (1.0 + 0.05 * n_regionkey) * factor AS new_value
      FROM nation JOIN ans ON ans.nation = n_name AND m = 0 WHERE n_nationkey < 12) WHERE round(old_value, 6) <> round(new_value, 6)""",
)
def proposals_to_rate_table(spark, sf):
    space = op.outcomes(risks(spark, sf), DEMAND, segment="nation", price="price", cost="cost", factors=_FACTORS)
    proposals = op.best_factors(space, "nation", [0.0])
    n = table(spark, sf, "nation")
    cells = n.select(F.col("n_name").alias("nation"), (F.lit("1.00").cast("decimal(6,2)") + F.lit("0.05").cast("decimal(6,2)") * F.col("n_regionkey").cast("decimal(4,0)")).cast("decimal(10,4)").alias("relativity"))
    accepted = [r["n_name"] for r in n.where("n_nationkey < 12").select("n_name").collect()]
    edited, _ = rt.apply_edits(cells, op.proposals_to_edits(cells, proposals, "nation", accepted), ["nation"])
    d = rt.diff_cells(cells, edited, ["nation"])
    return d.select("nation", "change", F.round(F.col("old_value").cast("double"), 6).alias("old_value"), F.round(F.col("new_value").cast("double"), 6).alias("new_value"))
