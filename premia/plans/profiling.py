"""Queries: profiling, one-ways, profile comparison, reference data."""

from __future__ import annotations

from pyspark.sql import functions as F

from premia.operators import profile as prof
from premia.operators import reference as ref
from premia.plans.registry import query
from premia.plans.views import BOOK, VERSION_CUT, book, policy_exposure, POLICY_EXPOSURE, table, versions, with_sql
from premia.sources import sinks

_ONE_WAY_SQL = """SELECT {level} AS level, round(sum(exposure_years), 6) AS exposure_years, CAST(sum(claim_count) AS BIGINT) AS claim_count,
  CAST(sum(claim_amount_minor) AS BIGINT) AS claim_amount_minor,
  sum(claim_count) / round(sum(exposure_years), 6) AS frequency,
  CASE WHEN sum(claim_count) <> 0 THEN sum(claim_amount_minor) / sum(claim_count) END AS mean_severity,
  sum(claim_amount_minor) / round(sum(exposure_years), 6) AS mean_burning_cost FROM book GROUP BY 1"""


@query("one_way", with_sql(BOOK) + _ONE_WAY_SQL.format(level="o_orderpriority"))
def one_way(spark, sf):
    return prof.one_way(book(spark, sf, "orders"), "o_orderpriority")


@query("one_way_null_level", with_sql(BOOK) + _ONE_WAY_SQL.format(level="nullif(c_mktsegment, 'BUILDING')"))
def one_way_null_level(spark, sf):
    b = book(spark, sf, "customer").withColumn("seg", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")))
    return prof.one_way(b, "seg")


@query("one_way_intervals")
def one_way_intervals(spark, sf):
    return prof.one_way(book(spark, sf, "part"), "p_brand", confidence=0.95)


_FACTORS = ["o_orderpriority", "p_brand", "p_type", "c_mktsegment", "n_name"]


@query(
    "one_ways_many_factors",
    with_sql(BOOK)
    + " UNION ALL ".join(
        "SELECT '%s' AS factor, * FROM (%s)" % (f, _ONE_WAY_SQL.format(level=f)) for f in _FACTORS
    ),
)
def one_ways_many_factors(spark, sf):
    return prof.one_ways(book(spark, sf, "part", "nation"), _FACTORS)


_PROFILE_COLUMNS = ["l_quantity", "price_whole", "l_tax_known", "l_linenumber", "l_returnflag", "l_shipdate", "claim_amount_minor"]


def _profile_input(spark, sf):
    derived = {"l_tax_known": F.nullif(F.col("l_tax"), F.lit(0.0)), "price_whole": F.floor("l_extendedprice").cast("double")}
    return book(spark, sf).withColumns(derived).select(*_PROFILE_COLUMNS, "exposure_years")


_PROFILE_VIEW = "src AS (SELECT *, nullif(l_tax, 0) AS l_tax_known, floor(l_extendedprice) AS price_whole FROM book)"


def _profile_sql(column: str, dtype: str, semantic: str, numeric: bool) -> str:
    base = f"""SELECT '{column}' AS "column", '{dtype}' AS dtype, '{semantic}' AS semantic_type, CAST(count(*) AS BIGINT) AS n_rows,
      CAST(count(*) - count({column}) AS BIGINT) AS null_count, round((count(*) - count({column})) / count(*), 9) AS null_rate,
      CAST(count(DISTINCT {column}) AS BIGINT) AS distinct_count, """
    if numeric:
        parts = [f"CAST(min({column}) AS DOUBLE) AS minimum", f"CAST(max({column}) AS DOUBLE) AS maximum",
                 f"round(avg({column}), 4) AS mean", f"round(stddev_samp({column}), 4) AS std"]
        parts += [f"round(quantile_cont({column}, {q})::DOUBLE, 6) AS p{round(q*100)}" for q in prof.QUANTILES]
    else:
        parts = [f"CAST(NULL AS DOUBLE) AS {x}" for x in ["minimum", "maximum", "mean", "std", *[f"p{round(q*100)}" for q in prof.QUANTILES]]]
    return base + ", ".join(parts) + " FROM src"


@query(
    "profile",
    with_sql(BOOK, _PROFILE_VIEW)
    + " UNION ALL ".join(
        [
            _profile_sql("l_quantity", "double", "continuous", True),
            _profile_sql("price_whole", "double", "continuous", True),
            _profile_sql("l_tax_known", "double", "continuous", True),
            _profile_sql("l_linenumber", "int", "ordinal", True),
            _profile_sql("l_returnflag", "string", "categorical", False),
            _profile_sql("l_shipdate", "timestamp_ntz", "date", False),
            _profile_sql("claim_amount_minor", "bigint", "money", True),
        ]
    ),
)
def profile(spark, sf):
    df = prof.profile(_profile_input(spark, sf), _PROFILE_COLUMNS)
    rounded = {c: F.round(c, 4) for c in ("mean", "std")} | {f"p{round(q * 100)}": F.round(f"p{round(q * 100)}", 6) for q in prof.QUANTILES}
    return df.withColumns(rounded | {"null_rate": F.round("null_rate", 9)})


def _histogram_sql(column: str) -> str:
    return f"""SELECT '{column}' AS "column", CAST(b AS INTEGER) AS bin, round(lo + w*b, 6) AS low,
      round(CASE WHEN b = 19 THEN hi ELSE lo + w*(b+1) END, 6) AS high, CAST(count(x) AS BIGINT) AS n, round(coalesce(sum(e), 0), 6) AS exposure
      FROM (SELECT min({column})::DOUBLE AS lo, max({column})::DOUBLE AS hi, (max({column}) - min({column}))::DOUBLE / 20 AS w FROM book) r
      CROSS JOIN range(20) t(b)
      LEFT JOIN (SELECT {column} AS x, exposure_years AS e FROM book) v
        ON least(greatest(floor((v.x - r.lo) / r.w), 0), 19) = t.b
      GROUP BY ALL"""


@query("histograms", with_sql(BOOK) + " UNION ALL ".join(_histogram_sql(c) for c in ("l_extendedprice", "p_size", "l_discount")))
def histograms(spark, sf):
    df = prof.histograms(book(spark, sf, "part"), ["l_extendedprice", "p_size", "l_discount"], "exposure_years")
    return df.withColumns({"low": F.round("low", 6), "high": F.round("high", 6), "exposure": F.round("exposure", 6)})


def _top_sql(column: str) -> str:
    return f"""SELECT '{column}' AS "column", CAST(rk AS INTEGER) AS rank, level, n, exposure_years FROM (
      SELECT CAST({column} AS VARCHAR) AS level, CAST(count(*) AS BIGINT) AS n, round(sum(exposure_years), 6) AS exposure_years,
        row_number() OVER (ORDER BY count(*) DESC, CAST({column} AS VARCHAR) ASC NULLS LAST) AS rk FROM src GROUP BY 1) WHERE rk <= 20"""


@query(
    "top_levels",
    with_sql(BOOK, "src AS (SELECT *, nullif(o_orderpriority, '1-URGENT') AS level_known FROM book)")
    + " UNION ALL ".join(_top_sql(c) for c in ("p_size", "n_name", "level_known", "l_linenumber")),
)
def top_levels(spark, sf):
    b = book(spark, sf, "part", "nation").withColumn("level_known", F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT")))
    return prof.top_levels(b, ["p_size", "n_name", "level_known", "l_linenumber"], "exposure_years")


@query(
    "candidate_rating_columns",
    """SELECT * FROM (VALUES ('l_linenumber'), ('l_returnflag'), ('l_linestatus'), ('o_orderpriority'), ('p_brand'), ('p_type'), ('c_mktsegment'), ('n_name')) t("column")""",
)
def candidate_rating_columns(spark, sf):
    columns = ["l_linenumber", "l_returnflag", "l_linestatus", "o_orderpriority", "p_brand", "p_type", "c_mktsegment", "n_name",
               "l_quantity", "exposure_years", "claim_count", "claim_amount_minor", "start_date", "l_orderkey"]
    b = book(spark, sf, "part", "nation").select(*columns)
    found = prof.candidate_rating_columns(prof.column_counts(b, columns))
    return spark.createDataFrame([(c,) for c in found], "column string")


def _psi_sql(column: str, weight: str) -> str:
    return f"""SELECT '{column}' AS "column", round(sum((greatest(coalesce(a.s,0),1e-6) - greatest(coalesce(b.s,0),1e-6))
       * ln(greatest(coalesce(a.s,0),1e-6) / greatest(coalesce(b.s,0),1e-6))), 9) AS psi
      FROM (SELECT {column} AS level, {weight} / sum({weight}) OVER () AS s FROM book WHERE start_date >= DATE '{VERSION_CUT}' AND {column} IS NOT NULL GROUP BY 1) a
      FULL JOIN (SELECT {column} AS level, {weight} / sum({weight}) OVER () AS s FROM book WHERE start_date < DATE '{VERSION_CUT}' AND {column} IS NOT NULL GROUP BY 1) b
      ON a.level = b.level"""


_PSI_COLUMNS = ["o_orderpriority", "p_brand", "p_type", "p_size"]


@query("psi_by_count", with_sql(BOOK) + " UNION ALL ".join(_psi_sql(c, "count(*)::DOUBLE") for c in _PSI_COLUMNS))
def psi_by_count(spark, sf):
    from premia.operators.ingest import level_counts

    cur, prev = versions(spark, sf, "part")
    out = prof.psi(level_counts(cur, _PSI_COLUMNS), level_counts(prev, _PSI_COLUMNS))
    return out.withColumn("psi", F.round("psi", 9))


@query("psi_by_exposure", with_sql(BOOK) + " UNION ALL ".join(_psi_sql(c, "sum(exposure_years)") for c in _PSI_COLUMNS))
def psi_by_exposure(spark, sf):
    from premia.operators.ingest import level_counts

    cur, prev = versions(spark, sf, "part")
    out = prof.psi(
        level_counts(cur, _PSI_COLUMNS, "exposure_years"), level_counts(prev, _PSI_COLUMNS, "exposure_years"), weight="weight"
    )
    return out.withColumn("psi", F.round("psi", 9))


def _compare_sql(column: str, numeric: bool) -> str:
    mean = f"round(avg({column}) FILTER (cur) - avg({column}) FILTER (NOT cur), 6)" if numeric else "CAST(NULL AS DOUBLE)"
    top = lambda cur: f"""(SELECT CAST({column} AS VARCHAR) AS level, count(*)::DOUBLE AS n FROM two WHERE {cur} GROUP BY 1)"""
    share = lambda cur: f"(SELECT level, n / sum(n) OVER () AS s FROM {top(cur)} WHERE level IS NOT NULL)"
    return f"""SELECT '{column}' AS "column", x.psi, m.mean_shift, m.null_rate_shift, x.new_levels, x.vanished_levels, m.row_count_ratio FROM
      (SELECT {mean} AS mean_shift, round(avg(CASE WHEN {column} IS NULL THEN 1.0::DOUBLE ELSE 0 END) FILTER (cur)
           - avg(CASE WHEN {column} IS NULL THEN 1.0::DOUBLE ELSE 0 END) FILTER (NOT cur), 9) AS null_rate_shift,
         round(count(*) FILTER (cur) / count(*) FILTER (NOT cur), 9) AS row_count_ratio FROM two) m,
      (SELECT round(sum((greatest(coalesce(a.s,0),1e-6) - greatest(coalesce(b.s,0),1e-6)) * ln(greatest(coalesce(a.s,0),1e-6) / greatest(coalesce(b.s,0),1e-6))), 9) AS psi,
         CAST(count(*) FILTER (b.level IS NULL) AS BIGINT) AS new_levels, CAST(count(*) FILTER (a.level IS NULL) AS BIGINT) AS vanished_levels
       FROM {share('cur')} a FULL JOIN {share('NOT cur')} b ON a.level = b.level) x"""


@query(
    "compare_profiles",
    with_sql(BOOK, f"two AS (SELECT *, start_date >= DATE '{VERSION_CUT}' AS cur, nullif(o_orderpriority, CASE WHEN start_date >= DATE '{VERSION_CUT}' THEN '5-LOW' ELSE '1-URGENT' END) AS priority FROM book)")
    + " UNION ALL ".join([_compare_sql("priority", False), _compare_sql("p_size", True), _compare_sql("n_name", False), _compare_sql("l_linenumber", True)]),
)
def compare_profiles(spark, sf):
    cur, prev = versions(spark, sf, "part", "nation")
    cur = cur.withColumn("priority", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")))
    prev = prev.withColumn("priority", F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT")))
    out = prof.compare_profiles(cur, prev, ["priority", "p_size", "n_name", "l_linenumber"])
    return out.withColumns(
        {
            "psi": F.round("psi", 9),
            "mean_shift": F.round("mean_shift", 6),
            "null_rate_shift": F.round("null_rate_shift", 9),
            "row_count_ratio": F.round("row_count_ratio", 9),
        }
    )


@query(
    "level_set_difference",
    with_sql(BOOK)
    + f"""SELECT 'p_brand_size' AS "column", level, change FROM (
      SELECT coalesce(a.level, b.level) AS level, CASE WHEN b.level IS NULL THEN 'new' WHEN a.level IS NULL THEN 'vanished' END AS change
      FROM (SELECT DISTINCT p_brand || '/' || n_name || '/' || p_size AS level FROM book WHERE start_date >= DATE '{VERSION_CUT}') a
      FULL JOIN (SELECT DISTINCT p_brand || '/' || n_name || '/' || p_size AS level FROM book WHERE start_date < DATE '{VERSION_CUT}') b ON a.level = b.level)
      WHERE change IS NOT NULL""",
)
def level_set_difference(spark, sf):
    from premia.operators.ingest import level_counts

    cur, prev = versions(spark, sf, "part", "nation")
    name = {"p_brand_size": F.concat_ws("/", "p_brand", "n_name", "p_size")}
    return prof.level_changes(
        level_counts(cur.withColumns(name), ["p_brand_size"]), level_counts(prev.withColumns(name), ["p_brand_size"])
    )


# -- reference data --------------------------------------------------------------------------

_REFERENCE = """refrows AS (SELECT n_name AS key, DATE '1900-01-01' AS effective_from, DATE '1998-01-01' AS effective_to, n_regionkey * 5 AS loading FROM nation
   UNION ALL SELECT n_name, DATE '1998-01-01', NULL, n_regionkey * 7 + 1 FROM nation WHERE n_nationkey <> 3)"""


def reference_rows(spark, sf):
    n = table(spark, sf, "nation")
    date = lambda d: F.lit(d).cast("date")
    old = n.select(F.col("n_name").alias("key"), date("1900-01-01").alias("effective_from"), date("1998-01-01").alias("effective_to"),
                   (F.col("n_regionkey") * 5).alias("loading"))
    new = n.where("n_nationkey <> 3").select("n_name", date("1998-01-01"), date(None), F.col("n_regionkey") * 7 + 1)
    return old.unionAll(new)


@query(
    "reference_lookup_as_at",
    with_sql(BOOK, _REFERENCE)
    + """SELECT n_name, CAST(loading AS BIGINT) AS loading, CAST(count(*) AS BIGINT) AS n FROM book LEFT JOIN refrows ON n_name = key
       AND effective_from <= start_date AND (effective_to IS NULL OR start_date < effective_to) GROUP BY ALL""",
)
def reference_lookup_as_at(spark, sf):
    b = book(spark, sf, "nation").withColumn("key", F.col("n_name"))
    found = ref.lookup_as_at(b, reference_rows(spark, sf), ["key"], "start_date")
    return found.groupBy("n_name", F.col("loading").cast("long").alias("loading")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "reference_resolve_all",
    with_sql(_REFERENCE)
    + """SELECT n_name AS key, CAST(loading AS BIGINT) AS loading, loading IS NULL AS missing FROM nation LEFT JOIN refrows ON n_name = key
       AND effective_from <= DATE '1999-06-01' AND (effective_to IS NULL OR DATE '1999-06-01' < effective_to)""",
)
def reference_resolve_all(spark, sf):
    keys = table(spark, sf, "nation").select(F.col("n_name").alias("key"), F.lit("1999-06-01").cast("date").alias("as_at"))
    found, missing = ref.resolve_all(keys, reference_rows(spark, sf), "key", "as_at")
    return found.select("key", F.col("loading").cast("long").alias("loading"), F.lit(False).alias("missing")).unionAll(
        missing.select("key", F.lit(None).cast("long"), F.lit(True))
    )


@query(
    "reference_overlaps",
    with_sql(POLICY_EXPOSURE)
    + """SELECT policy_id, CAST(count(*) AS BIGINT) AS overlapping_rows FROM (SELECT policy_id,
         max(exposure_end) OVER (PARTITION BY policy_id ORDER BY exposure_start, period_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > exposure_start AS inside
         FROM policy_exposure) WHERE inside GROUP BY 1""",
)
def reference_overlaps(spark, sf):
    found = ref.overlaps(policy_exposure(spark, sf), ["policy_id"], "exposure_start", "exposure_end")
    return found.groupBy("policy_id").agg(F.sum("overlapping_rows").alias("overlapping_rows"))


@query(
    "reference_in_force",
    with_sql(_REFERENCE)
    + """SELECT key, strftime(effective_from, '%Y-%m-%d') AS effective_from, CAST(loading AS BIGINT) AS loading FROM refrows
         WHERE effective_from <= DATE '1998-01-01' AND (effective_to IS NULL OR DATE '1998-01-01' < effective_to)""",
)
def reference_in_force(spark, sf):
    rows = reference_rows(spark, sf)
    path = ref.load_version(rows, ["key"], sinks.scratch_path(spark, "reference"))
    return ref.in_force(spark.read.parquet(path), "1998-01-01", ["key"]).select(
        "key", F.col("effective_from").cast("string").alias("effective_from"), F.col("loading").cast("long").alias("loading")
    )


@query(
    "reference_version_stats",
    with_sql(_REFERENCE)
    + """SELECT name, n_rows, covers_from, covers_to FROM (
        SELECT 'open' AS name, CAST(count(*) AS BIGINT) AS n_rows, strftime(min(effective_from), '%Y-%m-%d') AS covers_from, CAST(NULL AS VARCHAR) AS covers_to FROM refrows
        UNION ALL SELECT 'closed', CAST(count(*) AS BIGINT), strftime(min(effective_from), '%Y-%m-%d'), strftime(max(effective_to), '%Y-%m-%d') FROM refrows WHERE effective_to IS NOT NULL)""",
)
def reference_version_stats(spark, sf):
    rows = reference_rows(spark, sf)
    out = []
    for name, df in (("open", rows), ("closed", rows.where("effective_to is not null"))):
        out.append(ref.version_stats(df).select(F.lit(name).alias("name"), "n_rows", F.col("covers_from").cast("string").alias("covers_from"), F.col("covers_to").cast("string").alias("covers_to")))
    return out[0].unionAll(out[1])


@query(
    "route_by_date",
    """SELECT CASE WHEN d < DATE '1996-01-01' THEN NULL WHEN d < DATE '1997-07-01' THEN 'v1' ELSE 'v2' END AS version, CAST(count(*) AS BIGINT) AS n
       FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders) GROUP BY 1""",
)
def route_by_date(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    spans = table(spark, sf, "region").where("r_regionkey < 2").select(
        F.concat(F.lit("v"), (F.col("r_regionkey") + 1).cast("string")).alias("version"),
        F.when(F.col("r_regionkey") == 0, "1996-01-01").otherwise("1997-07-01").cast("date").alias("effective_from"),
        F.when(F.col("r_regionkey") == 0, "1997-07-01").cast("date").alias("effective_to"),
    )
    return ref.route_by_date(o, spans, "d").groupBy("version").agg(F.count(F.lit(1)).alias("n"))
