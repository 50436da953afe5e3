"""Queries: bandings, groupings, factor resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from premia.operators import banding as bd
from premia.operators import factors as fc
from premia.operators import grouping as gr
from premia.plans.registry import query
from premia.plans.views import BOOK, VERSION_CUT, book, table, versions, with_sql


def _cuts_frame(spark, banding):
    rows = [(i, round(b, 6), banding.labels[i] if i < len(banding.labels) else None) for i, b in enumerate(banding.boundaries)]
    return spark.createDataFrame(rows, "position int, boundary double, label string").select("position", "boundary")


@query(
    "banding_equal_width",
    with_sql(BOOK)
    + """SELECT CAST(i AS INTEGER) AS position, round(CASE WHEN i = 8 THEN b ELSE a + (b - a) / 8 * i END, 6) AS boundary
       FROM (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM book), range(9) t(i)""",
)
def banding_equal_width(spark, sf):
    return _cuts_frame(spark, bd.propose_banding(book(spark, sf), "l_extendedprice", "equal_width", 8))


def _weighted_cuts(column: str, weight: str, n: int) -> str:
    return f"""c AS (SELECT v, cum, max(cum) OVER () AS total FROM (SELECT v, sum(w) OVER (ORDER BY v) AS cum FROM
        (SELECT {column}::DOUBLE AS v, sum({weight}) AS w FROM book GROUP BY 1))),
      cuts AS (SELECT min(v) AS b FROM c UNION SELECT max(v) FROM c UNION SELECT (SELECT min(v) FROM c WHERE cum >= total * k / {n}) FROM range(1, {n}) t(k))
    SELECT CAST(row_number() OVER (ORDER BY b) - 1 AS INTEGER) AS position, round(b, 6) AS boundary FROM cuts"""


@query("banding_quantile", with_sql(BOOK) + ", " + _weighted_cuts("l_extendedprice", "1", 10))
def banding_quantile(spark, sf):
    return _cuts_frame(spark, bd.propose_banding(book(spark, sf), "l_extendedprice", "quantile", 10))


@query("banding_exposure_quantile", with_sql(BOOK) + ", " + _weighted_cuts("p_size", "CAST(exposure_years AS DECIMAL(18,6))", 12))
def banding_exposure_quantile(spark, sf):
    return _cuts_frame(spark, bd.propose_banding(book(spark, sf, "part"), "p_size", "exposure_quantile", 12))


@query("banding_credibility")
def banding_credibility(spark, sf):
    b = bd.propose_banding(book(spark, sf, "part"), "p_size", "credibility", 40, params={"min_claims_per_band": 700})
    return _cuts_frame(spark, b)


@query("banding_tree")
def banding_tree(spark, sf):
    return _cuts_frame(spark, bd.propose_banding(book(spark, sf, "part"), "p_size", "tree", 6))


SIZE_BANDS = bd.Banding("size", "p_size", (5.0, 11.0, 21.0, 31.0, 46.0), bd.band_labels((5.0, 11.0, 21.0, 31.0, 46.0)), null_level="unknown", above="null_level")
_SIZE_SQL = "CASE WHEN p_size IS NULL OR p_size > 46 THEN 'unknown' WHEN p_size >= 31 THEN '31+' WHEN p_size >= 21 THEN '21-30' WHEN p_size >= 11 THEN '11-20' ELSE '5-10' END"


@query(
    "band_statistics",
    with_sql(BOOK)
    + f"""SELECT {_SIZE_SQL} AS level, round(sum(exposure_years), 6) AS exposure_years, CAST(sum(claim_count) AS BIGINT) AS claim_count,
      CAST(sum(claim_amount_minor) AS BIGINT) AS claim_amount_minor, sum(claim_count) / round(sum(exposure_years), 6) AS frequency,
      CAST(list_position(['5-10','11-20','21-30','31+','unknown'], level) - 1 AS INTEGER) AS position FROM book GROUP BY 1""",
)
def band_statistics(spark, sf):
    return bd.band_statistics(book(spark, sf, "part"), SIZE_BANDS).drop("mean_severity", "mean_burning_cost")


@query(
    "band_right_closed",
    with_sql(BOOK)
    + """SELECT CASE WHEN l_quantity > 40 THEN '40+' WHEN l_quantity > 20 THEN '20-40' ELSE '0.5-20' END AS quantity_band, CAST(count(*) AS BIGINT) AS n FROM book GROUP BY 1""",
)
def band_right_closed(spark, sf):
    cuts = (0.5, 20.0, 40.0, 50.0)
    b = bd.Banding("quantity", "l_quantity", cuts, bd.band_labels(cuts, "right"), closed="right")
    return bd.apply_banding(book(spark, sf), b).groupBy("quantity_band").agg(F.count(F.lit(1)).alias("n"))


@query(
    "banding_breaches",
    with_sql(BOOK)
    + f"""SELECT band, measure, observed, minimum FROM (SELECT {_SIZE_SQL} AS band, round(sum(exposure_years), 6) AS e, sum(claim_count)::DOUBLE AS c FROM book GROUP BY 1),
       LATERAL (SELECT 'exposure' AS measure, e AS observed, 6000.0::DOUBLE AS minimum UNION ALL SELECT 'claims', c, 4000.0) x WHERE observed < minimum""",
)
def banding_breaches(spark, sf):
    from dataclasses import replace

    strict = replace(SIZE_BANDS, min_exposure=6000.0, min_claims=4000)
    rows = [(b["band"], b["measure"], b["observed"], b["minimum"]) for b in bd.check_banding(book(spark, sf, "part"), strict)]
    return spark.createDataFrame(rows, "band string, measure string, observed double, minimum double")


_LEVEL_KEY = "p_brand || '/' || n_regionkey"


def _level_book(spark, sf):
    return book(spark, sf, "part", "nation").withColumn("cell", F.concat_ws("/", "p_brand", "n_regionkey"))


def _sweep_sql(z: str, mean: str, extra: str = "") -> str:
    return f""", l AS (SELECT {_LEVEL_KEY} AS level, round(sum(exposure_years), 6) AS e, sum(claim_count)::DOUBLE AS c FROM book GROUP BY 1){extra},
      r AS (SELECT level, {z} * (c / e) + (1 - {z}) * ({mean}) AS rate FROM l),
      o AS (SELECT *, row_number() OVER (ORDER BY rate, level) AS rn FROM r),
      RECURSIVE_STEP AS (SELECT rn, level, rate, rate AS anchor, 1 AS g FROM o WHERE rn = 1
        UNION ALL SELECT o.rn, o.level, o.rate, CASE WHEN abs(o.rate - s.anchor) <= 0.002 * s.anchor THEN s.anchor ELSE o.rate END,
          CASE WHEN abs(o.rate - s.anchor) <= 0.002 * s.anchor THEN s.g ELSE s.g + 1 END FROM RECURSIVE_STEP s JOIN o ON o.rn = s.rn + 1)
      SELECT level, 'G' || g AS "group" FROM RECURSIVE_STEP"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1).replace("RECURSIVE_STEP", "swept")


def _mapping_frame(spark, grouping):
    return spark.createDataFrame(sorted(grouping.mapping.items()), "level string, `group` string")


@query(
    "grouping_limited_fluctuation",
    _recursive(with_sql(BOOK) + _sweep_sql("sqrt(least(c / 1082.2173823600122, 1))", "(SELECT sum(c) / sum(e) FROM l)")),
)
def grouping_limited_fluctuation(spark, sf):
    g = gr.propose_grouping(_level_book(spark, sf), "cell", "credibility_weighted", tolerance=0.002)
    return _mapping_frame(spark, g)


_SPREAD = "CAST(substr(p_brand, 7) AS INTEGER)"


@query(
    "buhlmann_straub_components",
    with_sql(BOOK)
    + f""", l AS (SELECT p_brand AS level, round(sum(exposure_years), 6) AS e, CAST(sum(claim_count * {_SPREAD}) AS DOUBLE) AS c FROM book GROUP BY 1),
      t AS (SELECT sum(c)/sum(e) AS m, sum(e) AS total, count(*) AS n, sum(e*e) AS e2 FROM l),
      v AS (SELECT m, (sum(e * (c/e - m) * (c/e - m)) - (any_value(n) - 1) * m) / (any_value(total) - any_value(e2) / any_value(total)) AS vhm FROM l, t GROUP BY m)
      SELECT round(m, 6) AS evpv, round(vhm, 6) AS vhm, round(m / vhm, 6) AS k FROM v""",
)
def buhlmann_straub_components(spark, sf):
    b = book(spark, sf, "part").withColumn("claim_count", F.col("claim_count") * F.substring("p_brand", 7, 9).cast("int"))
    parts = gr.buhlmann_straub(gr.level_rows(b, "p_brand"))
    return spark.createDataFrame([tuple(round(parts[x], 6) for x in ("evpv", "vhm", "k"))], "evpv double, vhm double, k double")


@query("grouping_ward")
def grouping_ward(spark, sf):
    return _mapping_frame(spark, gr.propose_grouping(_level_book(spark, sf), "cell", "hierarchical_clustering", n_groups=6))


@query("grouping_tree")
def grouping_tree(spark, sf):
    return _mapping_frame(spark, gr.propose_grouping(_level_book(spark, sf), "cell", "tree", n_groups=6))


@query(
    "grouping_hierarchy",
    """SELECT r_name AS region, CAST(count(*) AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
)
def grouping_hierarchy(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    tree = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    out = gr.group_by_hierarchy(table(spark, sf, "customer"), "c_nationkey", tree, level="n_nationkey", parent="r_name", name="region")
    return out.groupBy("region").agg(F.count(F.lit(1)).alias("n"))


BRAND_GROUPS = gr.Grouping(
    "brand", "p_brand", {f"Brand#{i}": ("low" if i <= 8 else "mid" if i <= 16 else "high") for i in range(1, 24)}, "map_to_default", "mid"
)
_BRAND_SQL = "CASE WHEN substr(p_brand, 7)::INT <= 8 THEN 'low' WHEN substr(p_brand, 7)::INT <= 16 THEN 'mid' WHEN substr(p_brand, 7)::INT <= 23 THEN 'high' ELSE 'mid' END"


@query(
    "apply_grouping",
    with_sql(BOOK)
    + f"SELECT {_BRAND_SQL} AS brand_group, CAST(count(*) AS BIGINT) AS n, CAST(sum(claim_count) AS BIGINT) AS claims FROM book GROUP BY 1",
)
def apply_grouping(spark, sf):
    out = gr.apply_grouping(book(spark, sf, "part"), BRAND_GROUPS)
    return out.groupBy("brand_group").agg(F.count(F.lit(1)).alias("n"), F.sum("claim_count").alias("claims"))


def _deviance_sql(level: str, view: str = "book") -> str:
    return f"""(SELECT 2 * sum(CASE WHEN mu > 0 THEN (CASE WHEN y > 0 THEN y * ln(y / mu) ELSE 0 END) - (y - mu) END) FROM
       (SELECT claim_count AS y, exposure_years * (sum(claim_count) OVER (PARTITION BY {level})) / (sum(exposure_years) OVER (PARTITION BY {level})) AS mu FROM {view}))"""


@query(
    "grouping_evidence",
    with_sql(BOOK, f"g AS (SELECT *, {_BRAND_SQL} AS grp FROM book)")
    + f"""SELECT CAST((SELECT count(DISTINCT p_brand) FROM book) AS BIGINT) AS source_levels, CAST(3 AS BIGINT) AS target_levels,
      round({_deviance_sql('p_brand')}, 4) AS deviance_before, round({_deviance_sql('grp', 'g')}, 4) AS deviance_after,
      CAST((SELECT count(DISTINCT p_brand) FROM book) - 3 AS BIGINT) AS df_saved""",
)
def grouping_evidence(spark, sf):
    e = gr.grouping_evidence(book(spark, sf, "part"), BRAND_GROUPS)
    row = (e["source_levels"], e["target_levels"], round(e["deviance_before"], 4), round(e["deviance_after"], 4), e["df_saved"])
    return spark.createDataFrame([row], "source_levels long, target_levels long, deviance_before double, deviance_after double, df_saved long")


FACTORS = (
    fc.Factor("size", "banding", banding=SIZE_BANDS),
    fc.Factor("brand", "grouping", grouping=BRAND_GROUPS),
    fc.Factor("segment", "identity", "c_mktsegment"),
    fc.Factor("price", "expression", expression="l_extendedprice / l_quantity", banding=bd.Banding("price", "unit", (900.0, 1300.0, 1700.0, 2100.0), ("900-1299", "1300-1699", "1700+"))),
    fc.Factor("status", "expression", expression="concat(l_linestatus, '-', l_returnflag)"),
    fc.Factor("brand_segment", "interaction", operands=("brand", "segment")),
)


@query(
    "resolve_factors",
    with_sql(BOOK)
    + f"""SELECT {_SIZE_SQL} AS size, CASE WHEN l_extendedprice / l_quantity >= 1700 THEN '1700+' WHEN l_extendedprice / l_quantity >= 1300 THEN '1300-1699' ELSE '900-1299' END AS price,
      l_linestatus || '-' || l_returnflag AS status, {_BRAND_SQL} || ' | ' || c_mktsegment AS brand_segment, CAST(count(*) AS BIGINT) AS n, round(sum(exposure_years), 6) AS exposure_years
      FROM book GROUP BY ALL""",
)
def resolve_factors(spark, sf):
    r = fc.resolve_factors(book(spark, sf, "part", "customer"), FACTORS)
    return r.df.groupBy(*[F.col(c).alias(s) for s, c in r.terms.items()]).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("exposure_years"), 6).alias("exposure_years")
    )


_FACTOR_COLUMNS = (("size", "p_size"), ("brand", "p_brand"), ("segment", "c_mktsegment"), ("price", "l_quantity"), ("price", "l_extendedprice"), ("status", "l_returnflag"), ("status", "l_linestatus"))


@query(
    "factor_columns_read",
    with_sql(BOOK) + " UNION ALL ".join(f"SELECT '{f}' AS factor, '{c}' AS \"column\", count(DISTINCT {c}) AS levels FROM book" for f, c in _FACTOR_COLUMNS),
)
def factor_columns_read(spark, sf):
    """Columns that each factor reads, expressions by their resolved trees, and how many levels they have."""
    b = book(spark, sf, "part", "customer")
    pairs = [(f.slug, c) for f in FACTORS for c in fc.factor_columns(b, f)]
    needed = fc.needed_columns(FACTORS, df=b)
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in needed])
    levels = b.select(F.inline(entries)).where("level is not null").distinct().groupBy("column").agg(F.count(F.lit(1)).alias("levels"))
    return spark.createDataFrame(pairs, "factor string, column string").join(levels, "column")


@query(
    "unseen_level_counts",
    with_sql(BOOK, f"b AS (SELECT *, CASE WHEN start_date >= DATE '{VERSION_CUT}' AND p_size > 45 THEN 'big' ELSE p_type END AS kind FROM book)")
    + f"""SELECT kind = 'big' OR o_orderpriority = '5-LOW' AS unseen, CAST(count(*) AS BIGINT) AS n_rows, round(sum(exposure_years), 6) AS exposure_years
      FROM b WHERE start_date >= DATE '{VERSION_CUT}' GROUP BY 1""",
)
def unseen_level_counts(spark, sf):
    cur, prev = versions(spark, sf, "part")
    cur = cur.withColumn("kind", F.when(F.col("p_size") > 45, "big").otherwise(F.col("p_type")))
    prev = prev.withColumn("kind", F.col("p_type")).where("o_orderpriority <> '5-LOW'")
    return fc.unseen_counts(cur, ["kind", "o_orderpriority"], prev)


@query(
    "unseen_cells",
    with_sql(BOOK)
    + """, k AS (SELECT DISTINCT p_type AS a, n_name AS b, c_mktsegment AS c FROM book WHERE p_size = 7),
      grid AS (SELECT a, b, c FROM (SELECT DISTINCT p_type AS a FROM part), (SELECT n_name AS b FROM nation), (SELECT DISTINCT c_mktsegment AS c FROM customer))
      SELECT a AS p_type, b AS n_name, c AS c_mktsegment, CAST((SELECT count(*) FROM (SELECT * FROM grid EXCEPT SELECT * FROM k)) AS BIGINT) AS n_unseen
      FROM (SELECT * FROM grid EXCEPT SELECT * FROM k) ORDER BY 1, 2, 3 LIMIT 20""",
)
def unseen_cells(spark, sf):
    levels = {}
    for t, c in (("part", "p_type"), ("nation", "n_name"), ("customer", "c_mktsegment")):
        levels[c] = [r[0] for r in table(spark, sf, t).select(c).distinct().collect()]
    columns = ["p_type", "n_name", "c_mktsegment"]
    fitted = fc.cells(book(spark, sf, "part", "nation").where("p_size = 7"), columns)
    n, examples = fc.unseen_cells(levels, fitted, columns)
    return spark.createDataFrame([(*e, n) for e in examples], "p_type string, n_name string, c_mktsegment string, n_unseen long")
