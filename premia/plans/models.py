"""Queries: models, diagnostics, comparison, perils, fairness."""

from __future__ import annotations

from pyspark.sql import functions as F

from premia.functions import losses
from premia.functions.losses import template_loss, weighted_metric
from premia.operators import boosting as bo
from premia.operators import diagnostics as dg
from premia.operators import fairness as fa
from premia.operators import glm
from premia.operators import perils as pe
from premia.operators.glm import Spec, Variant
from premia.operators.splits import assign_folds
from premia.plans.registry import query
from premia.session import stored
from premia.plans.views import BOOK, ROW_ORDER, VERSION_CUT, book, table, versions, with_sql

# -- GLM: at the fitted coefficients the score equations hold, which SQL can state -------------

FREQUENCY = Spec("claim_count", "poisson", ("p_type", "c_mktsegment", "o_orderpriority"), exposure="exposure_years")


@query(
    "glm_poisson_one_factor",
    with_sql(BOOK)
    + """, l AS (SELECT p_type AS level, round(sum(exposure_years), 6) AS e, sum(claim_count) AS c FROM book GROUP BY 1), b AS (SELECT c / e AS r FROM l ORDER BY e DESC, level LIMIT 1)
      SELECT 'p_type' AS factor, level, round(c / e / r, 6) AS relativity, round(ln(c / e / r), 6) AS estimate FROM l, b""",
)
def glm_poisson_one_factor(spark, sf):
    m = glm.fit_glm(book(spark, sf, "part"), Spec("claim_count", "poisson", ("p_type",), exposure="exposure_years"))
    return m.relativities(spark).select("factor", "level", F.round("relativity", 6).alias("relativity"), F.round("estimate", 6).alias("estimate"))


def _by_level(df, factors, *sums):
    entries = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("level")) for f in factors])
    return df.select("*", F.inline(entries)).groupBy("factor", "level").agg(*sums)


def _level_sql(factors, *sums) -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS factor, {f} AS level, {', '.join(sums)} FROM book GROUP BY 2" for f in factors)


@query(
    "glm_poisson_fit",
    with_sql(BOOK) + _level_sql(FREQUENCY.factors, "round(sum(claim_count)::DOUBLE, 3) AS observed", "round(sum(claim_count)::DOUBLE, 3) AS fitted"),
)
def glm_poisson_fit(spark, sf):
    """Three factors with an exposure offset; fitted claims equal observed claims for every level."""
    b = book(spark, sf, "part", "customer")
    scored = glm.fit_glm(b, FREQUENCY).predict(b, "mu")
    return _by_level(scored, FREQUENCY.factors, F.round(F.sum("claim_count").cast("double"), 3).alias("observed"), F.round(F.sum("mu"), 3).alias("fitted"))


SEVERITY = Spec("claim_amount_minor", "gamma", ("p_type", "c_mktsegment"), ("p_size",))


@query(
    "glm_gamma_fit",
    with_sql(BOOK) + _level_sql(SEVERITY.factors, "CAST(count(*) FILTER (claim_amount_minor > 0) AS BIGINT) AS n", "round(count(*) FILTER (claim_amount_minor > 0)::DOUBLE, 3) AS score"),
)
def glm_gamma_fit(spark, sf):
    """Severity of known positive amounts with a numeric term: sum(y / mu) equals the count per level."""
    rows, _ = glm.severity_population(book(spark, sf, "part", "customer"))
    rows = rows.where("claim_amount_minor > 0")
    scored = glm.fit_glm(rows, SEVERITY).predict(rows, "mu")
    return _by_level(scored, SEVERITY.factors, F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("claim_amount_minor") / F.col("mu")), 3).alias("score"))


TWEEDIE = Spec("cost", "tweedie", ("p_type", "c_mktsegment"), weight="exposure_years", power=1.5)


def _cost(spark, sf, *dims):
    return book(spark, sf, "part", "customer", *dims).withColumn("cost", F.col("claim_amount_minor") / F.col("exposure_years"))


@query("glm_tweedie_fit", with_sql(BOOK) + _level_sql(TWEEDIE.factors, "CAST(count(*) AS BIGINT) AS n", "1.0::DOUBLE AS score_ratio"))
def glm_tweedie_fit(spark, sf):
    b = stored(_cost(spark, sf), "cost", "exposure_years", *TWEEDIE.factors)
    scored = glm.fit_glm(b, TWEEDIE).predict(b, "mu")
    w = F.col("exposure_years") * F.pow("mu", F.lit(-0.5))
    return _by_level(scored, TWEEDIE.factors, F.count(F.lit(1)).alias("n"), F.round(F.sum(w * F.col("cost")) / F.sum(w * F.col("mu")), 5).alias("score_ratio"))


@query("glm_binomial_fit", with_sql(BOOK) + _level_sql(("p_brand", "n_name"), "round(sum(claim_count)::DOUBLE, 3) AS observed", "round(sum(claim_count)::DOUBLE, 3) AS fitted"))
def glm_binomial_fit(spark, sf):
    b = book(spark, sf, "part", "nation")
    spec = Spec("claim_count", "binomial", ("p_brand", "n_name"), link="logit")
    scored = glm.fit_glm(b, spec).predict(b, "mu")
    return _by_level(scored, spec.factors, F.round(F.sum("claim_count").cast("double"), 3).alias("observed"), F.round(F.sum("mu"), 3).alias("fitted"))


@query("glm_gaussian_fit", with_sql(BOOK) + _level_sql(("p_type", "o_orderpriority"), "round(avg(l_extendedprice), 3) AS observed", "round(avg(l_extendedprice), 3) AS fitted"))
def glm_gaussian_fit(spark, sf):
    b = book(spark, sf, "part", "orders")
    spec = Spec("l_extendedprice", "gaussian", ("p_type", "o_orderpriority"), ("l_quantity",), link="identity")
    scored = glm.fit_glm(b, spec).predict(b, "mu")
    return _by_level(scored, spec.factors, F.round(F.avg("l_extendedprice"), 3).alias("observed"), F.round(F.avg("mu"), 3).alias("fitted"))


@query("glm_negative_binomial_fit", with_sql(BOOK, "orders_book AS (SELECT 1)").replace(", orders_book AS (SELECT 1)", "")
    + """, pol AS (SELECT l_orderkey, any_value(o_orderpriority) AS o_orderpriority, any_value(c_mktsegment) AS c_mktsegment, sum(claim_count) AS n FROM book GROUP BY 1)
      SELECT 'o_orderpriority' AS factor, o_orderpriority AS level, CAST(sum(n) AS BIGINT) AS claims, 1.0::DOUBLE AS score_ratio FROM pol GROUP BY 2
      UNION ALL SELECT 'c_mktsegment', c_mktsegment, CAST(sum(n) AS BIGINT), 1.0 FROM pol GROUP BY 2""")
def glm_negative_binomial_fit(spark, sf):
    b = book(spark, sf, "customer").groupBy("l_orderkey").agg(
        F.any_value("o_orderpriority").alias("o_orderpriority"), F.any_value("c_mktsegment").alias("c_mktsegment"), F.sum("claim_count").alias("claims")
    )
    spec = Spec("claims", "negative_binomial", ("o_orderpriority", "c_mktsegment"), theta=0.3)
    scored = glm.fit_glm(b, spec).predict(b, "mu")
    w = 1 / (1 + 0.3 * F.col("mu"))
    return _by_level(scored, spec.factors, F.sum("claims").alias("claims"), F.round(F.sum(w * F.col("claims")) / F.sum(w * F.col("mu")), 5).alias("score_ratio"))


_RETURNS = """pol AS (SELECT c_custkey, any_value(c_mktsegment) AS c_mktsegment, CAST(coalesce(sum(r), 0) AS BIGINT) AS claims
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1)"""


@query(
    "glm_negative_binomial_theta",
    # With one factor the means are the levels' own; the score is positive below the root, which is found by halving.
    f"""WITH RECURSIVE {_RETURNS}, mu AS (SELECT c_mktsegment, avg(claims) AS m, count(*) AS n, sum(claims) AS s FROM pol GROUP BY 1),
      above AS (SELECT k, count(*) AS t FROM (SELECT unnest(range(claims)) AS k FROM pol) GROUP BY 1),
      half AS (SELECT 0 AS i, ln(1e-3) AS a, ln(1e5) AS b
        UNION ALL SELECT i + 1, CASE WHEN up THEN mid ELSE a END, CASE WHEN up THEN b ELSE mid END
        FROM (SELECT i, a, b, (a + b) / 2 AS mid,
            (SELECT sum(t / (exp((a + b) / 2) + k)) FROM above) + (SELECT sum(n - n * ln(1 + m / exp((a + b) / 2)) - (s + n * exp((a + b) / 2)) / (exp((a + b) / 2) + m)) FROM mu) > 0 AS up
          FROM half WHERE i < 60)),
      root AS (SELECT exp((a + b) / 2) AS theta FROM half WHERE i = 60)
      SELECT round(theta, 6) AS theta, round(1 / sqrt((SELECT sum(t / (theta + k) ** 2) FROM above)
        - (SELECT sum(n / theta - 2 * n / (theta + m) + (s + n * theta) / (theta + m) ** 2) FROM mu)), 6) AS standard_error FROM root""",
)
def glm_negative_binomial_theta(spark, sf):
    """Shape of the returned items of customers, and its error."""
    returned = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    owner = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    counts = returned.join(owner, "l_orderkey").groupBy("c_custkey").agg(F.count(F.lit(1)).alias("claims"))
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment").join(counts, "c_custkey", "left").fillna(0, ["claims"])
    found = glm.estimate_theta(rows, Spec("claims", "negative_binomial", ("c_mktsegment",)))
    return spark.createDataFrame([(round(found.value, 6), round(found.standard_error, 6))], "theta double, standard_error double")


@query("glm_model_offset", with_sql(BOOK) + _level_sql(("p_size",), "round(sum(claim_count)::DOUBLE, 3) AS observed", "round(sum(claim_count)::DOUBLE, 3) AS fitted"))
def glm_model_offset(spark, sf):
    """A second model on top of another one's linear predictor."""
    b = book(spark, sf, "part", "customer").withColumn("p_size", F.col("p_size").cast("long"))
    first = glm.fit_glm(b, FREQUENCY).linear_predictor(b, "base_eta", with_offset=False)
    second = glm.fit_glm(first, Spec("claim_count", "poisson", ("p_size",), exposure="exposure_years", offset="base_eta"))
    scored = second.predict(first, "mu").withColumn("level", F.col("p_size"))
    return scored.groupBy(F.lit("p_size").alias("factor"), F.col("p_size").cast("int").alias("level")).agg(
        F.round(F.sum("claim_count").cast("double"), 3).alias("observed"), F.round(F.sum("mu"), 3).alias("fitted")
    )


@query("glm_prediction_interval")
def glm_prediction_interval(spark, sf):
    """Bulk prediction with an interval, or the reason there is none."""
    cur, prev = versions(spark, sf, "part", "customer")
    m = glm.fit_glm(prev.where("p_type <> 'PROMO'"), FREQUENCY)
    cells = cur.groupBy(*FREQUENCY.factors).agg(F.sum("exposure_years").alias("exposure_years"))
    return m.predict_interval(cells)


@query(
    "glm_fit_statistics",
    with_sql(BOOK)
    + """, m AS (SELECT claim_count AS y, exposure_years * sum(claim_count) OVER (PARTITION BY p_type) / sum(exposure_years) OVER (PARTITION BY p_type) AS mu,
        exposure_years * sum(claim_count) OVER () / sum(exposure_years) OVER () AS m0 FROM book),
      s AS (SELECT count(*) AS n, (SELECT count(DISTINCT p_type) FROM part) AS k, 2 * sum(CASE WHEN y > 0 THEN y * ln(y / mu) ELSE 0 END - (y - mu)) AS d, 2 * sum(CASE WHEN y > 0 THEN y * ln(y / m0) ELSE 0 END - (y - m0)) AS d0,
        sum((y - mu) * (y - mu) / mu) AS x, sum(y * ln(mu) - mu) AS ll FROM m)
      SELECT CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS parameters, round(d, 3) AS deviance, round(d0, 3) AS null_deviance, round(x / (n - k), 6) AS dispersion, round(2 * k - 2 * ll, 3) AS aic, round(ln(n) * k - 2 * ll, 3) AS bic FROM s""",
)
def glm_fit_statistics(spark, sf):
    b = book(spark, sf, "part")
    s = glm.fit_statistics(b, glm.fit_glm(b, Spec("claim_count", "poisson", ("p_type",), exposure="exposure_years")))
    row = (s["n"], s["parameters"], round(s["deviance"], 3), round(s["null_deviance"], 3), round(s["dispersion"], 6), round(s["aic"], 3), round(s["bic"], 3))
    return spark.createDataFrame([row], "n long, parameters long, deviance double, null_deviance double, dispersion double, aic double, bic double")


@query("glm_type_three_tests")
def glm_type_three_tests(spark, sf):
    rows = glm.type_three(book(spark, sf, "part", "customer"), FREQUENCY)
    return spark.createDataFrame([(r["term"], r["df"], r["statistic"], r["p_value"]) for r in rows], "term string, df int, statistic double, p_value double")


@query("glm_penalty_path")
def glm_penalty_path(spark, sf):
    """Held-out deviance for every penalty and fold, all fitted together."""
    b = assign_folds(book(spark, sf, "part", "customer"), method="grouped_by_key", folds=4, seed=1, key="policy_id")
    rows = glm.cross_validate(b, FREQUENCY, [0.0, 10.0, 1000.0], "fold", 4)
    return spark.createDataFrame([(r["penalty"], r["fold"], r["score"]) for r in rows], "penalty double, fold int, score double")


@query("glm_tweedie_power")
def glm_tweedie_power(spark, sf):
    b = _cost(spark, sf).where("exposure_years > 0").withColumn("cost", F.col("cost") / 100000)
    b = stored(b, "cost", "p_type")
    grid = [1.1, 1.2, 1.3, 1.5, 1.7]
    spec = Spec("cost", "tweedie", ("p_type",))
    fits = glm.fit_variants(b, spec, [Variant(str(p), power=p) for p in grid])
    rows = b
    for i, m in enumerate(fits):
        rows = m.predict(rows, f"mu{i}")
    out = rows.agg(*[F.sum(losses.tweedie_log_density(1.0, p)("cost", f"mu{i}")).alias(f"l{i}") for i, p in enumerate(grid)])
    return out.select(F.inline(F.array(*[F.struct(F.lit(p).alias("power"), F.col(f"l{i}").alias("log_likelihood")) for i, p in enumerate(grid)])))


@query("glm_collinearity")
def glm_collinearity(spark, sf):
    b = book(spark, sf, "part").withColumn("price_per_unit", F.col("l_extendedprice") / F.col("l_quantity"))
    b = stored(b.withColumn("twice", F.col("p_size") * 2.0), "claim_count", "exposure_years", "p_type", "p_size", "price_per_unit", "twice")
    m = glm.fit_glm(b, Spec("claim_count", "poisson", ("p_type",), ("p_size", "price_per_unit", "twice"), exposure="exposure_years"))
    bad = set(glm.aliased(m))
    rows = [(k[0], k[1], v, k in bad) for k, v in glm.variance_inflation(m).items()]
    return spark.createDataFrame(rows, "term string, level string, inflation double, aliased boolean")


@query(
    "severity_population",
    with_sql(BOOK)
    + """SELECT CAST(count(*) FILTER (claim_count = 0) AS BIGINT) AS no_claims, CAST(count(*) FILTER (claim_count > 0 AND l_linenumber = 1) AS BIGINT) AS unknown_amount,
      CAST(count(*) FILTER (claim_count > 0 AND l_linenumber <> 1) AS BIGINT) AS fitted_rows FROM book""",
)
def severity_population(spark, sf):
    b = book(spark, sf).withColumn("claim_amount_minor", F.when(F.col("l_linenumber") != 1, F.col("claim_amount_minor")))
    return glm.severity_population(b)[1]


@query(
    "weight_rules",
    with_sql(BOOK) + "SELECT CAST(count(*) FILTER (l_discount = 0) AS BIGINT) AS zero_weight, CAST(count(*) FILTER (l_discount > 0) AS BIGINT) AS fitted_rows FROM book",
)
def weight_rules(spark, sf):
    rows, counts = glm.check_weights(book(spark, sf), "l_discount")
    return rows.agg(F.lit(counts["zero_weight"]).cast("long").alias("zero_weight"), F.count(F.lit(1)).alias("fitted_rows"))


@query(
    "capped_losses",
    with_sql(BOOK) + "SELECT p_type, CAST(sum(least(claim_amount_minor, 400000)) AS BIGINT) AS capped, CAST(sum(claim_amount_minor) AS BIGINT) AS uncapped FROM book GROUP BY 1",
)
def capped_losses(spark, sf):
    b = book(spark, sf, "part").withColumn("uncapped", F.col("claim_amount_minor"))
    return glm.cap_losses(b, "claim_amount_minor", 400000).groupBy("p_type").agg(F.sum("claim_amount_minor").alias("capped"), F.sum("uncapped").alias("uncapped"))


@query(
    "degenerate_levels",
    with_sql(BOOK)
    + """SELECT factor, level, claim_count, exposure_years FROM (
      SELECT 'p_brand' AS factor, p_brand AS level, CAST(sum(claim_count) AS BIGINT) AS claim_count, round(sum(exposure_years), 6) AS exposure_years FROM book GROUP BY 2
      UNION ALL SELECT 'cell', p_brand || n_name, CAST(sum(claim_count) AS BIGINT), round(sum(exposure_years), 6) FROM book GROUP BY 2) WHERE claim_count < 25""",
)
def degenerate_levels(spark, sf):
    b = book(spark, sf, "part", "nation").withColumn("cell", F.concat("p_brand", "n_name"))
    return glm.degenerate_levels(b, ["p_brand", "cell"], min_claims=25)


# -- diagnostics on a fixed prediction --------------------------------------------------------

_PREDICTED = "exposure_years * (0.4 + p_size / 100.0::DOUBLE + l_tax)"
_SCORED = f"scored AS (SELECT *, {_PREDICTED} AS predicted, exposure_years * (0.5 + l_discount * 3) AS challenger, (0.4 + p_size / 100.0::DOUBLE + l_tax) AS rate FROM book)"


def scored(spark, sf, *dims):
    rate = 0.4 + F.col("p_size") / 100.0 + F.col("l_tax")
    return book(spark, sf, "part", *dims).withColumns(
        {"predicted": F.col("exposure_years") * rate, "challenger": F.col("exposure_years") * (0.5 + F.col("l_discount") * 3)}
    )


def _ae_sql(factor: str | None) -> str:
    f = "CAST(NULL AS VARCHAR)" if factor is None else f"'{factor}'"
    level = "CAST(NULL AS VARCHAR)" if factor is None else factor
    group = "" if factor is None else " GROUP BY 2"
    return f"SELECT {f} AS factor, {level} AS level, sum(claim_count)::DOUBLE AS actual, round(sum(predicted), 6) AS expected, round(sum(exposure_years), 6) AS exposure_years, CAST(count(*) AS BIGINT) AS n_rows, round(sum(claim_count) / sum(predicted), 9) AS ratio FROM scored{group}"


@query("actual_expected", with_sql(BOOK, _SCORED) + " UNION ALL ".join(_ae_sql(f) for f in (None, "p_type", "p_brand", "o_orderpriority")))
def actual_expected(spark, sf):
    out = dg.actual_expected(scored(spark, sf, "orders"), ["p_type", "p_brand", "o_orderpriority"], actual="claim_count", predicted="predicted", exposure="exposure_years", confidence=None)
    return out.withColumns({"expected": F.round("expected", 6), "ratio": F.round("ratio", 9)})


@query("actual_expected_intervals")
def actual_expected_intervals(spark, sf):
    return dg.actual_expected(scored(spark, sf), ["p_brand"], actual="claim_count", predicted="predicted", exposure="exposure_years")


_LIFT = f"""binned AS (SELECT *, CAST(ntile(10) OVER (ORDER BY predicted / exposure_years, {ROW_ORDER}) AS INTEGER) AS bin FROM scored)"""


@query(
    "lift",
    with_sql(BOOK, _SCORED, _LIFT)
    + """SELECT bin, CAST(count(*) AS BIGINT) AS n_rows, round(sum(exposure_years), 6) AS exposure_years, round(sum(claim_count) / sum(exposure_years), 9) AS actual, round(sum(predicted) / sum(exposure_years), 9) AS predicted FROM binned GROUP BY 1""",
)
def lift(spark, sf):
    out = dg.lift(scored(spark, sf), actual="claim_count", predicted="predicted", exposure="exposure_years", tie="row_key")
    return out.withColumns({"actual": F.round("actual", 9), "predicted": F.round("predicted", 9)})


@query(
    "calibration",
    with_sql(BOOK, _SCORED, _LIFT)
    + """SELECT bin, CAST(count(*) AS BIGINT) AS n_rows, round(sum(claim_count) / sum(predicted), 9) AS ratio, round((sum(claim_count) - sum(predicted)) / sum(exposure_years), 9) AS gap FROM binned GROUP BY 1""",
)
def calibration(spark, sf):
    out = dg.calibration(scored(spark, sf), actual="claim_count", predicted="predicted", exposure="exposure_years", tie="row_key")
    return out.select("bin", "n_rows", F.round("ratio", 9).alias("ratio"), F.round("gap", 9).alias("gap"))


def _gini_sql(order: str, view: str = "scored") -> str:
    return f"""(SELECT 1 - 2 * sum(e * (cy - y / 2)) / (sum(e) * sum(y)) FROM (SELECT e, y, sum(y) OVER (ORDER BY o) AS cy FROM
       (SELECT {order} AS o, sum(exposure_years) AS e, sum(claim_count)::DOUBLE AS y FROM {view} GROUP BY 1)))"""


@query(
    "gini",
    with_sql(BOOK, _SCORED)
    + f"SELECT round({_gini_sql('predicted / exposure_years')}, 9) AS gini, round({_gini_sql('predicted / exposure_years')} / {_gini_sql('claim_count / exposure_years')}, 9) AS gini_normalised",
)
def gini(spark, sf):
    a, b = dg.normalised_gini(scored(spark, sf), actual="claim_count", predicted="predicted", exposure="exposure_years")
    return spark.createDataFrame([(round(a, 9), round(b, 9))], "gini double, gini_normalised double")


@query(
    "residual_summary",
    with_sql(BOOK, _SCORED)
    + """, r AS (SELECT claim_count - predicted AS r FROM scored) SELECT round(avg(r), 9) AS mean, round(stddev_samp(r), 9) AS std, round(min(r), 9) AS minimum, round(max(r), 9) AS maximum,
      round(quantile_cont(r, 0.01), 9) AS p01, round(quantile_cont(r, 0.99), 9) AS p99 FROM r""",
)
def residual_summary(spark, sf):
    out = dg.residual_summary(scored(spark, sf), actual="claim_count", predicted="predicted")
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


def _dev(f: str, y: str, mu: str) -> str:
    return {
        "gaussian": f"({y}-{mu})*({y}-{mu})",
        "poisson": f"2*(CASE WHEN {y}>0 THEN {y}*ln({y}/{mu}) ELSE 0 END - ({y}-{mu}))",
        "gamma": f"2*(({y}-{mu})/{mu} - ln({y}/{mu}))",
        "tweedie": f"2*(sqrt({y})/(-0.25) + 2*{y}/sqrt({mu}) + 2*sqrt({mu}))",
        "binomial": f"2*(CASE WHEN {y}>0 THEN {y}*ln({y}/{mu}) ELSE 0 END + CASE WHEN {y}<1 THEN (1-{y})*ln((1-{y})/(1-{mu})) ELSE 0 END)",
        "negative_binomial": f"2*(CASE WHEN {y}>0 THEN {y}*ln({y}/{mu}) ELSE 0 END - ({y}+2)*ln((1+0.5*{y})/(1+0.5*{mu})))",
    }[f]


@query(
    "deviance_by_family",
    with_sql(BOOK, _SCORED)
    + " UNION ALL ".join(
        f"SELECT '{f}' AS family, round(sum({_dev(f, 'y', 'mu')}), 4) AS deviance FROM (SELECT {'l_quantity' if f == 'gamma' else 'claim_count::DOUBLE'} AS y, least(predicted, 0.95) AS mu FROM scored)"
        for f in losses.FAMILIES
    ),
)
def deviance_by_family(spark, sf):
    rows = scored(spark, sf).withColumn("mu", F.least("predicted", F.lit(0.95)))
    aggs = [F.struct(F.lit(f).alias("family"), F.round(F.sum(losses.unit_deviance("l_quantity" if f == "gamma" else "claim_count", "mu", f, power=1.5, theta=0.5)), 4).alias("deviance")) for f in losses.FAMILIES]
    return rows.agg(F.array(*aggs).alias("x")).select(F.inline("x"))


@query(
    "model_complexity",
    with_sql(BOOK)
    + "SELECT CAST(14 AS INTEGER) AS parameters, round(round(sum(exposure_years), 6) / 14, 6) AS exposure_per_parameter, round(sum(claim_count) / 14, 6) AS claims_per_parameter FROM book",
)
def model_complexity(spark, sf):
    out = dg.complexity(book(spark, sf), 14)
    return out.withColumns({c: F.round(c, 6) for c in ("exposure_per_parameter", "claims_per_parameter")})


@query(
    "monotonicity",
    with_sql(BOOK)
    + """, r AS (SELECT p_type, p_size, sum(claim_count) / sum(exposure_years) AS rate FROM book GROUP BY ALL), s AS (SELECT p_type, rate - lag(rate) OVER (PARTITION BY p_type ORDER BY p_size) AS d FROM r)
      SELECT p_type, CAST(count(*) FILTER (d < 0) AS BIGINT) AS violations, round(coalesce(max(-d) FILTER (d < 0), 0), 9) AS worst FROM s GROUP BY 1""",
)
def monotonicity(spark, sf):
    rates = book(spark, sf, "part").groupBy("p_type", "p_size").agg((F.sum("claim_count") / F.sum("exposure_years")).alias("rate"))
    return dg.monotonicity(rates, group=["p_type"], order="p_size", value="rate").withColumn("worst", F.round("worst", 9))


@query(
    "partial_dependence",
    with_sql(BOOK)
    + """, l AS (SELECT p_type AS level, sum(claim_count) / sum(exposure_years) AS r, sum(exposure_years) AS e FROM book GROUP BY 1)
      SELECT 'p_type' AS factor, level, round(r, 6) AS mean_prediction, round(e / (SELECT sum(e) FROM l), 6) AS exposure_share FROM l""",
)
def partial_dependence(spark, sf):
    b = book(spark, sf, "part")
    m = glm.fit_glm(b, Spec("claim_count", "poisson", ("p_type",), exposure="exposure_years"))
    out = dg.partial_dependence(b, m, "p_type")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_prediction", "exposure_share")})


@query("permutation_importance")
def permutation_importance(spark, sf):
    b = scored(spark, sf)
    m = glm.fit_glm(b, Spec("claim_count", "poisson", ("p_type", "p_brand"), exposure="exposure_years"))
    loss = F.avg(losses.unit_deviance("claim_count", "mu", "poisson"))
    return dg.permutation_importance(b, ["p_type", "p_brand"], lambda df: m.predict(df, "mu"), loss, key="row_key", seed=3)


@query(
    "permuted_column",
    with_sql(BOOK) + "SELECT p_type, CAST(count(*) AS BIGINT) AS n FROM book GROUP BY 1",
)
def permuted_column(spark, sf):
    """A seeded permutation moves values between rows and keeps their counts."""
    return dg.permuted(book(spark, sf, "part"), "p_type", "row_key", 5).groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "quantile_crossing",
    with_sql(BOOK)
    + """, q AS (SELECT CASE WHEN l_linenumber <> 3 THEN l_tax * 2 END AS lo, l_discount AS hi FROM book)
      SELECT CAST(count(lo) AS BIGINT) AS rows_checked, CAST(count(*) FILTER (lo > hi) AS BIGINT) AS rows_crossing, round(max(lo - hi), 9) AS worst_gap FROM q""",
)
def quantile_crossing(spark, sf):
    b = book(spark, sf).withColumn("lo", F.when(F.col("l_linenumber") != 3, F.col("l_tax") * 2))
    return dg.quantile_crossing(b, "lo", "l_discount").withColumn("worst_gap", F.round("worst_gap", 9))


@query(
    "custom_metrics",
    with_sql(BOOK, _SCORED)
    + """, x AS (SELECT claim_count::DOUBLE AS y, ln(predicted) AS f, l_quantity AS w, l_tax - l_discount AS e FROM scored)
      SELECT 'poisson' AS loss, round(sum(w * (exp(f) - y * f)) / sum(w), 6) AS value FROM x UNION ALL SELECT 'gamma', round(sum(w * (y / exp(f) + f)) / sum(w), 6) FROM x
      UNION ALL SELECT 'huber', round(sum(w * CASE WHEN abs(y - f) <= 1 THEN 0.5 * (y-f)*(y-f) ELSE abs(y-f) - 0.5 END) / sum(w), 6) FROM x
      UNION ALL SELECT 'quantile', round(sum(w * CASE WHEN y >= f THEN 0.9 * (y-f) ELSE -0.1 * (y-f) END) / sum(w), 6) FROM x
      UNION ALL SELECT 'asymmetric_squared', round(sum(w * 0.5 * (CASE WHEN y < f THEN 2 ELSE 1 END) * (y-f)*(y-f)) / sum(w), 6) FROM x
      UNION ALL SELECT 'tweedie', round(sum(w * (2 * y * exp(-0.5*f) + 2 * exp(0.5*f))) / sum(w), 6) FROM x
      UNION ALL SELECT 'pseudo_huber', round(sum(w * 4 * (sqrt(1 + (y-f)*(y-f)/4) - 1)) / sum(w), 6) FROM x
      UNION ALL SELECT 'focal_binomial', round(sum(w * -(y * pow(1 - 1/(1+exp(-f)), 2) * ln(1/(1+exp(-f))) + (1-y) * pow(1/(1+exp(-f)), 2) * ln(1 - 1/(1+exp(-f))))) / sum(w), 6) FROM x
      UNION ALL SELECT 'zero_inflated_poisson', round(sum(w * CASE WHEN y = 0 THEN -ln(0.2 + 0.8 * exp(-exp(f))) ELSE -ln(0.8) + exp(f) - y * f END) / sum(w), 6) FROM x""",
)
def custom_metrics(spark, sf):
    params = {"poisson": {}, "gamma": {}, "huber": {"delta": 1.0}, "quantile": {"tau": 0.9}, "asymmetric_squared": {"w_over": 2.0}, "tweedie": {"power": 1.5},
              "pseudo_huber": {"delta": 2.0}, "focal_binomial": {"gamma": 2.0}, "zero_inflated_poisson": {"pi": 0.2}}
    rows = scored(spark, sf).withColumn("f", F.ln("predicted"))
    values = [F.struct(F.lit(n).alias("loss"), F.round(weighted_metric(template_loss(n, "claim_count", "f", p), "l_quantity"), 6).alias("value")) for n, p in params.items()]
    return rows.agg(F.array(*values).alias("x")).select(F.inline("x"))


# -- comparison -------------------------------------------------------------------------------


@query(
    "compare_models",
    with_sql(BOOK, _SCORED)
    + f""", v AS (SELECT 'ae_overall' AS metric, sum(claim_count) / sum(predicted) AS a, sum(claim_count) / sum(challenger) AS b FROM scored
      UNION ALL SELECT 'gini', {_gini_sql('predicted / exposure_years')}, {_gini_sql('challenger / exposure_years')}
      UNION ALL SELECT 'gini_normalised', {_gini_sql('predicted / exposure_years')} / {_gini_sql('claim_count / exposure_years')}, {_gini_sql('challenger / exposure_years')} / {_gini_sql('claim_count / exposure_years')}
      UNION ALL SELECT 'holdout_deviance', sum({_dev('poisson', 'claim_count::DOUBLE', 'predicted')}), sum({_dev('poisson', 'claim_count::DOUBLE', 'challenger')}) FROM scored
      UNION ALL SELECT 'rows', count(*)::DOUBLE, count(*)::DOUBLE FROM scored),
      l AS (SELECT *, CASE metric WHEN 'ae_overall' THEN CASE WHEN abs(a-1) < abs(b-1) THEN 'first' ELSE 'second' END WHEN 'holdout_deviance' THEN CASE WHEN a < b THEN 'first' ELSE 'second' END
        WHEN 'rows' THEN NULL ELSE CASE WHEN a > b THEN 'first' ELSE 'second' END END AS leader FROM v)
      SELECT metric, 'first' AS model, round(a, 4) AS value, leader FROM l UNION ALL SELECT metric, 'second', round(b, 4), leader FROM l""",
)
def compare_models(spark, sf):
    out = dg.compare_models(scored(spark, sf), {"first": "predicted", "second": "challenger"}, actual="claim_count", exposure="exposure_years")
    return out.withColumn("value", F.round("value", 4))


@query(
    "double_lift",
    with_sql(BOOK, _SCORED, f"binned AS (SELECT *, CAST(ntile(10) OVER (ORDER BY challenger / predicted, {ROW_ORDER}) AS INTEGER) AS bin FROM scored)")
    + """SELECT bin, CAST(count(*) AS BIGINT) AS n_rows, round(sum(exposure_years), 6) AS exposure_years, round(sum(claim_count) / sum(exposure_years), 9) AS actual,
      round(sum(predicted) / sum(exposure_years), 9) AS baseline_predicted, round(sum(challenger) / sum(exposure_years), 9) AS challenger_predicted FROM binned GROUP BY 1""",
)
def double_lift(spark, sf):
    out = dg.double_lift(scored(spark, sf), actual="claim_count", baseline="predicted", challenger="challenger", exposure="exposure_years", tie="row_key")
    return out.withColumns({c: F.round(c, 9) for c in ("actual", "baseline_predicted", "challenger_predicted")})


def _rel_sql(name: str, condition: str) -> str:
    return f"""(SELECT level, c / e / (SELECT c / e FROM {name} ORDER BY e DESC, level LIMIT 1) AS r FROM {name})"""


def _rel_cte(name: str, condition: str) -> str:
    return f"{name} AS (SELECT p_type AS level, round(sum(exposure_years), 6) AS e, sum(claim_count)::DOUBLE AS c FROM book WHERE {condition} GROUP BY 1)"


@query(
    "relativity_differences",
    with_sql(BOOK, _rel_cte("m1", f"start_date < DATE '{VERSION_CUT}'"), _rel_cte("m2", f"start_date >= DATE '{VERSION_CUT}' AND p_type <> 'SMALL'"))
    + f"""SELECT 'p_type' AS factor, coalesce(a.level, b.level) AS level, round(a.r, 6) AS old, round(b.r, 6) AS new, round(abs(a.r - b.r), 6) AS max_abs_difference
      FROM {_rel_sql('m1', '')} a FULL JOIN {_rel_sql('m2', '')} b ON a.level = b.level""",
)
def relativity_differences(spark, sf):
    cur, prev = versions(spark, sf, "part")
    spec = Spec("claim_count", "poisson", ("p_type",), exposure="exposure_years")
    old = glm.fit_glm(prev, spec).relativities(spark).withColumn("model", F.lit("old"))
    new = glm.fit_glm(cur.where("p_type <> 'SMALL'"), spec).relativities(spark).withColumn("model", F.lit("new"))
    out = dg.relativity_differences(old.unionAll(new), ["old", "new"])
    return out.withColumns({c: F.round(c, 6) for c in ("old", "new", "max_abs_difference")}).orderBy(F.col("max_abs_difference").desc_nulls_last(), "factor", "level")


@query(
    "backtest",
    with_sql(BOOK)
    + f""", r AS (SELECT p_type, sum(claim_count) / sum(exposure_years) AS rate FROM book WHERE start_date < DATE '{VERSION_CUT}' GROUP BY 1),
      s AS (SELECT b.*, exposure_years * rate AS expected FROM book b JOIN r USING (p_type) WHERE start_date >= DATE '{VERSION_CUT}')
      SELECT CAST(NULL AS VARCHAR) AS factor, CAST(NULL AS VARCHAR) AS level, sum(claim_count)::DOUBLE AS actual, round(sum(expected), 4) AS expected, round(sum(claim_count) / sum(expected), 6) AS ratio FROM s
      UNION ALL SELECT 'p_type', p_type, sum(claim_count)::DOUBLE, round(sum(expected), 4), round(sum(claim_count) / sum(expected), 6) FROM s GROUP BY p_type""",
)
def backtest(spark, sf):
    cur, prev = versions(spark, sf, "part", keep=["row_key", "claim_count", "exposure_years", "p_type"])
    m = glm.fit_glm(prev, Spec("claim_count", "poisson", ("p_type",), exposure="exposure_years"))
    out = dg.backtest(cur, m, actual="claim_count", exposure="exposure_years", factors=["p_type"], trained_on="1", version="2", tie="row_key")["actual_expected"]
    return out.select("factor", "level", "actual", F.round("expected", 4).alias("expected"), F.round("ratio", 6).alias("ratio"))


# -- additive models --------------------------------------------------------------------------


@query("shape_model_fit", with_sql(BOOK) + "SELECT p_type AS label, round(sum(claim_count)::DOUBLE, 0) AS observed, TRUE AS close FROM book GROUP BY 1")
def shape_model_fit(spark, sf):
    """Cyclic boosting on three binned features: after the last round each level is fitted closely."""
    b = stored(book(spark, sf, "part", "orders"), "claim_count", "exposure_years", "p_type", "o_orderpriority", "p_size")
    f = bo.make_features(b, ["p_type", "o_orderpriority"], ["p_size"], 8)
    m = bo.fit_shapes(b, f, response="claim_count", exposure="exposure_years", rounds=6)
    fitted = m.predict(b, "rate").groupBy(F.col("p_type").alias("label")).agg(
        F.round(F.sum("claim_count").cast("double"), 0).alias("observed"), F.sum(F.col("rate") * F.col("exposure_years")).alias("mu")
    )
    return fitted.select("label", "observed", (F.abs(F.col("mu") / F.col("observed") - 1) < 0.01).alias("close"))


_SHAPES = {"p_type": {"ECONOMY": 0.1, "LARGE": -0.05, "MEDIUM": 0.0, "PROMO": 0.2, "SMALL": -0.1, "STANDARD": 0.05}}


@query(
    "shape_model_score",
    with_sql(BOOK)
    + """SELECT p_type, round(sum(exp(-0.5 + CASE p_type WHEN 'ECONOMY' THEN 0.1 WHEN 'LARGE' THEN -0.05 WHEN 'MEDIUM' THEN 0.0 WHEN 'PROMO' THEN 0.2 WHEN 'SMALL' THEN -0.1 ELSE 0.05 END
      + CASE WHEN p_size >= 25 THEN 0.3 WHEN p_size >= 10 THEN 0.1 ELSE -0.2 END
      + CASE WHEN p_size >= 25 AND p_type = 'PROMO' THEN 0.07 ELSE 0 END)), 6) AS total FROM book GROUP BY 1""",
)
def shape_model_score(spark, sf):
    """Scoring per-feature bin tables and one pair grid."""
    levels = tuple(_SHAPES["p_type"])
    features = {"p_type": bo.Feature("p_type", levels=levels), "p_size": bo.Feature("p_size", cuts=(10.0, 25.0))}
    grid = [[0.0, 0.0, 0.07 if level == "PROMO" else 0.0] for level in levels]
    m = bo.ShapeModel(features, -0.5, {"p_type": list(_SHAPES["p_type"].values()), "p_size": [-0.2, 0.1, 0.3]}, {("p_type", "p_size"): grid})
    return m.predict(book(spark, sf, "part"), "mu").groupBy("p_type").agg(F.round(F.sum("mu"), 6).alias("total"))


@query("shape_model_interactions")
def shape_model_interactions(spark, sf):
    b = stored(book(spark, sf, "part", "customer"), "claim_count", "exposure_years", "p_type", "c_mktsegment", "p_size")
    f = bo.make_features(b, ["p_type", "c_mktsegment"], ["p_size"], 6)
    m = bo.fit_shapes(b, f, response="claim_count", exposure="exposure_years", rounds=4, pairs=[("p_type", "c_mktsegment"), ("p_type", "p_size")])
    rows = [(a, c, r["strength"]) for r in bo.interaction_strength(m, b) for a, c in [r["pair"]]]
    return spark.createDataFrame(rows, "first string, second string, strength double")


@query("shape_model_export")
def shape_model_export(spark, sf):
    """The fitted tables, and whether each is monotone."""
    b = stored(book(spark, sf, "part"), "claim_count", "exposure_years", "p_type", "p_size", "l_tax")
    m = bo.fit_shapes(b, bo.make_features(b, ["p_type"], ["p_size", "l_tax"], 6), response="claim_count", exposure="exposure_years", rounds=4, cap=1.0)
    return dg.monotonicity(m.export(spark), group=["feature"], order="position", value="value")


@query("boosted_trees")
def boosted_trees(spark, sf):
    b = stored(book(spark, sf, "part"), "claim_amount_minor", "l_extendedprice", "l_discount", "p_size")
    _, curve, importance = bo.boosted_trees(b, response="claim_amount_minor", features=["l_extendedprice", "l_discount", "p_size"], depth=3, rounds=4)
    rows = [("loss", str(i), v) for i, v in enumerate(curve)] + [("importance", n, v) for n, v in importance]
    return spark.createDataFrame(rows, "kind string, name string, value double")


@query("surrogate_model")
def surrogate_model(spark, sf):
    """A GLM that explains another model's predictions, and how much of them it explains."""
    b = scored(spark, sf)
    m = dg.fit_surrogate(b.withColumn("target", F.col("predicted") / F.col("exposure_years")), "target", ["p_type"], ["p_size", "l_tax"])
    rows = m.predict(b.withColumn("target", F.col("predicted") / F.col("exposure_years")), "approximation")
    q = dg.surrogate_quality(rows, target="target", approximation="approximation")
    return spark.createDataFrame([(q["r_squared"], q["deviance_explained"])], "r_squared double, deviance_explained double")


@query(
    "worst_regions",
    with_sql(BOOK, _SCORED)
    + " UNION ALL ".join(
        f"""SELECT '{f}' AS factor, {f} AS level, round(sum(exposure_years) / (SELECT sum(exposure_years) FROM scored), 9) AS exposure_share, round(avg(abs(challenger - predicted) / predicted * 100), 6) AS mean_abs_pct_error FROM scored GROUP BY 2"""
        for f in ("p_type", "p_brand")
    )
    + " ORDER BY 4 DESC, 1, 2 LIMIT 10",
)
def worst_regions(spark, sf):
    out = dg.worst_regions(scored(spark, sf), ["p_type", "p_brand"], target="predicted", approximation="challenger", exposure="exposure_years")
    return out.withColumns({"exposure_share": F.round("exposure_share", 9), "mean_abs_pct_error": F.round("mean_abs_pct_error", 6)})


@query(
    "term_contributions",
    with_sql(BOOK)
    + """, l AS (SELECT p_type, ln(sum(claim_count) / sum(exposure_years)) AS b, count(*) AS n FROM book GROUP BY 1), m AS (SELECT sum(b * n) / sum(n) AS m FROM l)
      SELECT 'p_type' AS factor, round(sum(abs(b - m) * n) / sum(n), 6) AS mean_abs_contribution FROM l, m""",
)
def term_contributions(spark, sf):
    b = book(spark, sf, "part")
    m = glm.fit_glm(b, Spec("claim_count", "poisson", ("p_type",), exposure="exposure_years"))
    return dg.contributions(b, m).withColumn("mean_abs_contribution", F.round("mean_abs_contribution", 6))


# -- perils -----------------------------------------------------------------------------------

_PERILS = [
    pe.Peril("fire", "frequency_severity", frequency="freq", severity="sev", large_loss="capped", loading=1.1),
    pe.Peril("theft", "burning_cost", burning_cost="bc", large_loss="flat_loading", loading=1.05),
    pe.Peril("flood", "burning_cost", burning_cost="bc2"),
]


def _perils(spark, sf):
    b = book(spark, sf, "part")
    return b.withColumns(
        {"freq": F.col("exposure_years") * 0.4, "sev": 150000 + F.col("p_size") * 1000.0, "bc": F.col("l_extendedprice") * 0.5, "bc2": F.col("l_quantity") * 100.0,
         "observed": F.when(F.col("l_linenumber") != 2, F.col("claim_amount_minor").cast("double")).otherwise(F.when(F.col("claim_count") == 0, F.lit(0.0)))}
    )


_PERIL_SQL = """p AS (SELECT *, exposure_years * 0.4 * (150000 + p_size * 1000.0) * 1.1 AS fire, l_extendedprice * 0.5 * 1.05 AS theft, l_quantity * 100.0 AS flood,
   CASE WHEN l_linenumber <> 2 OR claim_count = 0 THEN claim_amount_minor::DOUBLE END AS observed FROM book)"""


@query(
    "peril_risk_premium",
    with_sql(BOOK, _PERIL_SQL)
    + "SELECT p_type, round(sum(fire), 2) AS fire, round(sum(theft), 2) AS theft, round(sum(flood), 2) AS flood, round(sum(fire + theft + flood), 2) AS risk_premium FROM p GROUP BY 1",
)
def peril_risk_premium(spark, sf):
    out = pe.assemble_risk_premium(_perils(spark, sf), _PERILS)
    return out.groupBy("p_type").agg(
        *[F.round(F.sum(f"peril_{p}"), 2).alias(p) for p in ("fire", "theft", "flood")], F.round(F.sum("risk_premium"), 2).alias("risk_premium")
    )


@query(
    "peril_reconciliation",
    with_sql(BOOK, _PERIL_SQL)
    + """, s AS (SELECT sum(observed) / sum(claim_count) FILTER (observed IS NOT NULL) AS mean FROM p),
      t AS (SELECT CAST(round_even(sum(coalesce(observed, claim_count * mean)) / sum(exposure_years), 0) AS BIGINT) AS o, CAST(round_even(sum(fire) / sum(exposure_years), 0) AS BIGINT)
        + CAST(round_even(sum(theft) / sum(exposure_years), 0) AS BIGINT) + CAST(round_even(sum(flood) / sum(exposure_years), 0) AS BIGINT) AS m, CAST(count(*) FILTER (observed IS NULL) AS BIGINT) AS imputed_rows,
        round(sum(CASE WHEN observed IS NULL THEN claim_count * mean END) / sum(coalesce(observed, claim_count * mean)), 6) AS imputed_share FROM p, s)
      SELECT o AS observed_burning_cost, m AS modelled_burning_cost, round(m / o, 6) AS ratio, CASE WHEN abs(m / o - 1) <= 0.5 THEN 'pass' ELSE 'fail' END AS status, imputed_rows, imputed_share FROM t""",
)
def peril_reconciliation(spark, sf):
    out = pe.assemble_risk_premium(_perils(spark, sf), _PERILS)
    r = pe.reconcile(out, {"fire": "capped", "theft": "flat_loading", "flood": "none"}, observed="observed", exposure="exposure_years", tolerance="0.5", claims="claim_count")
    row = (r["observed_burning_cost"], r["modelled_burning_cost"], float(r["ratio"]), r["status"], r["imputed_rows"], float(r["imputed_share"]))
    return spark.createDataFrame([row], "observed_burning_cost long, modelled_burning_cost long, ratio double, status string, imputed_rows long, imputed_share double")


@query(
    "mean_claim_cost",
    with_sql(BOOK)
    + "SELECT CAST(sum(claim_amount_minor) AS BIGINT) AS amount, CAST(sum(claim_count) AS BIGINT) AS claims, round(sum(claim_amount_minor) / sum(claim_count), 6) AS mean_claim_cost FROM book WHERE l_linenumber <> 2",
)
def mean_claim_cost(spark, sf):
    b = book(spark, sf).withColumn("claim_amount_minor", F.when(F.col("l_linenumber") != 2, F.col("claim_amount_minor")))
    return pe.mean_claim_cost(b).withColumn("mean_claim_cost", F.round("mean_claim_cost", 6))


# -- fairness ---------------------------------------------------------------------------------

_SHARES = """shares AS (SELECT n_name AS k, 0.2 + 0.1 * n_regionkey AS a, 0.3::DOUBLE AS b, 1 - (0.2 + 0.1 * n_regionkey) - 0.3 AS c FROM nation WHERE n_nationkey <> 4)"""


def _shares(spark, sf):
    a = 0.2 + 0.1 * F.col("n_regionkey")
    return table(spark, sf, "nation").where("n_nationkey <> 4").select(F.col("n_name").alias("k"), a.alias("a"), F.lit(0.3).alias("b"), (1 - a - 0.3).alias("c"))


def _proxy_sql(f: str) -> str:
    joint = f"(SELECT {f} AS l, cls, sum(exposure_years * CASE cls WHEN 'a' THEN a WHEN 'b' THEN b ELSE c END) AS x FROM book JOIN shares ON n_name = k, (VALUES ('a'), ('b'), ('c')) t(cls) GROUP BY ALL)"
    return f"""SELECT '{f}' AS factor, j.cls AS "class", round(mi, 9) AS mutual_information_bits, round(mi / h, 9) AS normalised_mutual_information, round(auc, 9) AS auc FROM
      (SELECT greatest(sum(x / t * log2(x * t / (lt * ct))), 0) AS mi FROM (SELECT *, sum(x) OVER () AS t, sum(x) OVER (PARTITION BY l) AS lt, sum(x) OVER (PARTITION BY cls) AS ct FROM {joint}) WHERE x > 0),
      (SELECT -sum(q * log2(q)) AS h FROM (SELECT sum(x) / (SELECT sum(x) FROM {joint}) AS q FROM {joint} GROUP BY cls) WHERE q > 0),
      (SELECT cls, sum(pos * (below - neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM (SELECT cls, pos, neg, sum(neg) OVER (PARTITION BY cls ORDER BY score) AS below FROM
        (SELECT cls, score, sum(pos) AS pos, sum(neg) AS neg FROM (SELECT cls, x / lt AS score, x AS pos, lt - x AS neg FROM (SELECT *, sum(x) OVER (PARTITION BY l) AS lt FROM {joint})) GROUP BY ALL)) GROUP BY cls) j"""


@query("proxy_assessment", with_sql(BOOK, _SHARES) + " UNION ALL ".join(_proxy_sql(f) for f in ("n_name", "p_type", "c_mktsegment")))
def proxy_assessment(spark, sf):
    measures, _ = fa.assess_proxies(book(spark, sf, "part", "nation"), ["n_name", "p_type", "c_mktsegment"], _shares(spark, sf), key="n_name", reference_key="k", classes=["a", "b", "c"])
    return measures.withColumns({c: F.round(c, 9) for c in ("mutual_information_bits", "normalised_mutual_information", "auc")})


@query(
    "proxy_coverage",
    with_sql(BOOK, _SHARES)
    + """SELECT CAST(count(k) AS BIGINT) AS matched_rows, round(sum(exposure_years) FILTER (k IS NOT NULL), 4) AS matched_exposure, round(sum(exposure_years), 4) AS total_exposure,
      round(sum(exposure_years) FILTER (k IS NOT NULL) / sum(exposure_years), 9) AS coverage FROM book LEFT JOIN shares ON n_name = k""",
)
def proxy_coverage(spark, sf):
    _, coverage = fa.assess_proxies(book(spark, sf, "nation"), ["n_name"], _shares(spark, sf), key="n_name", reference_key="k", classes=["a", "b", "c"])
    return coverage.withColumns({"matched_exposure": F.round("matched_exposure", 4), "total_exposure": F.round("total_exposure", 4), "coverage": F.round("coverage", 9)})


@query(
    "outcome_disparity",
    with_sql(BOOK)
    + """SELECT CAST(n_regionkey AS INTEGER) AS "group", CAST(count(*) AS BIGINT) AS policies, round(sum(l_tax * 100 * exposure_years) / sum(exposure_years), 6) AS mean_change_pct,
      round(sum(l_tax * 100 * exposure_years) / sum(exposure_years) - (SELECT sum(l_tax * 100 * exposure_years) / sum(exposure_years) FROM book), 6) AS gap_pct FROM book GROUP BY 1""",
)
def outcome_disparity(spark, sf):
    b = book(spark, sf, "nation").withColumn("change", F.col("l_tax") * 100).drop("n_regionkey")
    groups = table(spark, sf, "nation").select("n_name", "n_regionkey")
    out = fa.outcome_disparity(b, groups, key="n_name", group="n_regionkey", change="change", exposure="exposure_years")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_change_pct", "gap_pct")})
