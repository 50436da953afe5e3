"""Queries: sources, ingestion, preparation, scalar functions, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from premia.functions import scalar
from premia.operators import columns_read as lineage
from premia.operators import ingest, prepare, splits
from premia.plans.registry import query
from premia.plans.views import (
    BOOK, CLAIM, POLICY_EXPOSURE, VERSION_CUT, book, claim, policy_exposure, table, with_sql,
)
from premia.sources import files, sinks


# -- sources and sinks -----------------------------------------------------------------------


@query(
    "delimited_scan",
    """SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n, CAST(sum(c_custkey) AS BIGINT) AS key_sum,
       CAST(count(CASE WHEN c_nationkey <> 0 THEN 1 END) AS BIGINT) AS with_nation
     FROM customer GROUP BY 1""",
)
def delimited_scan(spark, sf):
    """CSV (gzip) written and read as text with null texts, then typed by declared casts."""
    path = sinks.scratch_path(spark, "customer-csv")
    nation = F.when(F.col("c_nationkey") == 0, "N/A").otherwise(F.col("c_nationkey").cast("string"))
    table(spark, sf, "customer").withColumn("c_nationkey", nation).write.option("header", True).option(
        "compression", "gzip"
    ).csv(path)
    df = files.read_delimited(spark, path)
    return (
        df.withColumn("c_custkey", scalar.cast_to("c_custkey", "int"))
        .groupBy("c_mktsegment")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("c_custkey").alias("key_sum"),
            F.count("c_nationkey").alias("with_nation"),
        )
    )


@query(
    "tab_separated_scan",
    "SELECT r_name, CAST(count(*) AS BIGINT) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
)
def tab_separated_scan(spark, sf):
    path = sinks.scratch_path(spark, "nation-tsv")
    table(spark, sf, "nation").write.option("header", True).option("sep", "\t").csv(path)
    n = files.read_tabs(spark, path).withColumn("n_regionkey", scalar.cast_to("n_regionkey", "int32"))
    r = table(spark, sf, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("nations"))


@query(
    "versioned_table_write",
    """SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n, round(sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE, 2) AS total
       FROM orders GROUP BY 1""",
)
def versioned_table_write(spark, sf):
    """A parquet+zstd table version, written as two files' worth of folders and scanned as one table."""
    root = sinks.scratch_path(spark, "versions")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    paths = [
        sinks.write_table(o.where(F.col("o_orderkey") % 2 == part), sinks.version_path(root, f"orders-{part}", 1, "orders"))
        for part in (0, 1)
    ]
    return (
        files.read_parquet(spark, *paths)
        .groupBy("o_orderpriority")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), 2).alias("total"),
        )
    )


@query(
    "content_fingerprint",
    """SELECT name, CAST(n AS BIGINT) AS n_rows, TRUE AS same_after_reordering FROM
       (SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders)""",
)
def content_fingerprint(spark, sf):
    rows = []
    for name in ("customer", "orders"):
        df = table(spark, sf, name)
        first = files.content_fingerprint(df).first()
        again = files.content_fingerprint(df.repartition(5, df.columns[0])).first()
        rows.append((name, first["n_rows"], first["fingerprint"] == again["fingerprint"]))
    return spark.createDataFrame(rows, "name string, n_rows long, same_after_reordering boolean")


@query(
    "new_arrivals",
    """SELECT o_orderkey AS idempotency_key, sha256(concat_ws('|', o_orderkey, o_orderstatus)) AS fingerprint
       FROM orders WHERE o_orderdate >= TIMESTAMP '1998-04-01'""",
)
def new_arrivals(spark, sf):
    o = table(spark, sf, "orders")
    keyed = o.select(
        F.col("o_orderkey").alias("idempotency_key"),
        F.sha2(F.concat_ws("|", "o_orderkey", "o_orderstatus"), 256).alias("fingerprint"),
        F.col("o_orderdate").cast("date").alias("d"),
    )
    log = keyed.where(F.col("d") < F.lit(VERSION_CUT).cast("date"))
    return files.new_arrivals(keyed.drop("d"), log)


# -- ingestion -------------------------------------------------------------------------------


@query(
    "normalised_columns",
    """SELECT o_orderpriority AS order_priority, CAST(count(*) AS BIGINT) AS col_2026_rows, CAST(count(DISTINCT o_custkey) AS BIGINT) AS policy_id_count
       FROM orders GROUP BY 1""",
)
def normalised_columns(spark, sf):
    raw = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("Order-Priority")).agg(
        F.count(F.lit(1)).alias("2026 rows"), F.count_distinct("o_custkey").alias("PolicyID (count)")
    )
    return ingest.with_normalised_columns(raw)


_RAW_ORDERS = """raw AS (
  SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS level, nullif(o_orderstatus, 'P') AS status,
         o_totalprice FROM orders)"""


def _raw_orders(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("level"),
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"),
        "o_totalprice",
    )


def _inferred_sql(view: str, columns: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS dtype, CAST(count(*) - count({c}) AS BIGINT) AS null_count,
        CAST(count(DISTINCT {c}) + CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END AS BIGINT) AS distinct_count,
        count({c}) < count(*) AS nullable,
        count(*) > 1 AND count({c}) = count(*) AND count(DISTINCT {c}) = count(*) AS is_candidate_key FROM {view}"""
        for c, t in columns
    )


@query(
    "infer_schema",
    with_sql(_RAW_ORDERS)
    + _inferred_sql("raw", [("o_orderkey", "bigint"), ("level", "string"), ("status", "string"), ("o_totalprice", "double")]),
)
def infer_schema(spark, sf):
    return ingest.infer_schema(_raw_orders(spark, sf))


@query(
    "date_format_sniff",
    """SELECT * FROM (VALUES ('iso', '%Y-%m-%d'), ('british', '%d/%m/%Y'), ('named', '%d %b %Y'), ('stamp', '%Y-%m-%dT%H:%M:%S'), ('text', NULL)) t("column", date_format)""",
)
def date_format_sniff(spark, sf):
    d = F.col("o_orderdate")
    texts = table(spark, sf, "orders").select(
        "o_orderkey",
        F.date_format(d, "yyyy-MM-dd").alias("iso"),
        F.date_format(d, "dd/MM/yyyy").alias("british"),
        F.date_format(d, "dd MMM yyyy").alias("named"),
        F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss").alias("stamp"),
        F.col("o_orderpriority").alias("text"),
    )
    names = ["iso", "british", "named", "stamp", "text"]
    found = [(c, ingest.sniff_date_format(texts, c)) for c in names]
    return spark.createDataFrame(found, "column string, date_format string")


@query(
    "partition_rejects",
    with_sql(_RAW_ORDERS)
    + """SELECT CASE WHEN level IS NULL THEN 'level is null' WHEN status IS NULL THEN 'status is null' ELSE 'clean' END AS outcome,
         CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM raw GROUP BY 1""",
)
def partition_rejects(spark, sf):
    clean, rejected = ingest.partition_rejects(_raw_orders(spark, sf), ["level", "status"])
    both = clean.withColumn("outcome", F.lit("clean")).unionByName(
        rejected.withColumn("outcome", F.col(ingest.REASON)), allowMissingColumns=True
    )
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum"))


@query(
    "reject_rate",
    with_sql(_RAW_ORDERS)
    + """SELECT CAST(count(level) AS BIGINT) AS clean_rows, CAST(count(*)-count(level) AS BIGINT) AS rejected_rows,
         (count(*)-count(level))/count(*) AS reject_rate FROM raw""",
)
def reject_rate(spark, sf):
    return ingest.reject_rate(*ingest.partition_rejects(_raw_orders(spark, sf), ["level"]))


@query(
    "reject_sample",
    with_sql(_RAW_ORDERS)
    + """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, status, 'level is null' AS reason FROM raw WHERE level IS NULL
         ORDER BY raw.o_orderkey LIMIT 10""",
)
def reject_sample(spark, sf):
    _, rejected = ingest.partition_rejects(_raw_orders(spark, sf), ["level"])
    return ingest.reject_sample(rejected, "o_orderkey").select("o_orderkey", "status", F.col(ingest.REASON).alias("reason"))


@query(
    "version_totals",
    with_sql(BOOK)
    + """SELECT CAST(CAST(sum(CAST(exposure_years AS DECIMAL(18,6))) AS DECIMAL(38,6)) AS VARCHAR) AS exposure_years,
         CAST(sum(claim_count) AS BIGINT) AS claim_count, CAST(sum(claim_amount_minor) AS BIGINT) AS claim_amount_minor FROM book""",
)
def version_totals(spark, sf):
    return ingest.version_totals(book(spark, sf))


# -- recipes ---------------------------------------------------------------------------------


_RECIPE_SOURCE = """src AS (
  SELECT o_orderkey AS k, '  ' || o_orderpriority || ' ' AS level,
    CASE WHEN o_orderkey % 10 = 3 THEN 'n/k' ELSE CAST(CAST(o_totalprice AS INTEGER) AS VARCHAR) END AS premium,
    CASE WHEN o_orderkey % 7 = 2 THEN 'soon' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS start_date,
    nullif(o_orderstatus, 'P') AS status, CAST(o_custkey AS VARCHAR) AS customer FROM orders)"""


def _recipe_source(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("k"),
        F.concat(F.lit("  "), "o_orderpriority", F.lit(" ")).alias("level"),
        F.when(k % 10 == 3, "n/k").otherwise(F.bround("o_totalprice", 0).cast("int").cast("string")).alias("premium"),
        F.when(k % 7 == 2, "soon").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("start_date"),
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"),
        F.col("o_custkey").cast("string").alias("customer"),
    )


_RECIPE = [
    {"step": "trim_whitespace", "params": {"columns": ["level"]}},
    {"step": "normalise_case", "params": {"columns": ["level"], "case": "lower"}},
    {"step": "cast", "params": {"columns": {"premium": "int", "customer": "int"}}},
    {"step": "parse_date", "params": {"column": "start_date", "format": "%d/%m/%Y"}},
    {"step": "map_values", "params": {"column": "level", "mapping": {"1-urgent": "urgent", "2-high": "high"}}},
    {"step": "fill_null", "params": {"column": "status", "value": "unknown"}},
    {"step": "derive_expression", "params": {"column": "loaded", "expression": "premium * 2 + 1"}},
    {"step": "filter_rows", "params": {"expression": "loaded > 100001"}},
    {"step": "deduplicate", "params": {"columns": ["customer", "level"]}},
    {"step": "rename", "params": {"columns": {"customer": "policy_id"}}},
]

_CLEAN = """typed AS (SELECT * FROM src WHERE premium <> 'n/k' AND start_date <> 'soon'),
  clean AS (SELECT *, CAST(premium AS BIGINT)*2+1 AS loaded,
   CASE lower(trim(level)) WHEN '1-urgent' THEN 'urgent' WHEN '2-high' THEN 'high' ELSE lower(trim(level)) END AS lvl FROM typed)"""


@query(
    "recipe_clean_rows",
    with_sql(_RECIPE_SOURCE, _CLEAN)
    + """SELECT k, lvl AS level, CAST(premium AS BIGINT) AS premium, strftime(strptime(start_date, '%d/%m/%Y'), '%Y-%m-%d') AS start_date,
         coalesce(status, 'unknown') AS status, CAST(customer AS BIGINT) AS policy_id, loaded
         FROM clean WHERE loaded > 100001 QUALIFY row_number() OVER (PARTITION BY customer, lvl ORDER BY k) = 1""",
)
def recipe_clean_rows(spark, sf):
    done = prepare.apply_recipe({"orders": _recipe_source(spark, sf)}, _RECIPE, row_keys={"orders": "k"})
    return done.tables["orders"].withColumn("start_date", F.col("start_date").cast("string"))


_LINEAGE = (("customer", "policy_id"), ("k", "k"), ("level", "level"), ("premium", "loaded"), ("premium", "premium"), ("start_date", "start_date"), ("status", "status"))


@query(
    "recipe_lineage",
    # a source column's values in the raw table, and how many distinct ones the clean column has
    with_sql(_RECIPE_SOURCE, _CLEAN)
    + ", done AS (SELECT k, lvl AS level, CAST(premium AS BIGINT) AS premium, start_date, coalesce(status, 'unknown') AS status, customer AS policy_id, loaded"
    + " FROM clean WHERE loaded > 100001 QUALIFY row_number() OVER (PARTITION BY customer, lvl ORDER BY k) = 1)"
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{s}' AS source, (SELECT count({s}) FROM src) AS source_values, (SELECT count(DISTINCT {c}) FROM done) AS levels" for s, c in _LINEAGE
    ),
)
def recipe_lineage(spark, sf):
    """Which source columns each clean column comes from, with the values of both."""
    source = _recipe_source(spark, sf)
    found = lineage.recipe_lineage({"orders": source}, _RECIPE)
    done = prepare.apply_recipe({"orders": source}, _RECIPE, row_keys={"orders": "k"}).tables["orders"]
    pairs = [(c, s) for (_, c), sources in sorted(found.items()) for _, s in sorted(sources)]
    values = source.agg(*[F.count(c).alias(c) for c in source.columns]).select(F.inline(F.array(*[F.struct(F.lit(c).alias("source"), F.col(c).alias("source_values")) for c in source.columns])))
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in done.columns])
    levels = done.select(F.inline(entries)).where("level is not null").distinct().groupBy("column").agg(F.count(F.lit(1)).alias("levels"))
    return spark.createDataFrame(pairs, "column string, source string").join(values, "source").join(levels, "column")


_READS = ((0, "trim_whitespace", "level"), (1, "normalise_case", "level"), (2, "cast", "premium"), (2, "cast", "customer"), (3, "parse_date", "start_date"), (4, "map_values", "level"),
          (5, "fill_null", "status"), (6, "derive_expression", "premium"), (7, "filter_rows", "loaded"), (8, "deduplicate", "customer"), (8, "deduplicate", "level"), (9, "rename", "customer"))


@query(
    "recipe_columns_read",
    with_sql(_RECIPE_SOURCE)
    + " UNION ALL ".join(f"SELECT {i} AS step, '{kind}' AS kind, '{c}' AS reads, (SELECT count({c if c != 'loaded' else 'NULL'}) FROM src) AS source_values" for i, kind, c in _READS),
)
def recipe_columns_read(spark, sf):
    """Columns that each step of the recipe reads, and how many values the source has of them."""
    source = _recipe_source(spark, sf)
    pairs = [(s.index, s.kind, c) for s in lineage.recipe_columns({"orders": source}, _RECIPE) for c in s.reads]
    values = source.agg(*[F.count(c).alias(c) for c in source.columns]).select(F.inline(F.array(*[F.struct(F.lit(c).alias("reads"), F.col(c).alias("n")) for c in source.columns])))
    read = spark.createDataFrame(pairs, "step int, kind string, reads string").join(values, "reads", "left")
    return read.select("step", "kind", "reads", F.coalesce("n", F.lit(0)).cast("long").alias("source_values"))


@query(
    "recipe_quarantine",
    with_sql(_RECIPE_SOURCE)
    + """SELECT CAST(k AS VARCHAR) AS k, level, premium, start_date,
         CASE WHEN premium = 'n/k' THEN 'premium: cast could not parse ''n/k'' as int'
              ELSE 'start_date: parse_date could not parse ''soon'' as %d/%m/%Y' END AS _reject_reason,
         CASE WHEN premium = 'n/k' THEN 'premium' ELSE 'start_date' END AS _reject_column,
         CASE WHEN premium = 'n/k' THEN 'cast' ELSE 'parse_date' END AS _reject_step
         FROM src WHERE premium = 'n/k' OR start_date = 'soon'""",
)
def recipe_quarantine(spark, sf):
    done = prepare.apply_recipe({"orders": _recipe_source(spark, sf)}, _RECIPE, row_keys={"orders": "k"})
    return done.rejected["orders"].drop("status", "customer")


@query(
    "recipe_step_balance",
    with_sql(_RECIPE_SOURCE)
    + """, b AS (SELECT premium = 'n/k' AS bad_premium, start_date = 'soon' AS bad_date,
            CASE WHEN premium <> 'n/k' THEN CAST(premium AS BIGINT)*2+1 END AS loaded, customer, level FROM src),
         c AS (SELECT count(*) AS n, count(*) FILTER (bad_premium) AS r1, count(*) FILTER (NOT bad_premium AND bad_date) AS r2,
            count(*) FILTER (NOT bad_premium AND NOT bad_date AND loaded > 100001) AS kept,
            count(DISTINCT CASE WHEN NOT bad_premium AND NOT bad_date AND loaded > 100001 THEN customer || level END) AS uniq FROM b)
         SELECT 'cast' AS step, n AS rows_before, n - r1 AS rows_after, r1 AS rows_rejected, CAST(0 AS BIGINT) AS rows_removed, CAST(0 AS BIGINT) AS rows_added FROM c
         UNION ALL SELECT 'parse_date', n - r1, n - r1 - r2, r2, 0, 0 FROM c
         UNION ALL SELECT 'filter_rows', n - r1 - r2, kept, 0, n - r1 - r2 - kept, 0 FROM c
         UNION ALL SELECT 'deduplicate', kept, uniq, 0, kept - uniq, 0 FROM c""",
)
def recipe_step_balance(spark, sf):
    done = prepare.apply_recipe({"orders": _recipe_source(spark, sf)}, _RECIPE, row_keys={"orders": "k"}, observe=True)
    rows = [
        (r["step"], r["rows_before"], r["rows_after"], r["rows_rejected"], r["rows_removed"], r["rows_added"])
        for r in done.step_counts()
        if r["step"] in ("cast", "parse_date", "filter_rows", "deduplicate")
    ]
    return spark.createDataFrame(
        rows, "step string, rows_before long, rows_after long, rows_rejected long, rows_removed long, rows_added long"
    )


@query(
    "quarantine_write",
    with_sql(_RECIPE_SOURCE)
    + """SELECT CASE WHEN premium = 'n/k' THEN 'cast' ELSE 'parse_date' END AS step, CAST(count(*) AS BIGINT) AS n
         FROM src WHERE premium = 'n/k' OR start_date = 'soon' GROUP BY 1
         UNION ALL SELECT 'required_non_null', CAST(count(*) AS BIGINT) FROM src WHERE status IS NULL""",
)
def quarantine_write(spark, sf):
    """Parsing rejects and required-null rejects written as one text table, columns by name."""
    src = _recipe_source(spark, sf)
    done = prepare.apply_recipe({"orders": src}, _RECIPE, row_keys={"orders": "k"})
    _, nulls = ingest.partition_rejects(src, ["status"])
    nulls = nulls.drop("customer").select([F.col(c).cast("string").alias(c) for c in nulls.columns if c != "customer"])
    path = sinks.write_rejected([done.rejected["orders"], nulls], sinks.scratch_path(spark, "rejected"))
    return files.read_parquet(spark, path).groupBy(F.col(ingest.STEP).alias("step")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "first_row_per_key",
    """SELECT o_orderkey, o_custkey, o_orderpriority FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1""",
)
def first_row_per_key(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return prepare.deduplicate(o, ["o_custkey"], order_by="o_orderkey", unique_order=True)


@query(
    "join_table_step",
    """SELECT n_name, CAST(count(*) AS BIGINT) AS n, CAST(count(r_name) AS BIGINT) AS with_region FROM supplier
       LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey > 1 GROUP BY 1""",
)
def join_table_step(spark, sf):
    s = table(spark, sf, "supplier").withColumnRenamed("s_nationkey", "nation_key")
    n = table(spark, sf, "nation").withColumnsRenamed({"n_nationkey": "nation_key", "n_regionkey": "region_key"})
    r = table(spark, sf, "region").where("r_regionkey > 1").withColumnRenamed("r_regionkey", "region_key")
    steps = [
        {"step": "join_table", "table": "s", "params": {"other": "n", "on": ["nation_key"], "how": "left"}},
        {"step": "join_table", "table": "s", "params": {"other": "r", "on": ["region_key"], "how": "left"}},
    ]
    out = prepare.apply_recipe({"s": s, "n": n, "r": r}, steps, row_keys={"s": "s_suppkey"}).tables["s"]
    return out.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.count("r_name").alias("with_region"))


@query(
    "derive_exposure",
    with_sql(POLICY_EXPOSURE)
    + """SELECT rating_level, round(sum(CAST(round((exposure_end - exposure_start)/365.25::DOUBLE, 9) AS DECIMAL(18,9)))::DOUBLE, 6) AS exposure
         FROM policy_exposure GROUP BY 1""",
)
def derive_exposure(spark, sf):
    step = {"step": "derive_exposure", "params": {"start": "exposure_start", "end": "exposure_end", "column": "e"}}
    df = prepare.apply_recipe({"p": policy_exposure(spark, sf)}, [step]).tables["p"]
    return df.groupBy("rating_level").agg(
        F.round(F.sum(F.round("e", 9).cast("decimal(18,9)")).cast("double"), 6).alias("exposure")
    )


BOUNDARIES = ["1996-01-01", "1997-01-01", "1998-01-01", "1998-06-01"]


@query(
    "explode_period",
    with_sql(POLICY_EXPOSURE)
    + """, cuts AS (SELECT unnest([DATE '1996-01-01', DATE '1997-01-01', DATE '1998-01-01', DATE '1998-06-01']) AS c),
    edges AS (SELECT period_id, exposure_start AS s FROM policy_exposure
      UNION SELECT period_id, c FROM policy_exposure, cuts WHERE c > exposure_start AND c < exposure_end),
    frag AS (SELECT e.period_id, e.s, coalesce(lead(e.s) OVER (PARTITION BY e.period_id ORDER BY e.s), p.exposure_end) AS t,
        count(*) OVER (PARTITION BY e.period_id) AS k, CAST(CAST(p.exposure_years AS VARCHAR) AS DECIMAL(20,17)) AS whole, p.exposure_years
        FROM edges e JOIN policy_exposure p USING (period_id)),
    shared AS (SELECT *, CASE WHEN lead(s) OVER (PARTITION BY period_id ORDER BY s) IS NULL THEN NULL
        ELSE CAST(round_even(CAST(whole AS DOUBLE)*(t-s)/182, 6) AS DECIMAL(20,17)) END AS part FROM frag)
    SELECT period_id, strftime(s, '%Y-%m-%d') AS exposure_start, strftime(t, '%Y-%m-%d') AS exposure_end,
      round(CASE WHEN k = 1 THEN exposure_years WHEN part IS NOT NULL THEN CAST(part AS DOUBLE)
        ELSE CAST(whole - sum(part) OVER (PARTITION BY period_id) AS DOUBLE) END, 9) AS exposure_years FROM shared""",
)
def explode_period(spark, sf):
    df = prepare.explode_period(policy_exposure(spark, sf), BOUNDARIES)
    return df.select(
        "period_id",
        F.col("exposure_start").cast("string").alias("exposure_start"),
        F.col("exposure_end").cast("string").alias("exposure_end"),
        F.round("exposure_years", 9).alias("exposure_years"),
    )


@query(
    "explode_period_balance",
    with_sql(POLICY_EXPOSURE)
    + """SELECT CAST(CAST(round_even(sum(CAST(CAST(exposure_years AS VARCHAR) AS DECIMAL(38,17))), 6) AS DECIMAL(38,6)) AS VARCHAR) AS exposure_before,
         exposure_before AS exposure_after, TRUE AS preserved FROM policy_exposure""",
)
def explode_period_balance(spark, sf):
    before = policy_exposure(spark, sf)
    return prepare.exposure_balance(before, prepare.explode_period(before, BOUNDARIES))


_LINKS = (
    with_sql(POLICY_EXPOSURE, CLAIM)
    + """, link AS (SELECT c.claim_id, c.claim_amount_minor, any_value(c.policy_id) AS policy_id, count(p.period_id) AS k, min(p.period_id) AS period_id
       FROM claim c LEFT JOIN policy_exposure p ON c.policy_id = p.policy_id AND date_of_loss >= exposure_start AND date_of_loss < exposure_end
       GROUP BY 1, 2)
    """
)


@query(
    "attach_claims",
    _LINKS
    + """SELECT claim_id, CASE WHEN k = 0 THEN 'unlinked' WHEN k = 1 THEN 'linked' ELSE 'multi_linked' END AS outcome,
         CASE WHEN k = 1 THEN period_id END AS period_id, CAST(CASE WHEN k > 1 THEN k END AS BIGINT) AS n_periods FROM link""",
)
def attach_claims(spark, sf):
    done = prepare.attach_claims(policy_exposure(spark, sf), claim(spark, sf))
    none = F.lit(None).cast("long")
    return (
        done.linked.select("claim_id", F.lit("linked").alias("outcome"), "period_id", none.alias("n_periods"))
        .unionAll(done.unlinked.select("claim_id", F.lit("unlinked"), none, none))
        .unionAll(done.multi_linked.select("claim_id", F.lit("multi_linked"), none, F.col("n_periods").cast("long")))
    )


@query(
    "covering_pairs",
    with_sql(POLICY_EXPOSURE, CLAIM)
    + """SELECT claim_id, period_id FROM claim c JOIN policy_exposure p ON c.policy_id = p.policy_id
         AND date_of_loss >= exposure_start AND date_of_loss < exposure_end""",
)
def covering_pairs(spark, sf):
    return prepare.covering_pairs(policy_exposure(spark, sf), claim(spark, sf)).select("claim_id", "period_id")


@query(
    "claims_to_policy",
    with_sql(CLAIM)
    + """, pol AS (SELECT policy_id, count(*) AS claim_count FROM claim GROUP BY 1),
       known AS (SELECT policy_id, sum(claim_amount_minor) AS amount FROM claim WHERE peril = 'F' GROUP BY 1)
       SELECT c_custkey AS policy_id, CAST(coalesce(claim_count, 0) AS BIGINT) AS claim_count,
         CAST(CASE WHEN amount IS NOT NULL THEN amount WHEN coalesce(claim_count, 0) = 0 THEN 0 END AS BIGINT) AS claim_amount_minor,
         round(CASE WHEN claim_count > 0 THEN amount / claim_count END, 6) AS mean_severity
       FROM customer LEFT JOIN pol ON c_custkey = pol.policy_id LEFT JOIN known ON c_custkey = known.policy_id""",
)
def claims_to_policy(spark, sf):
    c = claim(spark, sf)
    counts = c.groupBy("policy_id").agg(F.count(F.lit(1)).alias("claim_count"))
    policies = table(spark, sf, "customer").select(F.col("c_custkey").alias("policy_id")).join(counts, "policy_id", "left")
    policies = policies.fillna(0, ["claim_count"])
    return prepare.claims_to_policy(policies, c.where("peril = 'F'")).withColumn("mean_severity", F.round("mean_severity", 6))


_KEY = "workspace key"
_PADS = ["".join(f"\\x{b ^ pad:02X}" for b in _KEY.encode().ljust(64, b"\0")) for pad in (0x36, 0x5C)]


@query(
    "pseudonymise",
    f"SELECT c_custkey, substr(sha256('{_PADS[1]}'::BLOB || unhex(sha256('{_PADS[0]}'::BLOB || encode(c_name)))), 1, 32) AS token FROM customer",
)
def pseudonymise(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("token"))
    return prepare.pseudonymise(c, "token", _KEY)


@query(
    "correct_schema",
    "SELECT c_mktsegment, CAST(sum(CAST(c_acctbal AS BIGINT)) AS BIGINT) AS balance, CAST(0 AS BIGINT) AS numeric_names FROM (SELECT c_mktsegment, trunc(c_acctbal) AS c_acctbal FROM customer) GROUP BY 1",
)
def correct_schema(spark, sf):
    df = prepare.correct_schema(table(spark, sf, "customer"), {"c_acctbal": "int", "c_name": "int"})
    return df.groupBy("c_mktsegment").agg(F.sum("c_acctbal").alias("balance"), F.count("c_name").alias("numeric_names"))


# -- scalar functions ------------------------------------------------------------------------


@query(
    "scalar_arithmetic",
    """SELECT o_orderkey, o_totalprice / nullif(o_custkey, 0) AS ratio,
       CAST(((o_orderkey - 700) % 7 + 7) % 7 AS BIGINT) AS floor_mod, round(pow(o_custkey, 0.5), 6) AS power,
       -o_custkey AS negated, o_totalprice > 100000 AND NOT (o_orderstatus = 'F') OR o_custkey <> 5 AS logic,
       CASE WHEN o_orderstatus = 'P' THEN 'part' ELSE 'whole' END AS branch FROM orders""",
)
def scalar_arithmetic(spark, sf):
    o = table(spark, sf, "orders")
    logic = (F.col("o_totalprice") > 100000) & ~(F.col("o_orderstatus") == "F") | (F.col("o_custkey") != 5)
    return o.select(
        "o_orderkey",
        scalar.divide("o_totalprice", "o_custkey").alias("ratio"),
        scalar.floor_mod(F.col("o_orderkey") - 700, F.lit(7)).cast("long").alias("floor_mod"),
        F.round(F.pow(F.col("o_custkey"), F.lit(0.5)), 6).alias("power"),
        (-F.col("o_custkey")).alias("negated"),
        logic.alias("logic"),
        scalar.where(F.col("o_orderstatus") == "P", F.lit("part"), F.lit("whole")).alias("branch"),
    )


@query(
    "scalar_functions",
    """SELECT c_custkey, abs(c_acctbal) AS a, floor(c_acctbal) AS fl, ceil(c_acctbal) AS ce,
       round(sqrt(abs(c_acctbal)), 6) AS sq, round(ln(abs(c_acctbal) + 1), 6) AS lg, round(exp(c_nationkey / 10.0::DOUBLE), 6) AS ex,
       round(ln(1 + c_nationkey::DOUBLE), 6) AS l1, round(exp(c_nationkey/10.0::DOUBLE) - 1, 6) AS e1,
       least(c_custkey, CAST(c_nationkey AS BIGINT) * 50) AS mn, greatest(c_custkey, CAST(c_nationkey AS BIGINT) * 50) AS mx,
       coalesce(nullif(c_mktsegment, 'MACHINERY'), 'none') AS co, least(greatest(c_acctbal, 0), 5000) AS cl,
       upper(lower(c_name)) AS up, TRY_CAST(replace(c_name, 'Customer#', '') AS BIGINT) AS nr FROM customer""",
)
def scalar_functions(spark, sf):
    c = table(spark, sf, "customer")
    b, n = F.col("c_acctbal"), F.col("c_nationkey")
    return c.select(
        "c_custkey",
        F.abs(b).alias("a"),
        F.floor(b).cast("double").alias("fl"),
        F.ceil(b).cast("double").alias("ce"),
        F.round(F.sqrt(F.abs(b)), 6).alias("sq"),
        F.round(F.ln(F.abs(b) + 1), 6).alias("lg"),
        F.round(F.exp(n / 10), 6).alias("ex"),
        F.round(F.log1p(n), 6).alias("l1"),
        F.round(F.expm1(n / 10), 6).alias("e1"),
        scalar.horizontal_min("c_custkey", n.cast("long") * 50).alias("mn"),
        scalar.horizontal_max("c_custkey", n.cast("long") * 50).alias("mx"),
        F.coalesce(F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")), F.lit("none")).alias("co"),
        scalar.clip("c_acctbal", 0.0, 5000.0).alias("cl"),
        F.upper(F.lower("c_name")).alias("up"),
        scalar.cast_to(F.replace(F.col("c_name"), F.lit("Customer#"), F.lit("")), "int").alias("nr"),
    )


@query(
    "explicit_rounding",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2)) * 5 AS v FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round_even(v, 0) AS BIGINT) AS half_even, CAST(round(v) AS BIGINT) AS half_up,
      CAST(ceil(v) AS BIGINT) AS ceiling, CAST(floor(v) AS BIGINT) AS "floor", CAST(trunc(v) AS BIGINT) AS down FROM x""",
)
def explicit_rounding(spark, sf):
    v = F.col("l_quantity").cast("decimal(18,2)") * F.col("l_discount").cast("decimal(18,2)") * F.lit(5).cast("decimal(1,0)")
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", v.alias("v"))
    modes = {m: scalar.round_exact("v", m).cast("long") for m in scalar.ROUNDING_MODES}
    return df.withColumns(modes).drop("v")


@query(
    "date_functions",
    """SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(sum(CAST(o_orderdate AS DATE) - DATE '1995-01-01') AS BIGINT) AS days,
       CAST(count(TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS DATE)) AS BIGINT) AS parsed
       FROM orders GROUP BY 1""",
)
def date_functions(spark, sf):
    d = F.col("o_orderdate").cast("date")
    text = F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return (
        table(spark, sf, "orders")
        .groupBy(F.year("o_orderdate").cast("long").alias("y"))
        .agg(
            F.sum(F.datediff(d, F.lit("1995-01-01").cast("date"))).alias("days"),
            F.count(scalar.parse_date(text, "%Y-%m-%d")).alias("parsed"),
        )
    )


@query(
    "flatten_json",
    """SELECT event_type, 'outer.inner.k' AS path, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total
       FROM events GROUP BY 1
       UNION ALL SELECT event_type, 'id', CAST(count(*) AS BIGINT), CAST(sum(event_id) AS BIGINT) FROM events GROUP BY 1""",
)
def flatten_json(spark, sf):
    nested = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "outer": {"inner": '), "props", F.lit("}}"))
    e = table(spark, sf, "events").select("event_type", F.explode(scalar.flatten_json(nested, 3)).alias("path", "value"))
    return e.groupBy("event_type", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("long")).alias("total"))


# -- splits ----------------------------------------------------------------------------------

_UNIT = "('0x' || substr(sha256({seed} || ':' || {key}), 1, 13))::BIGINT / 4503599627370496.0"


@query(
    "hash_split",
    f"""SELECT part, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM
     (SELECT o_orderkey, CASE WHEN u < 0.2 THEN 'holdout' WHEN u < 0.4 THEN 'test' ELSE 'train' END AS part
      FROM (SELECT o_orderkey, {_UNIT.format(seed=7, key='o_orderkey')} AS u FROM orders)) GROUP BY 1""",
)
def hash_split(spark, sf):
    df = splits.assign_parts(
        table(spark, sf, "orders"), method="random", seed=7, key="o_orderkey",
        fractions={"train": 0.6, "test": 0.2, "holdout": 0.2},
    )
    return df.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum"))


@query(
    "grouped_split",
    f"""SELECT o_custkey, CASE WHEN u < 0.25 THEN 'test' ELSE 'train' END AS part, CAST(count(*) AS BIGINT) AS n
      FROM (SELECT o_custkey, {_UNIT.format(seed=11, key='o_custkey')} AS u FROM orders) GROUP BY ALL""",
)
def grouped_split(spark, sf):
    df = splits.assign_parts(
        table(spark, sf, "orders"), method="grouped_by_key", seed=11, key="o_custkey", fractions={"train": 0.75, "test": 0.25}
    )
    return df.groupBy("o_custkey", "part").agg(F.count(F.lit(1)).alias("n"))


@query(
    "temporal_split",
    """SELECT part, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM
     (SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 AND o_orderdate < TIMESTAMP '1997-01-01' THEN 'train' ELSE 'test' END AS part FROM orders) GROUP BY 1""",
)
def temporal_split(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate").cast("date")).alias("d")
    )
    parts = splits.partition(o, method="temporal", time="d", cutoff="1997-01-01")
    out = None
    for name, df in parts.items():
        row = df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum"))
        out = row if out is None else out.unionAll(row)
    return out


@query(
    "hash_folds",
    f"""SELECT o_orderkey, CAST(least(floor({_UNIT.format(seed=3, key='o_orderkey')} * 5), 4) AS INTEGER) AS fold FROM orders""",
)
def hash_folds(spark, sf):
    return splits.assign_folds(table(spark, sf, "orders"), method="random", seed=3, folds=5, key="o_orderkey").select(
        "o_orderkey", "fold"
    )


@query(
    "temporal_folds",
    """SELECT o_orderkey, CAST(least((row_number() OVER (ORDER BY d NULLS FIRST, o_orderkey) - 1) * 7 // count(*) OVER (), 6) AS INTEGER) AS fold
       FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderdate AS DATE) END AS d FROM orders)""",
)
def temporal_folds(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate").cast("date")).alias("d")
    )
    return splits.assign_folds(o, method="temporal", folds=7, time="d", tie="o_orderkey").select("o_orderkey", "fold")


@query(
    "seeded_sample",
    f"SELECT o_orderkey, o_orderpriority FROM orders ORDER BY {_UNIT.format(seed=5, key='o_orderkey')}, o_orderkey LIMIT 500",
)
def seeded_sample(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return prepare.derive_version(o, "sample", key="o_orderkey", n=500, seed=5)


@query(
    "evenly_spaced_sample",
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rk, count(*) OVER () AS n FROM orders)
       SELECT o_orderkey FROM r WHERE rk IN (SELECT i * n // 300 FROM range(300) t(i), (SELECT max(n) AS n FROM r))""",
)
def evenly_spaced_sample(spark, sf):
    return splits.evenly_spaced_sample(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 300)


@query(
    "derived_versions",
    """SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(o_custkey) AS BIGINT) AS with_customer, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM
       (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT o_orderkey, NULL FROM orders)""",
)
def derived_versions(spark, sf):
    o = table(spark, sf, "orders")
    large = prepare.derive_version(o, "filter", expression="o_totalprice > 200000")
    both = prepare.derive_version(large, "union", others=[o.select("o_orderkey")])
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.count("o_custkey").alias("with_customer"), F.sum("o_orderkey").alias("key_sum")
    )
