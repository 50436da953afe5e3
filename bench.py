"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from premia.plans import catalogue
from premia.session import local_session

#: Ingest and prepare, validation, profiling, batch scoring and what is built on them.
HEADLINE = (
    "recipe_clean_rows",
    "version_totals",
    "infer_schema",
    "attach_claims",
    "explode_period",
    "validate_rows_one_pass",
    "profile",
    "one_way",
    "one_ways_many_factors",
    "top_levels",
    "histograms",
    "compare_profiles",
    "psi_by_exposure",
    "reference_lookup_as_at",
    "temporal_folds",
    "banding_exposure_quantile",
    "resolve_factors",
    "glm_poisson_fit",
    "lift",
    "gini",
    "proxy_assessment",
    "score_portfolio",
    "dislocation_segments",
    "dislocation_quantiles",
    "golden_quotes",
    "rate_table_change_summary",
    "input_drift",
    "segment_search",
    "stream_windowed_levels",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, app="premia-bench")
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.REGISTRY["one_way"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the JVM
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalogue.REGISTRY[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}
        )
    )


if __name__ == "__main__":
    main()
