"""Times the headline queries once each on $BENCH_SF_DIR; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from cairn.plans import catalogue

HEADLINE = [
    "identifier_registry", "token_stats", "postings_top", "exact_lookup", "typo_candidates", "prefix_readings", "shortlist_topk", "fuzzy_search",
    "template_match", "text_search_roundrobin", "call_sites", "display_names", "definition_override", "snapshot_diff", "cardinality_check", "fk_references", "parse_nodes", "validate_scripts",
    "validate_codes", "node_paths", "definition_texts", "economic_names",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, seconds = catalogue.queries(), {}
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in HEADLINE:
        began = time.time()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    queries = found["mutation_cases"](spark, sf_dir).count()
    extra = {"fuzzy_queries_per_s": round(queries / seconds["fuzzy_search"], 2)}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rpartition("/sf")[2], **extra}))


if __name__ == "__main__":
    main()
