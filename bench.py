"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local threads. Every query is run to the end
on a sink that discards its rows.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from ruleweave.catalog import all_queries

HEADLINE = [
    "p06_quartile_codes",
    "p06_quartile_counts_lineitem",
    "p10_to_facts",
    "a02_candidate_counts",
    "a02_candidate_counts_grouped",
    "r02_ranked_literals",
    "r03_grow_two_steps",
    "c05_score",
    "c05_score_facts",
    "c06_drop_alternatives",
    "a14_evaluate",
    "a16_roc_points",
    "j01_match_all",
    "j02_bind",
    "c01_covered_relational",
    "r11_determinate_literals",
    "a12_signed_attribution",
    "u01_utility_lists",
    "u02_top_k_itemsets",
    "u05_threshold_itemsets",
    "u06_attributions_to_tx",
    "r04_learn_orders",
    "r05_learn_documents_with_exceptions",
    "r09_learn_utility_rules",
    "r10_learn_guided_rules",
    "m06_tree_attributions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ruleweave-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="ruleweave-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = all_queries()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
