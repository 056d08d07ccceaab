"""Headline queries on one table folder: one JSON line with seconds per query.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local cores. Every query runs twice; the second,
warm run is reported, with the whole result computed and thrown away.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINES = [
    "place_name_keys",
    "name_similarity",
    "place_ladder_lookups",
    "place_ladder_full",
    "fuzzy_top_candidates",
    "manual_review_candidates",
    "crosswalk_summary",
    "audits_prepared",
    "programme_filter",
    "audits_linked_long",
    "audit_events_wide",
    "link_coverage",
    "downloads_index",
    "download_summary",
    "fetch_medians",
    "manifest_upsert",
    "page_anchors",
    "places_from_pages",
    "pdf_links",
    "search_candidates",
    "match_scores_quarantined",
    "document_chunks",
    "candidate_pairs",
    "enforcement_indices",
    "place_year_panel",
    "roc_and_pr_points",
]


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    data = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("civiclink-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from civiclink.plans import QUERIES

    wanted = sys.argv[1:] or HEADLINES
    seconds: dict[str, float] = {}
    for name in wanted:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(data).name.removeprefix("sf"),
    }
    spark.stop()
    print(json.dumps(line))


if __name__ == "__main__":
    main()
