"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
#: Seconds after which a query is timed once only.
LONG = 15
HEADLINE = [
    "doc_lines_profile", "text_quality", "repeated_lines", "kept_lines", "lexicon_words", "lexicon_bigrams", "deglue_candidates", "line_joiners", "search_snippets", "stage_metrics",
    "page_number_offsets", "longest_page_run", "asof_section", "nearest_line", "rank_top1_ties", "section_ancestors", "adjacency", "html_blocks", "list_runs", "block_continuation", "sentences", "content_blocks",
]


def main() -> None:
    from pyspark.sql import SparkSession

    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    from quire.plans.registry import QUERIES

    taken: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):  # the first run compiles
            began = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
            if runs[0] > LONG:
                break
        taken[name] = round(min(runs), 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
