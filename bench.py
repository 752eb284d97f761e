"""Time the headline queries and print one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (comma list, or "all") choose data, cores and queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "page_elements",
    "page_confidence",
    "page_statistics",
    "page_plain_text",
    "normalize_references",
    "search_relevance_topk",
    "global_stats",
    "label_coverage",
    "category_stats",
    "pending_export_view",
    "pending_union_view",
    "articles_with_issues",
    "acts_with_categories",
    "export_package",
    "article_dedupe_longest",
    "number_gaps",
    "retain_latest",
    "diff_classify",
    "diff_summary",
    "change_log",
    "upsert_acts",
    "quality_rules_md",
    "quality_rules_table",
    "quality_report",
    "orphan_audit",
    "parse_issue_json",
)


def main() -> None:
    from actlake.registry import all_queries
    from actlake.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    spark = local_session(cpus, "actlake-bench")
    registered = all_queries()
    names = list(registered) if chosen == "all" else [n for n in (chosen.split(",") if chosen else HEADLINE) if n in registered]

    # one untimed run of a small query starts the JVM's code generation
    registered["acts_by_type"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        registered[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
