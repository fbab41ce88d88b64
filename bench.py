"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from suite import queries as _  # noqa: E402, F401
from suite.registry import QUERIES  # noqa: E402
from threadloom.session import local_session  # noqa: E402

HEADLINE = [
    "scan_files",
    "detect_language",
    "clean_code_lines",
    "mask_text",
    "token_entropy",
    "declarations",
    "dedupe_last_wins",
    "link_symbols",
    "bfs_distance",
    "keyword_score",
    "rank_context",
    "optimize_context",
    "vector_topk",
    "vector_topk_batch",
    "answer_lookup",
    "changed_files",
    "name_index",
    "savings_report",
    "windowed_savings",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench", "12g")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["content_sha256"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm up
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
