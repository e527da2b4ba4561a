"""Headline queries, timed end to end; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from siftline.session import local_session  # noqa: E402
from workload import all_queries  # noqa: E402

HEADLINE = (
    "T8_preprocess",
    "F1_vocabulary_all_documents",
    "F3_tfidf_features",
    "F8_prepare_dataset",
    "M1_train_logistic_regression",
    "M5_predict_with_score",
    "X8_extract_articles",
    "X10_extract_links",
    "C2_bfs_unlimited",
    "C7_process_pages_scored",
    "W1_upsert_articles",
    "Q1_search_articles",
    "I3_list_incidents",
    "I5_search_incidents",
    "D2_incidents_by_source",
    "D3_incidents_timeline",
    "J5_job_history",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = set(sys.argv[1:])
    spark = local_session(cpus, "bench", **{"spark.ui.showConsoleProgress": "false"})
    fns = all_queries()
    # one untimed small query so that the first timing is not the start-up
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        start = time.time()
        fns[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
