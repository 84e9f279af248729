"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

from topicvote.plans.queries import QUERIES
from topicvote.session import get_session

HEADLINE = [
    "topic_recode_counts",
    "fold_split",
    "text_clean",
    "text_clean_stemmed",
    "stopword_filter",
    "tokens_vocab",
    "tfidf_terms_by_document",
    "top_terms_by_topic",
    "trimmed_dfm",
    "ovr_class_counts",
    "negative_sample",
    "negative_sample_numbers",
    "nb_multiclass",
    "nb_votes",
    "vote_tally",
    "ensemble_verdict",
    "verdict_strictness_sweep",
    "validation_numbers",
    "gate_route_stepwise",
    "fold_mean_pr",
    "pr_by_topic",
    "workflow_v0",
    "workflow_v1",
    "workflow_v4",
    "svm_votes",
    "row_range",
    "repair_merge",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    QUERIES["ensemble_verdict"](spark, folder).count()  # warms the JVM and the Python workers
    seconds = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    line = {
        "metric": "total_query_time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
