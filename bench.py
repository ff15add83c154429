"""Time the headline queries: one JSON line with seconds per query.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores. Each query is planned, run in full
and its rows are consumed by a sink that keeps nothing. An untimed scan starts the session.
"""

from __future__ import annotations

import json
import os
import sys
import time

from checks.queries import QUERIES
from corpuslens.plans.session import local_session

HEADLINE = [
    "sentiment_compound",
    "toxicity_lexicon",
    "toxicity_score",
    "injection_score",
    "jailbreak_score",
    "refusal_score",
    "similarity_shingle",
    "similarity_tfidf",
    "similarity_dense",
    "topic_closest",
    "topic_custom",
    "pattern_label",
    "pattern_hits",
    "pii_entities",
    "common_words",
    "readability_scores",
    "readability_histogram",
    "score_summary",
    "score_histogram",
    "score_quartiles",
    "topic_counts",
    "pii_counts",
    "table_filter",
    "stream_scores",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    QUERIES["dataset_view"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
