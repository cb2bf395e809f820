"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# relational work and one model of every kind
HEADLINE = (
    "split_tail_als",
    "w_timespent",
    "w_log_decay",
    "item_stats",
    "source_stats_combined",
    "user2source_stats",
    "user_stats",
    "nearest_quantiles",
    "embedding_sims",
    "feature_table",
    "score_pivot",
    "user_auc",
    "auc_report",
    "ease_gram",
    "als_scores",
    "sequence_scores",
    "svd_scores",
    "ease_scores",
    "bpr_scores",
    "ranker_scores",
)


def main() -> None:
    from duskrank.plans.registry import queries
    from duskrank.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench", os.environ.get("BENCH_MEMORY", "16g"))
    registered = queries()
    names = sys.argv[1:] or HEADLINE
    # the first query of a session pays for starting the JVM's code paths
    registered["target"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_wall_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
