"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from palaver.plans.catalogue import QUERIES
from palaver.session import local_session

HEADLINE = ("talk_time", "line_durations", "handover_grid", "longest_runs", "phrase_counts", "phrase_counts_of_documents", "hit_levels", "trend_rows", "trend_top_episodes", "trend_of_sentences", "token_freq", "log_odds_signature", "vocab_ttr", "voice_best_margin", "nearest_line", "cue_parse", "topic_share")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, cpus, "16g")
    QUERIES["talk_time"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's compilers
    took = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
