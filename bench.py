"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names; default the headline set, "all" for all).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from govaudit.plans import registry  # noqa: E402
from govaudit.session import local_session  # noqa: E402

HEADLINE = [
    "violations_by_sector", "rule_results", "label_audit", "baseline_average", "phrase_in_documents",
    "validated_actions", "recovered_json", "reward_log", "review_states", "reward_breakdown", "review_grades",
    "review_explanations", "rule_based_verdicts", "planned_reviews", "rating_states", "rating_history",
    "round_outcomes", "leaderboard", "weakness_states", "curriculum", "frequently_missed",
    "codes_by_difficulty", "targeted_codes_and_domains", "verified_packets", "mutated_packets",
]


def main() -> None:
    registry.load_all()
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(registry.QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = local_session(cpus)
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()  # warm-up
    times = {}
    for name in names:
        begin = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
        print(name, times[name], file=sys.stderr)
    spark.stop()
    print(json.dumps({"metric": "total wall time of the queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
