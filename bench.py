"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

smaller data (two queries on the smallest folder beside the measured one, where there is one).
"""

import json
import os
import time

from orthomark.plans import catalog
from orthomark.session import local_session

HEADLINE = (
    "j1_match_evidence", "a3_candidate_identity", "a17_match_summary", "j2_overlap_boxes", "j3_merge_candidates",
    "j3_merge_across_windows", "j4_detections_at_sites", "j7_apply_label_edits", "w1_number_objects", "a9_duplicate_leakage",
    "q1_parse_requests", "p4_filter_results", "j8_match_descriptors_l2", "u2_union_masks", "r9_connected_components_8",
    "r12_detect_changes", "r13_outlines", "r7_percentile_stretch", "r16_warp", "w7_fresh_responses",
)
WARM_UP = ("a3_candidate_identity", "u2_union_masks")


def run(spark, sf_dir: str, name: str) -> float:
    started = time.time()
    # Every column of every row is computed, nothing is written or collected.
    catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.time() - started, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "orthomark-bench")
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    for name in WARM_UP:
        run(spark, small if os.path.isdir(small) else sf_dir, name)
    wanted = os.environ.get("BENCH_QUERIES")
    times = {name: run(spark, sf_dir, name) for name in (wanted.split(",") if wanted else HEADLINE)}
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
