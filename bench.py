"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Every result row is produced and
sent to the ``noop`` sink. A small query warms the session up first.
"""

from __future__ import annotations

import json
import os
import time

from catalog import QUERIES
from sievelight.session import local_session

HEADLINE = (
    "text_report validate_text_ml text_duplicates_any union_sources label_balance value_percent "
    "nunique_by_column histogram_bins tfidf_vocab tfidf_top_terms impute_median preprocess_metadata "
    "standard_scale_fit encode_mias split_three_way stratified_order validate_image_files "
    "image_report clean_filter pipeline_summary join_images_inner image_duplicates_md5 load_image_gray "
    "classification_report roc_auc evaluate_loss_accuracy permutation_importance train_classifier"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    QUERIES["value_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
