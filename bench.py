"""Time the headline queries on one scale; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from colscope.plans.all_queries import QUERIES  # noqa: E402
from colscope.session import build_session  # noqa: E402

HEADLINE = [
    "profile_basic", "profile_types", "profile_uniqueness", "profile_categorical", "profile_numeric",
    "profile_dispersion", "profile_gini", "profile_moments", "profile_outliers", "profile_sequence", "profile_full",
    "field_outcomes", "clean_corpus", "nested_key_find", "features_join_labels", "corpus_profile", "corpus_training_table", "score_unlabeled", "csv_database_catalog", "batch_evaluation", "chart_lists", "csv_blocks", "columns_to_lists", "prediction_sink", "sink_roundtrip", "dedup_keep_first", "split_by_id",
    "sample_random", "sample_stratified", "sample_systematic", "clip_fit_apply", "zscore", "sequences_padded",
    "value_equal", "list_match", "evaluate_cases", "eval_chunks", "eval_by_hardness", "chart_rank_eval", "rank_metrics",
    "macro_prf", "mask_terms", "parse_json", "schema_catalog", "prompt_table", "chat_render", "batch_infer",
    "chart_data_month", "chart_data_weekday", "chart_data_grouped", "train_type_model", "train_axis_model",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    times = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")), "cpus": int(cpus)}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
