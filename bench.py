"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf"}.
Every query is executed to completion with the ``noop`` sink (all rows
produced, nothing collected to the driver). ``value`` is the sum of the
per-query wall times.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quarry.plans.catalog import QUERIES  # noqa: E402
from quarry.session import get_spark  # noqa: E402

HEADLINE = [
    "qa_pairs", "qa_count_by_agent", "split_random", "orchestrator_split", "format_errors",
    "distributions", "dialog_history", "parse_completion", "page_text", "toc_links",
    "chapter_concat", "gen_prompt", "vocab", "mask_labels", "pack_chunks", "knn_dense",
    "knn_lexical", "rag_answer", "routed_answer", "bleu", "meteor_exact", "rouge_l",
    "rouge_lsum", "eval_summary", "batch_latency", "train_curve", "eval_paired", "rag_prompt_agent",
    "pad_batches", "length_batches", "meteor_stages", "eval_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or (os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE)
    spark = get_spark(app="quarry-bench")
    times: dict[str, float] = {}
    # warm-up on the smallest scale: JIT, codegen caches, Python workers
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        for name in names:
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_queries_total_wall", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
