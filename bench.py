"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

from catalog.queries import registry  # noqa: E402
from folioscope.session import local_session  # noqa: E402

HEADLINES = (
    "ingest_ledger",
    "ingested_points",
    "content_hash",
    "dedup_first",
    "incremental_anti",
    "page_lines",
    "chunk_naive",
    "chunk_recursive",
    "chunk_stats",
    "page_points",
    "hash_embed",
    "vector_topk5",
    "vector_topk25",
    "naive_retrieval",
    "reranked_retrieval",
    "text_retrieval",
    "context_assembly",
    "prompt_render",
    "qa_pairs",
    "history_window",
    "stream_history",
    "chat_prompt_parts",
    "chat_turns",
    "eval_dataset",
    "answer_relevancy",
    "answer_correctness",
    "metric_suite",
    "judge_json",
    "first_success",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = local_session(cpus, "bench", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    timings: dict[str, float] = {}
    first: dict[str, float] = {}
    for name in HEADLINES:
        runs = []
        for _ in range(repeats):
            start = time.perf_counter()
            registry()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        # The best run; the first one, told apart, also starts Python workers, compiles and, for the
        # first query that needs it, ingests the documents into the index.
        timings[name] = round(min(runs), 3)
        first[name] = round(runs[0], 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "first_runs": first,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
