"""Time the headline queries over whole tables and print one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the number of local cores. Every query is
written to the no-op sink, so all of its columns are computed; it is run once to warm up and then
timed ``BENCH_RUNS`` times, of which the fastest counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import queries as Q  # noqa: E402
from promptloom.session import build_session  # noqa: E402

HEADLINE = (
    "compress_prompt",
    "compress_detailed",
    "compression_diff",
    "tokenize",
    "word_count",
    "generate_requests",
    "extract_requirements",
    "clean_history",
    "phase_complete",
    "classify_intent",
    "parse_plan",
    "run_report",
    "run_events",
    "run_pipeline",
    "assemble_output",
    "local_stream_tokens",
    "call_fold",
    "frame_decode",
    "run_state",
    "chunk16",
    "stream_compress",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    only = os.environ.get("BENCH_QUERIES", "").split()
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = Q.queries()

    def seconds(name: str) -> float:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times: dict[str, float] = {}
    for name in only or HEADLINE:
        seconds(name)
        times[name] = round(min(seconds(name) for _ in range(runs)), 3)
    total = round(sum(times.values()), 3)
    scale = os.path.basename(sf_dir).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": scale}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
