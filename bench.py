"""Time the headline queries and print one JSON line.

Reads BENCH_SF_DIR (default the sf0.1 tables) and BENCH_CPUS (default 8).
Each query is written to the no-op sink, so all of its rows are produced.
"""

from __future__ import annotations

import json
import os
import time

from bindings.queries import QUERIES
from bindings.tables import Tables
from doseframe.session import build_session

HEADLINE = [
    "scan_de",
    "fetch_de",
    "sql_over_de",
    "indexed_fetch",
    "treatment_index",
    "signature_scores",
    "pathway_activity",
    "score_responses",
    "top_genes",
    "ranked_genes",
    "set_membership",
    "enrichment_score",
    "prerank_scale",
    "index_and_enrich",
    "significant_pathways",
    "top_activated",
    "build_questions",
    "split_tasks",
    "replay_episodes",
    "episode_score",
    "stream_signature_filter",
    "stream_first_seen",
    "stream_replay",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.sql.shuffle.partitions": cpus,
            # One machine and small files: split scans and keep partitions so that every core has work.
            "spark.sql.files.maxPartitionBytes": "2m",
            "spark.sql.files.openCostInBytes": "256k",
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)

    tables = Tables(spark, sf_dir)
    # What the reference prepares once: fact files and stored results.
    timed("prepare_de_files", tables.de_store)
    timed("prepare_enrichment", tables.enrichment_path)
    for name in HEADLINE:
        timed(name, lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    spark.stop()
    total = round(sum(seconds[n] for n in HEADLINE), 3)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)}
        )
    )


if __name__ == "__main__":
    main()
