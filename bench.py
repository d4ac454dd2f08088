"""Time the headline queries, cold and warm; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma separated, default the list below).  "queries" holds the first run of
each query, "warm" the second.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from lekhya.plans import QUERIES
from lekhya.session import get_session, release_staged

HEADLINE = [
    "bm25_topk", "bm25_acl_topk", "hybrid_search", "cosine_topk", "hashed_embedding_votes",
    "acl_visible_counts", "soft_filter", "parse_questions", "evidence_packet",
    "claim_extraction", "precedent_extraction", "document_metadata",
    "clean_text", "language_profile", "quality_flags", "contradictory_pages", "semantic_units",
    "chunk_packing", "chunk_blocks", "error_rates", "exact_match", "secret_redaction",
    "content_issues", "html_links", "exact_duplicates", "version_chain", "incremental_ingest",
    "delta_quarantine", "signed_inventory", "rate_limit", "idempotent_replays",
    "latest_versions", "block_resolution", "session_summary", "ndcg_at_10",
    "scorecard_grouping_sets", "latency_percentiles", "citation_coverage",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.driver.memory": "16g", "spark.sql.shuffle.partitions": cpus,
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": Path(tempfile.mkdtemp(prefix="bench-")).as_uri()})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["acl_visible_counts"](spark, folder).count()  # start the workers once
    times, warm = {}, {}
    for name in names:
        for taken in (times, warm):
            begin = time.perf_counter()
            try:
                QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
                taken[name] = round(time.perf_counter() - begin, 3)
            except Exception as e:  # a failing query is reported, not hidden
                taken[name] = None
                print(f"{name}: {str(e)[:300]}", file=sys.stderr)
            release_staged(spark)
        print(f"{name}: {times[name]} {warm[name]}", file=sys.stderr, flush=True)
    total = round(sum(t for t in times.values() if t is not None), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec",
                      "queries": times, "warm": warm,
                      "conf": {k: spark.conf.get(k) for k in (
                          "spark.sql.shuffle.partitions", "spark.driver.memory")}, "sf": os.path.basename(folder), "cpus": int(cpus),
                      "failed": [n for n, t in times.items() if t is None]}))


if __name__ == "__main__":
    main()
