"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sparkvec.catalog import QUERIES  # noqa: E402
from sparkvec.session import get_spark  # noqa: E402

HEADLINES = (
    "R1_build_index_postings", "R2_sparse_search_dot", "R2_text_lookup", "R3_sparse_search_cosine",
    "R4_coder_search_dot", "R5_all_documents_search", "R6_dense_search", "R6_dense_search_blocks",
    "R6_text_dense_search", "C1_topk_encode", "C8_raw_topk", "C6_decode", "C11_sharded_encode", "C12_pca_fit",
    "E1_E7_embed", "M4_ndcg", "M8_sparse_vs_dense", "M10_sparsity_trade_off", "M12_raw_topk_suite",
    "J1_relevance", "J4_negatives", "S1_read_items", "S3_qrels_lenient", "K2_manifest", "X2_incremental_index",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    names = sys.argv[1:] or HEADLINES
    QUERIES["M4_ndcg"](spark, sf_dir).collect()  # start the Python workers and warm the JVM
    seconds = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
