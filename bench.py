"""Wall time of the headline queries; prints one JSON line. ``index_sec`` is the writing of the trigram index that the searches read, once."""

from __future__ import annotations

import json
import os
import time

from folio.plans import registry
from folio.session import local_session

QUERIES = ["RT01_hybrid_search", "RT03_bm25", "TK01_vector_top", "JN01_chunks_pages", "AG01_page_text", "AG14_edges_and_degree", "AG15_usage_rollup", "CH09_split_report", "CH01_rag_chunks", "XA07_glossary", "CH31_page_issues", "FN13_plain_text"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, cpus, "folio-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/nation.parquet").count()
    took, known = {}, registry.queries()
    began = time.time()
    known["RT03_gram_index"](spark, sf).write.format("noop").mode("overwrite").save()
    index = round(time.time() - began, 3)
    for name in QUERIES:
        began = time.time()
        known[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "index_sec": index, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
