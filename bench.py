"""Benchmark: run the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Prints one JSON line ``{"metric", "value", "unit", "queries", "sf"}``; each
query is executed in full with the ``noop`` sink (no collection to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "corpus_clean_default",
    "vocab_min5",
    "cooccurrence_window",
    "thes_clean",
    "knn_symmetric",
    "eval_stats",
    "ls_eval_stats_multi_seed",
    "baseline_k_sweep",
    "bipartite_ls_stats",
    "pair_overlap",
    "embed_word2vec",
    "expansion_end_to_end",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]

    from lexiprop.plans.registry import all_queries
    from lexiprop.session import local_session

    spark = local_session(cpus, shuffle_partitions=max(8, int(cpus) * 2), app="lexiprop-bench")
    spark.sparkContext.setLogLevel("ERROR")
    qs = all_queries()
    # session warm-up (JVM, Python workers, Arrow), reported separately and not counted
    t0 = time.perf_counter()
    import pandas as pd
    from pyspark.sql import functions as F

    spark.range(1000).withColumn("k", F.col("id") % 8).groupBy("k").applyInPandas(
        lambda p: pd.DataFrame({"k": [int(p["k"].iloc[0])], "n": [len(p)]}), "k long, n long"
    ).collect()
    warmup = round(time.perf_counter() - t0, 3)
    timings = {}
    for name in names:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {timings[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(m.group(1)) if m else sf_dir,
                "warmup_sec": warmup,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
