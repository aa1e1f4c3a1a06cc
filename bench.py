"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. The mail tables
are first copied, untimed, to as many files as there are cores: the given ones have one row group each, which
a reader cannot split, while a large table has many.
Every query runs in full into a sink that discards rows. Model training is timed once, as
``train_models``; the queries after it use the trained models.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from mailsift import queries as Q  # noqa: E402
from mailsift.sources.inbox import TABLES  # noqa: E402

HEADLINE = [
    "merge_sources_summary", "exact_dedup_first_source", "duplicates_by_source", "cleaned_text",
    "quality_flags_before_after", "non_email_filtered", "html_strip_pages", "train_val_test_split",
    "text_features_by_label", "url_features_by_label", "tfidf_vocabulary", "tfidf_weights", "assembled_matrix",
    "metrics_overall_by_source", "roc_auc_by_source", "threshold_pick", "best_baseline_vs_ensemble",
    "mbox_messages", "json_tree_texts", "train_models", "score_mails", "explain_top10",
]


def laid_out(spark: SparkSession, sf_dir: str, files: int) -> str:
    out = tempfile.mkdtemp(prefix="mailsift-bench-")
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(files).write.parquet(f"{out}/{name}.parquet")
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("mailsift-bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = laid_out(spark, sf_dir, int(cpus))
    wanted = os.environ.get("BENCH_QUERIES")
    seconds = {}
    for name in wanted.split(",") if wanted else HEADLINE:
        start = time.time()
        if name == "train_models":
            Q.trained(spark, folder)
        else:
            Q.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
