"""Wall times of the headline queries; prints one JSON line.

Settings: BENCH_SF_DIR (folder of the tables), BENCH_CPUS (local cores), BENCH_RUNS (timed runs per
query, the best counts; one untimed run goes first).
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame

from tidewatch.plans import catalog
from tidewatch.session import session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

HEADLINE = [
    "alerts", "alerts_by_severity", "alerts_scope_all", "alert_lines", "packet_features",
    "packet_details", "port_scan", "source_scan_summary", "connection_count", "connection_epochs",
    "epoch_starts", "connection_summary", "recent_suspicious", "status_window", "run_totals",
    "batch_alert_rate", "label_distribution", "fit_vocabulary", "one_hot", "clean_numeric",
    "scaler_params", "apply_scaler", "stratified_split", "class_weight", "weighted_log_loss",
    "confusion_matrix", "threshold_sweep", "best_threshold", "roc_curve", "roc_auc", "pr_curve",
    "average_precision", "encode_packets", "dense_score", "predict_test", "stream_status",
]


def consume(df: DataFrame) -> None:
    """Run the whole query without moving rows to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session(
        "tidewatch-bench",
        master=f"local[{CPUS}]",
        spark__sql__shuffle__partitions=CPUS,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        consume(catalog.QUERIES[name](spark, FOLDER))
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            consume(catalog.QUERIES[name](spark, FOLDER))
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total wall time of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
