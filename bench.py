"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tankwise.plans import evaluation
from tankwise.plans.queries import QUERIES

NAMES = ["segment_noise", "look_around", "heuristic_labels", "confusion", "curve_quality", "kalman_end", "fleet_by_region", "latest_points", "motion_states", "smooth_tracking"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["segment_noise"](spark, sf).write.format("noop").mode("overwrite").save()  # starts the workers
    took = {}
    for name in NAMES:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    # the forest learns once, outside the clock, as in a service; then every point gets its state and is tracked
    began = time.time()
    model = evaluation.trained(spark, sf)
    training = round(time.time() - began, 3)
    began = time.time()
    evaluation.replayed_with(spark, sf, model).write.format("noop").mode("overwrite").save()
    took["predicted_replay"] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total seconds of the telemetry queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "training_sec": training, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
