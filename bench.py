"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query is run once to warm the JVM and then timed; the result is written to the no-op sink,
so all rows and columns are computed.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

HEADLINE = [
    "a01_max_rate_by_servicer", "a03_first_delinquency", "a07_max_rate_by_batch", "a09_boxes_per_image",
    "a11_stats_by_parameter", "a14_total_and_average_by_step", "j06_performance_with_monthly_features",
    "j12_images_with_boxes", "k08_sharded_corpus", "k08_built_corpus", "k15_round_robin_files", "m00_loan_training_table",
    "m01_encoded_text_columns", "m02_cleaned_training_results", "p09_varying_columns", "p13_drop_degenerate_boxes", "p13_p14_normalised_boxes",
    "r01_unstack", "s01_performance_csv", "s08_result_records", "s12_xml_annotations", "t01_counter_feed_rates", "t02_utilisation_per_window",
    "w01_forward_12_month_label", "w04_sample_rate", "w05_running_maximum", "w06_irate_at_samples", "w06_irate_on_step_grid",
    "w07_average_over_2_minutes", "w08_traffic_per_bucket", "w09_shuffled_shards", "w10_matching_lines_and_next",
    "w11_cumulative_bytes", "w15_value_on_step_grid", "x17_box_line",
]


def main() -> None:
    from fathomry.catalog import CATALOG
    from fathomry.session import build_session

    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        app="bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.log.level": "ERROR",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
        },
    )

    def run(name: str) -> float:
        begin = time.perf_counter()
        CATALOG[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(run(name), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
