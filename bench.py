"""Timings of the headline queries, one JSON line on standard output."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from weirspan.plans import registry  # noqa: E402
from weirspan.session import local_session  # noqa: E402

# One query of every kind of work: flow records, lookups, jumps, ranges, spatial, network, validation.
HEADLINE = (
    "jump_class A1_median_and_max A3_return_period_flows A5_exceedance_flows A13_daily_mean W1_flow_duration_curve J21_exceedance_of_flow "
    "K2_reach_statistics_with_exceedance K8_incident_exceedance_per_source J1_rekey_nhd_to_tdx J5_keys_present U6_replace_rows_of_keys K11_cleaned_slices "
    "J11_tolerance_join J13_nearest_cell J16_priority_nearest_reach J17_region_of_site J28_network_walk F38_target_points F12_area_and_centroid "
    "F15_conjugate_by_momentum F19_danger_range_rectangular F18_danger_range_momentum K6_site_analysis_sections K6_site_analysis_results K9_danger_curves "
    "A20_agreement_summary A24_height_density K13_validation_report ST1_daily_mean_stream"
).split()


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{root}/lineitem.parquet").groupBy("l_suppkey").count().write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        registry.QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = os.path.basename(root.rstrip("/")).removeprefix("sf")
    out = {"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
