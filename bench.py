"""Headline timings: one JSON line.

``BENCH_SF_DIR`` picks the tables (default /root/testdata/sf0.1) and
``BENCH_CPUS`` the local cores.  Each query is planned, run to the last row and
discarded.  ``ingest_*_records`` entries time the writing of the records tables that
the ordered queries then read, ``render_*`` entries that of the logger files that text
and record parsers read.  ``parts`` has for each query the seconds until its plan was
there (with the small tables that are computed for it) and those of the run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from telemetra.plans import q_folder, q_ingest, registry  # noqa: E402
from telemetra.session import build_session  # noqa: E402
from telemetra.sources import tables  # noqa: E402

HEADLINE = (
    "hist2d_hits", "hist2d_cell_statistics", "density_grid", "describe_channels",
    "channel_statistics", "correlation", "regression_residuals", "z_score",
    "moving_average", "moving_average_long_log", "median_filter_long_log",
    "time_derivative_long_log", "index_shift", "time_shift_long_log", "nearest_record_cursor",
    "merge_rates", "exponential_moving_average", "butterworth_lowpass", "drift_flags",
    "lttb", "lttb_long_log", "formula_shifts", "formula_statistics", "unit_conversion",
    "normalise_channel_names", "ingest_keyvalue", "ingest_holdfill", "ingest_fixed_records",
    "table_operation", "analyze_rich_lean_zone", "analyze_injector_duty_cycle",
)
INGEST = {
    "ingest_event_records": tables.event_records,
    "ingest_event_stream_record": lambda s, f: tables.event_stream_record(s, f),
    "ingest_line_records": tables.line_records,
    "ingest_order_records": tables.order_records,
}
RENDER = {
    "render_keyvalue": q_ingest.keyvalue_lines,
    "render_holdfill": q_ingest.holdfill_lines,
    "render_fixed_records": q_folder.record_folder,
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "telemetra-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables.read_table(spark, folder, "nation").count()  # start the JVM side once
    took: dict[str, float] = {}
    parts: dict[str, dict[str, float]] = {}
    for name, build in (INGEST | RENDER).items():
        start = time.perf_counter()
        build(spark, folder)
        took[name] = round(time.perf_counter() - start, 3)
    known = registry.entries()
    for name in HEADLINE:
        start = time.perf_counter()
        result = known[name].build(spark, folder)
        planned = time.perf_counter()
        result.write.format("noop").mode("overwrite").save()
        ended = time.perf_counter()
        took[name] = round(ended - start, 3)
        parts[name] = {"plan": round(planned - start, 3), "run": round(ended - planned, 3)}
    print(
        json.dumps(
            {
                "metric": "total wall-clock of headline queries",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "parts": parts,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
