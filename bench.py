"""Times the headline queries and prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerloom.plans import catalog  # noqa: E402
from ledgerloom.session import build_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "n09_normalize_record", "a11_survivorship", "d04_provenance", "j01_exact_match", "j03b_resolve_in_order",
    "j02_similar_names", "u02_register_keys", "d06_change_events", "d07_rescore", "a09_flatten_contacts",
    "c01_contact_extraction", "j04_new_leads", "t01b_default_sort", "a01_event_counts", "w06_latest_events",
]


def main() -> None:
    spark = build_session("ledgerloom-bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{SF_DIR}/orders.parquet").count()
    seconds = {}
    for key in ["flagship", *HEADLINE]:
        query = catalog.flagship if key == "flagship" else catalog.BOOK.queries[key]
        started = time.perf_counter()
        query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.perf_counter() - started, 3)
        print(key, seconds[key], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
