"""Times the headline queries; prints one JSON line."""

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))
from loomframe.queries import QUERIES  # noqa: E402

HEADLINE = ["flagship_filter_group", "pricing_summary", "map_project", "filter_and_or_not", "group_by_many_keys", "reduce_sum", "distinct_by_first", "min_by_group", "order_by_take", "join_inner", "filter_some_semi", "local_supplier_volume", "flat_map_words", "arrays_aggregate", "strings_regex", "dates_truncate", "numbers_scalar", "map_with_index"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.files.openCostInBytes", "1m")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='bench-')}").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    out = {}
    for name in HEADLINE:
        times = []
        for _ in range(4):
            began = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        out[name] = round(statistics.median(times[1:]), 4)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": sf}))


if __name__ == "__main__":
    main()
