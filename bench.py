"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from veilspan.plans.catalogue import QUERIES
from veilspan.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "find_email",
    "find_credit_card",
    "find_phone",
    "find_api_key",
    "find_password",
    "find_password_text_scope",
    "findings_all",
    "count_by_entity",
    "rollup_source_entity",
    "resolve_notes",
    "redact_email",
    "redact_all",
    "redact_notes",
    "verify_fail_closed",
    "report_joined",
    "assemble_pages",
    "find_person",
    "find_address",
    "redact_with_names",
    "verify_redacted",
    "write_versions",
    "restore_written",
    "restore",
    "findings_segmented",
    "findings_model",
    "redact_udf",
    "read_merged",
)


def main() -> None:
    spark = build_session(
        "bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__ui__enabled="false",
        spark__driver__memory="16g",
        # The tables are one scan split each: deal them out, as the many splits of a large table are.
        veilspan__input__partitions=CPUS,
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Starting up and compiling the matching code are not a query's cost: one real query runs first.
    QUERIES["redact_email"](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
