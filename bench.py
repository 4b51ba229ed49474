"""Benchmark: headline KPI queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

The seven input tables are derived from the driver's parquet files and
materialised once (as a production deployment would have them stored:
by day, payments a second time by their own day) into a fresh folder
under ``spark.checkpoint.dir``; that step is timed as ``materialize``.  Each
query is then timed end to end (plan + full execution into Spark's ``noop``
sink).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dunlin.operators import contact, migration, ptp, recovery, staffing  # noqa: E402
from dunlin.plans import report  # noqa: E402
from dunlin.session import get_session  # noqa: E402
from dunlin.sources.derived import from_testdata  # noqa: E402
from dunlin.sources.periods import Periods  # noqa: E402
from dunlin.sources.tables import scratch_path  # noqa: E402

MAIN = Periods.of(("2024-01-08", "2024-01-14"))
WEEKS = Periods.of(("2024-01-01", "2024-01-07"), ("2024-01-08", "2024-01-14"),
                   ("2024-01-15", "2024-01-21"), ("2024-01-22", "2024-01-28"))
MONTH = Periods.of(("2024-01-01", "2024-01-28"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus), app="dunlin-bench")

    t0 = time.time()
    tables = from_testdata(spark, sf_dir).materialize(scratch_path(spark, "bench"))
    materialize = time.time() - t0

    plan = {
        "welcome_call_contact_rate": lambda t: contact.welcome_call_contact_rate(t, MAIN),
        "reminder_call_contact_rate": lambda t: contact.reminder_call_contact_rate(t, MAIN),
        "bucket_contact_rate_1": lambda t: contact.bucket_contact_rate(t, MAIN, 1),
        "bucket_normalization_1": lambda t: migration.bucket_normalization(t, MAIN, 1),
        "recovery_wide": lambda t: recovery.recovery_wide(t, MAIN),
        "rollback": lambda t: migration.rollback(t, MAIN),
        "ptp_received_kept": lambda t: ptp.ptp_received_kept(t, MAIN),
        "ptp_payments_by_bucket": lambda t: ptp.ptp_payments_by_bucket(t, MAIN),
        "fte": lambda t: staffing.fte(t, MAIN),
        "total_accounts": lambda t: staffing.total_accounts(t, MAIN),
        "active_works": lambda t: staffing.active_works(t, MAIN),
        "bucket_transitions_weeks": lambda t: migration.bucket_transitions(t, WEEKS),
        "weekly_kpi_report": lambda t: report.weekly_kpi_report(t, MAIN),
        "weekly_kpi_report_4weeks": lambda t: report.weekly_kpi_report(t, WEEKS),
        "monthly_kpi_report": lambda t: report.monthly_kpi_report(t, MONTH),
    }
    # untimed warm-up (JIT, code generation caches), on a different period
    s = time.time()
    contact.welcome_call_contact_rate(tables, Periods.of(("2024-01-22", "2024-01-28"))) \
        .write.mode("overwrite").format("noop").save()
    warmup = time.time() - s

    only = set(a for a in sys.argv[1:] if not a.startswith("-"))
    times = {}
    for name, fn in plan.items():
        if only and name not in only:
            continue
        s = time.time()
        # run the whole plan; the noop sink discards rows instead of shipping
        # them to Python (row-level outputs would otherwise time the transfer)
        # the reports keep what several of their KPIs share; a single KPI uses everything once
        with tables.reusing() if name.endswith(("_report", "_4weeks")) else tables as t:
            fn(t).write.mode("overwrite").format("noop").save()
        times[name] = round(time.time() - s, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "kpi_queries_total_wall",
        "value": total,
        "unit": "sec",
        "queries": times,
        "materialize_sec": round(materialize, 3),
        "warmup_sec": round(warmup, 3),
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
