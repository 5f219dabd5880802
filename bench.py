"""Headline queries over one folder of star-schema tables; prints one JSON line.

The practice's tables are derived and written once, as they would be stored; then each
query runs over the stored tables: one warm-up, then the median of three runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame  # noqa: E402

from tallywork.catalog import AS_OF, AT, DORMANT_BEFORE, QUERIES, Case  # noqa: E402
from tallywork.plans import claims, reports, upkeep, views  # noqa: E402
from tallywork.session import build_session, shared_dir  # noqa: E402
from tallywork.sources import star, tables  # noqa: E402
from tallywork.streaming import balances as stream  # noqa: E402

RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def run_all(df: DataFrame) -> None:
    """Every row and column computed, nothing kept."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("ERROR")
    t0 = time.perf_counter()
    stored = tempfile.mkdtemp(prefix="practice-", dir=shared_dir(spark))
    raw_dir, client_dir = f"{stored}/raw", f"{stored}/kept"
    tables.write_practice(star.from_star(spark, folder), raw_dir, int(cpus))
    raw = tables.read_practice(spark, raw_dir)
    tables.write_table(upkeep.with_balances(raw, DORMANT_BEFORE, AT).client, client_dir, "client",
                       int(cpus))
    db = raw.replaced(client=tables.read_table(spark, client_dir, "client"))
    prepared = time.perf_counter() - t0

    printed = Case(spark, folder)
    printed.__dict__.update(raw=raw, db=db)

    def footers(name: str, scope: str) -> DataFrame:
        return reports.report_footers(db, name, AS_OF, "client", scope)

    def streamed() -> None:
        events = star.star_table(spark, folder, "events")
        rows = (spark.readStream.schema(events.schema)
                .option("pathGlobFilter", "events.parquet").parquet(folder))
        out, state = (tempfile.mkdtemp(prefix=p, dir=stored) for p in ("cells-", "stream-"))
        stream.keep_balances(star.change_rows(rows, star.visits_of(events)), out, state,
                             available_now=True).awaitTermination()
        run_all(stream.read_balances(spark, out))

    jobs: dict[str, Callable[[], None]] = {
        "r01_attendance_all": lambda: run_all(views.attendance_all(db)),
        "r02_attendance": lambda: run_all(views.attendance(db)),
        "r03_client_balances": lambda: run_all(views.client_balances(db)),
        "r04_group_attendance_trend": lambda: run_all(views.group_attendance_trend(db, AS_OF)),
        "r08_attendance_by_client": lambda: run_all(QUERIES["r08_attendance_by_client"](printed)),
        "r09_attendance_by_group": lambda: run_all(QUERIES["r09_attendance_by_group"](printed)),
        "a11_break_sums_any": lambda: run_all(footers("attendance_by_client", "any")),
        "a12_break_sums_level": lambda: run_all(footers("attendance_by_client", "level")),
        "r14_income_by_therapist": lambda: run_all(reports.income_by_therapist(db, AS_OF)),
        "r23_invoice_batch": lambda: run_all(reports.invoice_batch(db, AS_OF)),
        "r25_smoke_totals": lambda: run_all(reports.smoke_totals(db, AS_OF)),
        "c03_claim_slots": lambda: run_all(claims.claim_file(db, None, AS_OF)),
        "c05_printed_claims": lambda: run_all(claims.printed_claims(db, AS_OF)),
        "m04b_refresh_everybody": lambda: run_all(upkeep.refresh_balances(db, AT, True)),
        "t01_streamed_balances": streamed,
    }
    only = sys.argv[1:]
    took: dict[str, float] = {}
    for name, job in jobs.items():
        if only and name not in only:
            continue
        job()
        times = []
        for _ in range(RUNS):
            t = time.perf_counter()
            job()
            times.append(time.perf_counter() - t)
        took[name] = round(statistics.median(times), 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3),
                      "unit": "sec", "queries": took, "sf": Path(folder).name.removeprefix("sf"),
                      "prepare_sec": round(prepared, 3)}))
    spark.stop()


if __name__ == "__main__":
    main()
