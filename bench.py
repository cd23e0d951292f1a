"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the driver tables, BENCH_CPUS the local
cores. Every query is planned and run to completion, all rows and columns, nothing cached
between queries; the session is warmed with one untimed run of the first query. A query that
fails is reported under ``failed`` and the exit status is 1; the others are timed all the same.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from gearledger import catalog  # noqa: E402
from gearledger.session import local_session  # noqa: E402

HEADLINE = (
    "vw1_inventory_status", "vw2_available_equipment", "vw3_rental_details",
    "vw4_invoice_full", "vw5_return_analysis", "fl8_items_per_equipment_status",
    "fl11_unpaid_invoices_by_day", "rp2_late_fee_report", "rp3_damage_fee_report",
    "fn1_equipment_value", "fn6_shipping_fee", "fn7_generated_codes",
    "sp1_check_compatibility", "sp2_update_inventory_on_rent",
    "sp3_update_inventory_on_return", "sp4_create_rental", "sp4_create_rental_items", "sp5_create_deposit_payment",
    "sp6_pickup_media", "sp7_create_invoice", "sp8_pay_invoice", "sp9_process_refund",
    "sp10_complete_rental", "tr1_check_new_items", "tr4_audit_rentals",
    "tr7_equipment_status", "tr9_rental_totals", "tr11_rental_item_ids", "dq1_primary_keys", "dq3_foreign_keys",
    "dq4_not_null", "st2_deposit_settlement", "st3_overlapping_rentals",
    "str1_audit_stream", "str2_running_totals",
)


def main() -> int:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, app="gearledger-bench")
    queries = catalog.queries()
    queries[HEADLINE[0]](spark, folder).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        try:
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        except Exception as error:  # one broken query must not hide the others
            failed[name] = f"{type(error).__name__}: {str(error).splitlines()[0][:200]}"
            print(f"{name} FAILED {failed[name]}", file=sys.stderr, flush=True)
            continue
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = Path(folder).name.removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
                "cpus": int(cpus),
                **({"failed": failed} if failed else {}),
            }
        )
    )
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
