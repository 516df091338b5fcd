"""The streaming escalation closes the loops of all subjects who purchase."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_every_purchase_closes_its_loop(spark):
    bought = {r.user_id for r in spark.read.parquet(f"{SF}/events.parquet").where("event_type = 'purchase'").select("user_id").distinct().collect()}
    status = {r.pid: r.status for r in __spark_entry__.queries()["t7_stream_escalation"](spark, SF).collect()}
    met = {p: s for p, s in status.items() if p in bought}
    assert any(p % 10 for p in met) and set(met.values()) == {"CLOSED"}
    assert "CLOSED" not in {s for p, s in status.items() if p not in bought}
    print("figures", len(status), len(met), sum(p % 10 == 0 for p in met))
