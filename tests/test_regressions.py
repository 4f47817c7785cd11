"""Regressions against counting event by event."""

import random
from datetime import datetime, timedelta

from faultline.operators import telemetry


def test_parts_of_the_hour_give_the_counts_of_every_window(spark, monkeypatch):
    monkeypatch.setattr(telemetry, "PART_ROWS", 40)
    rng, start = random.Random(3), datetime(2024, 1, 1)
    events = [(start + timedelta(seconds=rng.choice([rng.randrange(900_000), rng.randrange(250) * 3600])), rng.randrange(9), rng.choice("ab"), rng.choice("cd"), "X")
              for _ in range(1500)]
    changes = [(i, "T", start + timedelta(seconds=rng.choice([rng.randrange(900_000), rng.randrange(250) * 3600])), rng.choice(["X", "X", "Y", None]),
                rng.choice(["a", None]), rng.choice(["c", None])) for i in range(300)]
    got = telemetry.regressions(
        spark.createDataFrame(changes, "change_id long, ticket_id string, merged_at timestamp, error_category string, app string, chipset string"),
        spark.createDataFrame(events, "ts timestamp, user_id long, app string, chipset string, error_category string"))
    got = {r.change_id: (r.hours_after_merge, r.current_rate, round(r.baseline_rate, 9)) for r in got.collect()}
    want = {}
    for i, _, at, category, app, chipset in changes:
        mine = [e[0] for e in events if e[4] == category and app in (None, e[2]) and chipset in (None, e[3])]
        base = sum(at - timedelta(hours=168) <= t < at for t in mine) / 168
        for h in range(1, 73):
            n = sum(at + timedelta(hours=h - 1) <= t < at + timedelta(hours=h) for t in mine)
            if base > 0 and n / base >= 1.5:
                want[i] = (h, float(n), round(base, 9))
                break
    assert got == want and len(want) > 100
