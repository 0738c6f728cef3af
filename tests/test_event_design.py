"""Diagnostics of an event design on a panel made by hand."""

import datetime

from macrotide.operators import events


def test_diagnostics_of_a_step_after_each_event(spark):
    day = lambda k: datetime.date(2000, 1, 1) + datetime.timedelta(days=k)
    values, level = [], 0.0
    for k in range(80):
        level += 5.0 if k % 8 == 7 else 0.01 * (k % 3)
        values.append(("a", day(k), level))
    panel = spark.createDataFrame(values, "series string, date date, value double")
    found, looser = events.select_events(panel, 0.88, 4), events.select_events(panel, 0.5, 4)
    placebo = found.selectExpr("series", "i - 3 as i").filter("i > 1")
    rows, shifted = (events.event_panel(panel, e, -2, 2, -1) for e in (found, placebo))
    got = events.design_diagnostics(rows, shifted, found, looser, 2).collect()
    assert len(got) == 1 and got[0].n_events == 10 and got[0].overlap == 1.0 and got[0].stability == 1.0
    shared = len({r.i for r in found.collect()} & {r.i for r in looser.collect()})
    assert got[0].jaccard == shared / len({r.i for r in found.collect()} | {r.i for r in looser.collect()})
    assert "support" not in got[0].failed and "stable" not in got[0].failed
    none = events.design_diagnostics(rows.limit(0), shifted.limit(0), found, looser, 2).first()
    assert none.overlap is None and none.failed == "pretrend;placebo;depth;stable"
