"""Expedited reporting clock: state for each case, with event-time timers.

The first report of a case that is serious and unexpected opens a clock of ``days``.  The next report of the
case, received until the clock is due, closes it (``met``); it opens none itself.  A clock that comes due without one is
``overdue``: told by the timer once the watermark has passed it, or by a later report of the case, whichever comes
first.  After either the case can open a clock anew.  Clocks that aren't due yet are state, not rows.

Reports of a case are taken in the order of their received times within a micro-batch (ties by report id).  A report that
comes later than the watermark allows can still open a clock, and is then judged by its received time; one received
before the running clock was opened doesn't close it.

State is kept for buckets of cases, not for each case: a bucket's row holds the running clocks of its cases, its timer is
the first of them to come due.  So a micro-batch calls Python once a bucket, and cases cost a few steps of a loop each.
``buckets`` grows with the cases: some thousands of them a bucket are well.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DAYS = 15
DAY_MS = 86_400_000
BUCKETS = 1024
NO_REPORT = -(1 << 63)  # stands for a null report id: pandas would turn its column into floats
STATE = "cases array<long>, opened_by array<long>, opened_ms array<long>"
OUT = "case_id long, opened_by long, opened_ms long, closed_by long, closed_ms long, status string"
Clock = tuple[int, int]


def walk(clock: Clock | None, reports: list[tuple[int, int, bool]], days: int = DAYS) -> tuple[Clock | None, list[tuple]]:
    """The clock after (received_ms, report_id, opens) in order, and the clocks that ended: (opened_by, opened_ms, closed_by, closed_ms, status)."""
    ended = []
    for t, report, opens in reports:
        if clock and t < clock[1]:
            continue
        if clock and t <= clock[1] + days * DAY_MS:
            ended.append((*clock, report, t, "met"))
            clock = None
            continue
        if clock:
            ended.append((*clock, None, None, "overdue"))
            clock = None
        if opens:
            clock = report, t
    return clock, ended


def _frame(ended: list[tuple]) -> pd.DataFrame:
    case, by, at, closed_by, closed_at, status = zip(*ended)
    whole = lambda v: pd.array([None if x == NO_REPORT else x for x in v], dtype="Int64")
    return pd.DataFrame({"case_id": pd.array(case, dtype="Int64"), "opened_by": whole(by), "opened_ms": whole(at), "closed_by": whole(closed_by),
                         "closed_ms": whole(closed_at), "status": list(status)})


def expedited(reports: DataFrame, days: int = DAYS, delay: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """Ended clocks of a stream of case_id, report_id (longs), received (timestamp) and opens (serious and unexpected)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        running: dict[int, Clock] = {}
        if state.exists:
            cases, by, at = state.get
            running = dict(zip(cases, zip(by, at)))
        ended = []
        if not state.hasTimedOut:
            rows = sorted(r for b in batches for r in zip(b["case_id"].tolist(), b["ms"].tolist(), b["report_id"].tolist(), b["opens"].tolist()))
            for case, own in groupby(rows, itemgetter(0)):
                clock, done = walk(running.pop(case, None), [r[1:] for r in own], days)
                ended += [(case, *e) for e in done]
                if clock:
                    running[case] = clock
        now = state.getCurrentWatermarkMs()
        for case in [c for c, (_, at) in running.items() if at + days * DAY_MS < now]:  # no report came, or a late one opened it
            ended.append((case, *running.pop(case), None, None, "overdue"))
        if running:
            state.update((list(running), *(list(v) for v in zip(*running.values()))))
            state.setTimeoutTimestamp(min(at for _, at in running.values()) + days * DAY_MS)
        elif state.exists:
            state.remove()
        if ended:
            yield _frame(ended)

    own = reports.select("case_id", F.coalesce("report_id", F.lit(NO_REPORT)).alias("report_id"), "received",
                         F.coalesce("opens", F.lit(False)).alias("opens"), F.unix_millis("received").alias("ms"),
                         F.pmod(F.xxhash64("case_id"), F.lit(buckets)).alias("bucket"))
    return (own.where("case_id is not null and received is not null").withWatermark("received", delay).groupBy("bucket")
            .applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout))
