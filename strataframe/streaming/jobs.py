"""Job and assessment states of a stream, kept by key with timers.

``job_stream`` holds the state machine of each job: only legal transitions
count, and a job that stays in a state longer than its time-out fails by a
timer. ``assessment_stream`` numbers the assessments of each client: one goes
on while the product stays the same, and a client that is silent for too long
begins a new one. Both take a saved state to start from, and a restart from the
checkpoint goes on where the stream stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The states a job may go to from each state.
TRANSITIONS = {None: ("QUEUED",), "QUEUED": ("PROCESSING", "FAILED"), "PROCESSING": ("COMPLETED", "FAILED"), "COMPLETED": (), "FAILED": ()}
LIVE = ("QUEUED", "PROCESSING")

#: State store that arbitrary keyed state needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

JOB = "job string, at timestamp, state string, accepted boolean, reason string"
ASSESSMENT = "client string, at timestamp, product string, assessment long, fresh boolean"


class _Jobs(StatefulProcessor):
    """Key: job. Rows: at, state. A live state's timer is set anew by every accepted change."""

    def __init__(self, timeout_s: float):
        self.timeout_ms = int(timeout_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "state string, at timestamp")

    def handleInitialState(self, key, initial: pd.DataFrame, timerValues) -> None:
        r = initial.sort_values("at").iloc[-1]
        self.state.update((r["state"], r["at"].to_pydatetime()))
        self._watch(r["state"], r["at"])

    def _watch(self, state: str, at) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if state in LIVE:
            self.handle.registerTimer(int(pd.Timestamp(at).timestamp() * 1000) + self.timeout_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else (None, None)
        current, last = held
        out = []
        frame = pd.concat(list(rows)).sort_values(["at", "rank"])
        for at, state in zip(frame["at"], frame["state"]):
            if state not in TRANSITIONS.get(current, ()):
                out.append((key[0], at, state, False, f"{current} to {state} is no transition"))
                continue
            current, last = state, at
            out.append((key[0], at, state, True, None))
        if last is not None:
            self.state.update((current, pd.Timestamp(last).to_pydatetime()))
            self._watch(current, last)
        yield pd.DataFrame(out, columns=["job", "at", "state", "accepted", "reason"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        current, _ = self.state.get()
        if current in LIVE:
            at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
            self.state.update(("FAILED", at.to_pydatetime()))
            yield pd.DataFrame([(key[0], at, "FAILED", True, f"{current} timed out")], columns=["job", "at", "state", "accepted", "reason"])

    def close(self) -> None:
        pass


def job_stream(events: DataFrame, job: str, state: str, at: str, timeout_s: float, late: str = "0 seconds", saved: DataFrame | None = None) -> DataFrame:
    """job, at, state, accepted, reason: every event of a job stream with whether it counted, and the failures of timers.

    ``saved``: job, state, at of jobs that were known before the stream began.
    """
    from pyspark.sql import functions as F

    order = F.array_position(F.array(*[F.lit(s) for s in ("QUEUED", "PROCESSING", "COMPLETED", "FAILED")]), F.col(state))  # events of one moment in their natural order
    rows = events.withWatermark(at, late).select(F.col(job).cast("string").alias("job"), F.col(at).alias("at"), F.col(state).alias("state"), order.cast("int").alias("rank"))
    kept = None if saved is None else saved.select(F.col(job).cast("string").alias("job"), F.col(state).alias("state"), F.col(at).alias("at")).groupBy("job")
    return rows.groupBy("job").transformWithStateInPandas(statefulProcessor=_Jobs(timeout_s), outputStructType=JOB, outputMode="append", timeMode="eventTime", initialState=kept)


class _Assessments(StatefulProcessor):
    """Key: client. Rows: at, product."""

    def __init__(self, idle_s: float):
        self.idle = pd.Timedelta(seconds=idle_s)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("assessment", "product string, number long, at timestamp")

    def handleInitialState(self, key, initial: pd.DataFrame, timerValues) -> None:
        r = initial.sort_values("at").iloc[-1]
        self.state.update((r["product"], int(r["assessment"]), r["at"].to_pydatetime()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        product, number, last = self.state.get() if self.state.exists() else (None, 0, None)
        out = []
        frame = pd.concat(list(rows)).sort_values(["at", "product"])
        for at, asked in zip(frame["at"], frame["product"]):
            fresh = number == 0 or asked != product or at - pd.Timestamp(last) > self.idle
            number += int(fresh)
            product, last = asked, at
            out.append((key[0], at, asked, number, bool(fresh)))
        self.state.update((product, number, pd.Timestamp(last).to_pydatetime()))
        yield pd.DataFrame(out, columns=["client", "at", "product", "assessment", "fresh"])

    def close(self) -> None:
        pass


def assessment_stream(requests: DataFrame, client: str, product: str, at: str, idle_s: float, saved: DataFrame | None = None) -> DataFrame:
    """client, at, product, assessment, fresh: which assessment of its client each request belongs to.

    ``saved``: client, product, assessment, at to start from.
    """
    from pyspark.sql import functions as F

    rows = requests.select(F.col(client).cast("string").alias("client"), F.col(at).alias("at"), F.col(product).alias("product"))
    kept = None if saved is None else saved.select(F.col(client).cast("string").alias("client"), F.col(product).alias("product"), "assessment", F.col(at).alias("at")).groupBy("client")
    return rows.groupBy("client").transformWithStateInPandas(statefulProcessor=_Assessments(idle_s), outputStructType=ASSESSMENT, outputMode="append", timeMode="none", initialState=kept)
