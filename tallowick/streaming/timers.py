"""The watch list as keyed state with timers: channels wake up by themselves when their next check is due.

``watch.step`` is the rule.  State lives in the RocksDB store; ``state_store`` sets it for
the queries started within it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, replace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallowick.streaming.watch import OUTPUT, PROBING, STATE, Watch, step

_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_COLUMNS = [x.split()[0] for x in OUTPUT.split(", ")]


@contextmanager
def state_store(spark: SparkSession) -> Iterator[SparkSession]:
    """A query started here keeps its state in RocksDB; the session is left as it was."""
    name, store = _STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, store)
    try:
        yield spark
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class WatchedChannel(StatefulProcessor):
    """A channel's ``Watch`` and at most one timer, at its next check."""

    def __init__(self, threshold: int):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("watch", STATE)

    def _load(self) -> Watch:
        return Watch(*self.state.get()) if self.state.exists() else Watch()

    def _save(self, before: Watch, now: Watch) -> None:
        """The state as it is now, and the timer where the next check is."""
        due = lambda w: round(1000 * w.next_check) if w.flagged_at else None
        if due(before) != due(now):
            if due(before) is not None and due(before) in list(self.handle.listTimers()):
                self.handle.deleteTimer(due(before))
            if due(now) is not None:
                self.handle.registerTimer(due(now))
        if now == Watch():
            self.state.clear()
        elif now != before:
            self.state.update(tuple(asdict(now).values()))

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=_COLUMNS)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        """All rows of the key in the order of their time, however many chunks they come in."""
        before = now = self._load()
        out = []
        for r in pd.concat(list(rows)).sort_values("at", kind="stable").itertuples():
            primary = r.primary if isinstance(r.primary, str) and r.primary else None
            now, action = step(now, r.kind, float(r.at), primary, self.threshold)
            if action:
                out.append((key[0], float(r.at), action, now.demoted, now.next_check))
        self._save(before, now)
        yield self._frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """The check that is due, put off by ``PROBING`` seconds until its result comes in."""
        at = expiredTimerInfo.getExpiryTimeInMs() / 1000
        before = self._load()
        if not before.flagged_at or round(1000 * before.next_check) != round(1000 * at):
            return
        now = replace(before, next_check=at + PROBING)
        self.handle.registerTimer(round(1000 * now.next_check))
        self.state.update(tuple(asdict(now).values()))
        yield self._frame([(key[0], at, "check", now.demoted, now.next_check)])

    def close(self) -> None:
        pass


def watched(rows: DataFrame, threshold: int = 1, clock: str = "EventTime") -> DataFrame:
    """Actions from a stream of ``channel_key, kind, at, primary``, and a ``check`` for each channel whose next check is due.

    ``at`` counts seconds.  Time is that of the stream's watermark, which is as late as its
    latest row, or with ``ProcessingTime`` that of the clock on the wall.
    """
    if clock == "EventTime":
        rows = rows.withColumn("seen_at", F.timestamp_millis(F.round(F.col("at") * 1000).cast("long"))).withWatermark("seen_at", "0 seconds")
    return rows.groupBy("channel_key").transformWithStateInPandas(WatchedChannel(threshold), OUTPUT, "Append", clock)
