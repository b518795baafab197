"""The watch list as keyed state over a stream of events and check results.

``step`` is the whole rule and knows no Spark; ``watch`` runs it under
``applyInPandasWithState``, one small state for each channel.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FIRST_INTERVAL, LONGEST, STABLE, PROBING = 900.0, 21_600.0, 72 * 3600.0, 180.0


@dataclass(frozen=True)
class Watch:
    pending: int = 0
    demoted: str = ""
    flagged_at: float = 0.0
    last_event_at: float = 0.0
    interval: float = 0.0
    next_check: float = 0.0
    stable_since: float = 0.0


STATE = "pending int, demoted string, flagged_at double, last_event_at double, interval double, next_check double, stable_since double"
OUTPUT = "channel_key string, at double, action string, demoted string, next_check double"


def step(state: Watch, kind: str, at: float, primary: str | None, threshold: int) -> tuple[Watch, str | None]:
    """The state after a row and what it calls for.

    ``event``: count; at the threshold flag the channel, demote its primary stream and
    start checks, or renew a flag.  Counts stay while there is no primary.  ``ok`` and ``bad``
    are results of a check: stable for 72 hours ends the watch, a good one doubles
    the interval, a bad one starts it anew.
    """
    if kind == "event":
        state = replace(state, pending=state.pending + 1, last_event_at=at)
        if state.pending < threshold or not primary:
            return state, None
        new = not state.flagged_at
        return replace(state, pending=0, demoted=primary, flagged_at=at if new else state.flagged_at, interval=FIRST_INTERVAL, next_check=at + FIRST_INTERVAL, stable_since=0.0), "flag" if new else "renew"
    if not state.flagged_at:
        return state, None
    if kind == "bad":
        return replace(state, interval=FIRST_INTERVAL, next_check=at + FIRST_INTERVAL, stable_since=0.0), "recheck"
    since = state.stable_since or at
    if at - since >= STABLE:
        return Watch(), "promote"
    interval = min(LONGEST, state.interval * 2)
    return replace(state, stable_since=since, interval=interval, next_check=at + interval), "recheck"


def watch(rows: DataFrame, threshold: int = 1) -> DataFrame:
    """Actions from a stream of ``channel_key, kind, at, primary`` with a watermark or none; ``timers.watched`` also has the checks that are due."""

    def run(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = Watch(*state.get) if state.exists else Watch()
        out = []
        # All rows of the key, which may come in several chunks.
        for r in pd.concat(list(parts)).sort_values("at", kind="stable").itertuples():
            now, action = step(now, r.kind, float(r.at), r.primary if isinstance(r.primary, str) and r.primary else None, threshold)
            if action:
                out.append((key[0], float(r.at), action, now.demoted, now.next_check))
        if now != Watch():
            state.update(tuple(asdict(now).values()))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["channel_key", "at", "action", "demoted", "next_check"])

    return rows.groupBy("channel_key").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def due(states: DataFrame, now: float) -> DataFrame:
    """Watched channels whose check is due, each put off by ``PROBING`` seconds."""
    return states.filter((F.col("flagged_at") > 0) & (F.col("next_check") <= now)).withColumn("next_check", F.lit(now + PROBING))


def deferred(states: DataFrame, now: float) -> DataFrame:
    """Channels whose check could not run, put off by the interval that they have."""
    return states.withColumn("next_check", F.lit(float(now)) + F.col("interval"))


def tick(states: DataFrame, results: DataFrame, now: float, reachable: bool = True) -> DataFrame:
    """``channel_key, action, status, next_check``: what to do with each watched channel now.

    A result that is in (``channel_key, status``) is evaluated; a channel that is due without one
    gets a check; others wait.  While the remote system can't be reached, channels that are due
    are down and put off.
    """
    rows = states.filter("flagged_at > 0").join(results.groupBy("channel_key").agg(F.max("status").alias("status")), "channel_key", "left")
    ready = F.col("next_check") <= now
    action = F.when(F.col("status").isNotNull(), "evaluate").when(ready & F.lit(not reachable), "down").when(ready, "check").otherwise("wait")
    later = F.when(action == "check", F.lit(now + PROBING)).when(action == "down", F.lit(float(now)) + F.col("interval")).otherwise(F.col("next_check"))
    return rows.select("channel_key", action.alias("action"), "status", later.alias("next_check"))


def on_batches(rows: DataFrame, path: str, threshold: int = 1):
    """A stream writer that adds the actions of every batch to the table at ``path``, once each, whatever is run again."""

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return watch(rows, threshold).writeStream.outputMode("append").foreachBatch(add)
