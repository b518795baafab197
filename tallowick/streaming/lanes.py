"""When a provider's refusals call for a pause, for lanes of any length.

``trips`` is the rule over a lane's times.  What it does next depends only on when the last pause
ends and how long the next one is, which is one of a few lengths.  So a lane is cut into slices
of time.  A first pass works out for each slice where it leads from every such state that may reach
it: pauses end within ``longest`` of what was before, so these are states of the slice's beginning
only.  The lane's slices are then gone through by these tables, a row each, and a second pass
goes through each slice from the state it is really reached in.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallowick.storage import keep


#: shares that the lanes of a slice of the table are worked off in
LANES = 16


@dataclass(frozen=True)
class Rule:
    """A pause after ``least`` refusals within ``window`` seconds: ``first`` seconds, doubled each time up to ``longest``, ``first`` again after ``quiet`` seconds without a refusal."""

    least: int = 3
    window: float = 60.0
    first: float = 30.0
    longest: float = 300.0
    quiet: float = 180.0

    def after(self, pause: float) -> float:
        return min(self.longest, pause * 2)

    def pauses(self) -> list[float]:
        out = [self.first]
        while self.after(out[-1]) != out[-1]:
            out.append(self.after(out[-1]))
        return out


def trips(times: Iterable[float], rule: Rule = Rule()) -> list[tuple[float, float]]:
    """When a provider's refusals call for a pause, and how long: doubling, and back to the first after quiet.

    Every pause clears what was counted, and nothing counts during one.
    """
    recent: list[float] = []
    out: list[tuple[float, float]] = []
    until, pause, last = float("-inf"), rule.first, float("-inf")
    for t in sorted(times):
        if t < until:
            last = t
            continue
        if t - last > rule.quiet:
            pause = rule.first
        last = t
        recent = [x for x in recent if t - x <= rule.window] + [t]
        if len(recent) >= rule.least:
            out.append((t, pause))
            until, pause, recent = t + pause, rule.after(pause), []
    return out


class Slice:
    """A slice of a lane: its times, with the last few of the slices before in front."""

    def __init__(self, before: Iterable[float], times: np.ndarray, rule: Rule):
        before = np.array(sorted(before), float)
        self.rule, self.own, self.times = rule, len(before), np.concatenate([before, np.sort(times)])
        back = rule.least - 1
        close = np.flatnonzero(self.times[back:] - self.times[: len(self.times) - back] <= rule.window) + back
        self.close = close[close >= self.own]
        calm = np.zeros(len(self.times) + 1, np.int64)
        gaps = np.diff(self.times, prepend=-np.inf) > rule.quiet
        gaps[: self.own] = False  # the slices before have seen to these
        np.cumsum(gaps, out=calm[1:])
        self.calm = calm

    def at(self, until: float) -> int:
        """The first time that counts after a pause."""
        return int(np.searchsorted(self.times, until, side="left"))

    def path(self, start: int, pause: float) -> Iterator[tuple[float, float, float]]:
        """The pauses from a state on, each with its time, its length, and the length of the next; last the length that is left."""
        while True:
            found = int(np.searchsorted(self.close, start + self.rule.least - 1))
            end = int(self.close[found]) if found < len(self.close) else len(self.times) - 1
            if self.calm[end + 1] > self.calm[min(max(start, self.own), end + 1)]:
                pause = self.rule.first
            if found == len(self.close):
                yield np.nan, np.nan, pause
                return
            yield float(self.times[end]), pause, self.rule.after(pause)
            start, pause = self.at(self.times[end] + pause), self.rule.after(pause)

    def table(self) -> tuple[list[float], list[float], list[float]]:
        """The times a state may begin at, and for each of these and each length of a pause when the last pause ends (none: as before) and how long the next is."""
        begins = self.times[: self.at(self.times[self.own] + self.rule.longest) + 1]
        known: dict[tuple[int, float], tuple[float, float]] = {}
        ends, lengths = [], []
        for start in range(len(begins) + 1):
            for pause in self.rule.pauses():
                state, went, until = (start, pause), [], np.nan
                for at, length, pause_after in self.path(start, pause):
                    if np.isnan(at):
                        left = (until, pause_after)
                        break
                    until = at + length
                    state = (self.at(until), pause_after)
                    if state in known:
                        end, pause_left = known[state]
                        left = (until if np.isnan(end) else end, pause_left)
                        break
                    went.append((state, until))
                for state, came in went:
                    known[state] = (np.nan if left[0] == came else left[0], left[1])
                ends.append(left[0])
                lengths.append(left[1])
        return begins.tolist(), ends, lengths


def rate_trips(refusals: DataFrame, lane: str = "lane", at: str = "at", rule: Rule = Rule()) -> DataFrame:
    """``lane, at, pause``: ``trips`` for each provider's lane of refusals, a slice of a lane being a task's work."""
    rows = refusals.select(F.col(lane).cast("string").alias("lane"), F.col(at).cast("double").alias("at")).filter("at is not null and not isnan(at)")
    dealt = keep(rows.repartitionByRange("lane", "at").withColumn("slice", F.spark_partition_id()), "lanes")
    back = rule.least - 1
    place = Window.partitionBy("lane", "slice").orderBy(F.desc("at"))
    tails = dealt.withColumn("n", F.row_number().over(place)).filter(F.col("n") <= back).groupBy("lane", "slice").agg(F.collect_list("at").alias("tail"))
    # A row for each slice; the last times before it are those of as many slices at most.
    of_lane = Window.partitionBy("lane")
    before = of_lane.orderBy("slice").rowsBetween(-back, -1)
    cut = tails.withColumn("slices", F.count("*").over(of_lane)).withColumn("front", F.slice(F.reverse(F.array_sort(F.flatten(F.collect_list("tail").over(before)))), 1, back)).filter("slices > 1")
    # Lanes within one slice begin anew; of the others, at most as many as there are slices, tables are made.
    fronts = keep(cut.select("lane", "slice", "front"), "lane-fronts")
    none = F.lit(None).cast("double")
    own = dealt.select("lane", "slice", "at", F.lit(True).alias("own"), none.alias("until"), none.alias("length"))
    ahead = fronts.select("lane", "slice", F.explode("front").alias("at"), F.lit(False).alias("own"), none.alias("until"), none.alias("length"))
    lanes = fronts.select(F.col("lane").alias("l")).distinct()
    cut_rows = own.join(F.broadcast(lanes), F.col("lane").eqNullSafe(F.col("l")), "left_semi")  # fewer than slices

    def tables(pdf: pd.DataFrame) -> pd.DataFrame:
        at, mine = pdf["at"].to_numpy(), pdf["own"].to_numpy(bool)
        begins, ends, lengths = Slice(at[~mine], at[mine], rule).table()
        return pd.DataFrame({"lane": [pdf["lane"].iloc[0]], "slice": [pdf["slice"].iloc[0]], "begins": [begins], "ends": [ends], "lengths": [lengths]})

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        until, pause, pauses, out = float("-inf"), rule.first, rule.pauses(), []
        for r in pdf.sort_values("slice").itertuples():
            out.append((r.lane, r.slice, until, pause))
            at = int(np.searchsorted(np.array(r.begins), until, side="left")) * len(pauses) + pauses.index(pause)
            until, pause = (until if np.isnan(r.ends[at]) else r.ends[at]), r.lengths[at]
        return pd.DataFrame(out, columns=["lane", "slice", "until", "length"])

    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        code = pd.factorize(pdf["lane"], use_na_sentinel=False)[0]
        order = np.lexsort((pdf["at"].to_numpy(), code))
        code, lane = code[order], pdf["lane"].to_numpy()[order]
        at, mine, until, length = (pdf[c].to_numpy()[order] for c in ("at", "own", "until", "length"))
        edges = [*np.flatnonzero(np.diff(code, prepend=-1)).tolist(), len(code)]
        out = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            times = at[a:b]
            state = np.flatnonzero(np.isnan(times))  # a state has no time, and stands last
            end = b - len(state)
            if end - a < rule.least or (at[a + back : end] - at[a : end - back]).min() > rule.window:
                continue
            times, own_times = at[a:end], mine[a:end].astype(bool)
            one = Slice(times[~own_times], times[own_times], rule)
            start, pause = (until[end], length[end]) if len(state) else (float("-inf"), rule.first)
            out += [(lane[a], when, long) for when, long, _ in one.path(one.at(start), pause) if not np.isnan(when)]
        return pd.DataFrame(out, columns=["lane", "at", "pause"])

    made = cut_rows.union(ahead).groupBy("lane", "slice").applyInPandas(tables, "lane string, slice int, begins array<double>, ends array<double>, lengths array<double>")
    reached = keep(made.groupBy("lane").applyInPandas(states, "lane string, slice int, until double, length double"), "lane-states")
    every = own.union(ahead).union(reached.select("lane", "slice", none.alias("at"), F.lit(False).alias("own"), "until", "length"))
    # Many lanes at a time, as a call for each costs more than most lanes' work.
    return every.groupBy("slice", F.pmod(F.hash("lane"), F.lit(LANES)).alias("share")).applyInPandas(found, "lane string, at double, pause double")
