"""Resets kept up to date from tails of segments, as a stateful stream.

A meter's readings lie in segments of SPAN, in state.  Each segment remembers the walk's state at its start and end and the resets found in it.
A reading that comes late, is edited or taken back changes its segment; the walk starts again there and stops where its state meets the one that
the next segment started from, so a batch costs what it touches, not the history.  Resets that appear or disappear are given
as rows with op 1 or -1: their sum over all batches is what a walk through the whole history finds.

Readings later than the clock are kept aside and count once the clock reaches them (a timer wakes the stream for them); a clock that is set
back takes them out again.  The clock is the stream's processing time, or a column of the readings.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.filters import cohort_key
from ..operators.sequence import HOUR_US
from ..operators.windows import RESET_TOLERANCE_US, reset_step

SPAN = 24 * HOUR_US
START = (None, (None, None, None))
CHANGES = "cohort string, op int, account string, kind string, previous_us long, us long, effective_us long, previous_used double, used double, classification string, confidence double"


def classified(before: tuple, now: tuple, changed: bool, tolerance_us: int) -> tuple[str, float] | None:
    """The rule of detect_resets for two adjacent readings (us, used, resets)."""
    (_, used0, resets0), (us, used, resets) = before, now
    drop = used0 - used
    due = resets0 is not None and abs(us - resets0) <= tolerance_us
    if not changed:
        return ("FullReset", 0.62) if drop >= 50 else ("UnusualReset", 0.5) if drop >= 5 else None
    if drop < 1:
        later = resets is not None and resets0 is not None and resets > resets0
        return ("ReanchoredWindow", 0.92 if resets0 <= us else 0.72) if later else None
    if due:
        return "ExpectedReset", min(0.98, 0.88 + min(drop, 50.0) / 500)
    return ("FullReset", 0.78) if drop >= 50 else ("UnusualReset", 0.68 if drop >= 5 else 0.55)


def walk(state: tuple, rows: list[list], tolerance_us: int) -> tuple[tuple, list[list]]:
    """state: (last reading's time, the state of reset_step); rows: [us, id, used, resets] in order -> (state, resets)."""
    found = []
    last, inner = state
    for us, _, used, resets in rows:
        before = inner[0]
        inner, (changed,) = reset_step(inner, (used, resets))
        if changed is not None and (hit := classified((last, *before), (us, used, resets), changed, tolerance_us)):
            found.append([last, us, before[1] if hit[0] == "ExpectedReset" else us, before[0], used, *hit])
        last = us
    return (last, inner), found


def _listed(x):
    return [_listed(v) for v in x] if isinstance(x, tuple) else x


def _tupled(x):
    return tuple(map(_tupled, x)) if isinstance(x, list) else x


class Tails:
    """One meter's segments.  load and save reach a segment by number; links are (previous, next) numbers; head is (last number, clock)."""

    def __init__(self, load: Callable, save: Callable, link: Callable, relink: Callable, tolerance_us: int):
        self.load, self.save, self.link, self.relink, self.tolerance_us = load, save, link, relink, tolerance_us
        self.walked = 0

    def update(self, head: tuple[int | None, int | None], rows: list[list], clock: int) -> tuple[tuple, list[tuple[int, list]]]:
        """rows: [us, id, used, resets, removed], any order -> (head, [(op, reset)])."""
        last, clock0 = head
        dirty: set[int] = set()
        by: dict[int, list] = {}
        for r in rows:
            by.setdefault(r[0] // SPAN, []).append(r)
        for n, part in sorted(by.items(), reverse=True):
            last = self._changed(n, part, last)
            dirty.add(n)
        if clock0 is not None and clock != clock0 and last is not None:  # what the clock's move lets in, or takes out
            low, high = sorted((clock, clock0))
            n = last
            while n is not None and n >= low // SPAN:
                if n <= high // SPAN:
                    dirty.add(n)
                n = self.link(n)[0]
        out: list[tuple[int, list]] = []
        todo = sorted(dirty, reverse=True)
        while todo:
            n = todo.pop()
            while n is not None:
                met = self._walked(n, clock, out)
                nxt = self.link(n)[1]
                if todo and nxt == todo[-1]:
                    todo.pop()
                elif met:
                    break
                n = nxt
        return (last, clock), out

    def _changed(self, n: int, part: list, last: int | None) -> int:
        """Puts readings into segment n, which is linked in where it belongs; the last segment's number."""
        segment = self.load(n)
        if segment is None:
            after, before = None, last
            while before is not None and before > n:  # as far back as the reading is late
                after, before = before, self.link(before)[0]
            self.relink(n, before, after)
            if before is not None:
                self.relink(before, self.link(before)[0], n)
            if after is not None:
                self.relink(after, n, self.link(after)[1])
            last = n if after is None else last
            segment = {"rows": [], "start": None, "end": None, "found": []}  # not walked yet
        kept = {(r[0], r[1]): r for r in segment["rows"]}
        for us, ident, used, resets, removed in part:
            if removed:
                kept.pop((us, ident), None)
            else:
                kept[us, ident] = [us, ident, used, resets]
        self.save(n, segment | {"rows": [kept[k] for k in sorted(kept)]})
        return last

    def _walked(self, n: int, clock: int, out: list) -> bool:
        """Walks through segment n; whether the next one need not be."""
        segment = self.load(n)
        before, after = self.link(n)
        start = START if before is None else _tupled(self.load(before)["end"])
        seen = [r for r in segment["rows"] if r[0] <= clock]
        end, found = walk(start, seen, self.tolerance_us)
        self.walked += len(seen)
        old = segment["found"]
        out += [(-1, r) for r in old if r not in found]
        out += [(1, r) for r in found if r not in old]
        met = after is None or _tupled(self.load(after)["start"]) == end
        self.save(n, segment | {"start": _listed(start), "end": _listed(end), "found": found})
        return met

    def pending(self, last: int | None, clock: int) -> int | None:
        """The first reading that the clock has not reached."""
        first, n = None, last
        while n is not None and (n + 1) * SPAN > clock:
            later = [r[0] for r in self.load(n)["rows"] if r[0] > clock]
            first = later[0] if later else first
            n = self.link(n)[0]
        return first


class ResetTails(StatefulProcessor):
    def __init__(self, tolerance_us: int, timers: bool):
        self.tolerance_us, self.timers = tolerance_us, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "last long, clock long, account string, kind string")
        self.segments = handle.getMapState("segments", "n long", "body string")
        self.links = handle.getMapState("links", "n long", "before long, after long")

    def _tails(self) -> Tails:
        return Tails(
            lambda n: json.loads(self.segments.getValue((n,))[0]) if self.segments.containsKey((n,)) else None,
            lambda n, s: self.segments.updateValue((n,), (json.dumps(s),)),
            lambda n: tuple(self.links.getValue((n,))),
            lambda n, before, after: self.links.updateValue((n,), (before, after)),
            self.tolerance_us,
        )

    def _given(self, key, rows: list[list], clock: int, account, kind):
        head = (None, None)
        if self.head.exists():
            *head, account, kind = self.head.get()
        tails = self._tails()
        head, found = tails.update(tuple(head), rows, clock)
        self.head.update((*head, account, kind))
        if self.timers:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if (first := tails.pending(head[0], clock)) is not None:
                self.handle.registerTimer(-(-first // 1000))
        return pd.DataFrame([(key[0], op, account, kind, *r) for op, r in found], columns=[c.split()[0] for c in CHANGES.split(", ")])

    def handleInputRows(self, key, rows, timerValues):
        parts = [r for r in rows if len(r)]
        if not parts:
            return
        batch = pd.concat(parts).sort_values("arrival", kind="stable")
        given = batch["clock_us"].iloc[-1]
        clock = int(time.time() * 1e6) if pd.isna(given) else int(given)
        none = lambda v: None if pd.isna(v) else v
        values = [[int(us), int(i), none(used), None if pd.isna(resets) else int(resets), bool(removed)] for us, i, used, resets, removed in batch[["us", "observation_id", "used", "resets_us", "removed"]].itertuples(index=False)]
        yield self._given(key, values, clock, batch["account"].iloc[0], batch["kind"].iloc[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._given(key, [], int(time.time() * 1e6), None, None)

    def close(self) -> None:
        pass


def stream_resets(readings: DataFrame, tolerance_us: int = RESET_TOLERANCE_US, clock: str | None = None, removed: str | None = None, arrival: str | None = None, timers: bool = False) -> DataFrame:
    """Changes of resets, with op 1 (found) or -1 (no more); event ids are those of detect_resets.

    A reading with the time and id of an earlier one replaces it; `removed` marks one that is taken back; within a batch the last by `arrival`
    counts.  clock: a column to be taken for the clock (the batch's last) instead of the time of day.  timers: later readings wake the
    stream when their time comes, else they wait for their meter's next batch; such a stream runs on, so availableNow does not end it."""
    r = readings.where(F.col("kind").isin("FiveHour", "Weekly") & F.col("us").isNotNull()).select(
        F.to_json(cohort_key(), {"ignoreNullFields": "false"}).alias("cohort"), "account", "kind", "observation_id", "us", F.col("used").cast("double").alias("used"), "resets_us",
        (F.col(removed) if removed else F.lit(False)).alias("removed"), (F.col(clock) if clock else F.lit(None)).cast("long").alias("clock_us"), (F.col(arrival) if arrival else F.lit(0)).cast("long").alias("arrival"),
    )
    out = r.groupBy("cohort").transformWithStateInPandas(statefulProcessor=ResetTails(tolerance_us, timers), outputStructType=CHANGES, outputMode="Append", timeMode="ProcessingTime" if timers else "None")
    # the text that detect_resets hashes for its ids
    ident = F.sha2(F.concat(F.lit('{"cohort":'), F.col("cohort"), F.lit(',"_us":'), F.col("previous_us").cast("string"), F.lit(',"us":'), F.col("us").cast("string"), F.lit("}")), 256)
    return out.select(ident.alias("event_id"), *out.columns[1:])


def standing(changes: DataFrame) -> DataFrame:
    """The resets that hold after all changes."""
    names = [c for c in changes.columns if c != "op"]
    return changes.groupBy(*names).agg(F.sum("op").alias("_n")).where("_n > 0").drop("_n")
