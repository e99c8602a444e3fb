"""Structured Streaming forms (T operators).  Each takes a streaming (or batch) DataFrame and returns one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sequence import COUNTERS, Watermark, reduce_step
from ..sources.event_log import parse_lines


def stream_events(spark: SparkSession, path: str, most_files: int = 1000) -> DataFrame:
    """New closed chunks of growing logs; the checkpoint moves only with the sink's commit."""
    raw = spark.readStream.option("maxFilesPerTrigger", most_files).text(path)
    return parse_lines(raw.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("ordinal"), "value"))


REDUCED = "session_id long, source_event_id long, us long, kind string, epoch int, uncached long, cache_read long, cache_write long, output long, reasoning long, delta_total long"


class CounterReducer(StatefulProcessor):
    """The batch step function with its watermark kept as state; ids seen before are no-ops."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", ", ".join(f"{c} long" for c in COUNTERS) + ", epoch int, last_id long, last_us long, anchored boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        state = None
        if self.mark.exists():
            *c, epoch, last_id, last_us, anchored = self.mark.get()
            state = Watermark(tuple(c), epoch, last_id, last_us, anchored)
        parts = [r for r in rows if len(r)]
        if not parts:
            return
        batch = pd.concat(parts).sort_values(["us", "source_event_id"], kind="stable")
        out = []
        for ident, us, total, last in zip(batch["source_event_id"], batch["us"], batch["total"], batch["last"]):
            read = lambda v: None if v is None or (isinstance(v, float) and v != v) else tuple(None if v[n] is None else int(v[n]) for n in COUNTERS)
            state, values = reduce_step(state, (int(ident), int(us), read(total), read(last)))
            out.append((key[0], int(ident), int(us), *values))
        if state is not None:
            self.mark.update((*state.counters, state.epoch, state.last_id, state.last_us, state.anchored))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in REDUCED.split(", ")])

    def close(self) -> None:
        pass


def stream_counters(observations: DataFrame) -> DataFrame:
    """T2.  Needs the RocksDB state store provider."""
    return observations.groupBy("session_id").transformWithStateInPandas(statefulProcessor=CounterReducer(), outputStructType=REDUCED, outputMode="Append", timeMode="None")


def stream_dedup(events: DataFrame, ident: str, time: str, delay: str) -> DataFrame:
    """Each id once within the watermark."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([ident])


def split_late(events: DataFrame, delay_us: int, keys: list[str], time: str = "us") -> DataFrame:
    """T4 over a batch: rows more than delay behind the latest time seen before them are late; they stay as evidence."""
    w = Window.partitionBy(*keys).orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("late", F.coalesce(F.col(time) < F.max(time).over(w) - delay_us, F.lit(False)))


class LateProcessor(StatefulProcessor):
    """T4 as a stream: the newest time of each key is state, so it outlives a restart; rows keep their order of arrival."""

    def __init__(self, delay_us: int):
        self.delay = delay_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "us long")

    def handleInputRows(self, key, rows, timer):
        parts = [r for r in rows if len(r)]
        if not parts:
            return
        newest = self.newest.get()[0] if self.newest.exists() else None
        out = []
        for ident, us in pd.concat(parts).sort_values("arrival", kind="stable")[["event_id", "us"]].itertuples(index=False):
            out.append((key[0], int(ident), int(us), newest is not None and us < newest - self.delay))
            newest = int(us) if newest is None else max(newest, int(us))
        self.newest.update((newest,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "us", "late"])

    def close(self) -> None:
        pass


def stream_late(events: DataFrame, delay_us: int) -> DataFrame:
    """T4 as a stream: events (user_id, event_id, arrival, us) with `late`; all rows stay, and the sink parts them, before any watermark drops them."""
    return events.groupBy("user_id").transformWithStateInPandas(statefulProcessor=LateProcessor(delay_us), outputStructType="user_id long, event_id long, us long, late boolean", outputMode="Append", timeMode="None")


def stream_usage(events: DataFrame, time: str, width: str, delay: str, amount: str = "total") -> DataFrame:
    """T5: sums in tumbling windows."""
    g = events.withWatermark(time, delay).groupBy(F.window(time, width)).agg(F.sum(amount).cast("long").alias(amount), F.count(F.lit(1)).alias("events"))
    return g.select(F.col("window.start").alias("bucket"), amount, "events")


def stream_recent(events: DataFrame, time: str, width: str, slide: str, delay: str, amount: str = "total") -> DataFrame:
    """Sums in sliding windows."""
    g = events.withWatermark(time, delay).groupBy(F.window(time, width, slide)).agg(F.sum(amount).cast("long").alias(amount), F.count(F.lit(1)).alias("events"))
    return g.select(F.col("window.start").alias("from_time"), F.col("window.end").alias("to_time"), amount, "events")


def stream_idle_sessions(events: DataFrame, time: str, delay: str, key: str = "session_id", gap: str = "10 minutes") -> DataFrame:
    """Stretches of activity that a gap ends."""
    g = events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("events"), F.sum("total").cast("long").alias("total"))
    return g.select(key, F.col("w.start").alias("from_time"), F.col("w.end").alias("to_time"), "events", "total")


def nearest_threshold(remaining: Column, thresholds: list[int]) -> Column:
    return F.when(remaining.isNotNull(), F.coalesce(*(F.when(remaining <= t, F.lit(t)) for t in sorted(thresholds))))


def quota_alerts(readings: DataFrame, keys: list[str], thresholds: list[int]) -> DataFrame:
    """T8 over a batch: low alerts once for each window and nearest threshold, refresh alerts when a window changes and
    more than five points come back.  Windows with an unknown reset count generations of such recoveries."""
    w = Window.partitionBy(*keys).orderBy("us", "observation_id")
    r = readings.where(F.col("used").isNotNull()).withColumn("remaining", 100.0 - F.col("used"))
    r = r.withColumns({"_before": F.lag("remaining").over(w), "_resets": F.lag("resets_us").over(w), "_n": F.row_number().over(w)})
    back = F.coalesce(F.col("remaining") > F.col("_before") + 5, F.lit(False))
    blind = (F.col("_n") > 1) & F.col("_resets").isNull() & F.col("resets_us").isNull() & back
    r = r.withColumn("_g", F.sum(blind.cast("int")).over(w))
    window = F.coalesce(F.col("resets_us").cast("string"), F.concat(F.lit("generation-"), F.col("_g").cast("string")))
    changed = F.coalesce(F.col("resets_us") != F.col("_resets"), F.lit(False)) & back
    low = r.select(*keys, "us", "observation_id", window.alias("window"), F.lit("low").alias("alert"), nearest_threshold(F.col("remaining"), thresholds).alias("threshold"), "remaining").where("threshold is not null")
    fresh = r.where(changed | blind).select(*keys, "us", "observation_id", window.alias("window"), F.lit("refreshed").alias("alert"), F.lit(0).alias("threshold"), "remaining")
    first = Window.partitionBy(*keys, "window", "alert", "threshold").orderBy("us", "observation_id")
    return low.unionByName(fresh).withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "observation_id")


class AlertProcessor(StatefulProcessor):
    """T8 as a stream: the batch rule with the last reading, the generation of windows of unknown reset, and what was sent as state."""

    def __init__(self, thresholds: list[int]):
        self.thresholds = sorted(thresholds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "remaining double, resets long, generation int")
        self.sent = handle.getMapState("sent", "window string, alert string, threshold int", "us long")

    def handleInputRows(self, key, rows, timer):
        parts = [r for r in rows if len(r)]
        if not parts:
            return
        before, resets0, generation = self.last.get() if self.last.exists() else (None, None, 0)
        out = []
        for us, used, resets in pd.concat(parts).sort_values(["us", "observation_id"], kind="stable")[["us", "used", "resets_us"]].itertuples(index=False):
            if used != used:
                continue
            left, resets = 100.0 - used, None if pd.isna(resets) else int(resets)
            back = before is not None and left > before + 5
            blind = back and resets is None and resets0 is None
            generation += blind
            window = f"generation-{generation}" if resets is None else str(resets)
            alerts = [("refreshed", 0)] if blind or (back and None not in (resets, resets0) and resets != resets0) else []
            near = next((t for t in self.thresholds if left <= t), None)
            for alert, threshold in alerts + ([("low", near)] if near is not None else []):
                if not self.sent.containsKey((window, alert, threshold)):
                    self.sent.updateValue((window, alert, threshold), (int(us),))
                    out.append((key[0], int(us), window, alert, threshold, left))
            before, resets0 = left, resets
        if before is not None:
            self.last.update((before, resets0, int(generation)))
        yield pd.DataFrame(out, columns=["account", "us", "window", "alert", "threshold", "remaining"])

    def close(self) -> None:
        pass


def stream_quota_alerts(readings: DataFrame, thresholds: list[int]) -> DataFrame:
    return readings.groupBy("account").transformWithStateInPandas(statefulProcessor=AlertProcessor(thresholds), outputStructType="account string, us long, window string, alert string, threshold int, remaining double", outputMode="Append", timeMode="None")


class HealthProcessor(StatefulProcessor):
    """T9 as a stream: the last state of each key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "state string")

    def handleInputRows(self, key, rows, timer):
        parts = [r for r in rows if len(r)]
        if not parts:
            return
        before = self.last.get()[0] if self.last.exists() else None
        out = []
        for ident, state in pd.concat(parts).sort_values("event_id", kind="stable")[["event_id", "state"]].itertuples(index=False):
            if state in BAD and state != before:
                out.append((key[0], int(ident), state))
            before = state
        self.last.update((before,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "state"])

    def close(self) -> None:
        pass


def stream_health_alerts(status: DataFrame) -> DataFrame:
    """T9 as a stream: status (user_id, event_id, state)."""
    return status.groupBy("user_id").transformWithStateInPandas(statefulProcessor=HealthProcessor(), outputStructType="user_id long, event_id long, state string", outputMode="Append", timeMode="None")


BAD = ("Unavailable", "Error")


def health_alerts(status: DataFrame, key: str, order: str) -> DataFrame:
    """Entries into a bad state; repeats are quiet until the state changes."""
    before = F.lag("state").over(Window.partitionBy(key).orderBy(order))
    return status.withColumn("_b", before).where(F.col("state").isin(*BAD) & ~F.col("state").eqNullSafe(F.col("_b"))).drop("_b")


def refresh_resets(history: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The resets that a batch's streams show from its first row on.  Only these streams are rebuilt, from all of their history,
    so readings that come late change what follows them as well."""
    from ..operators.windows import detect_resets

    touched = batch.groupBy(*keys).agg(F.min("us").alias("_from"))
    old = history.join(touched.select(*keys), keys, "left_semi")
    return detect_resets(old.unionByName(batch)).join(touched, keys).where(F.col("us") >= F.col("_from")).drop("_from")


def keep_resets(history: Callable[[], DataFrame], keys: list[str], sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """T10 in a stream: a foreachBatch function; history() reads what was there before the batch, and the sink replaces each
    touched stream's resets from the batch's first row on, so a repeated batch does no harm."""

    def batch(df: DataFrame, epoch: int) -> None:
        sink(refresh_resets(history(), df, keys), epoch)

    return batch
