"""Three readings of a file's cumulative counters beside each other (W2): the reducer's, a plain high watermark's, and that
of counter lineages.

A file may interleave the counters of several lines of work.  A lineage is known by its head, the last cumulative total
seen in it; an observation whose own usage leads from a head to its total extends that lineage.  At most HEADS heads are
kept, the oldest goes first, so a file's state is bounded.  What kind of step an observation is (first, above, at or below the
watermark, a retry) names its transition bucket; the buckets show where the three readings part.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import tasks_for
from .sequence import Watermark, _counters, _usable, fold, reduce_step

HEADS = 32
# fixed values: the names of the transition buckets
RETRY, UNUSABLE, FIRST, AT, ABOVE = "occurrence-retry", "unusable-cumulative", "first-cumulative", "at-watermark", "above-watermark"
BELOW = {-1: "below-watermark/falling", 0: "below-watermark/repeated", 1: "below-watermark/recovering"}
USABLE_LAST, UNUSABLE_LAST = "/usable-last", "/unusable-last"


class Lineage(NamedTuple):
    """What is remembered of a file: the reducer's state, the watermark, the last complete counters, and the heads, oldest first."""

    reducer: Watermark | None = None
    high: int = 0
    previous: tuple[int, ...] | None = None
    heads: tuple[int, ...] = ()


STEPS = "transition string, reducer_tokens long, watermark_tokens long, lineage_tokens long, incomplete boolean, totals_only_drop boolean, category_change boolean, heads int"


def lineage_step(state: Lineage, row: tuple) -> tuple[Lineage, tuple]:
    """row: (id, verified time or None, total counters or None, last counters or None, seen before?) -> the columns STEPS."""
    ident, us, now, last, again = row
    now, last = _counters(now), _counters(last)
    whole, led = _usable(now), _usable(last)
    if again:
        return state, (RETRY, 0, 0, 0, False, False, False, len(state.heads))
    reducer, decision = reduce_step(state.reducer, (ident, us, now, last))
    tail = USABLE_LAST if led else UNUSABLE_LAST
    if not whole:
        return state._replace(reducer=reducer), (UNUSABLE + tail, decision[-1], 0, 0, True, False, False, len(state.heads))
    total, before, heads = now[5], state.previous, state.heads
    if before is None:
        kind = FIRST
    elif total < state.high:
        kind = BELOW[(total > before[5]) - (total < before[5])]
    else:
        kind = AT if total == state.high else ABOVE
    risen = max(0, total - state.high)
    drop = False
    if led and last[5] <= total:
        grown = 0 if total in heads else last[5]
        if total not in heads:
            heads = _without(heads, total - last[5])
    else:
        grown, drop = risen, total < state.high
    heads = (*_without(heads, total), total)[-HEADS:]
    changed = before is not None and before[5] == total and before != now
    return Lineage(reducer, max(state.high, total), now, heads), (kind + tail, decision[-1], risen, grown, False, drop, changed, len(heads))


def _without(heads: tuple[int, ...], head: int) -> tuple[int, ...]:
    return tuple(h for h in heads if h != head)


def lineage_steps(observations: DataFrame, file: str = "session_id", order: tuple[str, ...] = ("us", "source_event_id"), ident: str = "source_event_id", time: str = "us", tasks: int | None = None) -> DataFrame:
    """Every observation with its transition bucket and what each reading adds for it.

    An observation whose id the file had before is a retry.  Retries are told by a window over (file, id), so the walk
    through a file holds its heads and no set of ids.  tasks: into how many the files are dealt, else as many as their rows need."""
    nth = F.row_number().over(Window.partitionBy(file, ident).orderBy(*order))
    tasks = tasks or tasks_for(observations)
    return fold(observations.repartition(tasks, file).withColumn("_again", nth > 1), [file], list(order), [ident, time, "total", "last", "_again"], Lineage, lineage_step, STEPS, tasks=tasks).drop("_again")


def lineage_totals(steps: DataFrame, file: str = "session_id") -> DataFrame:
    """Per file the three totals, and what makes them doubtful."""
    return steps.groupBy(file).agg(
        F.sum("reducer_tokens").cast("long").alias("reducer_total"), F.sum("watermark_tokens").cast("long").alias("watermark_total"), F.sum("lineage_tokens").cast("long").alias("lineage_total"),
        F.count_if(F.col("transition") == RETRY).alias("retries"), F.count_if("incomplete").alias("incomplete_counters"), F.count_if("totals_only_drop").alias("totals_only_drops"), F.count_if("category_change").alias("category_changes"), F.max("heads").alias("most_heads"),
    ).withColumn("agree", (F.col("reducer_total") == F.col("watermark_total")) & (F.col("reducer_total") == F.col("lineage_total"))).withColumn("ambiguous", F.col("totals_only_drops") > 0)


def lineage_transitions(steps: DataFrame) -> DataFrame:
    """Per transition bucket how often the three readings part, and what each adds."""
    parts = (F.col("reducer_tokens") != F.col("watermark_tokens")) | (F.col("reducer_tokens") != F.col("lineage_tokens"))
    return steps.groupBy("transition").agg(
        F.count(F.lit(1)).alias("observations"), F.count_if(parts).alias("disagreements"),
        F.sum("reducer_tokens").cast("long").alias("reducer_tokens"), F.sum("watermark_tokens").cast("long").alias("watermark_tokens"), F.sum("lineage_tokens").cast("long").alias("lineage_tokens"),
    )
