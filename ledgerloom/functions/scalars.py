"""Column expressions of the domain: counters, meters, sources, buckets and rounding.  Missing stays NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CATEGORIES = ("uncached", "cache_read", "cache_write", "output", "reasoning")


def clamp0(c: Column) -> Column:
    return F.greatest(F.lit(0), c)


def disjoint_categories(inp: Column, cached: Column, written: Column, out: Column, reasoning: Column) -> dict[str, Column]:
    """Counters that do not overlap; clamped in stages so that no step goes below zero."""
    return {
        "uncached": clamp0(clamp0(inp - cached) - written),
        "cache_read": cached,
        "cache_write": written,
        "output": clamp0(out - reasoning),
        "reasoning": reasoning,
    }


def category_sum(prefix: str = "") -> Column:
    out = F.col(prefix + CATEGORIES[0])
    for c in CATEGORIES[1:]:
        out = out + F.col(prefix + c)
    return out


def integrity(total: str = "total") -> Column:
    """Reported total less the sum of its categories; NULL when there is no total."""
    return F.col(total) - category_sum()


def complete_categories(total: str = "total") -> Column:
    """Every category is there and not negative, and they add up to the total."""
    ok = F.lit(True)
    for c in CATEGORIES:
        ok = ok & (F.coalesce(F.col(c), F.lit(-1)) >= 0)
    return ok & F.coalesce(category_sum() == F.col(total), F.lit(False))


def input_share(of: str) -> Column:
    """Share of the input in percent; NULL without input or with a negative part."""
    parts = [F.col(c) for c in ("uncached", "cache_read", "cache_write")]
    whole = parts[0] + parts[1] + parts[2]
    return F.when((whole > 0) & (F.least(*parts) >= 0), F.col(of) * 100.0 / whole)


def context_utilization(inp: Column, window: Column) -> Column:
    """P10: how full the context window is, 0 to 100."""
    return F.when((inp >= 0) & (window > 0), F.least(F.lit(100.0), F.greatest(F.lit(0.0), inp * 100.0 / window)))


def valid_percent(used: Column) -> Column:
    return F.coalesce(used.isNotNull() & ~F.isnan(used) & used.between(0, 100), F.lit(False))


def elapsed_percent(us: Column, resets_us: Column, window_minutes: Column) -> Column:
    """How much of the window has passed; NULL outside it."""
    start = resets_us - window_minutes.cast("long") * 60_000_000
    return F.when((window_minutes > 0) & us.between(start, resets_us), (us - start) * 100.0 / (resets_us - start))


def authority(source: Column) -> Column:
    """How far a reading's source can be trusted."""
    s = F.lower(source)
    return F.when(s.contains("app-server"), "ProviderAuthoritative").when(s.contains("rollout") | s.contains("embedded"), "EmbeddedObservation").otherwise("Unknown")


def activity_state(status: Column, seen_us: Column, now_us: Column, recent_us: int = 120_000_000) -> Column:
    """Work in progress is recent only if it was seen lately."""
    return (
        F.when(status == "completed", "Completed").when(status == "failed", "Failed")
        .when((status == "in_progress") & (now_us - seen_us <= recent_us), "RecentlyWorking").when(status == "in_progress", "StaleInProgress").otherwise("Unknown")
    )


def bucket_unit(span_us: int, most: int) -> str:
    """The finest of minute, hour, day and month that gives at most `most` buckets."""
    for unit, size in (("minute", 60_000_000), ("hour", 3_600_000_000), ("day", 86_400_000_000)):
        if -(-span_us // size) <= most:
            return unit
    return "month"


def sanitize_remote_url(url: Column) -> Column:
    """A repository URL without credentials, query or fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@", "$1")


def half_width(rounded: Column) -> Column:
    return F.when(rounded, 0.5).otherwise(1.0)


def measurement_envelope(start: Column, end: Column, trusted: Column) -> tuple[Column, Column]:
    """Least and most that a rounded meter can have moved, clipped to 0..100."""
    w = half_width(trusted & (start == F.floor(start)) & (end == F.floor(end)))
    zero, full = F.lit(0.0), F.lit(100.0)
    lower = F.greatest(zero, F.greatest(zero, end - w) - F.least(full, start + w))
    upper = F.greatest(zero, F.least(full, end + w) - F.greatest(zero, start - w))
    return lower, upper


def interval_residual(predicted: Column, lower: Column, upper: Column) -> Column:
    """Signed distance of a prediction to the envelope, zero inside it."""
    return F.when(predicted < lower, predicted - lower).when(predicted > upper, predicted - upper).otherwise(0.0)


def interval_loss(predicted: Column, lower: Column, upper: Column) -> Column:
    return F.abs(interval_residual(predicted, lower, upper))


def rank_quantile(values: Column, q: float, up: bool = True) -> Column:
    """An element of the values, by ceiling (or floor) rank; never an interpolation."""
    n = F.size(values)
    rank = F.ceil(n * q) if up else F.floor((n - 1) * q) + 1
    return F.when(n > 0, F.element_at(F.sort_array(values), F.least(n, F.greatest(F.lit(1), rank.cast("int")))))


def text_or_none(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def like_escaped(text: str) -> str:
    return "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def directed_ratio(num: Column, den: Column, scale: int, up: bool) -> Column:
    """A decimal quotient rounded down or up at a scale."""
    q = num.cast("decimal(38,10)") / F.nullif(den.cast("decimal(38,10)"), F.lit(0))
    return (F.ceil(q, F.lit(scale)) if up else F.floor(q, F.lit(scale))).cast(f"decimal(38,{scale})")


def median(values: Column) -> Column:
    s, n = F.sort_array(values), F.size(values)
    low, high = F.element_at(s, F.floor((n + 1) / 2).cast("int")), F.element_at(s, F.floor((n + 2) / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2.0)
