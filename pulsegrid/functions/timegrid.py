"""Times, durations, buckets and the grid of steps that a range query is evaluated on."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000, "y": 31_536_000_000}
RESOLUTIONS = {"SECONDLY": 1000, "MINUTELY": 60_000, "HOURLY": 3_600_000}
#: Steps a query may have.
STEPS_MOST = 1_000_000


def duration_ms(text: str | int | float) -> int:
    """5m, 1h30m, 250ms; a bare number is seconds."""
    if isinstance(text, (int, float)) or re.fullmatch(r"\d+(\.\d+)?", text.strip()):
        return int(float(text) * 1000)
    parts = re.findall(r"(\d+)(ms|[smhdwy])", text.strip())
    if not parts or "".join(a + b for a, b in parts) != text.strip():
        raise ValueError(f"not a duration: {text}")
    return sum(int(n) * _UNITS[u] for n, u in parts)


def instant_ms(text: str | int | float) -> int:
    """Seconds since the epoch, or an ISO 8601 instant (UTC if it names no zone)."""
    try:
        return round(float(text) * 1000)
    except ValueError:
        t = datetime.fromisoformat(str(text).replace("Z", "+00:00"))
        return round((t if t.tzinfo else t.replace(tzinfo=timezone.utc)).timestamp() * 1000)


@dataclass(frozen=True)
class Grid:
    """Steps start, start + step, ... up to end, in milliseconds."""

    start: int
    end: int
    step: int

    def __post_init__(self) -> None:
        if self.step <= 0 or self.end < self.start or (self.end - self.start) // self.step >= STEPS_MOST:
            raise ValueError(f"not a grid: {self}")

    @property
    def last(self) -> int:
        return (self.end - self.start) // self.step

    def times(self) -> Column:
        return F.sequence(F.lit(self.start).cast("long"), F.lit(self.start + self.last * self.step).cast("long"), F.lit(self.step).cast("long"))

    def reached(self, low: Column, high: Column) -> Column:
        """The steps t with low <= t <= high, as an array; none gives an empty array."""
        first = F.greatest(F.ceil((low - self.start) / self.step).cast("long"), F.lit(0).cast("long"))
        last = F.least(F.floor((high - self.start) / self.step).cast("long"), F.lit(self.last).cast("long"))
        steps = F.transform(F.sequence(first, last), lambda i: i * self.step + self.start)
        return F.when(first <= last, steps).otherwise(F.array().cast("array<bigint>"))

    def shifted(self, by: int) -> Grid:
        return replace(self, start=self.start + by, end=self.end + by)

    def pinned(self, at_seconds: float) -> Grid:
        """The single instant of an @ modifier."""
        ms = round(at_seconds * 1000)
        return Grid(ms, ms, self.step)


def resolution_for(step_ms: int) -> str:
    return "SECONDLY" if step_ms <= 1000 else "MINUTELY" if step_ms <= 60_000 else "HOURLY"


def bucket(ts: Column, size: int) -> Column:
    """The start of the tumbling bucket that ts lies in."""
    return ts - F.pmod(ts, F.lit(size))


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since the epoch of a timestamp with or without zone; the session's zone should be UTC."""
    return F.unix_millis(ts.cast("timestamp"))


def ns_to_ms(ns: Column) -> Column:
    """Milliseconds of nanoseconds, rounded down, in whole numbers: as doubles, times of today are off by up to 128 ns."""
    return F.call_function("div", ns - F.pmod(ns, F.lit(1_000_000)), F.lit(1_000_000).cast("long"))


def on_grid(series: DataFrame, grid: Grid) -> DataFrame:
    """Every series at every step."""
    return series.withColumn("ts_ms", F.explode(grid.times()))
