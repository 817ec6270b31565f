"""Weekly windows in local time, across midnight and changes of the clock."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Weekly:
    """days: 1 Monday to 7 Sunday; start and end: minutes of the local day; an end not after the start is on the next day."""

    days: tuple[int, ...]
    start: int
    end: int
    zone: str


def _instants(at: Column, w: Weekly, offset: int) -> tuple[Column, Column, Column]:
    """(whether the day counts, start, end) of the window of the local day ``offset`` days from now."""
    day = F.date_add(F.to_date(F.from_utc_timestamp(at, w.zone)), offset)
    clock = lambda d, m: F.to_utc_timestamp(F.timestamp_seconds(F.unix_seconds(d.cast("timestamp")) + m * 60), w.zone)
    return (F.weekday(day) + 1).isin(*w.days), clock(day, w.start), clock(F.date_add(day, 1 if w.end <= w.start else 0), w.end)


def allowed(at: Column, windows: Sequence[Weekly]) -> Column:
    """Whether an instant is in some window; always without windows. The session's time zone is UTC."""
    if not windows:
        return F.lit(True)
    out = F.lit(False)
    for w in windows:
        for offset in (-2, -1, 0, 1):
            day, start, end = _instants(at, w, offset)
            out = out | (day & (start <= at) & (at < end))
    return out


def next_start(at: Column, windows: Sequence[Weekly]) -> Column:
    """The first start after an instant; null without windows."""
    starts = [F.when(day & (end > start) & (start > at), start) for w in windows for day, start, end in (_instants(at, w, o) for o in range(-2, 10))]
    return F.least(*starts) if len(starts) > 1 else F.lit(None).cast("timestamp")
