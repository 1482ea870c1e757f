"""When a schedule fires next, in UTC epoch milliseconds."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names in the fourth and fifth field, and shorthands.
MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
DAYS = {d: i for i, d in enumerate("sun mon tue wed thu fri sat".split())}
SHORT = {"@hourly": "0 * * * *", "@daily": "0 0 * * *", "@weekly": "0 0 * * 0", "@monthly": "0 0 1 * *", "@yearly": "0 0 1 1 *"}


def _field(text: str, low: int, high: int, names: dict[str, int] | None = None) -> set[int]:
    """The numbers that lists, ranges and steps of one field name."""
    out: set[int] = set()
    number = lambda x: names[x.lower()] if names and x.lower() in names else int(x)
    for part in text.split(","):
        span, _, step = part.partition("/")
        every = int(step) if step else 1
        if every < 1:
            raise ValueError(f"bad step in {text!r}")
        if span == "*":
            a, b = low, high
        elif "-" in span:
            a, b = map(number, span.split("-"))
        else:
            a = number(span)
            b = high if step else a
        if not low <= a <= b <= high:
            raise ValueError(f"{part!r} is outside {low}-{high}")
        out |= set(range(a, b + 1, every))
    return out


@dataclass(frozen=True)
class Cron:
    """Five fields: minute, hour, day of month, month, day of week. Where both days are restricted, either will do."""

    text: str

    def fields(self) -> tuple[set[int], set[int], set[int], set[int], set[int], bool, bool]:
        parts = SHORT.get(self.text, self.text).split()
        if len(parts) != 5:
            raise ValueError("a cron expression has five fields")
        minute, hour, day, month, week = parts
        return (_field(minute, 0, 59), _field(hour, 0, 23), _field(day, 1, 31), _field(month, 1, 12, MONTHS), {d % 7 for d in _field(week, 0, 7, DAYS)}, day.startswith("*"), week.startswith("*"))

    def slots(self) -> list[int]:
        """The minutes of a day at which it fires."""
        minutes, hours, *_ = self.fields()
        return [60 * h + m for h in sorted(hours) for m in sorted(minutes)]

    def day_from(self, day: int) -> int | None:
        """The first day, counted from 1970, on which it fires, within a year and a day; None if there is none."""
        _, _, days, months, week, any_day, any_week = self.fields()
        for d in range(day, day + 368):
            at = EPOCH + dt.timedelta(days=d)
            in_days, in_week = at.day in days, (at.weekday() + 1) % 7 in week
            if at.month in months and (in_week if any_day and not any_week else in_days if any_week else in_days or in_week):
                return d
        return None

    def after(self, now_ms: float) -> int | None:
        """The first minute later than now, looking a year ahead; None if there is none."""
        found = fires(self.text, np.array([now_ms // 60_000], np.int64))[0]
        return None if found < 0 else int(found) * 60_000


EPOCH = dt.date(1970, 1, 1)


@lru_cache(maxsize=4096)
def _slots(text: str) -> np.ndarray:
    return np.array(Cron(text).slots(), np.int64)


@lru_cache(maxsize=1 << 16)
def _day_from(text: str, day: int) -> int:
    found = Cron(text).day_from(day)
    return -1 if found is None else found


def fires(text: str, minutes: np.ndarray) -> np.ndarray:
    """The next fire of one schedule after each minute, in minutes; -1 without one within 366 days. The calendar is looked at once for each distinct day."""
    slots, (day, minute) = _slots(text), np.divmod(minutes, 1440)
    days, of = np.unique(day, return_inverse=True)
    today = np.array([_day_from(text, d) == d for d in days.tolist()], bool)[of]
    later = np.array([_day_from(text, d + 1) for d in days.tolist()], np.int64)[of]
    k = np.searchsorted(slots, minute, side="right")
    out = np.where(today & (k < len(slots)), day * 1440 + slots[np.minimum(k, len(slots) - 1)], np.where(later < 0, -1, later * 1440 + slots[0]))
    return np.where(out < minutes + 1 + 366 * 1440, out, -1)


def next_fire(schedule: Column, now_ms: Column) -> Column:
    """The first fire after now of each row's schedule, in milliseconds; null without either, or without a fire within a year.

    A batch is taken schedule by schedule, in whole columns.
    """

    @F.pandas_udf("long")
    def after(texts: pd.Series, nows: pd.Series) -> pd.Series:
        out = pd.Series(pd.NA, index=texts.index, dtype="Int64")
        known = texts.notna() & nows.notna()
        for text, rows in nows[known].groupby(texts[known]):
            found = fires(text, rows.to_numpy().astype(np.int64) // 60_000)
            out[rows.index] = pd.array(found * 60_000, dtype="Int64")
            out[rows.index[found < 0]] = pd.NA
        return out

    return after(schedule, now_ms.cast("long"))


# Schedules by name, as the text that next_fire reads.


def hourly(minute: Column) -> Column:
    return F.concat_ws(" ", minute.cast("string"), F.lit("* * * *"))


def daily(hour: Column, minute: Column) -> Column:
    return F.concat_ws(" ", minute.cast("string"), hour.cast("string"), F.lit("* * *"))


def weekly(day: Column, hour: Column, minute: Column) -> Column:
    """day: its name or its first three letters."""
    return F.concat_ws(" ", minute.cast("string"), hour.cast("string"), F.lit("* *"), F.substring(day, 1, 3))


def monthly(day: Column, hour: Column, minute: Column) -> Column:
    """Months without that day are passed over."""
    return F.concat_ws(" ", minute.cast("string"), hour.cast("string"), day.cast("string"), F.lit("* *"))


def interval_after(anchor_ms: int, every_ms: int, now_ms: float) -> int:
    """Ticks are anchored; missed ones are skipped."""
    if every_ms <= 0:
        raise ValueError("an interval must be positive")
    return anchor_ms if now_ms < anchor_ms else anchor_ms + int((now_ms - anchor_ms) // every_ms + 1) * every_ms
