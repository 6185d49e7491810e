"""Report parameters: plain values worked out once on the driver."""

from __future__ import annotations

import re
from datetime import UTC, date, datetime, timedelta

DAY = 86400
# Accepted unit names.
UNITS = {"d": "days", "w": "weeks", "m": "months", "y": "years", "a": "all"}


def epoch(day: date) -> int:
    return int(datetime(day.year, day.month, day.day, tzinfo=UTC).timestamp())


def parse_date(text: str | None) -> int | None:
    """'YYYY-MM-DD' to epoch seconds; a missing date is an open bound."""
    return None if text is None else epoch(date.fromisoformat(text))


def _unit(name: str, allowed: tuple[str, ...]) -> str:
    full = UNITS.get(name, name)
    if full not in allowed:
        raise ValueError(f"unknown time unit {name!r}")
    return full


def _back(as_of: int, n: int, unit: str) -> int:
    today = datetime.fromtimestamp(as_of, UTC).date()
    if unit == "days":
        return epoch(today - timedelta(days=n))
    if unit == "weeks":
        return epoch(today - timedelta(days=today.isoweekday() % 7 + 7 * n))
    if unit == "months":
        months = today.year * 12 + today.month - 1 - n
        return epoch(date(months // 12, months % 12 + 1, 1))
    return epoch(date(today.year - n, 1, 1))


def _counted(text: str) -> tuple[int, str]:
    found = re.fullmatch(r"(\d+)\s*([A-Za-z]+)", text.strip())
    if not found or int(found[1]) < 1:
        raise ValueError(f"invalid time range {text!r}")
    return int(found[1]), found[2]


def period_start(as_of: int, period: str) -> int:
    """Start of the last N units, the current one included: '12months', '3w', '1y'."""
    n, name = _counted(period)
    return _back(as_of, n - 1, _unit(name, ("days", "weeks", "months", "years")))


def _given(resolution: str) -> str | None:
    if resolution in ("a", "auto"):
        return None
    return _unit(resolution, ("days", "weeks", "months", "years"))


def count_resolution(span: int, resolution: str = "auto") -> str:
    """Histogram resolution for a span of seconds."""
    # Day thresholds of the automatic choice.
    given = _given(resolution)
    days = span // DAY
    return given or ("years" if days >= 730 else "months" if days >= 90 else "weeks" if days >= 15 else "days")


def participation_resolution(span: int, resolution: str = "auto") -> str:
    """Histogram resolution for a span of seconds.

    Below 546 days the choice looks at the calendar day of epoch + span: weeks
    from 16 February on, days before it, so that spans little over a year are
    split by days.
    """
    # Day thresholds of the automatic choice.
    given = _given(resolution)
    days = span // DAY
    if given:
        return given
    if days >= 1826:
        return "years"
    if days >= 546:
        return "months"
    day = datetime.fromtimestamp(span, UTC)
    return "weeks" if (day.month, day.day) > (2, 15) else "days"


def slot_start(moment: int, resolution: str) -> int:
    return _back(moment, 0, resolution)


def volume_slots(as_of: int, slots: str = "all,12m,m") -> list[tuple[str, int | None]]:
    """(caption, first second) of each time slot; None is unbounded."""
    out: list[tuple[str, int | None]] = []
    for text in slots.split(","):
        n, name = _counted(text if text[:1].isdigit() else "1" + text)
        unit = _unit(name, ("days", "weeks", "months", "years", "all"))
        if unit == "all":
            out.append(("All Time", None))
            continue
        single = "Today" if unit == "days" else f"This {unit[:-1]}"
        out.append((single if n == 1 else f"Past {n} {unit}", _back(as_of, n - 1, unit)))
    return out
