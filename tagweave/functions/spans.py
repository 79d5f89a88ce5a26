"""Time spans: named and absolute forms, resolved on the driver to [start, end)."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta


@dataclass(frozen=True)
class Span:
    """Half-open; weeks start on Monday."""

    start: datetime
    end: datetime

    def __contains__(self, at: datetime) -> bool:
        return self.start <= at < self.end


def _months(day: date, n: int) -> date:
    index = day.year * 12 + day.month - 1 + n
    return date(index // 12, index % 12 + 1, 1)


def _midnight(day: date) -> datetime:
    return datetime.combine(day, time())


def _instant(text: str) -> datetime:
    return datetime.fromisoformat(text.split()[0].replace("Z", "+00:00")).replace(tzinfo=None)


def resolve(text: str, now: datetime) -> Span:
    """today, yesterday, this/last week/month/quarter/year, a date, two dates (the
    second included), or two instants."""
    today = now.date()
    name = text.strip().strip('"')
    lower = name[:1].lower() + name[1:]
    if lower == "today":
        days = today, today + timedelta(1)
    elif lower == "yesterday":
        days = today - timedelta(1), today
    elif lower[:4] in ("this", "last") and lower[4:].lower() in ("week", "month", "quarter", "year"):
        unit, back = lower[4:].lower(), lower.startswith("last")
        if unit == "week":
            start = today - timedelta(today.weekday() + 7 * back)
            days = start, start + timedelta(7)
        elif unit == "month":
            days = _months(today, -back), _months(today, 1 - back)
        elif unit == "quarter":
            start = date(today.year, (today.month - 1) // 3 * 3 + 1, 1)
            days = _months(start, -3 * back), _months(start, 3 - 3 * back)
        else:
            days = date(today.year - back, 1, 1), date(today.year - back + 1, 1, 1)
    else:
        parts = [p.strip() for p in name.split(",")]
        if not 1 <= len(parts) <= 2:
            raise ValueError(f"no span {text!r}")
        if "T" in parts[0]:
            start = _instant(parts[0])
            return Span(start, _instant(parts[1]) if len(parts) == 2 else now)
        days = date.fromisoformat(parts[0]), date.fromisoformat(parts[-1]) + timedelta(1)
    if days[0] >= days[1]:
        raise ValueError(f"{text!r} ends before it starts")
    return Span(_midnight(days[0]), _midnight(days[1]))
