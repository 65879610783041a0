"""Times and offsets as people write them: "now", "-3h", "noon yesterday", "16:00_20240102"."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone, tzinfo

_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_DAYS = "sun mon tue wed thu fri sat".split()
_SECONDS = {"s": 1, "min": 60, "h": 3600, "d": 86400, "w": 604800, "mon": 30 * 86400, "y": 365 * 86400}


def unit(word: str) -> str:
    for head, name in (("s", "s"), ("min", "min"), ("h", "h"), ("d", "d"), ("w", "w"), ("mon", "mon"), ("y", "y")):
        if word.startswith(head):
            return name
    raise ValueError(f"unknown unit of time: {word!r}")


def offset_seconds(text: str) -> int:
    """Seconds of "+1d12h", "-90min", "1hour"; a month has 30 days and a year 365."""
    if not text:
        return 0
    sign = -1 if text[0] == "-" else 1
    rest = text.lstrip("+-")
    if not re.fullmatch(r"(\d+[a-z]+)+", rest):
        raise ValueError(f"not an offset: {text!r}")
    return sign * sum(int(n) * _SECONDS[unit(w)] for n, w in re.findall(r"(\d+)([a-z]+)", rest))


def reference(text: str, now: datetime) -> datetime:
    """A point in time without an offset."""
    text = text.strip().lower()
    if not text or text == "now":
        return now
    # A day without a time of day begins at midnight.
    hour, minute = 0, 0
    if m := re.match(r"(\d{1,2}):(\d{2})(am|pm)?", text):
        hour, minute = (int(m[1]) + 12 * (m[3] == "pm")) % 24, int(m[2])
        text = text[m.end() :]
    elif m := re.match(r"(\d{1,2})(am|pm)", text):
        hour, text = int(m[1]) % 12 + 12 * (m[2] == "pm"), text[m.end() :]
    for word, h in (("noon", 12), ("midnight", 0), ("teatime", 16)):
        if text.startswith(word):
            hour, minute, text = h, 0, text[len(word) :]
    text = text.strip("_ ")
    at = now.replace(hour=hour, minute=minute, second=0, microsecond=0)
    if text in ("", "today"):
        return at
    if text == "yesterday":
        return at - timedelta(1)
    if text == "tomorrow":
        return at + timedelta(1)
    if m := re.fullmatch(r"(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})", text):
        year = int(m[3]) + (0 if len(m[3]) == 4 else 2000 if int(m[3]) < 70 else 1900)
        return at.replace(year=year, month=int(m[1]), day=int(m[2]))
    if re.fullmatch(r"\d{8}", text):
        return at.replace(year=int(text[:4]), month=int(text[4:6]), day=int(text[6:]))
    if text[:3] in _MONTHS:
        if not (m := re.search(r"(\d{1,2})$", text)):
            raise ValueError(f"a month needs a day: {text!r}")
        return at.replace(month=_MONTHS.index(text[:3]) + 1, day=int(m[1]))
    if text[:3] in _DAYS:
        back = (int(at.strftime("%w")) - _DAYS.index(text[:3])) % 7
        return at - timedelta(back)
    raise ValueError(f"not a time: {text!r}")


def parse_time(text: str, now: datetime | None = None, tz: tzinfo = timezone.utc) -> datetime:
    """An epoch number, HH:MM_YYYYMMDD, or a reference with an offset."""
    now = (now or datetime.now(tz)).astimezone(tz)
    text = text.strip().lower().replace("_", " ").replace(",", "").replace(" ", "")
    if text.isdigit() and not (len(text) == 8 and 1900 < int(text[:4]) and int(text[4:6]) < 13 and int(text[6:]) < 32):
        return datetime.fromtimestamp(int(text), tz)
    if m := re.fullmatch(r"(\d{1,2}:\d{2})(\d{8})", text):
        day = reference(m[2], now)
        hour, minute = map(int, m[1].split(":"))
        return day.replace(hour=hour, minute=minute)
    if m := re.fullmatch(r"([^+-]*)([+-].+)", text):
        return reference(m[1], now) + timedelta(seconds=offset_seconds(m[2]))
    return reference(text, now)
