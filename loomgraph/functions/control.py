"""Driver-side control functions: cron expressions, signatures, canonical values."""

from __future__ import annotations

import hashlib
import hmac
import json
import unicodedata
from datetime import datetime, timedelta
from decimal import Decimal, InvalidOperation
from zoneinfo import ZoneInfo

_FIELDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 6))


def cron_field(text: str, lo: int, hi: int) -> set[int]:
    """Values of one field: ``*``, lists, ranges and steps."""
    out: set[int] = set()
    for part in text.split(","):
        body, _, step = part.partition("/")
        k = int(step) if step else 1
        if k < 1:
            raise ValueError(f"step in {text!r}")
        a, b = (lo, hi) if body == "*" else (int(body.split("-")[0]), int(body.split("-")[-1]) if "-" in body or not step else hi)
        if not (lo <= a <= b <= hi):
            raise ValueError(f"{text!r} is not within {lo} and {hi}")
        out |= set(range(a, b + 1, k))
    return out


def cron_fields(expression: str) -> list[set[int]]:
    parts = expression.split()
    if len(parts) != 5:
        raise ValueError("five fields expected")
    return [cron_field(p.replace("7", "0") if i == 4 and p == "7" else p, lo, hi) for i, (p, (lo, hi)) in enumerate(zip(parts, _FIELDS))]


def cron_valid(expression: str) -> bool:
    try:
        cron_fields(expression)
        return True
    except ValueError:
        return False


def next_fire(expression: str, after: datetime, zone: str = "UTC", excluded: frozenset = frozenset()) -> datetime | None:
    """The first minute after ``after`` that the expression names in its zone, on no excluded date; None within four years."""
    m, h, d, mo, w = cron_fields(expression)
    any_day, any_week = len(d) == 31, len(w) == 7
    t = after.astimezone(ZoneInfo(zone)).replace(second=0, microsecond=0) + timedelta(minutes=1)
    end = t + timedelta(days=4 * 366)
    while t < end:
        week = (t.weekday() + 1) % 7
        day = (t.day in d and week in w) if any_day or any_week else (t.day in d or week in w)
        if t.month not in mo or not day or t.date() in excluded:
            t = (t + timedelta(days=1)).replace(hour=0, minute=0)
        elif t.hour not in h:
            t = (t + timedelta(hours=1)).replace(minute=0)
        elif t.minute not in m:
            t += timedelta(minutes=1)
        else:
            return t.astimezone(after.tzinfo)
    return None


def signed(body: bytes, secret: bytes, timestamp: str) -> str:
    return hmac.new(secret, timestamp.encode() + b"." + body, hashlib.sha256).hexdigest()


def verified(body: bytes, secret: bytes, timestamp: str, signature: str, now: float, window: float = 300) -> bool:
    """Whether a signature is right and its time within the replay window."""
    return abs(now - float(timestamp)) <= window and hmac.compare_digest(signed(body, secret, timestamp), signature)


def canonical(value: object) -> str:
    """One text for equal values: numbers without trailing zeros, times in UTC, sets in order, keys in order, texts in NFC."""
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, (int, float, Decimal)):
        try:
            d = Decimal(str(value))
        except InvalidOperation as e:
            raise ValueError(f"no number: {value!r}") from e
        return format(d.normalize() + 0, "f")
    if isinstance(value, datetime):
        return (value if value.tzinfo else value.replace(tzinfo=ZoneInfo("UTC"))).astimezone(ZoneInfo("UTC")).isoformat()
    if isinstance(value, (set, frozenset)):
        return "[" + ",".join(sorted(map(canonical, value))) + "]"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(str(k), ensure_ascii=False)}:{canonical(value[k])}" for k in sorted(value, key=str)) + "}"
    return json.dumps(unicodedata.normalize("NFC", str(value)), ensure_ascii=False)
