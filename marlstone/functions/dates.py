"""Dates named in Chinese prose: found, resolved against a reference time, told apart into due and mentioned."""

from __future__ import annotations

import re
from calendar import monthrange
from collections.abc import Callable
from datetime import date, datetime, timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits, weekdays (Monday is 0), named days, and the forms a date takes, those that go first first.
_DIGITS = {"零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
_WEEKDAYS = {"一": 0, "二": 1, "三": 2, "四": 3, "五": 4, "六": 5, "日": 6, "天": 6}
_NAMED = {"大后天": 3, "后天": 2, "明天": 1, "明日": 1, "今天": 0, "今日": 0, "当天": 0}
_N = r"(?P<n>[0-9]{1,2}|[一二两三四五六七八九十]{1,3})"
_MONTH = r"(?P<next>下个?月|下月|下)?\s*个?月"
_EVERY_WEEK = re.compile(r"每\s*(?:周|星期|礼拜)[一二三四五六日天]")
_LUNAR = r"(?![0-9一二两三四五六七八九十])"
#: At most so many dates of each kind are kept, the earliest.
MOST = 8


def chinese_number(s: str | None) -> int | None:
    """0 to 99 in Chinese or Arabic digits; None for anything else."""
    s = (s or "").strip()
    if s.isdigit():
        return int(s)
    if len(s) == 1 and s in _DIGITS:
        return _DIGITS[s]
    m = re.fullmatch(r"([一二两三四五六七八九]?)十([零一二两三四五六七八九]?)", s)
    if not m or s.endswith("零"):
        return None
    return 10 * (_DIGITS[m[1]] if m[1] else 1) + (_DIGITS[m[2]] if m[2] else 0)


def _later(ref: date, days: int | None) -> date | None:
    return None if days is None else ref + timedelta(days=days)


def _month(ref: date, ahead: bool) -> tuple[int, int]:
    return (ref.year + (ref.month == 12), ref.month % 12 + 1) if ahead else (ref.year, ref.month)


def _weekday(m: re.Match, ref: date) -> date:
    """Next week's, the one after, last week's, else the coming one, today included."""
    when, day = m["when"] or "", _WEEKDAYS[m["d"]]
    monday = ref - timedelta(days=ref.weekday())
    if when.startswith("下"):
        return monday + timedelta(days=7 * (2 if when.startswith("下下") else 1) + day)
    if when.startswith("上"):
        return monday - timedelta(days=-day % 7)
    return ref + timedelta(days=(day - ref.weekday()) % 7)


def _weeks(m: re.Match, ref: date) -> date | None:
    n = chinese_number(m["n"])
    return _later(ref, 3 if m["half"] else n and 7 * n)


def _in_month(m: re.Match, ref: date) -> date | None:
    n = chinese_number(m["n"])
    return None if n is None else date(*_month(ref, (m["which"] or "").startswith("下")), n)


def _end(m: re.Match, ref: date) -> date:
    y, mo = _month(ref, bool(m["next"]))
    return date(y, mo, monthrange(y, mo)[1])


_RULES: list[tuple[re.Pattern, Callable[[re.Match, date], date | None]]] = [
    (re.compile(r"(20\d{2})[-/年](\d{1,2})[-/月](\d{1,2})日?"), lambda m, ref: date(*map(int, m.groups()))),
    (re.compile(r"(\d{1,2})月(\d{1,2})[日号]"), lambda m, ref: date(ref.year, *map(int, m.groups()))),
    (re.compile("|".join(_NAMED)), lambda m, ref: _later(ref, _NAMED[m[0]])),
    (re.compile(_N + r"\s*[天日](?:以?后|之后)"), lambda m, ref: _later(ref, chinese_number(m["n"]))),
    (re.compile(r"[过隔]\s*" + _N + r"\s*天"), lambda m, ref: _later(ref, chinese_number(m["n"]))),
    (re.compile(rf"(?:{_N}|(?P<half>半))\s*个?星期(?:以?后|之后)"), _weeks),
    (re.compile(r"半\s*个?月(?:以?后|之后)"), lambda m, ref: _later(ref, 15)),
    (re.compile(_N + r"(?P<half>)\s*周(?:以?后|之后)"), _weeks),
    (re.compile(r"(?P<when>下下个?|下个?|这个?|本|上个?)?\s*(?:周|星期|礼拜)(?P<d>[一二三四五六日天])"), _weekday),
    (re.compile(r"(?P<which>下个?月|这个?月|本月|本)?\s*" + _N + r"\s*[号日]"), _in_month),
    (re.compile(_MONTH + "[底末]"), _end),
    (re.compile(_MONTH + "初" + _LUNAR), lambda m, ref: date(*_month(ref, bool(m["next"])), 1)),
]


def named_dates(text: str | None, ref: datetime) -> list[tuple[str, date]]:
    """(as written, date) of all dates in a text. A stretch that a form has used is closed to later forms; dates that do not exist, lunar months' days and weekly repetitions are none."""
    text, out = _EVERY_WEEK.sub(" ", text or ""), []
    free = bytearray(b"\1") * len(text)
    for form, resolve in _RULES:
        for m in form.finditer(text):
            a, b = m.span()
            if all(free[a:b]):
                try:
                    day = resolve(m, ref.date())
                except (ValueError, OverflowError):
                    day = None
                if day:
                    free[a:b] = bytes(b - a)
                    out.append((m[0], day))
    return out


_FIELDS = "struct<due: array<string>, mention: array<string>, ref: string>"
_ISO_IN_TEXT = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:[+-]\d{2}:\d{2})?"


def _fields(text: pd.Series, ref: pd.Series) -> pd.DataFrame:
    out = []
    for t, r in zip(text, ref):
        got = {d for _, d in named_dates(t, r)} if isinstance(t, str) and not pd.isna(r) else set()
        kinds = [sorted(d.isoformat() for d in got if (d > r.date()) == later)[:MOST] for later in (True, False)] if got else [None, None]
        out.append((*kinds, r.isoformat() if got else None))
    return pd.DataFrame(out, columns=["due", "mention", "ref"])


def date_fields(text: Column, ref: Column) -> Column:
    """(due, mention, ref): distinct dates after the reference day, and up to it, ascending, 8 of each; all null where a text names none."""
    return F.pandas_udf(_fields, _FIELDS)(text, ref)


def reference_time(text: Column, event_time: Column, created_at: Column) -> Column:
    """When a message was said: its event time, else the first ISO time in its text, else when it was stored (timestamps without zone)."""
    written = F.regexp_extract(text, _ISO_IN_TEXT, 0)
    return F.coalesce(event_time, F.try_to_timestamp(F.nullif(F.substring(written, 1, 19), F.lit("")), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz"), created_at)


def due_within(due: Column, day: str, window: int = 0) -> Column:
    """A due date lies within `window` days of the day (ISO text)."""
    at = F.lit(day).cast("date")
    return F.coalesce(F.exists(due, lambda d: d.cast("date").between(F.date_sub(at, window), F.date_add(at, window))), F.lit(False))
