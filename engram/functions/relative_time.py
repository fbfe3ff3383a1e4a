"""Relative time phrases, anchored to a given time; null where a phrase states none.

``parse`` works at plan time on one phrase, ``resolve`` on a column. Days start at midnight UTC.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"minute": 60, "hour": 3_600, "day": 86_400, "week": 604_800}


def parse(phrase: str | None, as_of: datetime) -> datetime | None:
    """The instant of now, today, yesterday, tomorrow, last or next week/month/year, N units ago, or an ISO date."""
    text = (phrase or "").strip().lower()
    day = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    fixed = {"now": as_of, "today": day, "yesterday": day - timedelta(days=1), "tomorrow": day + timedelta(days=1), "last week": day - timedelta(days=7), "next week": day + timedelta(days=7)}
    if text in fixed:
        return fixed[text]
    if m := re.fullmatch(r"(\d{1,4}) (minute|hour|day|week)s? ago", text):
        return as_of - timedelta(seconds=int(m[1]) * UNITS[m[2]])
    if m := re.fullmatch(r"(?:(\d{1,3}) (month|year)s? ago|(last|next) (month|year))", text):
        months = (int(m[1] or 1)) * (12 if (m[2] or m[4]) == "year" else 1) * (1 if m[3] == "next" else -1)
        total = day.year * 12 + day.month - 1 + months
        first = day.replace(year=total // 12, month=total % 12 + 1, day=1)
        last = (first.replace(year=first.year + first.month // 12, month=first.month % 12 + 1) - timedelta(days=1)).day
        return first.replace(day=min(day.day, last))
    try:
        return datetime.fromisoformat(text)
    except ValueError:
        return None


def resolve(phrase: Column, anchor: Column) -> Column:
    """The same on columns, for the first phrase that a text contains."""
    text, day = F.lower(phrase), F.date_trunc("day", anchor)
    n = F.regexp_extract(text, r"\b(\d{1,4}) (minute|hour|day|week)s? ago", 1)
    unit = F.regexp_extract(text, r"\b(\d{1,4}) (minute|hour|day|week)s? ago", 2)
    seconds = F.element_at(F.create_map(*[F.lit(x) for p in UNITS.items() for x in p]), F.when(unit != "", unit))
    return (
        F.when(n != "", F.timestamp_micros(F.unix_micros(anchor) - F.when(n != "", n).cast("bigint") * seconds * 1_000_000))
        .when(text.contains("yesterday"), day - F.expr("interval 1 day"))
        .when(text.contains("tomorrow"), day + F.expr("interval 1 day"))
        .when(text.contains("last week"), day - F.expr("interval 7 day"))
        .when(text.contains("next week"), day + F.expr("interval 7 day"))
        .when(text.contains("last month"), F.add_months(day, -1).cast("timestamp"))
        .when(text.contains("last year"), F.add_months(day, -12).cast("timestamp"))
        .when(text.rlike(r"\b(today|now)\b"), day)
    )
