"""Dates, periods, years, numbers and amounts written in text."""

from __future__ import annotations

import calendar
import datetime as dt
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, DoubleType, IntegerType, StringType, StructField, StructType

# Names of quarters, and what a word after a number multiplies it by.
QUARTERS = {"first": 1, "1st": 1, "second": 2, "2nd": 2, "third": 3, "3rd": 3, "fourth": 4, "4th": 4, "last": 4}
SCALES = {"k": 1_000, "thousand": 1_000, "m": 1_000_000, "million": 1_000_000}
MONTHS = {name.lower(): i for names in (calendar.month_name, calendar.month_abbr) for i, name in enumerate(names) if name}


@dataclass(frozen=True)
class Found:
    """A literal in a text: ``kind`` date_range, date, year or number; its place; its value; the period it means."""

    kind: str
    text: str
    start: int
    end: int
    value: Any = None
    low: dt.date | None = None
    high: dt.date | None = None


def months(year: int, first: int, count: int = 1) -> tuple[dt.date, dt.date]:
    """The first and last day of ``count`` months."""
    last = first + count - 1
    return dt.date(year, first, 1), dt.date(year, last, calendar.monthrange(year, last)[1])


def quarter(year: int, q: int) -> tuple[dt.date, dt.date]:
    return months(year, 3 * q - 2, 3)


def _range(period: Callable[[re.Match], tuple[dt.date, dt.date]]) -> Callable[[re.Match], dict]:
    return lambda m: dict(zip(("kind", "low", "high"), ("date_range", *period(m)), strict=True))


def _day(m: re.Match) -> dict | None:
    try:
        day = dt.date(*map(int, m.groups()))
    except ValueError:
        return None
    return {"kind": "date", "value": day, "low": day, "high": day}


def _year(m: re.Match) -> dict:
    y = int(m[1])
    return {"kind": "year", "value": y, "low": dt.date(y, 1, 1), "high": dt.date(y, 12, 31)}


def _number(m: re.Match) -> dict:
    value = float(m[1].replace(",", "")) * SCALES.get((m[2] or "").lower(), 1)
    return {"kind": "number", "value": int(value) if value.is_integer() else value, "text": m[0].strip()}


_Y = r"((?:19|20)\d{2})"
# What literals look like, the surer patterns first.
_PATTERNS: list[tuple[re.Pattern, Callable[[re.Match], dict | None]]] = [
    (re.compile(rf"\bQ([1-4])\s*(?:of\s+)?{_Y}\b", re.I), _range(lambda m: quarter(int(m[2]), int(m[1])))),
    (re.compile(rf"\b({'|'.join(QUARTERS)})\s+quarter\s+(?:of\s+)?{_Y}\b", re.I), _range(lambda m: quarter(int(m[2]), QUARTERS[m[1].lower()]))),
    (re.compile(rf"\b{_Y}-(\d{{2}})-(\d{{2}})\b"), _day),
    (re.compile(rf"\b({'|'.join(sorted(MONTHS, key=len, reverse=True))})\.?\s+{_Y}\b", re.I), _range(lambda m: months(int(m[2]), MONTHS[m[1].lower()]))),
    (re.compile(rf"(?<![\d$.,-]){_Y}(?![\d,.]\d|-\d)"), _year),
    (re.compile(r"(?<![\w.])\$?(\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?)\s*(k|thousand|million|m\b)?", re.I), _number),
]


def extract_literals(text: str, blocked: Iterable[tuple[int, int]] = ()) -> list[Found]:
    """Literals outside of the ``blocked`` spans, by place. Where patterns overlap the surer one has the place."""
    taken, out = list(blocked), []
    for pattern, reading in _PATTERNS:
        for m in pattern.finditer(text):
            if any(m.start() < b and a < m.end() for a, b in taken):
                continue
            got = reading(m)
            if got:
                out.append(Found(**{"text": m[0], "start": m.start(), "end": m.end()} | got))
                taken.append(m.span())
    return sorted(out, key=lambda f: (f.start, f.end))


LITERALS = ArrayType(
    StructType([StructField("kind", StringType()), StructField("text", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("number", DoubleType()), StructField("low", DateType()), StructField("high", DateType())])
)


@F.pandas_udf(LITERALS)
def literals_udf(text: pd.Series) -> pd.Series:
    """All literals of each text; NULL for NULL."""

    def one(t: str) -> list[dict]:
        return [{"kind": f.kind, "text": f.text, "start": f.start, "end": f.end, "number": float(f.value) if isinstance(f.value, (int, float)) else None, "low": f.low, "high": f.high} for f in extract_literals(t)]

    return text.map(one, na_action="ignore")
