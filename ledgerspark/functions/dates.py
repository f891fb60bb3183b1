"""Date expressions (F-40 to F-46)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted date formats, day first before month first, in the order of trial.
FIELD_FORMATS = [
    "d-M-yyyy", "d/M/yyyy", "d.M.yyyy", "yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "d MMMM yyyy", "d MMM yyyy",
    "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy", "M-d-yyyy", "M/d/yyyy", "d-MMM-yyyy", "d-MMMM-yyyy",
]
# Formats of whole cells, and of stored values.
CELL_FORMATS = ["d/M/yyyy", "d-M-yyyy", "yyyy-M-d", "yyyy/M/d", "d.M.yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy"]
STORED_FORMATS = ["yyyy-M-d", "yyyy/M/d", "d-M-yyyy", "d/M/yyyy", "M-d-yyyy", "M/d/yyyy"]
# Fixed value: what looks like a date inside a text.
DATE_LIKE = (
    r"\b(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}|\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2}|\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}"
    r"|[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4}|\d{1,2}-[A-Za-z]{3,9}-\d{4})\b"
)


def _first_of(text: Column, formats: list[str]) -> Column:
    # month names in any case; years have four digits
    titled = F.regexp_replace(F.initcap(F.regexp_replace(F.lower(F.trim(text)), "-([a-z])", "- $1")), "- ", "-")
    guard = titled.rlike(r"(^|\D)\d{4}(\D|$)")
    return F.when(guard, F.coalesce(*[F.try_to_date(titled, f) for f in formats]))


def normalize_date(value: Column) -> Column:
    """F-40: the first date-like part of a text as ISO text; null rather than a guess."""
    plain = F.regexp_replace(value, r"(?i)(?<=\d)(st|nd|rd|th)\b", "")
    found = F.regexp_extract(plain, DATE_LIKE, 1)
    return F.date_format(_first_of(F.when(found != "", found).otherwise(plain), FIELD_FORMATS), "yyyy-MM-dd")


def parse_date(value: Column) -> Column:
    """F-41: a whole cell as ISO text."""
    return F.date_format(_first_of(value, CELL_FORMATS), "yyyy-MM-dd")


def stored_date(value: Column) -> Column:
    """F-42: a date, from the whole text or from a year-month-day anywhere in it."""
    inside = F.regexp_extract(value, r"(\d{4})-(\d{1,2})-(\d{1,2})", 0)
    return F.coalesce(_first_of(value, STORED_FORMATS), F.try_to_date(F.when(inside != "", inside), "yyyy-M-d"))


def date_offset(date: Column, days: Column | int) -> Column:
    """F-43."""
    return F.date_add(date, days)


def quarter_bounds(as_of: str) -> tuple[Column, Column]:
    """F-44: first and last day of the quarter of an ISO date."""
    start = F.trunc(F.lit(as_of).cast("date"), "quarter")
    return start, F.date_sub(F.add_months(start, 3), 1)


def iso_format_ok(value: Column) -> Column:
    """F-45: the shape of an ISO date."""
    return value.rlike(r"^\d{4}-\d{2}-\d{2}$")


def iso_calendar_ok(value: Column) -> Column:
    """F-45: a day that exists."""
    return F.try_to_date(value, "yyyy-MM-dd").isNotNull()
