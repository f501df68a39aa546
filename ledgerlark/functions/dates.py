"""Dates kept as text, and what is derived from them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_diacritics


def iso_date(c: Column) -> Column:
    """The date of ``yyyy-m-d`` text, else null."""
    return F.try_to_timestamp(F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), c), F.lit("yyyy-M-d")).cast("date")


def bank_date(c: Column, formats: tuple[str, ...] = ("dd/MM/yyyy", "dd-MM-yyyy", "yyyy-MM-dd")) -> Column:
    """The first format that fits, as ISO text, else null."""
    return F.coalesce(*[F.date_format(F.try_to_timestamp(F.btrim(c), F.lit(f)), "yyyy-MM-dd") for f in formats])


def any_date(c: Column) -> Column:
    """As :func:`bank_date`, but text that fits no format stays as it is."""
    return F.coalesce(bank_date(c), F.nullif(F.btrim(c), F.lit("")))


def signed_days(a: Column, b: Column) -> Column:
    """Days from a to b."""
    return F.datediff(iso_date(b), iso_date(a))


def days_between(a: Column, b: Column) -> Column:
    return F.abs(signed_days(a, b))


def same_month(a: Column, b: Column) -> Column:
    return F.coalesce(F.trunc(iso_date(a), "MM") == F.trunc(iso_date(b), "MM"), F.lit(False))


def month_key(c: Column) -> Column:
    """``yyyy-mm`` at the start of a text, else null."""
    return F.nullif(F.regexp_extract(c, r"^(\d{4}-\d{2})", 1), F.lit(""))


def calendar_month(c: Column, full_date: bool = True) -> Column:
    """The month of a valid date (or of a month text), else null."""
    whole = c if full_date else F.concat(c, F.lit("-01"))
    return F.when(whole.rlike(r"^\d{4}-\d{2}-\d{2}$") & iso_date(whole).isNotNull(), F.substring(c, 1, 7))


def months_back(months: int, today: date) -> list[str]:
    """Months from ``months`` ago to this one."""
    at = today.year * 12 + today.month - 1
    return [f"{m // 12:04d}-{m % 12 + 1:02d}" for m in range(at - months, at + 1)]


def month_range(months: list[str]) -> tuple[str, str]:
    """First day of the first month and last day of the last."""
    y, m = map(int, max(months).split("-"))
    after = date(y + m // 12, m % 12 + 1, 1)
    return f"{min(months)}-01", date.fromordinal(after.toordinal() - 1).isoformat()


def partial_date(c: Column, issued: Column) -> Column:
    """The last valid ``dd/mm`` or ``dd-mm`` in the issue date's year; a December day on a January paper is last year's, and the reverse."""
    issue = iso_date(issued)

    def dated(found: Column) -> Column:
        day, month = (F.substring(found, i, 2).cast("int") for i in (1, 4))
        year = F.year(issue) + F.when((month == 12) & (F.month(issue) == 1), -1).when((month == 1) & (F.month(issue) == 12), 1).otherwise(0)
        return F.date_format(F.try_to_timestamp(F.format_string("%d-%d-%d", year, month, day), F.lit("yyyy-M-d")), "yyyy-MM-dd")

    valid = F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"\b(\d{2}[/-]\d{2})\b")), dated), lambda d: d.isNotNull())
    return F.try_element_at(valid, F.lit(-1))


def business_days_after(c: Column, days: int) -> Column:
    """The date so many weekdays later."""
    start = iso_date(c)
    span = F.sequence(F.date_add(start, 1), F.date_add(start, days * 2 + 4))
    return F.element_at(F.filter(span, lambda d: F.weekday(d) < 5), days)


#: Fixed value: month abbreviations of bank texts.
MONTHS = ("JAN", "FEV", "MAR", "ABR", "MAI", "JUN", "JUL", "AGO", "SET", "OUT", "NOV", "DEZ")


def period_tokens(c: Column) -> Column:
    """Distinct ``MON year`` tokens, whatever stands between the two."""
    plain = F.regexp_replace(F.upper(strip_diacritics(F.coalesce(c, F.lit("")))), "[^A-Z0-9]+", " ")
    return F.array_distinct(F.regexp_extract_all(plain, F.lit(rf"\b((?:{'|'.join(MONTHS)}) 20\d{{2}})\b")))
