"""Amounts: three parsers that differ on purpose, and comparisons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_amount(c: Column) -> Column:
    """A number, else null."""
    return c.cast("string").try_cast("double")


def sidecar_amount(c: Column) -> Column:
    """Number text of a document record: dots group, a comma is the decimal mark."""
    digits = F.regexp_replace(c, r"[^\d,.-]", "")
    return F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def bank_amount(c: Column) -> Column:
    """A bank cell: the last of comma and dot is the decimal mark, the other groups."""
    t = F.regexp_replace(c.cast("string"), "[ \u00a0]+", "")
    comma, dot = F.length(t) - F.locate(",", F.reverse(t)), F.length(t) - F.locate(".", F.reverse(t))
    has_comma, has_dot = F.contains(t, F.lit(",")), F.contains(t, F.lit("."))
    decimal_comma = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    decimal_dot = F.replace(t, F.lit(","), F.lit(""))
    return F.when(has_comma & (~has_dot | (comma > dot)), decimal_comma).otherwise(decimal_dot).try_cast("double")


def _euro(t: Column) -> Column:
    return F.replace(F.replace(F.replace(t, F.lit(" "), F.lit("")), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def euro_line(c: Column) -> Column:
    """A line that is nothing but an amount such as ``1.234,56`` or ``-1 234,56``."""
    t = F.btrim(c)
    return F.when(t.rlike(r"^-?\d[\d\s.]*,\d{2}$"), _euro(t))


def currency_line(c: Column) -> Column:
    """struct<amount, currency> of a line such as ``1.234,56 USD``, with or without the code; null elsewhere."""
    pattern = r"^(-?\d[\d\s.]*,\d{2})(?:\s+([A-Z]{3}))?$"
    t = F.btrim(c)
    return F.when(t.rlike(pattern), F.struct(_euro(F.regexp_extract(t, pattern, 1)).alias("amount"), F.nullif(F.regexp_extract(t, pattern, 2), F.lit("")).alias("currency")))


def amount_line(c: Column) -> Column:
    return F.coalesce(euro_line(c), currency_line(c)["amount"])


def key_amount(c: Column) -> Column:
    """Two decimals, halves up, no minus zero, junk as 0.00: as text."""
    d = F.round(F.coalesce(c.cast("string").try_cast("decimal(38,10)"), F.lit(0).cast("decimal(38,10)")), 2).cast("decimal(38,2)")
    return d.cast("string")


def within(a: Column, b: Column, tolerance: float) -> Column:
    """|a - b| <= tolerance in doubles."""
    return F.abs(a.cast("double") - b.cast("double")) <= F.lit(float(tolerance))


def currency_code(c: Column) -> Column:
    up = F.upper(F.btrim(c))
    return F.when(up.isin("€", "EURO"), F.lit("EUR")).when(up == "$", F.lit("USD")).when(up == "£", F.lit("GBP")).otherwise(F.nullif(up, F.lit("")))


def stamp_duty_pair(amounts: Column, rate: float, most_tax: float, tolerance: float = 0.01) -> Column:
    """struct<at, base, gross, tax> of two amounts whose difference is a tax of ``rate`` on the lesser; the first gross, then the least base."""
    pairs = F.flatten(F.transform(amounts, lambda g, i: F.transform(amounts, lambda b: F.struct(i.alias("at"), b.alias("base"), g.alias("gross"), F.round(g - b, 2).alias("tax")))))
    return F.array_min(F.filter(pairs, lambda p: (p["tax"] > 0) & (p["tax"] <= most_tax) & within(F.round(p["base"] * rate, 2), p["tax"], tolerance)))
