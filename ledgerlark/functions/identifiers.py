"""Tax numbers, bank accounts and hashes in file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_diacritics


def tax_number(c: Column, country: str = "PT") -> Column:
    """Letters and digits, nine bare digits with the country's prefix; empty for none."""
    t = F.regexp_replace(F.upper(F.coalesce(c.cast("string"), F.lit(""))), "[^A-Z0-9]", "")
    return F.when(t.rlike(r"^\d{9}$") & F.lit(bool(country)), F.concat(F.lit(country), t)).otherwise(t)


def bare_tax_number(c: Column, prefixes: tuple[str, ...] = ("PT",)) -> Column:
    t = F.regexp_replace(F.upper(F.coalesce(c.cast("string"), F.lit(""))), "[^A-Z0-9]", "")
    return F.regexp_replace(t, f"^(?:{'|'.join(prefixes)})", "") if prefixes else t


def tax_checksum_ok(c: Column) -> Column:
    """Mod-11 check digit of nine digits (weights 9 to 2; a remainder under 2 gives 0)."""
    digit = lambda i: F.substring(c, i, 1).try_cast("int")
    total = sum((digit(i) * (10 - i) for i in range(1, 9)), F.lit(0))
    rest = F.pmod(total, F.lit(11))
    return F.coalesce(c.rlike(r"^\d{9}$") & (digit(9) == F.when(rest < 2, 0).otherwise(11 - rest)), F.lit(False))


def is_national_tax_number(c: Column, prefixes: tuple[str, ...] = ("PT",)) -> Column:
    bare = bare_tax_number(c, prefixes)
    return bare.rlike(r"^[1-9]\d{8}$") & tax_checksum_ok(bare)


def _mod97(digits: Column) -> Column:
    """Remainder of a long digit string, seven digits at a time."""
    chunks = F.regexp_extract_all(digits, F.lit(r"(\d{1,7})"))
    power = lambda x: F.pow(F.lit(10), F.length(x)).cast("long")
    return F.aggregate(chunks, F.lit(0).cast("long"), lambda a, x: F.pmod(a * power(x) + x.cast("long"), F.lit(97)).cast("long"))


def valid_ibans(text: Column) -> Column:
    """Distinct account numbers in a text whose check digits hold."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b([A-Z]{2}\d{2}[A-Z0-9]{11,30})\b"))
    turned = lambda a: F.concat(F.substring(a, 5, 40), F.substring(a, 1, 4))
    digits = lambda a: F.array_join(F.transform(F.split(turned(a), ""), lambda ch: F.when(ch.rlike("[A-Z]"), (F.ascii(ch) - 55).cast("string")).otherwise(ch)), "")
    return F.array_distinct(F.filter(found, lambda a: _mod97(digits(a)) == 1))


#: Fixed value: labels of a payment's receiver.
BENEFICIARY = r"\b(?:BENEFICIARIO|BENEFICIARY|PAYEE)\b"


def payment_accounts(lines: Column, marker: str = BENEFICIARY) -> Column:
    """struct<mentions, beneficiaries>: accounts in any line, and those in a marked line or the one after it."""
    pair = F.flatten(F.transform(lines, lambda line, i: F.when(F.upper(strip_diacritics(line)).rlike(marker), F.array(line, F.coalesce(F.get(lines, i + 1), F.lit("")))).otherwise(F.array().cast("array<string>"))))
    return F.struct(valid_ibans(F.array_join(lines, "\n")).alias("mentions"), valid_ibans(F.array_join(pair, "\n")).alias("beneficiaries"))


def name_hash(c: Column) -> Column:
    """Eight hex digits at the end of a file name, else null."""
    return F.lower(F.nullif(F.regexp_extract(c, r"(?:^| - )([0-9a-fA-F]{8})(?:\.[^.]+)?$", 1), F.lit("")))
