"""Invoice QR text, read as a map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Type codes of invoice QR texts, and currencies of their countries.
DOCUMENT_TYPES = {"FT": "invoice", "FS": "invoice", "FR": "invoice-receipt", "NC": "invoice-credit", "ND": "invoice-debit", "RC": "receipt", "RG": "receipt"}
CURRENCIES = {"PT": "EUR"}
DEFAULT_COUNTRY = "PT"


def is_invoice_qr(c: Column) -> Column:
    """Starts with the issuer's number and has the document's unique code."""
    return F.coalesce(F.startswith(F.btrim(c), F.lit("A:")) & F.contains(c, F.lit("*H:")), F.lit(False))


def qr_type(c: Column) -> Column:
    return F.when(is_invoice_qr(c), F.lit("portuguese_invoice")).when(F.btrim(c).rlike(r"(?i)^(?:https?://|www\.)"), F.lit("url")).otherwise(F.lit("unknown"))


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def qr_fields(c: Column) -> Column:
    """Map of ``KEY:value`` parts between stars; the last of equal keys counts."""
    parts = F.filter(F.split(c, r"\*"), lambda p: F.contains(p, F.lit(":")))
    pairs = F.transform(parts, lambda p: F.struct(F.btrim(F.substring_index(p, ":", 1)).alias("k"), F.btrim(F.substring(p, F.instr(p, ":") + 1, F.length(p))).alias("v")))
    last = lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["k"] == p["k"]))
    return bound(pairs, lambda ps: F.map_from_entries(last(ps)))


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def qr_metadata(c: Column, currencies: dict[str, str] | None = None, default_currency: str = "EUR", types: dict[str, str] | None = None) -> Column:
    """struct of the document fields in an invoice QR text; null for other texts."""

    def made(f: Column) -> Column:
        amount = f["O"].try_cast("double")
        return F.struct(
            F.when(F.length(f["F"]) == 8, F.regexp_replace(f["F"], "^(.{4})(.{2})(.{2})$", "$1-$2-$3")).alias("date_issued"),
            _lookup(types or DOCUMENT_TYPES, F.coalesce(f["D"], F.lit(""))).alias("document_type"),
            F.nullif(f["A"], F.lit("")).alias("issuer_tax_number"),
            F.when(amount > 0, amount).alias("total_amount"),
            F.coalesce(_lookup(currencies or CURRENCIES, F.upper(F.coalesce(f["C"], F.lit(DEFAULT_COUNTRY)))), F.lit(default_currency)).alias("total_amount_currency"),
            F.nullif(f["G"], F.lit("")).alias("document_number"),
            F.nullif(f["H"], F.lit("")).alias("atcud"),
        )

    return F.when(is_invoice_qr(c), bound(qr_fields(c), made))


def over(first: Column, second: Column, fields: tuple[str, ...]) -> list[Column]:
    """Fields of two structs, those of the first before those of the second."""
    return [F.coalesce(first[f], second[f]).alias(f) for f in fields]
