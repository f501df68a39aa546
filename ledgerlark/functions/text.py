"""Text folds and keys as Column expressions.

Spark has no Unicode normalisation, so the folds are ``translate`` maps made
from ``unicodedata``: every character of the Latin, Greek and Cyrillic blocks
whose decomposition is one base character plus marks.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a field that is known to be unknown, which is not null.
UNKNOWN = "$UNKNOWN$"


@cache
def _fold_map(form: str) -> tuple[str, str]:
    src, dst = [], []
    for c in map(chr, [*range(0x80, 0x2100), *range(0x1E00, 0x2000), *range(0xFF01, 0xFF5F)]):
        base = "".join(x for x in unicodedata.normalize(form, c) if unicodedata.category(x) != "Mn")
        if len(base) == 1 and base != c and c not in src:
            src.append(c)
            dst.append(base)
    return "".join(src), "".join(dst)


def _folded(c: Column, form: str) -> Column:
    return F.regexp_replace(F.translate(c, *_fold_map(form)), r"\p{Mn}+", "")


def strip_diacritics(c: Column) -> Column:
    """Accents go, letters such as ø and ß stay."""
    return _folded(c, "NFD")


def ascii_fold(c: Column) -> Column:
    """Compatibility forms and accents folded, then all that is not ASCII dropped."""
    return F.regexp_replace(_folded(c, "NFKD"), r"[^\x00-\x7F]+", "")


def compact_key(c: Column) -> Column:
    """Lower-cased letters and digits only; an empty string for null."""
    return F.regexp_replace(F.lower(strip_diacritics(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{N}]+", "")


def slug(c: Column) -> Column:
    """a-z, 0-9 and single dashes."""
    return F.btrim(F.regexp_replace(F.lower(strip_diacritics(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "-"), F.lit("-"))


def subject_slug(c: Column, most: int = 80) -> Column:
    cut = F.btrim(F.substring(F.btrim(F.regexp_replace(F.lower(ascii_fold(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "-"), F.lit("-")), 1, most), F.lit("-"))
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("no-subject"))


def hash_text(c: Column) -> Column:
    """What a text hash covers: lower-case ASCII without white space."""
    return F.regexp_replace(ascii_fold(F.lower(c)), r"\s+", "")


def short_hash(c: Column) -> Column:
    """First eight hex digits of SHA-256."""
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 8)


def description_key(c: Column) -> Column:
    """Folded, case-folded, white space squeezed."""
    low = F.replace(F.lower(_folded(F.coalesce(c, F.lit("")), "NFKD")), F.lit("ß"), F.lit("ss"))
    return F.btrim(F.regexp_replace(low, r"\s+", " "))


def enum_value(c: Column, prefix: str) -> Column:
    """``Prefix.value`` as ``value``, anything else trimmed."""
    t = F.btrim(c)
    return F.when(F.startswith(t, F.lit(prefix + ".")), F.substring(t, len(prefix) + 2, 1 << 30)).otherwise(t)


def or_unknown(c: Column) -> Column:
    """Blank and null become the unknown marker."""
    return F.coalesce(F.nullif(F.btrim(c), F.lit("")), F.lit(UNKNOWN))


def raw_or_unknown(c: Column) -> Column:
    """Null stays null, blank becomes the unknown marker."""
    return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(or_unknown(c))


def label(c: Column, fallback: str) -> Column:
    return F.coalesce(F.nullif(F.nullif(F.btrim(c), F.lit("")), F.lit(UNKNOWN)), F.lit(fallback))


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"))


def json_digest(c: Column) -> Column:
    return F.sha2(F.to_json(c), 256)


#: Legal forms at the end of a company name.
LEGAL_SUFFIXES = ("inc", "incorporated", "ltd", "limited", "llc", "llp", "plc", "corp", "corporation", "company", "co", "sa", "lda", "pbc")


def company_key(c: Column, suffixes: tuple[str, ...] = LEGAL_SUFFIXES) -> Column:
    """Folded words without trailing legal forms, then without trailing ``s a``; in this order."""
    words = F.btrim(F.regexp_replace(F.lower(ascii_fold(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", " "))
    bare = F.regexp_replace(F.concat(F.lit(" "), words), f"( (?:{'|'.join(suffixes)}))+$", "")
    return F.btrim(F.regexp_replace(bare, "( s a)+$", ""))


def company_slug(c: Column, suffixes: tuple[str, ...] = LEGAL_SUFFIXES) -> Column:
    return F.coalesce(F.nullif(F.replace(company_key(c, suffixes), F.lit(" "), F.lit("-")), F.lit("")), F.lit(UNKNOWN))


def glob_matches(c: Column, pattern: str) -> Column:
    """A pattern with regex syntax is searched for, one with ``*`` or ``?`` matches whole, else a substring counts."""
    if any(x in pattern for x in "^$[]()|+\\"):
        return c.rlike(pattern)
    if "*" in pattern or "?" in pattern:
        body = "".join(".*" if x == "*" else "." if x == "?" else "\\Q" + x + "\\E" for x in pattern)
        return c.rlike(f"(?s)^{body}$")
    return F.contains(c, F.lit(pattern))
