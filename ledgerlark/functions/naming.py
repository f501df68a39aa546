"""File names from document fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import UNKNOWN, ascii_fold


def component(c: Column) -> Column:
    """ASCII without characters that file systems refuse, brackets and commas; blanks squeezed."""
    return F.regexp_replace(F.btrim(F.regexp_replace(ascii_fold(c), r'[\\/*?:"<>|()\[\],]', "")), r"\s+", " ")


def trimmed(c: Column, most: int) -> Column:
    """At most so many characters, cut at a word where there is one."""
    cut = F.substring(c, 1, most)
    whole = F.regexp_extract(cut, r"(?s)^(.*) ", 1)
    return F.when(F.length(c) <= most, c).otherwise(F.coalesce(F.nullif(whole, F.lit("")), cut))


def truncated(c: Column, most: int) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.regexp_replace(F.substring(c, 1, most), r"[ \-_.]+$", ""))


def money(c: Column, currency: Column) -> Column:
    whole = c == F.floor(c)
    text = F.when(whole, F.format_string("%.0f", c)).otherwise(F.format_string("%.2f", c))
    return F.when(c.isNotNull(), F.concat_ws(" ", text, currency))


def file_name(date: Column, kind: Column, party: Column, title: Column, amount: Column, currency: Column, digest: Column, most: int = 60, extension: Column | None = None) -> Column:
    """``date - type - party - title - amount - hash.ext``, lower-case; a missing title or amount is left out.

    The three first are always there, be it as the unknown marker.
    """
    first = [component(F.coalesce(c, F.lit(UNKNOWN))) for c in (date, kind, party)]
    name = F.when(F.coalesce(title, F.lit("")) != "", trimmed(component(title), most))
    return F.lower(F.concat_ws(" - ", *first, name, component(money(amount, currency)), F.concat(digest, F.lit(".pdf") if extension is None else extension)))


def from_fields(fields: list[Column], digest: Column, most: int = 60) -> Column:
    parts = [F.nullif(trimmed(component(c.cast("string")), most), F.lit("")) for c in fields]
    return F.concat_ws(" - ", *parts, digest)


def _short(c: Column, most: Column) -> Column:
    """The first ``most`` characters without trailing separators, unless nothing else is left."""
    cut = F.substring(c, F.lit(1), most.cast("int"))
    return F.when(F.length(c) <= most, c).otherwise(F.coalesce(F.nullif(F.regexp_replace(cut, r"[ \-_.]+$", ""), F.lit("")), cut))


def fitted(name: Column, most: int, extension: str = ".pdf") -> Column:
    """A PDF name brought to ``most`` characters, others as they are.

    Of ``a - b - c - ... - z`` the first three parts and the last stay; the third
    shrinks first, then the second, each to one character at least, then the
    first.  A name of fewer than four parts is cut at the end.
    """
    stem = F.substring(name, F.lit(1), F.length(name) - len(extension))
    parts = F.split(stem, " - ")
    few = F.concat(_short(stem, F.lit(most - len(extension))), F.lit(extension))
    p = [F.get(parts, F.lit(i)) for i in range(3)] + [F.element_at(parts, -1)]
    for i in (2, 1, 0):
        over = F.length(F.concat_ws(" - ", *p)) + len(extension) - most
        p[i] = F.when(over > 0, _short(p[i], F.greatest(F.length(p[i]) - over, F.lit(1)))).otherwise(p[i])
    fits = ~F.lower(name).endswith(extension) | (F.length(name) <= most)
    return F.when(fits, name).when(F.size(parts) < 4, few).otherwise(F.concat(F.concat_ws(" - ", *p), F.lit(extension)))
