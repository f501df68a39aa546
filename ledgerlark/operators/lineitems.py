"""Line items from the lines of page texts; markers and windows come from settings.

``pages`` is an array of page texts.  Look-behind and look-ahead are array
slices, so a document is one row and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import amount_line, currency_line, stamp_duty_pair
from ..functions.dates import any_date, bank_date, business_days_after, partial_date
from ..functions.text import ascii_fold
from .matching import LINE_ITEM


def lines_of(pages: Column) -> Column:
    return F.flatten(F.transform(pages, lambda p: F.filter(F.transform(F.split(p, r"\r?\n"), lambda x: F.btrim(x)), lambda x: x != "")))


def folded(line: Column) -> Column:
    return F.upper(ascii_fold(line))


def amounts_near(lines: Column, i: Column, before: int, after: int) -> Column:
    """Amounts on the lines from ``before`` above to ``after`` below."""
    start = F.greatest(i - before, F.lit(0))
    return F.filter(F.transform(F.slice(lines, (start + 1).cast("int"), (i + after - start + 1).cast("int")), amount_line), lambda a: a.isNotNull())


def next_amount(lines: Column, i: Column, after: int) -> Column:
    return F.get(F.filter(F.transform(F.slice(lines, (i + 2).cast("int"), after), amount_line), lambda a: a.isNotNull()), F.lit(0))


def previous_amount(lines: Column, i: Column, before: int) -> Column:
    start = F.greatest(i - before, F.lit(0))
    found = F.filter(F.transform(F.slice(lines, (start + 1).cast("int"), (i - start).cast("int")), amount_line), lambda a: a.isNotNull())
    return F.element_at(F.concat(F.array(F.lit(None).cast("double")), found), -1)


def amounts_between(lines: Column, start: Column, end: Column, default: str | None = None) -> Column:
    """array<struct<amount, currency>> of the lines strictly between two places.

    A bare amount takes the stand-alone currency line of its number, else the
    first one, else ``default``.
    """
    part = F.slice(lines, (start + 2).cast("int"), F.greatest(end - start - 1, F.lit(0)).cast("int"))
    alone = F.filter(F.transform(part, lambda x: F.btrim(x)), lambda x: x.rlike("^[A-Z]{3}$"))
    found = F.filter(F.transform(part, currency_line), lambda a: a["amount"].isNotNull())
    return F.transform(found, lambda a, k: F.struct(a["amount"].alias("amount"), F.coalesce(a["currency"], F.get(alone, k), F.get(alone, F.lit(0)), F.lit(default).cast("string")).alias("currency")))


def page_date(text: Column, fallback: Column) -> Column:
    """The first ``dd/mm/20yy`` or ``dd-mm-20yy`` of a text if it is a date, else the fallback."""
    return F.coalesce(bank_date(F.regexp_extract(text, r"\b(\d{2}[/-]\d{2}[/-]20\d{2})\b", 1)), fallback)


def item(category, label, amount, currency=None, date=None, reference=None, required: bool = True, kind: str | None = None) -> Column:
    as_col = lambda c: c if isinstance(c, Column) else F.lit(c)
    return F.struct(
        as_col(category).alias("category"),
        as_col(label).alias("label"),
        amount.cast("double").alias("amount"),
        as_col(currency).cast("string").alias("currency"),
        as_col(date).cast("string").alias("date"),
        as_col(reference).cast("string").alias("reference"),
        F.lit(required).alias("amount_required"),
        F.lit(kind).cast("string").alias("document_type"),
    )


def marked_amounts(lines: Column, date: Column, markers: dict[str, str], after: int = 6, currency: str = "EUR", kind: str | None = None) -> Column:
    """Items where a marker line is followed by an amount line; markers map text to category."""


    def hits(marker: str, category: str) -> Column:
        return F.transform(lines, lambda x, i: F.when(F.contains(folded(x), F.lit(marker.upper())), item(category, x, next_amount(lines, i, after), currency, date, kind=kind)))

    out = [hits(m, c) for m, c in markers.items()]
    return F.filter(F.flatten(F.array(*out)), lambda x: x.isNotNull() & (x["amount"] > 0))


def fee_invoice(lines: Column, date: Column, cfg: dict) -> Column:
    """Maintenance fees with their stamp duty, two items each, and custody fees.

    Below a maintenance line, two amounts that differ by the duty on the lesser
    are fee and total.  A custody fee is the first amount at a total line below
    its marker; without one, the second small amount below (right under a
    maintenance line), else the last small amount above.
    """
    near = lambda key, usual: int(cfg.get(key, usual))
    says = lambda x, key: F.contains(folded(x), F.lit(cfg.get(key, "").upper()))
    none = F.array().cast(f"array<{LINE_ITEM}>")

    def maintenance(x: Column, i: Column) -> Column:
        pair = stamp_duty_pair(amounts_near(lines, i, 0, near("maintenance_search_after", 25)), cfg.get("stamp_duty_rate", 0.04), cfg.get("max_stamp_duty", 1.0))
        fee = lambda p: item(cfg.get("maintenance_category", "bank-fee-maintenance"), x, F.round(p["base"], 2))
        duty = lambda p: item(cfg.get("stamp_duty_category", "bank-fee-stamp-duty"), F.concat(F.lit("Stamp duty for "), x), p["tax"])
        return F.when(says(x, "maintenance_marker"), F.flatten(F.transform(F.array(pair), lambda p: F.when(p.isNotNull(), F.array(fee(p), duty(p))).otherwise(none)))).otherwise(none)

    def custody(x: Column, i: Column) -> Column:
        small = lambda found: F.filter(found, lambda a: (a > 0) & (a <= float(cfg.get("custody_fallback_max_amount", 100))))
        places = F.transform(F.sequence(F.lit(0), F.lit(near("custody_total_search_after", 20) - 1)), lambda j: i + j)
        totals = F.transform(places, lambda j: F.when(folded(F.get(lines, j)) == cfg.get("total_debit_marker", "").upper(), F.get(amounts_near(lines, j, 0, near("custody_total_amount_after", 3)), F.lit(0))))
        below = small(amounts_near(lines, i, 0, near("custody_fallback_after", 15)))
        above = small(amounts_near(lines, i, near("custody_fallback_before", 15), 0))
        under = (i > 0) & says(F.get(lines, i - 1), "maintenance_marker")
        found = F.coalesce(F.get(F.filter(totals, lambda a: a.isNotNull()), F.lit(0)), F.when(under, F.get(below, F.lit(1))), F.try_element_at(above, F.lit(-1)))
        return F.when(says(x, "custody_marker"), F.array(item(cfg.get("custody_category", "bank-custody-fee"), x, F.round(found, 2)))).otherwise(none)

    every = [F.flatten(F.transform(lines, f)) for key, f in (("maintenance_marker", maintenance), ("custody_marker", custody)) if cfg.get(key)]
    return F.filter(F.concat(*every) if every else none, lambda x: x["amount"] > 0)


def stock_sales(lines: Column, date: Column, cfg: dict) -> Column:
    """Credits in order under a column head, dealt to the sale lines in order; dated by settlement."""
    sales = F.filter(lines, lambda x: F.contains(folded(x), F.lit(cfg["sale_marker"].upper())))
    head = F.array_position(F.transform(lines, lambda x: F.contains(folded(x), F.lit(cfg["credit_marker"].upper()))), True) - 1
    credits = amounts_between(lines, head, F.size(lines), cfg.get("currency", "EUR"))
    settle = F.date_format(business_days_after(date, cfg.get("settlement_days", 2)), "yyyy-MM-dd")
    items = F.transform(sales, lambda s, i: item(cfg.get("category", "stock-sale"), s, F.get(credits, i)["amount"], F.get(credits, i)["currency"], settle, kind="bank-stock-sell"))
    return F.filter(F.when(head >= 0, items).otherwise(F.array().cast(f"array<{LINE_ITEM}>")), lambda x: x["amount"] > 0)


def transfer_lines(lines: Column, date: Column, cfg: dict) -> Column:
    """Lines with a transfer reference, with the nearest amount above and a partial date."""
    pattern = cfg["reference_pattern"]
    hits = F.transform(lines, lambda x, i: F.when(x.rlike(pattern), item("bank-transfer", x, previous_amount(lines, i, cfg.get("before", 6)), cfg.get("currency", "EUR"), F.coalesce(partial_date(x, date), date), F.regexp_extract(x, pattern, 1), kind="bank-transfer")))
    return F.filter(hits, lambda x: x.isNotNull() & (x["amount"] > 0))


def by_patterns(lines: Column, date: Column, cfg: dict) -> Column:
    """One item from regular expressions for amount, date and reference over the whole text."""
    text = F.array_join(lines, "\n")
    pick = lambda k: F.nullif(F.regexp_extract(text, cfg[k], 1), F.lit("")) if k in cfg else F.lit(None).cast("string")
    found = item(cfg["category"], cfg.get("label", cfg["category"]), amount_line(pick("amount_pattern")), cfg.get("currency", "EUR"), F.coalesce(any_date(pick("date_pattern")), date), pick("reference_pattern"), cfg.get("amount_required", True), cfg.get("document_type"))
    return F.filter(F.array(found), lambda x: x["amount"] > 0)


#: Extractors by the name that settings use.
EXTRACTORS = {"fee_invoice": fee_invoice, "stock_sales": stock_sales, "transfer_lines": transfer_lines, "direct_debit": by_patterns, "insurance_notice": by_patterns}


def with_line_items(docs: DataFrame, settings: dict[str, dict]) -> DataFrame:
    """``docs`` (pages, document_type, issuing_party, date_issued) with line_items of all fitting extractors.

    A setting applies to its ``types`` and ``parties``, both non-empty; without
    settings no document has items.  Equal (category, amount, label) count once.
    """
    lines, date, parts = F.col("__lines"), F.col("date_issued"), []
    for cfg in settings.values():
        fits = F.lower("document_type").isin(*cfg.get("types", [])) & F.lower("issuing_party").isin(*[p.lower() for p in cfg.get("parties", [])]) if cfg.get("types") and cfg.get("parties") else F.lit(False)
        if cfg["extractor"] == "marked_amounts":
            found = marked_amounts(lines, date, cfg["markers"], cfg.get("after", 6), cfg.get("currency", "EUR"), cfg.get("document_type"))
        else:
            found = EXTRACTORS[cfg["extractor"]](lines, date, cfg)
        parts.append(F.when(F.coalesce(fits, F.lit(False)), found).otherwise(F.array().cast(f"array<{LINE_ITEM}>")))
    every = F.flatten(F.array(*parts)) if parts else F.array().cast(f"array<{LINE_ITEM}>")
    same = lambda a, b: (a["category"] == b["category"]) & (a["amount"] == b["amount"]) & (a["label"] == b["label"])
    d = docs.withColumn("__lines", lines_of(F.col("pages"))).withColumn("__all", every)
    once = F.filter("__all", lambda x, i: ~F.exists(F.slice(F.col("__all"), 1, i.cast("int")), lambda y: same(x, y)))
    return d.withColumn("line_items", once).drop("__all", "__lines")
