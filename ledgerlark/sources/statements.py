"""Bank statements in XLSX files, read with zipfile and ElementTree on the executors.

A format names its header row, columns and account cell.  The first format
whose header fits reads the file; one executor task reads whole files.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.amounts import bank_amount
from ..functions.dates import bank_date

ROWS = "path string, format string, account string, currency string, period_start string, period_end string, row_number int, date_posting string, date_value string, description string, amount string, row_currency string, notes string, treated string"


@dataclass(frozen=True)
class Format:
    """Rows and columns count from 1; ``columns`` maps fields to column numbers."""

    name: str
    header_row: int
    data_row: int
    headers: tuple[str, ...]
    columns: dict[str, int]
    account: tuple[int, int]
    account_pattern: str
    period: tuple[tuple[int, int], tuple[int, int]] | None = None
    currency: str = "EUR"
    untreated: tuple[str, ...] = field(default=("nao", "não", ""))


#: Layouts of two banks' workbooks.
FORMATS = (
    Format(
        "A",
        8,
        9,
        ("data lancamento", "descricao", "montante"),
        {"date_posting": 1, "date_value": 2, "description": 3, "amount": 4, "row_currency": 5, "notes": 6, "treated": 7},
        (2, 3),
        r"^(?P<account>.+?)\s*-\s*(?P<currency>[A-Z]{3})$",
        ((3, 3), (4, 3)),
    ),
    Format(
        "B",
        18,
        19,
        ("data mov", "descricao do movimento", "valor em eur"),
        {"date_posting": 1, "date_value": 2, "description": 3, "amount": 4},
        (7, 3),
        r"(?P<account>[\d\-.]+)\s*\((?P<currency>\w+)\)",
    ),
)

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def cells(content: bytes) -> dict[tuple[int, int], str]:
    """(row, column) -> text of the first sheet."""
    book = zipfile.ZipFile(io.BytesIO(content))
    names = book.namelist()
    shared = []
    if "xl/sharedStrings.xml" in names:
        root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
        shared = ["".join(t.text or "" for t in si.iter(f"{{{NS['m']}}}t")) for si in root.findall("m:si", NS)]
    sheet = sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))[0]
    out = {}
    for c in ElementTree.fromstring(book.read(sheet)).iter(f"{{{NS['m']}}}c"):
        letters, row = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
        column = 0
        for ch in letters:
            column = column * 26 + ord(ch) - 64
        value, inline = c.find("m:v", NS), c.find("m:is", NS)
        if inline is not None:
            out[int(row), column] = "".join(t.text or "" for t in inline.iter(f"{{{NS['m']}}}t"))
        elif value is not None:
            out[int(row), column] = shared[int(value.text)] if c.get("t") == "s" else value.text
    return out


def plain(text: str | None) -> str:
    import unicodedata

    folded = "".join(c for c in unicodedata.normalize("NFD", text or "") if unicodedata.category(c) != "Mn")
    return re.sub(r"[^a-z0-9]+", " ", folded.lower()).strip()


def detected(found: dict[tuple[int, int], str], formats: tuple[Format, ...]) -> Format | None:
    for f in formats:
        heads = {plain(v) for (r, _), v in found.items() if r == f.header_row}
        if all(any(h.startswith(x) for h in heads) for x in f.headers):
            return f
    return None


def day(text: str | None) -> str | None:
    """A cell's day: text as it is, a serial number as a date."""
    if text and re.fullmatch(r"\d{4,6}(\.\d+)?", text):
        return (pd.Timestamp("1899-12-30") + pd.Timedelta(days=int(float(text)))).strftime("%Y-%m-%d")
    return text


def statement_rows(path: str, content: bytes, formats: tuple[Format, ...], strict: bool) -> list[tuple]:
    try:
        found = cells(content)
        f = detected(found, formats)
    except (zipfile.BadZipFile, ElementTree.ParseError, IndexError, KeyError):
        f = None
    if f is None:
        if strict:
            raise ValueError(f"no known statement format: {path}")
        return []
    m = re.search(f.account_pattern, (found.get(f.account) or "").strip())
    account, currency = (m["account"], m["currency"]) if m else (None, f.currency)
    start, end = (day(found.get(p)) for p in f.period) if f.period else (None, None)
    out = []
    for row in range(f.data_row, max((r for r, _ in found), default=0) + 1):
        v = {k: found.get((row, c)) for k, c in f.columns.items()}
        if not (v["amount"] or "").strip() or plain(v.get("treated")) not in {plain(x) for x in f.untreated}:
            continue
        out.append((path, f.name, account, currency, start, end, row, day(v["date_posting"]), day(v["date_value"]), v["description"], v["amount"], v.get("row_currency") or currency, v.get("notes"), v.get("treated")))
    return out


def read_rows(spark: SparkSession, root: str, formats: tuple[Format, ...] = FORMATS, strict: bool = False) -> DataFrame:
    """Transactions of all workbooks below a folder; unknown formats give none, or fail if ``strict``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xlsx").load(root).select("path", "content")
    names = [x.split()[0] for x in ROWS.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame(statement_rows(path, content, formats, strict), columns=names)

    raw = files.mapInPandas(rows, ROWS)
    typed = {c: bank_date(F.col(c)) for c in ("date_posting", "date_value", "period_start", "period_end")}
    return raw.withColumns(typed | {"amount": bank_amount(F.col("amount"))}).filter("amount IS NOT NULL")


def statement_records(rows: DataFrame) -> DataFrame:
    """One record a workbook, with confidence 1.0; a period that the file lacks is that of its rows."""
    first = lambda c: F.coalesce(F.first(c, ignorenulls=True))
    g = rows.groupBy("path").agg(
        F.first("format").alias("bank_format"),
        first("account").alias("account_number"),
        first("currency").alias("currency"),
        F.coalesce(F.first("period_start", ignorenulls=True), F.min("date_posting")).alias("period_start"),
        F.coalesce(F.first("period_end", ignorenulls=True), F.max("date_posting")).alias("period_end"),
        F.count("*").cast("int").alias("transaction_count"),
    )
    fields = [c for c in g.columns if c != "path"]
    return g.select("path", F.lit("bank-statement").alias("document_type"), F.lit(1.0).alias("class_confidence"), F.col("period_end").alias("date_issued"), F.struct(*fields).alias("bank_statement"))


def transactions(rows: DataFrame) -> DataFrame:
    """Rows as the matching stages take them."""
    return rows.select(F.col("path").alias("statement"), F.col("row_number").alias("row"), F.coalesce("date_posting", "date_value").alias("date"), "description", "amount", F.coalesce("row_currency", "currency").alias("currency"), F.lit(None).cast("string").alias("party"))
