"""Document records (JSON), read as text first and typed by validators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.amounts import currency_code, plain_amount, sidecar_amount
from ..functions.dates import iso_date
from ..functions.text import UNKNOWN, enum_value, or_unknown, raw_or_unknown
from .files import is_internal

QR = "struct<qr_type: string, raw_content: string, page_number: int, confidence: double>"
PART = f"struct<date_issued: string, document_type: string, total_amount: string, total_amount_currency: string, issuer_tax_number: string, issuing_party: string, issuing_party_raw: string, document_number: string, atcud: string, locale: string, qrcode: {QR}>"
STATEMENT = "struct<bank_format: string, account_number: string, currency: string, period_start: string, period_end: string, transaction_count: int>"
SCALARS = (
    "class_confidence",
    "class_reasoning",
    "date_created",
    "date_issued",
    "date_updated",
    "document_type",
    "issuing_party",
    "total_amount",
    "total_amount_currency",
    "hash_content",
    "hash_file",
    "hash_text",
    "document_type_raw",
    "document_title",
    "issuing_party_raw",
    "page_count",
    "file_size_kb",
    "issuer_tax_number",
    "locale",
    "source_extension",
    "source_filename",
)
SCHEMA = ", ".join(f"{s} string" for s in SCALARS) + f", qrcode {QR}, bank_statement {STATEMENT}, sub_documents array<{PART}>, _corrupt_record string"


def read_raw(spark: SparkSession, root: str) -> DataFrame:
    """All records below a folder, scalars as text; internal and reconciliation files are left out."""
    raw = spark.read.schema(SCHEMA).option("multiLine", "true").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(root)
    raw = raw.withColumn("path", F.col("_metadata.file_path"))
    return raw.filter(~is_internal(F.col("path")) & ~F.col("path").rlike(r"(?i)(?:reconciliation|groundtruth)[^/]*\.json$"))


def has_key(raw_json: Column, key: str) -> Column:
    """Whether a key is there at all, be it null."""
    return F.array_contains(F.json_object_keys(raw_json), key)


def amount(c: Column) -> Column:
    """Numbers as they are; number text with a comma by the rule of records."""
    return F.when(F.contains(c, F.lit(",")), sidecar_amount(c)).otherwise(plain_amount(c))


def validated(raw: DataFrame, today: str | None = None) -> DataFrame:
    """Typed records; unreadable ones, those without required values and those dated in the future go."""
    date = F.coalesce(F.nullif(F.btrim("date_issued"), F.lit("")), F.lit(UNKNOWN))
    now = F.current_date() if today is None else F.lit(today).cast("date")
    d = raw.filter("_corrupt_record IS NULL").drop("_corrupt_record").filter(plain_amount(F.col("class_confidence")).isNotNull() & F.col("hash_content").isNotNull())
    d = d.filter(~F.coalesce(iso_date(F.col("date_issued")) > now, F.lit(False)))
    return d.withColumns(
        {
            "class_confidence": plain_amount(F.col("class_confidence")),
            "date_issued": date,
            "document_type": or_unknown(enum_value(F.col("document_type"), "DocumentType")),
            "issuing_party": or_unknown(enum_value(F.col("issuing_party"), "IssuingParty")),
            "document_type_raw": raw_or_unknown(F.col("document_type_raw")),
            "issuing_party_raw": raw_or_unknown(F.col("issuing_party_raw")),
            "total_amount": amount(F.col("total_amount")),
            "total_amount_currency": currency_code(F.col("total_amount_currency")),
            "page_count": F.col("page_count").try_cast("int"),
            "file_size_kb": F.col("file_size_kb").try_cast("int"),
            "sub_documents": F.transform("sub_documents", lambda s: s.withField("total_amount", amount(s["total_amount"])).withField("total_amount_currency", currency_code(s["total_amount_currency"]))),
        }
    )


def read(spark: SparkSession, root: str, today: str | None = None) -> DataFrame:
    return validated(read_raw(spark, root), today)


def write(docs: DataFrame, path: str) -> None:
    """One JSON line a record, keys in order."""
    columns = sorted(docs.columns)
    docs.select(F.to_json(F.struct(*columns)).alias("value")).write.mode("overwrite").text(path)


def read_groundtruth(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Approvals of ground-truth files with defaults for what is absent."""
    document = "struct<file_name: string, hash_file: string, hash_content: string, filename: string>"
    key = "struct<date: string, description_normalized: string, amount: string, currency: string, occurrence: int, description: string>"
    schema = f"schema_version int, source string, updated string, approvals array<struct<confirmed_at: string, transaction: {key}, required_documents: array<{document}>>>, rejections array<struct<confirmed_at: string, transaction: {key}>>"
    raw = spark.read.schema(schema).option("multiLine", "true").json(paths)
    none = F.array().cast(f"array<struct<confirmed_at: string, transaction: {key}, required_documents: array<{document}>>>")
    return raw.withColumns({"schema_version": F.coalesce("schema_version", F.lit(1)), "approvals": F.coalesce("approvals", none)})
