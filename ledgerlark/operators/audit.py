"""Audit reports over document records, one pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import iso_date
from ..functions.text import UNKNOWN

#: Fields of the unknown report, critical fields, and confidence bucket edges.
FIELDS = ("document_type", "issuing_party", "date_issued")
CRITICAL = ("hash_content", "hash_file", "hash_text", "date_issued", "document_type", "issuing_party", "document_title", "class_confidence", "page_count", "file_size_kb")
BUCKETS = (0.0, 0.5, 0.6, 0.7, 0.8, 0.9, 1.01)


def unknown_counts(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """How many records have the unknown marker, by field and in any; null is not unknown."""
    is_unknown = lambda f: F.coalesce(F.col(f) == UNKNOWN, F.lit(False))
    some = F.lit(False)
    for f in fields:
        some = some | is_unknown(f)
    one = docs.agg(*[F.count_if(is_unknown(f)).alias(f) for f in fields], F.count_if(some).alias("any"))
    return one.unpivot([], [*fields, "any"], "field", "n")


def cross_top(docs: DataFrame, where: Column, by: str, most: int = 10) -> DataFrame:
    return docs.filter(where).groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col(by).asc_nulls_last()).limit(most)


def confidence_histogram(docs: DataFrame, column: str = "class_confidence", edges: tuple[float, ...] = BUCKETS) -> DataFrame:
    """Counts in half-open buckets [low, high)."""
    pairs = list(zip(edges[:-1], edges[1:], strict=True))
    counted = docs.agg(*[F.count_if((F.col(column) >= a) & (F.col(column) < b)).alias(f"b{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"), F.col(f"b{i}").alias("n")) for i, (a, b) in enumerate(pairs)]))
    return counted.select(rows.alias("r")).select("r.*")


def lowest_confidence(docs: DataFrame, column: str = "class_confidence", key: str = "path", below: float = 0.6, most: int = 20) -> DataFrame:
    return docs.filter(F.col(column) < below).orderBy(column, key).limit(most).select(key, column)


def missing_counts(docs: DataFrame, fields: tuple[str, ...] = CRITICAL) -> DataFrame:
    """Fields that are null in some records, with how many."""
    return docs.agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in fields]).unpivot([], list(fields), "field", "n").filter("n > 0")


def distribution(docs: DataFrame, field: str, most: int = 25) -> DataFrame:
    """Most frequent values with their percentage of all records; ties by value."""
    total = docs.agg(F.count("*").alias("total"))
    top = docs.filter(F.col(field) != "").groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(most)
    return top.crossJoin(F.broadcast(total)).select("value", "n", F.round(F.col("n") * 100 / F.col("total"), 1).alias("percent"))  # one row


def year_counts(docs: DataFrame, field: str = "date_issued") -> DataFrame:
    """Records by year; a date that is none counts as ``invalid``."""
    year = F.when(iso_date(F.col(field)).isNotNull(), F.substring(field, 1, 4)).otherwise("invalid")
    return docs.groupBy(year.alias("year")).agg(F.count("*").alias("n"))


def duplicate_hash_counts(docs: DataFrame, hashes: tuple[str, ...] = ("hash_file", "hash_content")) -> DataFrame:
    """How many values of each hash occur more than once."""
    long = docs.select(F.explode(F.array(*[F.struct(F.lit(h).alias("field"), F.col(h).alias("value")) for h in hashes])).alias("h")).select("h.*").filter("value IS NOT NULL")
    return long.groupBy("field", "value").agg(F.count("*").alias("c")).groupBy("field").agg(F.count_if(F.col("c") > 1).alias("n"))


def amounts(docs: DataFrame, amount: str = "total_amount", currency: str = "total_amount_currency") -> DataFrame:
    return docs.filter(F.col(amount).isNotNull()).groupBy(currency).agg(F.count("*").alias("n"), F.min(amount).alias("least"), F.max(amount).alias("most"))


def qr_coverage(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count_if(F.col("qrcode").isNotNull()).alias("with_qr"), F.count_if(F.size("sub_documents") > 0).alias("with_parts"), F.count("*").alias("total"))


def totals(docs: DataFrame) -> DataFrame:
    known = F.lit(True)
    for f in FIELDS:
        known = known & F.coalesce(F.col(f) != UNKNOWN, F.lit(False))
    return docs.agg(F.count("*").alias("total"), F.count_if(known).alias("complete"), F.count_if(F.col("total_amount").isNotNull()).alias("with_amount"))


def integrity(docs: DataFrame, files: DataFrame) -> DataFrame:
    """First fault of each record against its file: missing, file hash, content hash; else ok."""
    f = files.select("path", F.col("hash_file").alias("__file"), F.col("hash_content").alias("__content"))
    fault = F.when(F.col("__file").isNull(), "missing file").when(F.coalesce(F.col("hash_file") != F.col("__file"), F.lit(False)), "file hash differs").when(F.coalesce(F.col("hash_content") != F.col("__content"), F.lit(False)), "content hash differs").otherwise("ok")
    return docs.join(f, "path", "left").select("path", fault.alias("fault"))


def long_names(docs: DataFrame, name: str = "file_name", most: int = 120) -> DataFrame:
    return docs.withColumn("name_length", F.length(name)).filter(F.col("name_length") > most)


def merged_pages_ok(parts: DataFrame, merged: DataFrame) -> DataFrame:
    """Whether each merged file has as many pages as its parts."""
    want = parts.groupBy("merged").agg(F.sum("pages").alias("expected"))
    return merged.join(want, "merged", "left").select("merged", "pages", "expected", (F.col("pages") == F.coalesce("expected", F.lit(0))).alias("ok"))


def known_values(docs: DataFrame, field: str) -> DataFrame:
    """Distinct known values of a field."""
    return docs.select(F.btrim(field).alias("value")).filter((F.col("value") != UNKNOWN) & (F.col("value") != "")).distinct()


def canonical(docs: DataFrame, field: str, registry: DataFrame) -> DataFrame:
    """``field`` spelt as in the registry, whatever its case; the first spelling by code point counts."""
    r = registry.groupBy(F.lower("value").alias("__low")).agg(F.min("value").alias("__value"))
    return docs.withColumn("__low", F.lower(F.btrim(field))).join(r, "__low", "left").withColumn(field, F.coalesce("__value", F.col(field))).drop("__low", "__value")


def ingest_totals(results: DataFrame, known_issuers: DataFrame) -> DataFrame:
    """Processed, duplicates and failures, and the number of issuers not known before."""
    counts = results.agg(F.count_if(F.col("outcome") == "processed").alias("processed"), F.count_if(F.col("outcome") == "duplicate").alias("duplicates"), F.count_if(F.col("outcome") == "failed").alias("failed"))
    new = results.filter("outcome = 'processed'").select("issuing_party").distinct().join(known_issuers.select("issuing_party"), "issuing_party", "left_anti").agg(F.count("*").alias("new_issuers"))
    return counts.crossJoin(F.broadcast(new))  # one row each
