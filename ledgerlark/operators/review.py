"""What the review screens show: queues, searches and monthly snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_key
from .bands import first_by


def match_status(method: Column, confidence: Column, errors: Column) -> Column:
    """incomplete, exact, llm_high or llm_low."""
    return F.when(F.size(errors) > 0, "incomplete").when(method != "llm", "exact").when(confidence >= 0.8, "llm_high").otherwise("llm_low")


def review_queue(rows: DataFrame, month: str | None = None, status: str = "open") -> DataFrame:
    q = rows.filter(F.col("status") == status) if status != "all" else rows
    return q.filter(F.startswith("date", F.lit(month))) if month else q


def transaction_search(rows: DataFrame, query: str = "", month: str | None = None, bank: str | None = None) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "date", "description", F.col("amount").cast("string"), "category"))
    q = rows.filter(F.contains(text, F.lower(F.lit(query)))) if query else rows
    q = q.filter(F.startswith("date", F.lit(month))) if month else q
    return q.filter(F.col("bank") == bank) if bank else q


def document_search(docs: DataFrame, query: str = "", month: str | None = None, kind: str | None = None, fields: tuple[str, ...] = ("document_title", "issuing_party", "document_type")) -> DataFrame:
    """Every term of the query must occur; newest first."""
    text = F.lower(F.concat_ws(" ", *fields))
    q = docs
    for term in query.lower().split():
        q = q.filter(F.contains(text, F.lit(term)))
    q = q.filter(F.startswith("date_issued", F.lit(month))) if month else q
    q = q.filter(F.col("document_type") == kind) if kind else q
    return q.orderBy(F.col("date_issued").desc_nulls_last(), F.col("path").desc())


def totals_agree(rows: DataFrame) -> DataFrame:
    """Sum of a row's linked amounts against its own, to half a cent."""
    return rows.withColumn("linked_total", F.aggregate("amounts", F.lit(0.0), lambda a, x: a + x)).withColumn("agrees", F.abs(F.col("linked_total") - F.abs("amount")) < 0.005)


def cards(docs: DataFrame) -> DataFrame:
    """One card a file hash, from the processed folder if it is there, else from exports by path."""
    return first_by(docs, ["hash_file"], [F.when(F.col("origin") == "processed", 0).otherwise(1), F.col("path")])


def snapshot_months(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Months of documents and rows, newest first, with how many of each."""
    d = docs.select(month_key(F.col("date_issued")).alias("month"), F.lit(1).alias("documents"), F.lit(0).alias("rows"))
    r = rows.select(month_key(F.col("date")).alias("month"), F.lit(0).alias("documents"), F.lit(1).alias("rows"))
    return d.unionByName(r).filter("month IS NOT NULL").groupBy("month").agg(F.sum("documents").alias("documents"), F.sum("rows").alias("rows")).orderBy(F.desc("month"))


def referenced_files(matches: DataFrame) -> DataFrame:
    return matches.select(F.explode("files").alias("file_name")).distinct()


def found_elsewhere(referenced: DataFrame, here: DataFrame, everywhere: DataFrame) -> DataFrame:
    """Referenced files that the folder lacks, with their first path anywhere."""
    lost = referenced.join(here.select("file_name"), "file_name", "left_anti")
    return first_by(lost.join(everywhere, "file_name"), ["file_name"], [F.col("path")])
