"""Month exports: which documents, under which names, and what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_key
from ..functions.naming import fitted
from ..functions.text import UNKNOWN, glob_matches
from ..scratch import saved
from .bands import first_by
from .dedup import table_digest

COLUMNS = ("date_issued", "document_type", "issuing_party", "document_title", "total_amount", "total_amount_currency")


def dedup_key() -> Column:
    """A statement's account and period, else the content hash; null never is a duplicate."""
    b = F.col("bank_statement")
    statement = F.when(b.isNotNull(), F.concat_ws("|", F.lit("statement"), b["bank_format"], b["account_number"], b["period_start"], b["period_end"]))
    return F.coalesce(statement, F.concat(F.lit("content|"), F.col("hash_content")))


def first_of_each(docs: DataFrame, key: str, path: str = "path") -> DataFrame:
    """The first path of each key; rows without a key all stay."""
    return first_by(docs.filter(F.col(key).isNotNull()), [key], [F.col(path)]).unionByName(docs.filter(F.col(key).isNull()))


def monthly(docs: DataFrame, name: Column, prefix: Column, pattern: str | None = None, most: int = 120) -> DataFrame:
    """Documents to export with export_month and export_name."""
    d = docs.withColumns({"export_month": month_key(F.col("date_issued")), "__key": dedup_key()}).filter("export_month IS NOT NULL")
    if pattern:
        d = d.filter(glob_matches(F.col("file_name"), pattern))
    return first_of_each(d, "__key").drop("__key").withColumn("export_name", fitted(F.concat(prefix, name), most))


def write_months(export: DataFrame, path: str) -> None:
    """Partitioned by month; a month that is exported again replaces the old one."""
    export.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("export_month").parquet(path)


def months(docs: DataFrame) -> DataFrame:
    return docs.select(month_key(F.col("date_issued")).alias("month")).filter("month IS NOT NULL").distinct().orderBy(F.desc("month"))


def sheet(docs: DataFrame) -> DataFrame:
    """Fixed columns first, then the others; year, month and name length; newest first."""
    extra = [c for c in docs.columns if c not in COLUMNS]
    d = docs.select(*COLUMNS, *extra)
    date = F.col("date_issued")
    return d.withColumns({"year": F.when(date != UNKNOWN, F.substring(date, 1, 4)), "month": F.when(date != UNKNOWN, F.substring(date, 6, 2)), "filename_length": F.length("file_name")}).orderBy(date.desc_nulls_last())


def changed(rows: DataFrame, name: str, digest: str, stored: str | None) -> bool:
    """Whether a folder's digest differs from the stored one (one row reaches the driver)."""
    return table_digest(rows, name, digest).first()["digest"] != stored


def to_copy(source: DataFrame, target: DataFrame) -> DataFrame:
    """Files that the target lacks or holds in another size or hash."""
    same = target.select("export_name", "size", "hash_file")
    return source.join(same, ["export_name", "size", "hash_file"], "left_anti")


def oversized(files: DataFrame, most_mb: float) -> DataFrame:
    return files.filter(F.col("size") >= most_mb * 1024 * 1024)


def renames(docs: DataFrame, name: Column) -> DataFrame:
    return docs.withColumn("new_name", name).filter(F.col("new_name") != F.col("file_name")).select("path", "file_name", "new_name")


def merge_manifest(files: DataFrame) -> DataFrame:
    """Which files make each merged paper: all, and those of each leading prefix.

    One row a file: merged, position (by name, gapless from 0) and file_name.
    Names are dealt out by ranges and numbered inside them, so no group is collected.
    """
    prefix = F.lower(F.nullif(F.regexp_extract("file_name", r"^([A-Za-z0-9]+)_", 1), F.lit("")))
    both = files.filter("file_name IS NOT NULL").select(F.explode(F.array_compact(F.array(F.lit("all"), prefix))).alias("merged"), "file_name")
    names = both.groupBy("merged", "file_name").agg(F.count("*").alias("n"))
    names = saved(names.repartitionByRange("merged", "file_name").withColumn("part", F.spark_partition_id()), "manifest")
    earlier = Window.partitionBy("merged").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = names.groupBy("merged", "part").agg(F.sum("n").alias("n")).select("merged", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("merged", "part").orderBy("file_name").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    placed = names.join(parts, ["merged", "part"]).withColumn("first", first)
    return placed.select("merged", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("position"), "file_name")


def archived(docs: DataFrame, digests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(last path of each wanted file hash, hashes that were not found)."""
    hit = docs.join(digests, "hash_file").groupBy("hash_file").agg(F.max("path").alias("path"))
    return hit, digests.join(hit, "hash_file", "left_anti")


def statement_key(c: Column) -> Column:
    """Account and period in a statement's file name, without hash and extension."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"\.[^.]+$", ""), r" - [0-9a-fA-F]{8}$", ""))


def readded(approved: DataFrame, exported: DataFrame, processed: DataFrame) -> DataFrame:
    """Processed documents that are approved but missing from an export."""
    lost = approved.join(exported.select("hash_content"), "hash_content", "left_anti").select("hash_content").distinct()
    return first_by(processed.join(lost, "hash_content", "left_semi"), ["hash_content"], [F.col("path")])


def month_window(rows: DataFrame, month: str, column: str = "export_month") -> DataFrame:
    """The month and its neighbours: a partition filter."""
    y, m = map(int, month.split("-"))
    near = [f"{(y * 12 + m - 1 + d) // 12:04d}-{(y * 12 + m - 1 + d) % 12 + 1:02d}" for d in (-1, 0, 1)]
    return rows.filter(F.col(column).isin(*near))


def prior_keys(matches: DataFrame, month: str) -> DataFrame:
    """Names and hash tails of documents in clean matches of earlier months."""
    clean = matches.filter((F.col("export_month") < month) & (F.size("errors") == 0))
    names = clean.select(F.explode("files").alias("file_name"))
    tail = F.lower(F.nullif(F.regexp_extract("file_name", r"(?:^| - )([0-9a-fA-F]{8})(?:\.[^.]+)?$", 1), F.lit("")))
    return names.select(F.explode(F.array_compact(F.array(F.col("file_name"), tail))).alias("prior")).distinct()


def without_prior(cands: DataFrame, prior: DataFrame) -> DataFrame:
    """Candidates whose name, file hash or id no earlier month has used."""
    for c in ("file_name", "hash_file", "candidate_id"):
        cands = cands.join(prior.select(F.col("prior").alias(c)), c, "left_anti")
    return cands


def stale(statements: DataFrame, outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """Statements without an output, or with one older than the newest input of their month."""
    newest = inputs.groupBy("export_month").agg(F.max("modified").alias("newest"))
    s = statements.join(outputs.select("statement", F.col("modified").alias("written")), "statement", "left").join(newest, "export_month", "left")
    return s.filter(F.col("written").isNull() | (F.col("written") < F.col("newest"))).select(*statements.columns)


def supplemental(cands: DataFrame, txns: DataFrame, amounts: DataFrame, tolerance: float, shared_ids: DataFrame) -> DataFrame:
    """Neighbour-month candidates that could matter: dated inside the rows' span, of a needed amount or shared."""
    from .bands import band_join

    span = txns.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).first()
    dated = cands.filter(F.col("date_issued").between(span["lo"], span["hi"]))
    by_amount = band_join(dated.filter("total_amount IS NOT NULL"), amounts, "total_amount", "needed", tolerance, how="left_semi")
    return by_amount.unionByName(dated.join(shared_ids, "candidate_id", "left_semi").join(by_amount.select("candidate_id"), "candidate_id", "left_anti"))
