"""Resync, backfill, classification and action plans over document records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.qr import is_invoice_qr, over, qr_metadata
from ..functions.text import UNKNOWN, glob_matches
from ..plans import rules

QR_FIELDS = ("date_issued", "document_type", "issuer_tax_number", "total_amount", "total_amount_currency")


def sync_targets(files: DataFrame, records: DataFrame, orphans_only: bool = False, unknown: bool = False, pattern: str | None = None, fields: tuple[str, ...] = ("document_type", "issuing_party", "date_issued")) -> DataFrame:
    """Files to read again: those without a record, of unknown fields, or whose name fits a pattern; by name, last first."""
    orphans = files.join(records.select("path"), "path", "left_anti")
    if orphans_only:
        return orphans.orderBy(F.desc("path"))
    known = files.join(records.select("path", *fields), "path")
    some = F.lit(not unknown and pattern is None)
    if unknown:
        some = some | rules.any_of([F.coalesce(F.col(f) == UNKNOWN, F.lit(False)) for f in fields])
    if pattern:
        some = some | glob_matches(F.regexp_extract("path", r"([^/]*)$", 1), pattern)
    return known.filter(some).select(*files.columns).unionByName(orphans).orderBy(F.desc("path"))


def resync_diff(old: DataFrame, new: DataFrame, fields: tuple[str, ...], name: str = "file_name") -> DataFrame:
    """changed, unchanged, renamed and added records, by path; nulls equal nulls."""
    o = old.select("path", F.struct(*fields).alias("o"), F.col(name).alias("o_name"))
    n = new.select("path", F.struct(*fields).alias("n"), F.col(name).alias("n_name"))
    both = n.join(o, "path", "left")
    state = F.when(F.col("o").isNull(), "added").when(~F.col("o").eqNullSafe(F.col("n")), "changed").when(~F.col("o_name").eqNullSafe(F.col("n_name")), "renamed").otherwise("unchanged")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def backfilled(records: DataFrame, key: str, present: Column, value: Column) -> DataFrame:
    """``value`` where a key is absent; a key that is there, even as null, stays."""
    return records.withColumn(key, F.when(present, F.col(key)).otherwise(value))


def classified_documents(docs: DataFrame, overrides: list[dict] = (), registry: DataFrame | None = None) -> DataFrame:
    """Fields of the QR text before those extracted (struct ``extracted``), then type overrides and the registry.

    A QR text makes the record certain; a field that neither knows is unknown.
    """
    d = docs.withColumn("__qr", qr_metadata(F.col("qr_text")))
    d = d.select("*", *over(F.col("__qr"), F.col("extracted"), QR_FIELDS))
    d = d.withColumns(
        {
            "issuing_party": F.coalesce("extracted.issuing_party", F.lit(UNKNOWN)),
            "document_type": F.coalesce(rules.override_type(F.col("extracted.document_type_raw"), F.col("extracted.document_title"), list(overrides)), "document_type", F.lit(UNKNOWN)),
            "date_issued": F.coalesce("date_issued", F.lit(UNKNOWN)),
            "class_confidence": F.when(F.col("__qr").isNotNull(), 1.0).otherwise(F.col("extracted.class_confidence")),
        }
    ).drop("__qr")
    if registry is not None:
        from .audit import canonical

        d = canonical(d, "issuing_party", registry)
    return d


def sub_documents(qr_texts: Column) -> Column:
    """The invoice QR texts of a document as parts, where there are two or more."""
    parts = F.transform(F.filter(qr_texts, is_invoice_qr), lambda t: qr_metadata(t))
    return F.when(F.size(parts) >= 2, parts)


def suggested_matches(pairs: DataFrame, choose: Callable[[pd.DataFrame], pd.DataFrame] | None, tolerance: float) -> DataFrame:
    """Matches by an outside model: ``choose`` keeps rows of (statement, row, candidate_id, ...).

    Without a model there are none.  A row's choice counts only if the amount of
    one of its documents fits.
    """
    if choose is None:
        return pairs.limit(0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield choose(batch)

    found = pairs.mapInPandas(run, pairs.schema)
    fits = found.filter(F.abs(F.col("abs_amount") - F.col("total_amount")) <= tolerance).select("statement", "row").distinct()
    return found.join(fits, ["statement", "row"], "left_semi")


def move_plan(members: DataFrame, approved: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Where the files of approved groups go: their name below ``folder``, numbered where names meet."""
    from pyspark.sql import Window

    m = members.join(approved.select(*keys).distinct(), keys)
    name = F.regexp_extract(F.col("move").cast("string"), r"([^/]*)$", 1)
    n = F.row_number().over(Window.partitionBy(name).orderBy("move"))
    stem, ext = F.regexp_replace(name, r"\.[^.]+$", ""), F.regexp_extract(name, r"(\.[^.]+)$", 1)
    return m.withColumn("target", F.concat(F.lit(folder + "/"), F.when(n == 1, name).otherwise(F.concat(stem, F.lit("_"), n - 1, ext))))


def review_folder(statements: DataFrame, outputs: DataFrame, approvals: DataFrame) -> DataFrame:
    """Statements with their output and approvals, joined on the file stem."""
    return statements.join(outputs, "stem", "left").join(approvals, "stem", "left")


def approved_documents(approvals: DataFrame) -> DataFrame:
    """Distinct documents of approvals by both hashes."""
    return approvals.select(F.explode("documents").alias("d")).select("d.*").dropDuplicates(["hash_file", "hash_content"])
