"""Transaction keys, approvals and the regression check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import key_amount
from ..functions.text import description_key

BASE = ["date", "description_normalized", "amount_key", "currency_key"]


def with_keys(txns: DataFrame) -> DataFrame:
    """Adds the base key, ``occurrence`` (number among equal keys of a statement) and ``key_id``."""
    keyed = txns.withColumns(
        {
            "description_normalized": description_key(F.col("description")),
            "amount_key": key_amount(F.col("amount")),
            "currency_key": F.upper(F.btrim(F.coalesce("currency", F.lit("")))),
        }
    )
    n = F.row_number().over(Window.partitionBy("statement", *BASE).orderBy("row"))
    return keyed.withColumn("occurrence", n).withColumn("key_id", key_id())


def key_id() -> Column:
    """Compact JSON with sorted keys."""
    return F.to_json(
        F.struct(F.col("amount_key").alias("amount"), F.col("currency_key").alias("currency"), F.coalesce("date", F.lit("")).alias("date"), "description_normalized", "occurrence"),
        {"ignoreNullFields": "false"},
    )


def upserted(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with the rows of ``new`` in the place of those with equal keys."""
    return table.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def removed(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def same_document(left: DataFrame, right: DataFrame, strict: bool = False) -> DataFrame:
    """Pairs that share the file hash or the content hash, and unless ``strict`` with a hash present, the name.

    Equi-joins united, since an OR would be a nested loop.
    """
    l = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns])  # noqa: E741
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    out = None
    for h in ("hash_file", "hash_content", "file_name"):
        pairs = l.join(r, F.col(f"l_{h}") == F.col(f"r_{h}"))
        if h == "file_name" and strict:
            none = F.col("r_hash_file").isNull() & F.col("r_hash_content").isNull()
            pairs = pairs.filter(none)
        out = pairs if out is None else out.unionByName(pairs)
    return out.distinct()


def sets_match(current: Column, approved: Column, strict: bool = False) -> Column:
    """Whether two arrays of (hash_file, hash_content, file_name) match one to one, in the approved order."""

    def same(a, b):
        hit = F.coalesce(a["hash_file"] == b["hash_file"], F.lit(False)) | F.coalesce(a["hash_content"] == b["hash_content"], F.lit(False))
        name = F.coalesce(a["file_name"] == b["file_name"], F.lit(False))
        return hit | (name & b["hash_file"].isNull() & b["hash_content"].isNull() if strict else name)

    start = F.struct(current.alias("left"), F.lit(True).alias("ok"))

    def step(acc, want):
        at = F.array_position(F.transform(acc["left"], lambda x: same(x, want)), True)
        rest = F.filter(acc["left"], lambda x, i: i + 1 != at)
        return F.struct(F.when(at > 0, rest).otherwise(acc["left"]).alias("left"), (acc["ok"] & (at > 0)).alias("ok"))

    return (F.size(current) == F.size(approved)) & F.aggregate(approved, start, step)["ok"]


def regression(approved: DataFrame, current: DataFrame, strict: bool = False) -> DataFrame:
    """key_id, verdict: missing, extra, changed or same.  Both have key_id and documents."""
    a = approved.groupBy("key_id").agg(F.max_by("documents", "confirmed_at").alias("approved")) if "confirmed_at" in approved.columns else approved.select("key_id", F.col("documents").alias("approved"))
    both = a.join(current.select("key_id", F.col("documents").alias("current")), "key_id", "full_outer")
    verdict = F.when(F.col("current").isNull(), "missing").when(F.col("approved").isNull(), "extra").when(~sets_match(F.col("current"), F.col("approved"), strict), "changed").otherwise("same")
    return both.select("key_id", verdict.alias("verdict"))


def seeded_approvals(approved: DataFrame, matches: DataFrame) -> DataFrame:
    """Clean matches without an approval, as new ones."""
    return matches.filter(F.size("errors") == 0).join(approved.select("key_id"), "key_id", "left_anti").select("key_id", "documents")


def statuses(rows: DataFrame, approvals: DataFrame, rejections: DataFrame) -> DataFrame:
    """``rows`` (key_id, documents) with status: rejected, approved, changed or open."""
    a = approvals.select("key_id", F.col("documents").alias("__approved"))
    r = rejections.select("key_id", F.lit(True).alias("__rejected"))
    both = rows.join(a, "key_id", "left").join(r, "key_id", "left")
    status = F.when(F.col("__rejected"), "rejected").when(F.col("__approved").isNull(), "open").when(sets_match(F.col("documents"), F.col("__approved"), True), "approved").otherwise("changed")
    return both.withColumn("status", status).drop("__approved", "__rejected")


def decided(table: DataFrame, current_revision: str, seen_revision: str, new: DataFrame, keys: list[str]) -> DataFrame:
    """An upsert that refuses to overwrite what the writer has not seen."""
    if current_revision != seen_revision:
        raise ValueError("the decision is based on an older state")
    return upserted(table, new, keys)


def restored(approvals: DataFrame, statements: DataFrame) -> DataFrame:
    """Approvals dealt to rebuilt statements: by hash, else name, else (date, type, issuer)."""
    out, left = None, approvals.withColumn("__id", F.monotonically_increasing_id())
    for keys in (["hash_file"], ["file_name"], ["date_issued", "document_type", "issuing_party"]):
        target = statements.select(*keys, F.col("statement").alias("restored_to")).dropDuplicates(keys)
        hit = left.join(target, keys)
        out = hit.select(*left.columns, "restored_to") if out is None else out.unionByName(hit.select(*left.columns, "restored_to"))
        left = left.join(hit.select("__id"), "__id", "left_anti").select(*left.columns)
    return out.drop("__id")
