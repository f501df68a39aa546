"""Fingerprints, duplicate groups and ingest decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_text, short_hash
from ..scratch import saved


def text_hash(pages: Column, least: int = 50) -> Column:
    """Hash of the normalised page texts; null if any page has fewer than ``least`` characters."""
    enough = (F.size(pages) > 0) & F.forall(pages, lambda p: F.length(F.btrim(p)) >= least)
    return F.when(enough, short_hash(hash_text(F.array_join(pages, ""))))


def content_hash(pages: Column) -> Column:
    """Hash over the hashes of the pages: page texts stand in for pixels, which nothing here can render."""
    return short_hash(F.array_join(F.transform(pages, lambda p: F.sha2(p.cast("binary"), 256)), ""))


def page_signatures(pages: Column) -> Column:
    return F.transform(pages, lambda p: F.sha2(F.btrim(p).cast("binary"), 256))


def duplicate_groups(files: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """Files of one content hash, and those without such a group of one text hash: group_kind, group_hash, keep, move.

    The smallest file is kept (ties by path).
    """
    by_content = F.count("*").over(Window.partitionBy("hash_content"))
    tiered = files.withColumn("__n", F.when(F.col("hash_content").isNotNull(), by_content).otherwise(0))
    kind = F.when(F.col("__n") > 1, F.lit("content")).when(F.col("hash_text").isNotNull(), F.lit("text"))
    key = F.when(F.col("__n") > 1, F.col("hash_content")).otherwise(F.col("hash_text"))
    return groups_of(tiered.withColumns({"group_kind": kind, "group_hash": key}).filter("group_kind IS NOT NULL"), ["group_kind", "group_hash"], path, size)


def groups_of(rows: DataFrame, keys: list[str], path: str, size: str) -> DataFrame:
    """Keys of two rows or more: keep, move, n_files and what moving saves.

    The aggregates are pre-aggregated on the map side, so a key of many copies
    is no hot task; :func:`duplicate_members` lists members without collecting.
    """
    g = rows.groupBy(*keys).agg(F.count("*").alias("n_files"), F.min(F.struct(F.col(size), F.col(path))).alias("least"), F.sum(size).alias("bytes"))
    return g.filter("n_files >= 2").select(*keys, "n_files", F.col(f"least.{path}").alias("keep"), (F.col("bytes") - F.col(f"least.{size}")).alias("bytes_saved"))


def duplicate_members(rows: DataFrame, groups: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Rows to move: members of a group other than the one that is kept."""
    return rows.join(groups.select(*keys, "keep"), keys).filter(F.col(path) != F.col("keep")).select(*keys, F.col(path).alias("move"), "keep")


def plan_totals(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum(F.col("n_files") - 1), F.lit(0)).alias("n_move"), F.coalesce(F.sum("bytes_saved"), F.lit(0)).alias("bytes_saved"))


def cached(rows: DataFrame, cache: DataFrame, key: str, value: str, compute: Column) -> DataFrame:
    """``value`` from a cache table by ``key``, computed where it is missing."""
    hit = cache.select(F.col(key), F.col(value).alias("__hit"))
    return rows.join(hit, key, "left").withColumn(value, F.coalesce("__hit", compute)).drop("__hit")


def fresh_only(rows: DataFrame, known: dict[str, DataFrame]) -> DataFrame:
    """Rows of which no hash is known, the cheap hashes first."""
    for column in ("hash_file", "hash_text", "hash_content"):
        if column in known:
            rows = rows.join(known[column].select(column).distinct(), column, "left_anti")
    return rows


HASHES = ("hash_file", "hash_text", "hash_content")


def accepted(rows: DataFrame, order: str = "path", most_rounds: int = 100) -> DataFrame:
    """``rows`` with ``accepted``: no earlier accepted row shares any hash.

    Not the same as the first of each hash: the hashes of a rejected row count
    for nothing.  Each round decides the rows that are first among the open rows
    for all their hashes (accepted) and those that share a hash with an accepted
    one (rejected); rounds follow the longest chain of such rows.
    """
    keys = [F.struct(F.lit(h).alias("kind"), F.col(h).alias("value")) for h in HASHES if h in rows.columns]
    ids = saved(rows.select(F.col(order).alias("id"), F.filter(F.array(*keys), lambda k: k["value"].isNotNull()).alias("keys")), "ingest-keys")
    open_ = ids.select("id", F.explode("keys").alias("key"))
    taken = [ids.filter(F.size("keys") == 0).select("id")]
    for _ in range(most_rounds):
        if open_.isEmpty():
            break
        first = open_.groupBy("key").agg(F.min("id").alias("first"))
        state = open_.join(first, "key").groupBy("id").agg(F.bool_and(F.col("id") == F.col("first")).alias("wins"))
        won = saved(state.filter("wins").select("id"), "ingest-won")
        taken.append(won)
        used = open_.join(won, "id").select("key").distinct()
        lost = open_.join(used, "key").select("id").distinct()
        open_ = saved(open_.join(lost, "id", "left_anti"), "ingest-open")
    else:
        raise RuntimeError("ingest did not settle")
    every = taken[0]
    for t in taken[1:]:
        every = every.unionByName(t)
    return rows.join(every.distinct().select(F.col("id").alias(order), F.lit(True).alias("accepted")), order, "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def splits_in_pages(pages: Column, pattern: str = r"(?i)\b(?:page|página|pag\.?)\s*1\s*(?:/|of|de)\s*1\b") -> Column:
    """Whether a bundle can be split: two pages or more that all say 1 of 1."""
    return (F.size(pages) > 1) & F.forall(pages, lambda p: p.rlike(pattern))


def split_pages(docs: DataFrame, pages: str = "pages") -> DataFrame:
    """One document a page for splittable bundles, others unchanged; adds ``part``."""
    split = docs.filter(splits_in_pages(F.col(pages))).select("*", F.posexplode(pages).alias("part", "__page")).withColumn(pages, F.array("__page")).drop("__page")
    return split.unionByName(docs.filter(~F.coalesce(splits_in_pages(F.col(pages)), F.lit(False))).withColumn("part", F.lit(None).cast("int")))


def ends_with_pages(target: Column, attachment: Column) -> Column:
    """Whether the attachment's page signatures are the target's last ones."""
    n = F.size(attachment)
    return (n > 0) & (F.size(target) >= n) & (F.slice(target, F.size(target) - n + 1, n) == attachment)


def table_digest(rows: DataFrame, name: str, digest: str) -> DataFrame:
    """First 16 hex digits over the sorted ``name:hash`` lines."""
    line = F.concat_ws(":", name, digest)
    return rows.agg(F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256), 1, 16).alias("digest"))


def bucketed_digest(rows: DataFrame, name: str, digest: str, digits: int = 4) -> DataFrame:
    """Digest of a table of any size, in another form than :func:`table_digest`.

    A line is ``name:hash:n`` of n equal rows.  Lines go to buckets by the first
    ``digits`` hex digits of the MD5 of the line without n; a bucket's digest is
    the SHA-256 of its sorted lines, and the result the first 16 hex digits of
    the SHA-256 of the ``bucket:digest`` lines in bucket order.  Both join lines
    by a line feed.
    """
    lines = rows.groupBy(F.concat_ws(":", name, digest).alias("line")).agg(F.count("*").alias("n"))
    joined = lambda c: F.sha2(F.array_join(c, "\n"), 256)
    line = F.concat_ws(":", "line", F.col("n").cast("string"))
    each = lines.groupBy(F.substring(F.md5("line"), 1, digits).alias("bucket")).agg(joined(F.sort_array(F.collect_list(line))).alias("digest"))
    ordered = F.sort_array(F.collect_list(F.concat_ws(":", "bucket", "digest")))
    return each.agg(F.substring(joined(ordered), 1, 16).alias("digest"))
