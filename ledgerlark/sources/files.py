"""File listings: which paths count, and companions of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bands import first_by


def scan(spark: SparkSession, roots: list[str], extensions: tuple[str, ...], skip_dirs: tuple[str, ...] = (), skip_prefixes: tuple[str, ...] = ("_dupes",), hidden: bool = False) -> DataFrame:
    """path, size, modified of non-empty files below the roots with one of the extensions."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    files = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    kinds = "|".join(e.lstrip(".") for e in extensions)
    ok = F.col("path").rlike(rf"(?i)\.(?:{kinds})$") & (F.col("size") > 0)
    parts = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    bad = lambda p: (p.isin(*skip_dirs) if skip_dirs else F.lit(False)) | any_prefix(p, skip_prefixes)
    ok = ok & ~F.exists(parts, bad)
    return files.filter(ok if hidden else ok & ~F.col("path").rlike(r"/\.[^/]*$"))


def any_prefix(c: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(c, F.lit(p))
    return out


def is_internal(path: Column) -> Column:
    """Below ``_dupes*`` or ``logs``, or a name that starts with an underscore."""
    return path.rlike(r"/(?:_dupes[^/]*|logs)/") | path.rlike(r"/_[^/]*$")


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]+$", "")


def with_companion(records: DataFrame, files: DataFrame, require: bool = False) -> DataFrame:
    """Records with the file of the same stem: their own extension first, then .pdf, then .xlsx."""
    f = files.select(stem(F.col("path")).alias("__stem"), F.col("path").alias("companion"))
    ext = F.lower(F.regexp_extract("companion", r"(\.[^./]+)$", 1))
    r = records.withColumn("__stem", stem(F.col("path")))
    order = F.when(ext == F.lower("source_extension"), 0).when(ext == ".pdf", 1).when(ext == ".xlsx", 2)
    pairs = r.select("path", "__stem", "source_extension").join(f, "__stem").withColumn("__rank", order).filter("__rank IS NOT NULL")
    best = first_by(pairs, ["path"], [F.col("__rank"), F.col("companion")]).select("path", "companion")
    return r.drop("__stem").join(best, "path", "inner" if require else "left")
