"""A corpus pipeline of five stages over ``documents``.

1. toxicity: documents that the classifier rejects go.
2. near_duplicates: one row (of the least doc_id) of each component stays.
3. decontamination: documents that hold a benchmark passage go.
4. mixing: sources are taken by weight, in whole documents; a copy is a row.
5. sharding: rows get their shard and slot.

A stage takes (spark, docs, sf_dir); what it returns is written as Parquet and
read again as the next one's docs.  Stages 2 and 3 judge rows by ``row_id``, which
stage 1 gives, since a doc_id may be null or repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import classify, mixing, ngrams, phrases, sharding
from ledgerlark.llm.common import saved, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def row_id() -> Column:
    return F.monotonically_increasing_id().alias("row_id")


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a stored row_id, unique in the table."""
    return docs if "row_id" in docs.columns else saved(docs.select(*COLUMNS, row_id()), "rows")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = classify.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=F.lit(True))
    return classify.score(docs, model, out="__score").filter(F.col("__score") < 0.5).select(*COLUMNS, row_id())


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity 0.8 or more; of repeated rows one stays, rows without an id and words all do."""
    docs = numbered(docs)
    named = ngrams.jaccard_components(docs, size=5, threshold=(4, 5), id_col="row_id").select(F.col("doc_id").alias("row_id"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_id"))["row_id"]
    keep = named.join(docs.select("row_id", "doc_id"), "row_id").groupBy("component_id").agg(first.alias("row_id")).select("row_id")
    kept = docs.join(keep, "row_id", "left_semi").withColumn("__alone", F.when(F.col("doc_id").isNull(), F.col("row_id")))
    return kept.dropDuplicates(["doc_id", "text", "__alone"]).select(*COLUMNS, "row_id")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ten consecutive words of an item, or all of a shorter one."""
    docs = numbered(docs)
    found = phrases.decontaminate(docs, table(spark, sf_dir, "benchmark"), size=10, id_col="row_id")
    return docs.join(found.filter("contaminated").select(F.col("doc_id").alias("row_id")), "row_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row's n_chars is that of the text it holds."""
    return mixing.taken_texts(mixing.mix(docs, fine=3), list(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs, shards=16)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL cannot express the classifier; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
