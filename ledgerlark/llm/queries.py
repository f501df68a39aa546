"""The thin ``opN_`` queries: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, classify, languages, mixing, neighbours, ngrams, phrases, sharding, substrings, urls
from .common import table

URL_RULES = (
    urls.HostRule("com", "/", "allow"),
    urls.HostRule("example.com", "/en/", "block"),
    urls.HostRule("www.example.com", "/en/", "allow"),
    urls.HostRule("net", "/es/", "block"),
    urls.HostRule("net", "/fr/", "block"),
)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "quota", "copies")


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.xxhash64("text")).alias("text_key"),
    )
    placed = sharding.shard(docs, shards=16, size_col="size", key_col="text_key")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"))
    extra = extra.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", both.alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.format_chats(rows).withColumn("runs", chat.runs_of(F.col("formatted")))
    turns = F.flatten(F.transform("runs", lambda r: F.transform(r["texts"], lambda t: F.struct(r["role"].alias("role"), t.alias("text")))))
    masked = F.filter("runs", lambda r, i: F.get("loss_mask", i))
    loss = F.array_join(F.transform(masked, lambda r: F.array_join(r["texts"], "")), "")
    out = out.withColumns({"turns": turns, "loss": loss})
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op7_shard": op7_shard,
    "op9_url_filter": op9_url_filter,
    "op10_chat": op10_chat,
}


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op6_dedup_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.dedup_substrings(table(spark, sf_dir, "documents"), window=20)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES |= {"op2_decontaminate": op2_decontaminate, "op6_dedup_substrings": op6_dedup_substrings}


def _bucket(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = classify.train(docs, labels, learn=_bucket(5) != 0)
    scored = classify.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (_bucket(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = languages.train(docs, learn=_bucket(3) != 1)
    named = languages.identify(docs.select("doc_id", "text"), model)
    return named.select("doc_id", (_bucket(3) == 1).alias("held_out"), "lang_pred", "score")


QUERIES |= {"op4_toxicity": op4_toxicity, "op8_language": op8_language}


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.jaccard_components(table(spark, sf_dir, "documents"), size=3, threshold=(9, 10))


QUERIES["op3_jaccard_join"] = op3_jaccard_join


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


QUERIES["op5_nearest"] = op5_nearest
