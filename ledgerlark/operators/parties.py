"""Issuer names: normal forms against a registry, and enrichment by tax number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import bare_tax_number, is_national_tax_number
from ..functions.text import LEGAL_SUFFIXES, UNKNOWN, company_key, company_slug
from .bands import first_by


#: Characters by which contained names are looked up.
GRAM = 4


def grams(key: Column) -> Column:
    """Distinct substrings of up to GRAM characters."""

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(key) - (n - 1))
        return F.when(F.length(key) >= n, F.transform(starts, lambda i: F.substring(key, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    each = [of(n) for n in range(1, GRAM + 1)]
    return F.array_distinct(F.flatten(F.array(*each)))


def normalized_issuers(names: DataFrame, known: DataFrame, raw: str = "raw", suffixes: tuple[str, ...] = LEGAL_SUFFIXES) -> DataFrame:
    """``names`` with issuing_party: the known name itself, one of equal key, the longest one that holds the key or is held by it, else a slug.

    Equi-joins first; of two keys, the longer is looked up by the first
    characters of the shorter, so no pair of all names is made.  Ties go to the
    first by name; a known name without a key is only found by itself.
    """
    distinct = names.select(F.col(raw).alias("__raw")).filter("__raw IS NOT NULL").distinct().withColumn("__key", company_key(F.col("__raw"), suffixes))
    k = known.select(F.col("issuing_party").alias("__known")).filter(F.col("__known") != UNKNOWN).distinct().withColumn("__known_key", company_key(F.replace("__known", F.lit("-"), F.lit(" ")), suffixes)).filter("__known_key <> ''")
    exact = distinct.join(k, F.lower("__raw") == F.lower("__known")).select("__raw", "__known", F.lit(0).alias("tier"), F.lit(0).alias("size"))
    equal = distinct.join(k, F.col("__key") == F.col("__known_key")).select("__raw", "__known", F.lit(1).alias("tier"), F.lit(0).alias("size"))
    begin = lambda c: F.substring(c, 1, GRAM)
    seen = distinct.filter("__key <> ''")
    held = seen.withColumn("__gram", F.explode(grams(F.col("__key")))).join(k.withColumn("__gram", begin("__known_key")), "__gram").filter(F.contains("__key", "__known_key"))
    holds = seen.withColumn("__gram", begin("__key")).join(k.withColumn("__gram", F.explode(grams(F.col("__known_key")))), "__gram").filter(F.contains("__known_key", "__key"))
    part = held.unionByName(holds).select("__raw", "__known", F.lit(2).alias("tier"), (-F.length("__known")).alias("size"))
    best = first_by(exact.unionByName(equal).unionByName(part), ["__raw"], [F.col("tier"), F.col("size"), F.col("__known")])
    out = names.join(best.select(F.col("__raw").alias(raw), "__known"), raw, "left")
    return out.withColumn("issuing_party", F.coalesce("__known", company_slug(F.col(raw), suffixes))).drop("__known")


def enriched_by_tax(docs: DataFrame, cache: DataFrame, locales: tuple[str, ...] = ("pt",), prefixes: tuple[str, ...] = ("PT",)) -> DataFrame:
    """Issuers from a tax-number table, for locales that have one and valid numbers only."""
    ok = F.lower(F.substring("locale", 1, 2)).isin(*locales) & is_national_tax_number(F.col("issuer_tax_number"), prefixes)
    d = docs.withColumn("__tax", F.when(ok, bare_tax_number(F.col("issuer_tax_number"), prefixes)))
    c = cache.groupBy(bare_tax_number(F.col("tax_number"), prefixes).alias("__tax")).agg(F.min("name").alias("__name"))
    return d.join(c, "__tax", "left").withColumn("issuing_party", F.coalesce("__name", "issuing_party")).drop("__tax", "__name")
