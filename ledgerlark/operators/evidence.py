"""Evidence columns of documents and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import compact_key
from ..plans import rules
from ..plans.policy import Policy


def with_evidence(docs: DataFrame, policy: Policy) -> DataFrame:
    """Adds family, counterparty, source_bank and is_shared_period (never written back)."""
    d = docs.withColumn("family", rules.family_of(F.col("document_type"), policy, F.col("total_amount")))
    d = d.withColumn("counterparty", rules.counterparty(F.col("issuer_tax_number"), F.col("issuing_party"), F.col("issuing_party_raw"), policy))
    bank = F.col("counterparty").isin(*policy.bank_counterparties) if policy.bank_counterparties else F.lit(False)
    return d.withColumns(
        {
            "source_bank": F.when((F.col("family") == "bank_anchor") & bank, F.col("counterparty")),
            "is_shared_period": rules.shared_period_document(F.col("document_title"), F.col("document_type_raw"), F.col("family"), F.col("counterparty"), policy),
            "party_key": compact_key(F.col("issuing_party")),
        }
    )


def candidates(docs: DataFrame, policy: Policy, exclude_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Documents, and the parts of those with two or more, as match candidates.

    ``docs``: path, file_name, hash_content, sub_documents and the document
    fields.  A candidate's id is its hash, else its path, with ``#sub<i>`` for a
    part; the whole document stays a candidate.  Of equal ids the first path stays.
    """
    part_fields = ["date_issued", "document_type", "total_amount", "total_amount_currency", "issuer_tax_number", "issuing_party", "issuing_party_raw"]
    base = docs.withColumn("base_id", F.coalesce("hash_content", "path"))
    whole = base.withColumns({"candidate_id": F.col("base_id"), "is_part": F.lit(False)}).drop("sub_documents", "base_id")
    parts = base.filter(F.size("sub_documents") >= 2).select("*", F.posexplode("sub_documents").alias("part", "sub"))
    parts = parts.withColumns({f: F.col(f"sub.{f}") for f in part_fields} | {"candidate_id": F.concat(F.col("path"), F.lit("#sub"), F.col("part")), "is_part": F.lit(True)})
    both = whole.unionByName(parts.drop("sub_documents", "base_id", "part", "sub"))
    if exclude_prefixes:
        both = both.filter(~rules.any_of([F.startswith("file_name", F.lit(p)) for p in exclude_prefixes]))
    firsts = both.groupBy("candidate_id").agg(F.min_by(F.struct(*both.columns), "path").alias("c")).select("c.*")
    return with_evidence(firsts, policy)
