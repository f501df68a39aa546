"""Policy compiler: values, types, families, classification, prefixes."""

import pytest
from pyspark.sql import functions as F

from ledgerlark.plans import rules
from ledgerlark.plans.policy import Policy, Rule, cardinality, overlaid

POLICY = Policy(counterparty_aliases={"acme": "acme-group"}, bank_counterparties=("bank-x",), shared_title_terms={"$bank": ("monthly",), "acme-group": ("plan",)})


def one(spark, expr, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()], F.lit(1).alias("_")).select(expr).first()[0]


@pytest.mark.parametrize(
    ("value", "kind", "pattern", "want"),
    [(12, "int", ">=10", True), (4, "int", "<5", True), (4, "int", ">5", False), (True, "boolean", True, True), (True, "boolean", "false", False), ("x", "string", "!=3", False), ("Invoice A", "string", "invoice-*", True), ("x", "string", "*", True), (None, "string", "*", False), ("É b", "string", "e-b", True), (5.0, "double", "5", True)],
)
def test_values(spark, value, kind, pattern, want):
    c = F.lit(value).cast(kind)
    assert spark.range(1).select(rules.value_matches(c, pattern, kind)).first()[0] is want


@pytest.mark.parametrize(
    ("kind", "pattern", "want"),
    [("invoice", "invoice|invoice-credit", True), ("bank-note", "bank-*", True), ("bank-card-transaction", "bank-note", True), ("receipt-x", "supplier-evidence", True), ("tax-vat", "supplier-evidence", False), ("", "x*", False), (None, "*", False)],
)
def test_types(spark, kind, pattern, want):
    assert spark.range(1).select(rules.type_matches(F.lit(kind).cast("string"), pattern, POLICY)).first()[0] is want


@pytest.mark.parametrize(
    ("kind", "amount", "want"),
    [("bank-note", 1.0, "bank_anchor"), ("invoice", 1.0, "supplier_evidence"), ("invoice", 0.0, "ignore"), ("receipt", None, "supplier_evidence"), ("loan-simulation", 5.0, "ignore"), ("loan-x", 5.0, "loan_evidence"), ("DocumentType.tax-vat", 1.0, "tax_evidence"), ("?", 1.0, "unknown"), (None, 1.0, "unknown")],
)
def test_families(spark, kind, amount, want):
    f = rules.family_of(F.lit(kind).cast("string"), POLICY, F.lit(amount).cast("double"))
    assert spark.range(1).select(f).first()[0] == want


def test_classification(spark):
    given = (Rule("fee", ("COMISSAO",), "debit"), Rule("fee", ("comissão",)), Rule("any", direction="credit"))
    rows = spark.createDataFrame([("comissão x", -1.0), ("comissão x", 0.0), ("comissão", 1.0), (None, -2.0)], "d string, a double")
    got = [r[0] for r in rows.select(rules.rule_number(F.col("d"), F.col("a"), given)).collect()]
    assert got == [0, 0, 2, None]


def test_counterparty(spark):
    rows = spark.createDataFrame([(None, "ACME", None), ("123456789", "x", None), (None, None, "Öl & Co"), (None, None, None)], "t string, p string, r string")
    got = [r[0] for r in rows.select(rules.counterparty(F.col("t"), F.col("p"), F.col("r"), POLICY)).collect()]
    assert got == ["acme-group", "tax:PT123456789", "ol-co", "$UNKNOWN$"]


def test_shared_period(spark):
    rows = spark.createDataFrame([("Monthly fee", "supplier_evidence", "bank-x"), ("Monthly fee", "supplier_evidence", "y"), ("A plan", "supplier_evidence", "acme-group"), ("A plan", "tax_evidence", "acme-group")], "t string, f string, p string")
    got = [r[0] for r in rows.select(rules.shared_period_document(F.col("t"), F.lit(None).cast("string"), F.col("f"), F.col("p"), POLICY)).collect()]
    assert got == [True, False, True, False]


def test_export_prefix(spark):
    tests = [({"document_type": "invoice", "amount": ">100"}, "BIG_"), ({"document_type": "inv*"}, "VND_")]
    rows = spark.createDataFrame([("invoice", 500.0), ("invoice", 5.0), ("x", 1.0)], "document_type string, amount double")
    assert [r[0] for r in rows.select(rules.export_prefix(tests, {"amount": "double"}, "DOC_")).collect()] == ["BIG_", "VND_", "DOC_"]


def test_overrides(spark):
    o = [{"raw": ["Fatura"], "type": "invoice"}, {"all": ["bank", "note"], "type": "bank-note"}, {"any": ["irs", "vat"], "type": "tax-x"}]
    rows = spark.createDataFrame([("fatura", None), ("Note of bank", None), ("x", "VAT 1"), ("x", None)], "r string, t string")
    assert [r[0] for r in rows.select(rules.override_type(F.col("r"), F.col("t"), o)).collect()] == ["invoice", "bank-note", "tax-x", None]


def test_policy():
    assert [cardinality(x) for x in (2, [1, 3], [None, None], "x")] == [(2, 2), (1, 3), (0, None), (0, None)]
    p = overlaid(Policy(), {"tolerance": 0.5, "rules": [Rule("mine")], "counterparty_aliases": {"a": "b"}})
    assert p.tolerance == 0.5 and p.rules[0].name == "mine" and len(p.rules) == 3 and p.counterparty_aliases == {"a": "b"}
    assert rules.resolved("${profile.x}", {"x": 3}) == 3
