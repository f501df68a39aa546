"""Scalar kernels, table by table."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import amounts, dates, identifiers, naming, qr, text


def column(spark, values, kind, f):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in frame.select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]


def test_bank_amounts(spark):
    got = column(spark, ["-4.932,62", "5.000,00", "-11,06", "17.99", "1,234.5", "", None, "x", "1 234,5", "1,5 €"], "string", amounts.bank_amount)
    assert got == [-4932.62, 5000.0, -11.06, 17.99, 1234.5, None, None, None, 1234.5, None]


def test_three_parsers_differ(spark):
    assert column(spark, ["12.34", "1.234,5"], "string", amounts.sidecar_amount) == [1234.0, 1234.5]
    assert column(spark, ["12,34", "1.234,56", "-1 5,00", "12.34", "12,3"], "string", amounts.euro_line) == [12.34, 1234.56, -15.0, None, None]
    assert column(spark, ["1.234,56 USD", "5 EUR", "2,00"], "string", lambda c: amounts.currency_line(c)["amount"]) == [1234.56, None, 2.0]


def test_key_amount(spark):
    assert column(spark, ["2.675", "-0.001", "junk", None, "18"], "string", amounts.key_amount) == ["2.68", "0.00", "0.00", "0.00", "18.00"]


def test_stamp_duty_pair(spark):
    pair = column(spark, [[5.2, 5.0, 3.0], [10.0, 0.4], [60.0, 50.0]], "array<double>", lambda c: amounts.stamp_duty_pair(c, 0.04, 1.0))
    assert (pair[0].base, pair[0].gross, pair[0].tax) == (5.0, 5.2, 0.2) and pair[1:] == [None, None]


def test_text(spark):
    assert column(spark, ["Ação Ø ß", None], "string", text.strip_diacritics) == ["Acao Ø ß", None]
    assert column(spark, [" Café-Münster, 2 ", None], "string", text.compact_key) == ["cafemunster2", ""]
    assert column(spark, ["  Á b--C! "], "string", text.slug) == ["a-b-c"]
    assert column(spark, ["PAGAMENTO  SERVIÇOS ", None, "Straße"], "string", text.description_key) == ["pagamento servicos", "", "strasse"]
    assert column(spark, ["DocumentType.invoice", " invoice "], "string", lambda c: text.enum_value(c, "DocumentType")) == ["invoice", "invoice"]
    assert column(spark, [None, " ", "x"], "string", text.or_unknown) == ["$UNKNOWN$", "$UNKNOWN$", "x"]
    assert column(spark, [None, " ", "x"], "string", text.raw_or_unknown) == [None, "$UNKNOWN$", "x"]
    assert column(spark, ["Re: Olá!", None, "??"], "string", text.subject_slug) == ["re-ola", "no-subject", "no-subject"]


@pytest.mark.parametrize(("raw", "want"), [("ACME, Inc.", "acme"), ("acme lda s a", "acme lda"), ("Acme S.A.", "acme"), ("Co", "$UNKNOWN$"), (None, "$UNKNOWN$")])
def test_company(spark, raw, want):
    assert column(spark, [raw], "string", text.company_slug) == [want.replace(" ", "-")]


def test_dates(spark):
    assert column(spark, ["2026-1-5", "2026-02-30", "x", None], "string", dates.iso_date) == [datetime.date(2026, 1, 5), None, None, None]
    assert column(spark, ["05/01/2026", "05-01-2026", "2026-01-05", "?"], "string", dates.bank_date) == ["2026-01-05"] * 3 + [None]
    assert column(spark, ["soon", "05/01/2026"], "string", dates.any_date) == ["soon", "2026-01-05"]
    assert column(spark, ["2026-01-31", "2026-13-01", "2026"], "string", dates.calendar_month) == ["2026-01", None, None]
    assert column(spark, ["31/12", "02/01", "15-06", "03/01 to 04/01 99/99", "soon", None], "string", lambda c: dates.partial_date(c, F.lit("2026-01-10"))) == ["2025-12-31", "2026-01-02", "2026-06-15", "2026-01-04", None, None]
    assert column(spark, ["2026-01-02"], "string", lambda c: dates.business_days_after(c, 2)) == [datetime.date(2026, 1, 6)]
    assert dates.months_back(2, datetime.date(2026, 1, 9)) == ["2025-11", "2025-12", "2026-01"]
    assert dates.month_range(["2025-12", "2026-02"]) == ("2025-12-01", "2026-02-28")


def test_identifiers(spark):
    assert column(spark, [" 123 456 789", "PT1", None], "string", identifiers.tax_number) == ["PT123456789", "PT1", ""]
    assert column(spark, ["123456789", "123456788", "12", None], "string", identifiers.tax_checksum_ok) == [True, False, False, False]
    assert column(spark, ["PT123456789", "023456789"], "string", identifiers.is_national_tax_number) == [True, False]
    assert column(spark, ["to GB82WEST12345698765432 or GB82WEST12345698765431", None], "string", identifiers.valid_ibans) == [["GB82WEST12345698765432"], []]
    assert column(spark, ["a - 0A1B2C3d.pdf", "0a1b2c3d", "x0a1b2c3d.pdf"], "string", identifiers.name_hash) == ["0a1b2c3d", "0a1b2c3d", None]
    lines = [["Beneficiary:", "GB82WEST12345698765432", "other"]]
    got = column(spark, lines, "array<string>", identifiers.payment_accounts)[0]
    assert got.beneficiaries == got.mentions == ["GB82WEST12345698765432"]


def test_qr(spark):
    code = "A:500000000*B:1*C:PT*D:FT*E:N*F:20260131*G:FT 1/2*H:X-1*O:12.30*O:12.50"
    got = column(spark, [code, "https://x", None, "A:1"], "string", qr.qr_metadata)
    assert (got[0].date_issued, got[0].document_type, got[0].total_amount, got[0].total_amount_currency) == ("2026-01-31", "invoice", 12.5, "EUR")
    assert got[1:] == [None, None, None]
    assert column(spark, [code, "https://x", "?", ""], "string", qr.qr_type) == ["portuguese_invoice", "url", "unknown", "unknown"]


def test_names(spark):
    frame = spark.createDataFrame([("2026-01-31", "invoice", "Ácme: Co", None, 12.5, "EUR", "0a1b2c3d")], "d string, k string, p string, t string, a double, c string, h string")
    name = naming.file_name(*[F.col(x) for x in "dkptach"])
    assert frame.select(name).first()[0] == "2026-01-31 - invoice - acme co - 12.50 eur - 0a1b2c3d.pdf"
    long = "2026 - invoice - " + "p" * 40 + " - drop - " + "t" * 10 + ".pdf"
    names = [long, "a - b.pdf", "a - " + "b" * 60 + ".pdf", long.replace(".pdf", ".txt")]
    got = column(spark, names, "string", lambda c: naming.fitted(c, 50))
    assert got == ["2026 - invoice - " + "p" * 16 + " - " + "t" * 10 + ".pdf", "a - b.pdf", "a - " + "b" * 42 + ".pdf", names[3]]
    assert column(spark, ["one two three"], "string", lambda c: naming.trimmed(c, 9)) == ["one two"]
