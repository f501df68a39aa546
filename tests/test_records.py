"""Sources, sinks, dedup, ground truth, exports, audits, line items, review and streaming."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from ledgerlark.operators import audit, dedup, exports, groundtruth, lineitems, parties, review
from ledgerlark.sources import files, mail, sidecars, statements
from ledgerlark.streaming import ingest


def put(path, name, content):
    target = path / name
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(content if isinstance(content, bytes) else content.encode())


def record(**fields):
    base = {"class_confidence": 0.9, "class_reasoning": "r", "date_issued": "2026-01-05", "document_type": "DocumentType.invoice", "issuing_party": "Acme", "hash_content": "aaaaaaaa", "total_amount": 12.34}
    return json.dumps(base | fields)


def test_sidecars(spark, tmp_path):
    put(tmp_path, "a.json", record(total_amount="1.234,5", total_amount_currency=" € "))
    put(tmp_path, "sub/b.json", record(hash_content="b", date_issued=" ", issuing_party=None, sub_documents=[{"total_amount": "7", "document_type": "x"}]))
    put(tmp_path, "future.json", record(date_issued="2999-01-01"))
    put(tmp_path, "broken.json", "{")
    put(tmp_path, "logs/c.json", record())
    put(tmp_path, "_dupes_1/d.json", record())
    put(tmp_path, "x reconciliation.json", record())
    got = {r.hash_content: r for r in sidecars.read(spark, str(tmp_path), "2026-06-01").collect()}
    assert set(got) == {"aaaaaaaa", "b"}
    assert (got["aaaaaaaa"].total_amount, got["aaaaaaaa"].total_amount_currency, got["aaaaaaaa"].document_type) == (1234.5, "EUR", "invoice")
    assert (got["b"].date_issued, got["b"].issuing_party, got["b"].sub_documents[0].total_amount) == ("$UNKNOWN$", "$UNKNOWN$", 7.0)
    sidecars.write(sidecars.read(spark, str(tmp_path), "2026-06-01"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2


def sheet(rows):
    cells = "".join(f'<row r="{r}">' + "".join(f'<c r="{"ABCDEFGH"[c - 1]}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in cols.items()) + "</row>" for r, cols in rows.items())
    xml = f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", xml)
    return out.getvalue()


def test_statements(spark, tmp_path):
    head = {1: "Data lançamento", 2: "Data valor", 3: "Descrição", 4: "Montante", 5: "Moeda", 6: "Notas", 7: "Tratado"}
    put(tmp_path, "a.xlsx", sheet({2: {3: "123 - EUR"}, 3: {3: "01/01/2026"}, 4: {3: "31/01/2026"}, 8: head, 9: {1: "05/01/2026", 2: "06/01/2026", 3: "x", 4: "-4.932,62", 7: "Não"}, 10: {1: "05/01/2026", 3: "done", 4: "1,00", 7: "Sim"}, 11: {1: "07-01-2026", 3: "y", 4: "5"}}))
    head = {1: "Data Mov.", 2: "Data Valor", 3: "Descrição do Movimento", 4: "Valor em EUR"}
    put(tmp_path, "b.xlsx", sheet({7: {3: "987 (EUR)"}, 18: head, 19: {1: "10/02/2026", 2: "10/02/2026", 3: "z", 4: "17.99"}, 20: {1: "12/02/2026", 3: "w", 4: "1"}}))
    put(tmp_path, "c.xlsx", b"not a workbook")
    rows = statements.read_rows(spark, str(tmp_path))
    assert sorted((r.format, r.account, r.row_number, r.date_posting, r.amount) for r in rows.collect()) == [("A", "123", 9, "2026-01-05", -4932.62), ("A", "123", 11, "2026-01-07", 5.0), ("B", "987", 19, "2026-02-10", 17.99), ("B", "987", 20, "2026-02-12", 1.0)]
    made = {r.bank_statement.bank_format: r.bank_statement for r in statements.statement_records(rows).collect()}
    assert (made["A"].period_end, made["B"].period_start, made["B"].period_end, made["B"].transaction_count) == ("2026-01-31", "2026-02-10", "2026-02-12", 2)
    assert statements.transactions(rows).count() == 4


def test_mail_and_archives(spark, tmp_path):
    message = "From x\nMessage-ID: <1>\nSubject: Olá\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=b\n\n--b\nContent-Type: application/pdf\nContent-Disposition: attachment; filename=a.pdf\n\nPDF\n--b\nContent-Type: text/html\nContent-Disposition: attachment; filename=a.html\n\nno\n--b--\n"
    put(tmp_path, "m.mbox", message + "\n" + message.replace("<1>", "<2>"))
    got = mail.read_mbox(spark, str(tmp_path))
    assert sorted((r.message_id, r.name) for r in got.collect()) == [("<1>", "a.pdf"), ("<2>", "a.pdf")]
    seen = spark.createDataFrame([("<1>",)], "message_id string")
    assert [r.message_id for r in mail.new_messages(got.select("message_id"), seen).collect()] == ["<2>"]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("in/one.txt", "1")
    put(tmp_path, "z.zip", out.getvalue())
    put(tmp_path, "bad.zip", b"x")
    assert sorted((str(r.name), r.n_members) for r in mail.read_archives(spark, str(tmp_path)).collect()) == [("None", -1), ("in/one.txt", 1)]
    assert mail.mail_query("2026-01-01", "2026-01-31", "bills") == "has:attachment after:2026/01/01 before:2026/02/01 label:bills"


def test_files_and_companions(spark, tmp_path):
    for name in ("a.pdf", "a.xlsx", "b.xlsx", "skip/c.pdf", ".d.pdf"):
        put(tmp_path, name, "x")
    put(tmp_path, "empty.pdf", "")
    found = files.scan(spark, [str(tmp_path)], (".pdf", ".xlsx"), skip_dirs=("skip",))
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["a.pdf", "a.xlsx", "b.xlsx"]
    root = found.first().path.rsplit("/", 1)[0]
    records = spark.createDataFrame([(f"{root}/a.json", None), (f"{root}/b.json", ".pdf"), (f"{root}/z.json", None)], "path string, source_extension string")
    got = {r.path[-6:]: r.companion and r.companion[-6:] for r in files.with_companion(records, found).collect()}
    assert got == {"a.json": "/a.pdf"[-6:], "b.json": "b.xlsx", "z.json": None}


def test_dedup_tiers_and_acceptance(spark):
    rows = spark.createDataFrame([("a", 5, "c1", "t1"), ("b", 3, "c1", "t1"), ("c", 9, "c2", "t2"), ("d", 9, "c3", "t2"), ("e", 1, None, None)], "path string, size long, hash_content string, hash_text string")
    got = sorted((r.group_kind, r.group_hash, r.keep, r.bytes_saved) for r in dedup.duplicate_groups(rows).collect())
    assert got == [("content", "c1", "b", 5), ("text", "t2", "c", 9)]
    chain = spark.createDataFrame([("A", "f1", "t1", "c1"), ("B", "f2", "t1", "c2"), ("C", "f3", "t2", "c2"), ("D", "f4", None, "c1"), ("E", None, None, None), ("F", "f3", None, None)], "path string, hash_file string, hash_text string, hash_content string")
    assert sorted(r.path for r in dedup.accepted(chain).filter("accepted").collect()) == ["A", "C", "E"]
    pages = spark.createDataFrame([(["Page 1/1 a", "page 1 of 1"],), (["Page 1/2"],), (["x", "y"],)], "pages array<string>")
    assert dedup.split_pages(pages).count() == 4
    long = "word " * 20
    assert spark.range(1).select(dedup.text_hash(F.array(F.lit(long), F.lit("Á" + long)))).first()[0] is not None
    assert spark.range(1).select(dedup.text_hash(F.array(F.lit(long), F.lit("short")))).first()[0] is None


def test_groundtruth(spark):
    rows = spark.createDataFrame([("s", 2, "2026-01-05", "PAGAMENTO  SERVIÇOS", -18.0, "eur"), ("s", 1, "2026-01-05", "pagamento servicos", -18.0, "EUR")], "statement string, row long, date string, description string, amount double, currency string")
    got = {r.row: r for r in groundtruth.with_keys(rows).collect()}
    assert (got[1].occurrence, got[2].occurrence) == (1, 2)
    assert got[1].key_id == '{"amount":"-18.00","currency":"EUR","date":"2026-01-05","description_normalized":"pagamento servicos","occurrence":1}'
    doc = "array<struct<hash_file: string, hash_content: string, file_name: string>>"
    sets = spark.createDataFrame([([("f1", "c1", "n1")], [("f2", "c1", "n2")]), ([("f1", "c1", "n")], [("f2", "c2", "n")]), ([("f", "c", "n"), ("f", "c", "n")], [("f", "c", "n")]), ([], [])], f"a {doc}, b {doc}")
    assert [tuple(r) for r in sets.select(groundtruth.sets_match(F.col("a"), F.col("b")), groundtruth.sets_match(F.col("a"), F.col("b"), True)).collect()] == [(True, True), (True, False), (False, False), (True, True)]


def test_exports_and_parties(spark):
    docs = spark.createDataFrame([("p2", "2026-02-01", "c"), ("p1", "2026-02-01", "c"), ("p3", "2026-01-01", None), ("p4", "?", None)], "path string, date_issued string, hash_content string")
    docs = docs.withColumns({"bank_statement": F.lit(None).cast(sidecars.STATEMENT), "file_name": F.concat("path", F.lit(".pdf"))})
    assert [r.month for r in exports.months(docs).collect()] == ["2026-02", "2026-01"]
    out = exports.monthly(docs, F.col("file_name"), F.lit("VND_"))
    assert sorted((r.export_month, r.export_name) for r in out.collect()) == [("2026-01", "VND_p3.pdf"), ("2026-02", "VND_p1.pdf")]
    names = spark.createDataFrame([("ACME, Inc",), ("The Acme Holdings Group Lda",), ("New Co Ltd",), ("Glo", ), ("Megaacmes",), (None,)], "raw string")
    known = spark.createDataFrame([("acme",), ("acme-holdings",), ("globex-portugal",), ("globex",)], "issuing_party string")
    got = [r.issuing_party for r in parties.normalized_issuers(names, known).orderBy(F.col("raw").asc_nulls_last()).collect()]
    assert got == ["acme", "globex-portugal", "acme", "new", "acme-holdings", "$UNKNOWN$"]
    cache = spark.createDataFrame([("123456789", "Registered Name")], "tax_number string, name string")
    taxed = spark.createDataFrame([("PT123456789", "x", "pt_PT"), ("PT123456789", "x", "en"), (None, "x", "pt")], "issuer_tax_number string, issuing_party string, locale string")
    assert sorted(r.issuing_party for r in parties.enriched_by_tax(taxed, cache).collect()) == ["Registered Name", "x", "x"]


def test_line_items(spark):
    page = "Comissão de custódia\ntexto\n12,50\nTRF 12345 em 05/01\nManutenção de conta\n5,20\n5,00"
    docs = spark.createDataFrame([([page], "invoice", "Bank", "2026-01-10"), ([page], "other", "Bank", "2026-01-10")], "pages array<string>, document_type string, issuing_party string, date_issued string")
    applies = {"types": ["invoice"], "parties": ["bank"]}
    settings = {
        "fees": {**applies, "extractor": "marked_amounts", "markers": {"custodia": "bank-custody-fee"}},
        "stamp": {**applies, "extractor": "fee_invoice", "maintenance_marker": "MANUTENCAO", "custody_marker": "CUSTODIA", "custody_category": "custody", "total_debit_marker": "TEXTO"},
        "transfer": {**applies, "extractor": "transfer_lines", "reference_pattern": r"TRF (\d+)"},
        "debit": {**applies, "extractor": "direct_debit", "category": "direct-debit", "amount_pattern": r"\n(\d+,\d\d)\n", "reference_pattern": r"TRF (\d+)"},
    }
    got = lineitems.with_line_items(docs, settings).collect()
    assert {(x.category, x.amount, x.reference) for x in got[0].line_items} == {("bank-custody-fee", 12.5, None), ("bank-fee-maintenance", 5.0, None), ("bank-fee-stamp-duty", 0.2, None), ("custody", 12.5, None), ("bank-transfer", 12.5, "12345"), ("direct-debit", 12.5, "12345")}
    assert [x.date for x in got[0].line_items if x.category == "bank-transfer"] == ["2026-01-05"] and got[1].line_items == []
    assert lineitems.with_line_items(docs, {}).first().line_items == []


def test_amounts_between_and_page_date(spark):
    lines = spark.createDataFrame([(["head", "1.000,00", "2,00 EUR", "3,00", "USD", "GBP", "end"], "on 99/99/2024 or 01/02/2024"), (["head", "1,00", "end"], "on 01/02/2024")], "l array<string>, t string")
    found = lines.select(lineitems.amounts_between(F.col("l"), F.lit(0), F.size("l") - 1).alias("a"), lineitems.page_date(F.col("t"), F.lit("2020-01-01")).alias("d")).collect()
    assert [[tuple(x) for x in r.a] for r in found] == [[(1000.0, "USD"), (2.0, "EUR"), (3.0, "USD")], [(1.0, None)]]
    assert [r.d for r in found] == ["2020-01-01", "2024-02-01"]


def test_custody_without_total(spark):
    cfg = {"maintenance_marker": "MANUT", "custody_marker": "CUSTODIA", "total_debit_marker": "TOTAL"}
    rows = [(["MANUT", "custódia", "3,00", "7,00"],), (["2,00", "4,00", "200,00", "custódia"],), (["custódia", "TOTAL", "x", "9,00"],)]
    docs = spark.createDataFrame(rows, "l array<string>")
    got = [[x.amount for x in r.a] for r in docs.select(lineitems.fee_invoice(F.col("l"), F.lit(None), cfg).alias("a")).collect()]
    assert got == [[7.0], [4.0], [9.0]]


def test_audit_and_review(spark):
    docs = spark.createDataFrame([("a", "x", "2026-01-01", 0.5, "h"), ("b", "$UNKNOWN$", "soon", 0.95, "h"), ("c", None, None, 1.0, None)], "path string, issuing_party string, date_issued string, class_confidence double, hash_file string").withColumns({"document_type": F.lit("t"), "hash_content": F.lit("c")})
    assert {r.field: r.n for r in audit.unknown_counts(docs).collect()} == {"document_type": 0, "issuing_party": 1, "date_issued": 0, "any": 1}
    assert {r.year: r.n for r in audit.year_counts(docs).collect()} == {"2026": 1, "invalid": 2}
    assert {r.field: r.n for r in audit.duplicate_hash_counts(docs).collect()} == {"hash_file": 1, "hash_content": 1}
    rows = spark.createDataFrame([("2026-01-02", "Água", -5.0, "fee", "open", [2.0, 3.004])], "date string, description string, amount double, category string, status string, amounts array<double>")
    assert review.transaction_search(rows, "ÁGUA").count() == 1 and review.review_queue(rows, "2026-02").count() == 0
    assert review.totals_agree(rows).first().agrees


def test_streaming_keeps_first_content(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    put(tmp_path / "in", "a.json", record(hash_content="1"))
    put(tmp_path / "in", "b.json", record(hash_content="2"))
    ingest.ingest(spark, source, out, checkpoint).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    put(tmp_path / "in", "c.json", record(hash_content="2"))
    put(tmp_path / "in", "d.json", record(hash_content="3"))
    ingest.ingest(spark, source, out, checkpoint).awaitTermination()
    assert sorted(r.hash_content for r in spark.read.parquet(out).collect()) == ["1", "2", "3"]


def test_sync_and_classification(spark):
    from ledgerlark.functions.qr import is_invoice_qr
    from ledgerlark.operators import sync

    texts = spark.createDataFrame([(["A:1*H:2*F:20260101", "A:1*H:2*F:20260102", "x"],), (["A:1*H:2"],)], "t array<string>")
    got = [r[0] for r in texts.select(sync.sub_documents(F.col("t"))).collect()]
    assert [p.date_issued for p in got[0]] == ["2026-01-01", "2026-01-02"] and got[1] is None
    assert texts.select(is_invoice_qr(F.col("t")[0])).first()[0]
    pairs = spark.createDataFrame([("s", 1, "a", 10.0, 10.0), ("s", 2, "b", 10.0, 11.0)], "statement string, row long, candidate_id string, abs_amount double, total_amount double")
    assert sync.suggested_matches(pairs, None, 0.01).count() == 0
    assert [r.row for r in sync.suggested_matches(pairs, lambda p: p, 0.01).collect()] == [1]
    moves = spark.createDataFrame([("g", "x/a.pdf"), ("g", "y/a.pdf"), ("h", "z/b.pdf")], "k string, move string")
    plan = sync.move_plan(moves, moves.filter("k = 'g'"), ["k"], "out")
    assert sorted(r.target for r in plan.collect()) == ["out/a.pdf", "out/a_1.pdf"]
    keys = spark.createDataFrame([('{"hash_text": null}', None), ("{}", None)], "raw string, hash_text string")
    filled = sync.backfilled(keys, "hash_text", sidecars.has_key(F.col("raw"), "hash_text"), F.lit("new"))
    assert [r.hash_text for r in filled.collect()] == [None, "new"]
