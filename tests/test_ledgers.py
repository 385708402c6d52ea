"""Readers, cleaning, keys, postings, layout and documents."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import dates, keys, money, text
from tallyframe.operators import layout, normalize, numbering, ofx, postings, summary
from tallyframe.schema import LEDGER, POSTED, ExportError, StatementParseError
from tallyframe.sources import readers, sinks

SAMPLE = """date,description,reference,amount
2026-08-01,ACH DEPOSIT RENT 101,RENT-101,1450.00
2026-08-03,ACH DEPOSIT RENT 204,RENT-204,1600.00
2026-08-04,CHECK 5521 LANDSCAPING,,-320.00
2026-08-06,ACH DEPOSIT RENT 305,RENT-305,1275.00
2026-08-09,ACH PLUMBING,INV-8834,-410.50
2026-08-30,BANK SERVICE FEE,,-15.00
"""


@pytest.fixture
def csv(spark, tmp_path):
    def write(content: str, name: str = "x.csv"):
        (tmp_path / name).write_text(content)
        return readers.read_statement(spark, f"file://{tmp_path}/{name}")

    return write


def values(frame, *columns):
    return [tuple(r[c] for c in columns) for r in frame.orderBy("row_id").collect()]


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


# cleaning


@pytest.mark.parametrize(
    ("written", "read"),
    [
        ("$(15.00)", -15.0), ("$3,998.82 ", 3998.82), ("$100.00 ", 100.0), ("(15.00) ", None), ("(-5)", None), ("1e3", 1000.0), ("+5", 5.0), ("1.", 1.0), ("-.5", -0.5),
        ("1d", None), ("5f", None), ("1_000", None), ("0x1F", None), ("True", None), ("€5", None), ("5-", None), ("", None), (" 7 ", 7.0), (None, None), ("inf", float("inf")),
    ],
)
def test_amounts(spark, written, read):
    assert one(spark, money.parse_amount, written) == read


def test_text(spark):
    assert one(spark, text.strip, " \t a b \n\x1c") == "a b"
    assert [one(spark, text.clean_text, x) for x in ("NA", "None", None, " NA ", "null")] == ["", "", "", "NA", ""]
    assert one(spark, lambda c: text.sanitize(c, 32), "Vendor <Corp> & Co") == "Vendor Corp Co"
    assert one(spark, lambda c: text.sanitize(c, 4), "abc defg") == "abc "
    assert one(spark, text.sanitize, "<>&") == "" and one(spark, lambda c: text.or_default(c, "T"), "<>&") == "<>&"


def test_fixed_decimals(spark):
    given = [(-0.001, "-0.00"), (-0.0, "-0.00"), (0.0, "0.00"), (12.5, "12.50"), (-320.0, "-320.00"), (1234567.8, "1234567.80")]
    assert all(one(spark, money.fixed2, v, "double") == w for v, w in given)
    assert [one(spark, money.short_number, v, "double") for v in (100.0, 3998.82, 0.5, -15.0)] == ["100", "3998.82", "0.50".rstrip("0"), "-15"]
    exact = spark.createDataFrame([(2.675,), (1.005,), (0.125,), (-0.005,), (None,)], "v double").select(money.exact_round2(F.col("v"))).collect()
    assert [r[0] for r in exact] == [2.67, 1.0, 0.12, -0.01, None]


def test_net_amounts(spark):
    rows = [(None, 250.0), (40.0, None), (-40.0, None), (None, None), (10.0, 25.0)]
    got = spark.createDataFrame(rows, "d double, c double").select(money.net_amount(F.col("d"), F.col("c"))).collect()
    assert [r[0] for r in got] == [250.0, -40.0, -40.0, None, 15.0]


def test_keys(spark):
    cases = [
        ("2026-08-01", "ACH DEPOSIT RENT 101 ALVAREZ", 1450.0, "R-3609eab6c2519e59", "R-499c0bfcc98ac23f"),
        ("2026-08-04", "CHECK 5521 GREENSCAPE LANDSCAPING", -320.0, "R-479274418b392f65", "R-c290314d72c5785e"),
        ("2026-06-04", "Late Fee", 50.0, "R-a190a6e7926ad300", "R-2722603528f138e9"),
        ("2026-06-04", "  bill pay  ", -100.0, "R-49c704f66861798a", "R-eb79a1924dcb7340"),
        (None, "", 0.0, "R-f0a701ba2090caca", None),
        (None, "", -0.0, "R-a1e3301424e31606", None),
        (None, "", -0.001, "R-a1e3301424e31606", None),
        ("2026-06-04", "", 5.0, "R-ab94548e1a10db2d", "R-8e3c7f59165e6e26"),
    ]
    frame = spark.createDataFrame([c[:3] for c in cases], "d string, t string, a double").withColumn("d", F.col("d").cast("timestamp_ntz"))
    got = frame.select(keys.push_key(F.col("d"), F.col("t"), F.col("a")), keys.export_key(F.col("d"), F.col("t"), F.col("a"))).collect()
    for (*_, push, export), row in zip(cases, got, strict=True):
        assert row[0] == push and (export is None or row[1] == export)


def test_dates(spark):
    first = [("2026-01-01", "yyyy-MM-dd"), ("01/02/2026", "M/d/yyyy"), ("13/02/2026", "d/M/yyyy"), ("Jan 5, 2026", "MMM d, yyyy"), ("nothing", "yyyy-MM-dd")]
    assert all(dates.FORMATS[one(spark, dates.format_of, v)][1] == form for v, form in first)
    # a column whose first value is the date itself
    alone = {
        "2026-01-02 10:11": "2026-01-02 10:11:00", "2026-01-02T10:11": "2026-01-02 10:11:00", "2026-01-02 10:11:12.5": "2026-01-02 10:11:12.500000", "01-02-2026": "2026-01-02 00:00:00",
        "13-02-2026": "2026-02-13 00:00:00", "02 Jan 2026": "2026-01-02 00:00:00", "2 January 2026": "2026-01-02 00:00:00", "02-Jan-26": "2026-01-02 00:00:00", "13/02/26": "2026-02-13 00:00:00",
        "02/13/95": "1995-02-13 00:00:00", "01.02.2026": "2026-01-02 00:00:00", "1/2/2026 9:05": "2026-01-02 09:05:00", "20260102": "2026-01-02 00:00:00", "2026-02-30": "None",
    }
    rows = spark.createDataFrame([(v,) for v in alone], "v string").select("v", dates.parse_date(F.col("v"), dates.format_of(F.col("v"))).alias("d"))
    assert {r.v: str(r.d) for r in rows.collect()} == alone
    assert one(spark, dates.statement_day, "September 30, 2026 Page 1 of 1").isoformat() == "2026-09-30T00:00:00"
    assert one(spark, dates.statement_day, "Sept 30, 2026 then June 1, 2026") is None


# CSV


def test_sample(csv):
    ledger = csv(SAMPLE)
    assert summary.summary(ledger).first().asDict() == {"entry_count": 6, "total": 3579.5, "start_date": "2026-08-01", "end_date": "2026-08-30"}
    assert values(ledger, "row_id", "reference")[2] == (2, "")
    assert [f.dataType for f in ledger.drop("source_file").schema] == [f.dataType for f in LEDGER]


def test_headers_and_blank_rows(csv):
    rows = csv("Posted Date ,Payee,Credit,Debt\n2026-01-01,Deposit,250.00,\n2026-01-02,Out,,$40.00 \n,,,\n2026-01-03,Both,10,25\n")
    assert values(rows, "row_id", "description", "amount") == [(0, "Deposit", 250.0), (1, "Out", -40.0), (2, "Both", -15.0)]
    assert values(csv("date,description,credit\n2026-06-25,x,\"$3,998.82 \"\n"), "amount") == [(3998.82,)]
    assert values(csv("Amount,amount,memo\n1,2,0012\n"), "amount", "description") == [(1.0, "0012")]
    assert values(csv('date,memo,amount\n2026-01-01,"two\nlines, ""quoted""",5\n'), "description") == [('two\nlines, "quoted"',)]


def test_wide_files_and_unnamed_columns(csv):
    names = ["date", "memo", *(f"more{k}" for k in range(70)), "amount"]
    assert values(csv(",".join(names) + "\n2026-01-01,x," + "y," * 70 + "7\n"), "description", "amount") == [("x", 7.0)]
    assert values(csv("date,,amount\n2026-01-01,z,5\n2026-01-02,,6\n"), "amount") == [(5.0,), (6.0,)]


def test_one_format_for_a_column_of_dates(csv):
    rows = csv("date,description,amount\n,x,1\n2026-01-01,a,1\n01/02/2026,b,2\n")
    assert values(rows, "date", "amount")[1][0].isoformat()[:10] == "2026-01-01" and values(rows, "date", "amount")[2] == (None, 2.0)
    assert summary.summary(rows).first().asDict() == {"entry_count": 3, "total": 4.0, "start_date": "2026-01-01", "end_date": "2026-01-01"}
    assert [str(d[0])[:10] for d in values(csv("date,amount\n01/02/2026,1\n13/02/2026,1\n"), "date")] == ["2026-01-02", "None"]


@pytest.mark.parametrize(
    ("content", "reason"),
    [
        ("date,description\n2026-01-01,x\n", "no_amount_column"), ("date,description,amount\n", "no_rows"), ("", "no_rows"), ("not,a,valid,ledger\n", "no_rows"),
        ("date,amount,credit\n2026-01-01,,5\n", "no_usable_amount"), ("date,amount\n2026-01-01,5,6\n", "unreadable"),
    ],
)
def test_refused_files(csv, content, reason):
    with pytest.raises(StatementParseError) as e:
        csv(content)
    assert e.value.reason == reason


def test_files_of_different_shapes_together(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,memo,amount\n2026-01-01,a,1\n2026-01-02,b,2\n")
    (tmp_path / "b.csv").write_text("debit,credit,payee,trans date\n5,,c,01/05/2026\n")
    got = normalize.to_ledger(readers.read_csv(spark, f"file://{tmp_path}")).collect()
    assert sorted((r.source_file[-5:], r.row_id, r.description, r.amount, str(r.date)[:10]) for r in got) == [
        ("a.csv", 0, "a", 1.0, "2026-01-01"), ("a.csv", 1, "b", 2.0, "2026-01-02"), ("b.csv", 0, "c", -5.0, "2026-01-05"),
    ]


def test_optional_libraries_are_named(spark):
    import importlib.util

    assert [readers.kind_of(x) for x in ("a.PDF", "b.xlsx", "c.xls", "d.csv", "e.txt", "f")] == ["pdf", "excel", "excel", "csv", "csv", "csv"]
    for module, name in (("openpyxl", "x.xlsx"), ("pdfplumber", "x.pdf")):
        if importlib.util.find_spec(module) is None:
            with pytest.raises(StatementParseError, match=module):
                readers.read_statement(spark, name)


# layout


def page(rows, name="s", number=1):
    out = []
    for top, words in rows:
        for x0, said in words:
            for k, word in enumerate(said.split()):
                out.append((name, number, float(top), float(x0) + k * (0.1 if len(said.split()) > 1 else 0), len(out), word))
    return out


HEAD = (282.0, [(63, "Date"), (117, "Number"), (150, "Description"), (413.2, "Credits"), (483, "Debits"), (540, "balance")])
STATEMENT = [
    (40, [(36, "September 30, 2026 Page 1 of 1")]), (249.7, [(36, "Transaction history")]), HEAD,
    (291.7, [(61.5, "9/2"), (150, "Fake Vendor Payment Test"), (474, "50.00"), (533.2, "9,950.00")]),
    (309.7, [(61.5, "9/10"), (126, "2001"), (150, "Test Check"), (474, "200.00"), (533.2, "9,750.00")]),
    (327.7, [(61.5, "9/15"), (150, "Test Wire Transfer From Someone"), (405.8, "1,000.00"), (533.2, "10,750.00")]),
    (336.7, [(150, "Continuation Of Description Line")]),
    (354.7, [(61.5, "9/28"), (150, "Fake Deposit"), (405.8, "25.00"), (533.2, "10,775.00")]),
    (372.7, [(61.5, "Totals"), (399.8, "$1,025.00"), (463.5, "$250.00")]), (390, [(61.5, "9/30"), (150, "After"), (474, "1.00")]),
]


def statements(spark, *pages, end="September 30, 2026"):
    words = spark.createDataFrame([w for p in pages for w in p], "source_file string, page int, top double, x0 double, seq long, text string")
    texts = spark.createDataFrame([("s", 1, f"Account\n{end} Page 1")], "source_file string, page int, text string")
    return words, texts


def test_statement(spark):
    got = layout.read_statements(*statements(spark, page(STATEMENT)))
    assert values(got, "row_id", "amount", "reference") == [(0, -50.0, ""), (1, -200.0, "2001"), (2, 1000.0, ""), (3, 25.0, "")]
    rows = values(got, "description", "date")
    assert rows[2][0] == "Test Wire Transfer From Someone Continuation Of Description Line" and str(rows[0][1])[:10] == "2026-09-02"


def test_statement_totals_must_agree(spark):
    off = [*STATEMENT[:-2], (372.7, [(61.5, "Totals"), (399.8, "$9,999.00"), (463.5, "$250.00")])]
    with pytest.raises(StatementParseError, match="9,999.00") as e:
        layout.read_statements(*statements(spark, page(off)))
    assert e.value.reason == "totals_differ"


def test_statement_edges(spark):
    rows = [
        (10, [(61.5, "Date"), (90, "of"), (120, "issue")]), (20, [(61.5, "Totals"), (100, "before")]), HEAD, (285, [(150, "stray")]), (290, [(61.5, "12/28")]),
        (300, [(61.5, "1/3"), (150, "x"), (180, "7.00"), (405.8, "1.00"), (410, "2.00"), (474, "5.00")]), (310, [(126, "77"), (395, "zz"), (150, "y")]),
    ]
    second = [HEAD, (300, [(61.5, "1/4"), (150, "z"), (405.8, "9.00")])]
    bare = [(300, [(61.5, "1/5"), (150, "none"), (405.8, "9.00")])]
    words, texts = statements(spark, page(rows), page(second, number=2), page(bare, number=3), end="January 31, 2026")
    got = layout.read_statements(words, texts)
    assert values(got, "row_id", "description", "reference", "amount") == [(0, "", "", 0.0), (1, "x y", "77", -3.0), (2, "z", "", 9.0)]
    assert [str(d[0])[:10] for d in values(got, "date")] == ["2025-12-28", "2026-01-03", "2026-01-04"]


@pytest.mark.parametrize(("rows", "end", "reason"), [(STATEMENT, "no date", "no_statement_date"), (STATEMENT[:2], "June 1, 2026", "no_table"), ([HEAD, (300, [(61.5, "2/30"), (405.8, "1.00")])], "June 1, 2026", "no_such_day")])
def test_refused_statements(spark, rows, end, reason):
    with pytest.raises(StatementParseError) as e:
        layout.read_statements(*statements(spark, page(rows), end=end))
    assert e.value.reason == reason


# postings


@pytest.fixture
def ledger(spark):
    rows = [
        (0, "2026-06-04", "Bill Pay", "", -100.0), (1, "2026-06-25", "Owner & <Co>", "R1", 3998.82), (2, "2026-06-04", "Late Fee", "", 50.0),
        (3, "2026-06-04", "Late Fee", "", 50.0), (4, None, "Undated", "", 0.0), (5, "2026-06-30", "", "", -0.001),
    ]
    return spark.createDataFrame(rows, "row_id long, date string, description string, reference string, amount double").withColumn("date", F.col("date").cast("timestamp_ntz"))


def test_postings(spark, ledger, tmp_path):
    none = spark.createDataFrame([], POSTED)
    plan = postings.plan_postings(ledger, none)
    assert values(plan, "txn_type", "status") == [("Purchase", "created"), ("Deposit", "created"), ("Deposit", "created"), ("Deposit", "skipped_duplicate"), ("Deposit", "created"), ("Deposit", "created")]
    path = f"file://{tmp_path}/posted"
    postings.append_created(plan, path)
    again = postings.plan_postings(ledger, spark.read.parquet(path))
    assert postings.status_counts(again).first().asDict() == {"created": 0, "skipped_duplicate": 6, "errors": 0}
    assert postings.to_create(ledger, spark.read.parquet(path)).count() == 0
    key = plan.where("row_id = 1").first().doc_number
    old = spark.createDataFrame([("Deposit", key, "55"), ("Deposit", key, "56")], POSTED)
    assert values(postings.plan_postings(ledger, old), "status", "posted_id")[1] == ("skipped_duplicate", "55")
    tried = spark.createDataFrame([("Deposit", key, None, "boom")], "txn_type string, doc_number string, id string, error string")
    assert values(postings.with_outcomes(plan, tried), "status", "detail")[1] == ("error", "Could not be created: boom")
    assert {r.status for r in postings.failed_lookups(ledger, "down").collect()} == {"error"}


def test_tries_after_failed_creates(spark, ledger):
    """Three equal rows; what the sink says of each try decides what becomes of the next."""
    fee = ledger.where("row_id = 2").drop("row_id")
    rows = spark.range(3).withColumnRenamed("id", "row_id").crossJoin(fee)
    plan = postings.plan_postings(rows, spark.createDataFrame([], POSTED))
    kind, key = plan.select("txn_type", "doc_number").first()

    def after(*tries):
        frame = spark.createDataFrame([(kind, key, k, i, e) for k, (i, e) in enumerate(tries, 1)], "txn_type string, doc_number string, attempt int, id string, error string")
        return values(postings.with_outcomes(plan, frame), "status", "posted_id")

    assert after(("7", None)) == [("created", "7"), ("skipped_duplicate", "7"), ("skipped_duplicate", "7")]
    assert after((None, "boom")) == [("error", None), ("created", None), ("skipped_duplicate", None)]
    assert after((None, "boom"), ("8", None)) == [("error", None), ("created", "8"), ("skipped_duplicate", "8")]
    assert after((None, "boom"), (None, "bang")) == [("error", None), ("error", None), ("created", None)]
    assert postings.with_outcomes(plan, plan.limit(0).selectExpr("txn_type", "doc_number", "posted_id AS id", "detail AS error")).exceptAll(plan).count() == 0


def test_lookups_that_fail_row_by_row(spark, ledger):
    missed = spark.createDataFrame([(2, "no answer")], "row_id long, error string")
    got = values(postings.plan_postings(ledger, spark.createDataFrame([], POSTED), lookup_errors=missed), "status", "detail", "turn")
    assert got[2] == ("error", "Could not be looked up: no answer", None) and got[3][0] == "created" and got[3][2] == 1


def test_first_match_and_clashing_columns(spark, ledger):
    odd = ledger.selectExpr("*", "'x' AS id", "1 AS turn", "2 AS _turn", "'y' AS doc_number", "'z' AS txn_type", "'e' AS error", "'e' AS _error")
    key = postings.with_keys(ledger).where("row_id = 1").first().doc_number
    posted = spark.createDataFrame([("Deposit", key, "10", 1), ("Deposit", key, "9", 2)], "txn_type string, doc_number string, id string, position long")
    assert values(postings.plan_postings(odd, posted), "posted_id")[1] == ("10",)  # the first that is listed
    assert values(postings.plan_postings(odd, posted.drop("position")), "posted_id")[1] == ("9",)  # the lower number
    assert postings.to_create(odd, posted).count() == 5


def test_documents(ledger):
    d = {r.row_id: r.document for r in postings.deposits(ledger, "35", "90").collect()}
    p = {r.row_id: r.document for r in postings.purchases(ledger, "35", "70").collect()}
    assert sorted(d) == [1, 2, 3, 4, 5] and sorted(p) == [0] and d[4].TxnDate is None
    assert d[1].Line[0].Amount == 3998.82 and d[1].Line[0].DepositLineDetail.AccountRef.value == "90" and d[1].DepositToAccountRef.value == "35"
    assert p[0].Line[0].Amount == 100.0 and p[0].PaymentType == "Cash" and p[0].AccountRef.type == "Account"
    assert postings.documents(ledger, "35", "90", "70").count() == 6


# OFX and CSV


def test_ofx(ledger):
    text_ = ofx.render(ledger, "12345", "checking", "111000025", now="20260701000000")
    lines = text_.split("\r\n")
    assert lines[0] == "OFXHEADER:100" and lines[9:11] == ["", "<OFX>"] and lines[-1] == "</OFX>" and text_.count("<STMTTRN>") == 5
    for x in ("<BANKMSGSRSV1>", "<BANKID>111000025", "<ACCTID>12345", "<ACCTTYPE>CHECKING", "<DTSTART>20260604", "<DTEND>20260630", "<NAME>Owner Co", "<BALAMT>3998.82", "<TRNAMT>-0.00", "<NAME>Transaction"):
        assert x in lines
    ids = re.findall("<FITID>(.*)", text_.replace("\r", ""))
    assert len(set(ids)) == 5 and ids[3] == f"{ids[2]}-2"
    card = ofx.render(ledger, "98765", "CREDITCARD")
    assert "CREDITCARDMSGSRSV1" in card and "<CCACCTFROM>" in card and "BANKID" not in card
    assert "<BANKID>0\r\n" in ofx.render(ledger, "1", "SAVINGS", "<>")


@pytest.mark.parametrize(("account", "kind"), [("1", "MONEY_MARKET"), ("", "CHECKING"), ("  ", "CHECKING")])
def test_ofx_refuses(ledger, account, kind):
    with pytest.raises(ExportError):
        ofx.render(ledger, account, kind)


def test_ofx_needs_a_date(ledger):
    with pytest.raises(ExportError):
        ofx.render(ledger.where("date IS NULL"), "1", "CHECKING")


def test_preview_and_csv(ledger, spark, tmp_path):
    got = summary.preview(ledger).first()
    assert got.summary.entry_count == 6 and [e.row_id for e in got.entries] == list(range(6)) and got.entries[4].date is None
    assert '"date":null' in summary.preview_json(ledger)
    assert values(sinks.csv_lines(ledger), "line")[1] == ('"2026-06-25","Owner & <Co>","R1","3998.82"',)
    sinks.write_csv(ledger.withColumn("description", F.lit(' x "y" ')), f"file://{tmp_path}/out")
    back = spark.read.text(f"file://{tmp_path}/out").where("value LIKE '%3998.82%'").first()[0]
    assert back == '"2026-06-25"," x ""y"" ","R1","3998.82"'
    sinks.write_ofx(ledger, f"file://{tmp_path}/ofx", "1", "SAVINGS", now="20260701000000")
    assert sinks.download_name("transactions.csv") == "transactions.qbo"


def test_numbering(spark):
    rows = [(k * k % 997, k) for k in range(2000)] + [(None, 5000)]
    got = numbering.number_rows(spark.createDataFrame(rows, "k long, t long"), "k", "t", rows_a_bucket=50).orderBy("row_id").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.k, r.t) for r in got] == want and [r.row_id for r in got] == list(range(len(rows)))


def test_numbering_with_a_key_far_off(spark):
    frame = spark.range(5000).select(F.when(F.col("id") == 0, 10**15).otherwise(F.col("id")).alias("k"), F.lit("a").alias("_key"), F.lit("b").alias("_range"))
    numbered = numbering.number_rows(frame, "k", rows_a_bucket=100)
    assert [r.row_id for r in numbered.orderBy("k").collect()] == list(range(5000)) and numbered.columns == ["k", "_key", "_range", "row_id"]
    bounds = [r[0] for r in frame.agg(F.percentile_approx("k", [j / 50 for j in range(1, 50)], 1000)).collect()][0]
    held = frame.groupBy(numbering._range(F.col("k"), sorted(set(bounds)))).count().collect()
    assert max(r[1] for r in held) < 300


def test_amounts_without_end_or_cents(spark):
    total = lambda *v: spark.createDataFrame([(x,) for x in v], "a double").agg(money.total(F.col("a"))).first()[0]
    inf = float("inf")
    assert total(0.1, 0.2, None) == 0.3 and total() == 0.0 and total(5.0, inf) == inf and total(1e17, 5.0) == 1e17 + 5.0 and str(total(inf, -inf)) == "nan"
    assert [one(spark, money.fixed2, v, "double") for v in (inf, -inf, 1e17, -0.0)] == ["inf", "-inf", "100000000000000000.00", "-0.00"]
    assert [one(spark, money.short_number, v, "double") for v in (inf, 1e17, 0.5, 100.0)] == ["Infinity", "100000000000000000", "0.5", "100"]


def test_properties(ledger):
    """Order of rows doesn't matter to sums; identifiers of a document differ; blocks add up to the balance."""
    assert summary.summary(ledger.repartition(3)).first() == summary.summary(ledger.coalesce(1)).first()
    ids = [r.fitid for r in ofx.with_ids(ledger).collect()]
    assert len(ids) == len(set(ids))
    amounts = [float(re.search(r"<TRNAMT>(.*)", r.block.replace("\r", ""))[1]) for r in ofx.blocks(ledger).collect()]
    assert round(sum(amounts), 2) == round(summary.balance(ledger).first().balance, 2)
