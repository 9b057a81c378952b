"""Extraction and reconciliation of quotations on small documents."""

import random
import re
from datetime import date
from decimal import ROUND_HALF_UP, Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from ledgerleaf.functions import text, wide
from ledgerleaf.operators import layout as L
from ledgerleaf.operators import quotation as Q
from ledgerleaf.operators import reconcile as R
from ledgerleaf.plans.details import quirk_layouts
from ledgerleaf.plans.quotations import wide_layouts

DECIMAL_ITEM = Q.ITEM.replace("quantity:string", "quantity:decimal(18,6)").replace("unit_price:string", "unit_price:decimal(18,6)").replace("line_total:string", "line_total:decimal(18,6)")
BOX = (0.0, 0.0, 1.0, 1.0)


def block(n, y, body, x=0.0):
    return (n, body, (x, y, x + 1, y + 1))


ITEMS = [
    ["SKU", "Description", "Qty", "Unit", "Unit Price\n(EUR)", "Lead time (days)", "Line\nTotal"],
    ["AX-1", "Sensor", "20", "pcs", "12.50", "5", "250.00"],
    ["BX-2", "Cable", "1,5", "", "1,000.00", "2.5", None],
    ["", "no sku", "1", "", "", "", ""],
    ["CX-3", "no number", "many"],
    ["DX-4", "short row", "3"],
]
META = [["Quotation No.", "Q-1", "Currency", "EUR"], ["Quotation date", "30.09.2026", "Valid until", "2026-10-15"], ["Customer ref", "R-1", "Quotation number", "Q-2"], ["Incoterms", " DAP "]]
BLOCKS = [
    block(0, 9.0, "Second Ltd.\nx@example.com"),
    block(1, 1.0, "Quotation\nsales@example.com"),
    block(2, 2.0, " First Ltd. \n\nVAT DE1"),
    block(3, 20.0, "Subtotal EUR 1,457.00"),
    block(4, 21.0, "VAT 20%: EUR 291.40"),
    block(5, 22.0, "Total EUR 1,748.40"),
    block(6, 23.0, "Payment terms: 30%: advance"),
    block(7, 24.0, "Notes: none\nPrepared by: A. Clerk\nQuote status: Issued"),
]


@pytest.fixture(scope="module")
def made(spark):
    pages = [(1, 1.0, 1.0, "text", BLOCKS, [("w", BOX, 1, 1, 1)], [(BOX, META), (BOX, ITEMS)]), (2, 1.0, 1.0, " \n", [], [], [])]
    df = spark.createDataFrame([(pages,), ([],), (None,)], L.LAYOUT_SCHEMA)
    return df, Q.as_decimals(Q.extract_quotations(df)).collect()


def test_extraction(made):
    q = made[1][0]
    assert (q.engine, q.document_type, q.confidence) == (Q.ENGINE, "supplier_quotation", None)
    assert (q.supplier_name, q.quotation_number, q.currency, q.customer_reference, q.incoterms) == ("First Ltd.", "Q-1", "EUR", "R-1", "DAP")
    assert (q.quotation_date, q.valid_until) == (date(2026, 9, 30), date(2026, 10, 15))
    assert (q.subtotal, q.vat_rate, q.vat_amount, q.total) == (Decimal("1457"), Decimal("20"), Decimal("291.4"), Decimal("1748.4"))
    assert (q.payment_terms, q.prepared_by, q.quote_status) == ("30%: advance", "A. Clerk", "Issued")
    assert q.notes == "none\nPrepared by: A. Clerk\nQuote status: Issued"
    assert [tuple(i) for i in q["items"]] == [
        ("AX-1", "Sensor", Decimal(20), "pcs", Decimal("12.5"), 5, Decimal(250)),
        ("BX-2", "Cable", Decimal("1.5"), "", Decimal(1000), None, None),
        ("DX-4", "short row", Decimal(3), "", None, None, None),
    ]


def test_documents_without_pages(made):
    for q in made[1][1:]:
        assert q.supplier_name is None and q["items"] == [] and q.subtotal is None


def test_layout_statistics(spark, made):
    first, none, null = L.layout_stats(made[0]).collect()
    assert (first.page_count, first.pages_with_text, first.empty_page_numbers, first.needs_ocr, first.text_length) == (2, 1, [2], False, 4)
    assert (first.word_count, first.block_count, first.table_count) == (1, 8, 2)
    assert (none.page_count, none.needs_ocr) == (0, False) and null.page_count == 0
    cells = L.explode_layout(L.clean_layout(made[0]), "cell").where("table_index = 1 and row_index = 2").orderBy("column_index").collect()
    assert [c.cell for c in cells] == ["BX-2", "Cable", "1,5", None, "1,000.00", "2.5", None]


def test_numbers_and_dates(spark):
    exact = {"1234567890123456.25": "1234567890123456.25", "0.0000005": "0.0000005", "EUR +007,50": "7.50", "9" * 45: "9" * 45, "-.5": "-0.5", "5-": None}
    got = spark.createDataFrame([(c,) for c in exact], "c string").select(Q.parse_number(F.col("c")).alias("d")).collect()
    assert [r.d for r in got] == list(exact.values())
    cells = {"1,234": "1.234", "1.234,56": "1.23456", "EUR 12.50": "12.5", "-3": "-3", "5-": None, "": None, "n/a": None, "1.2.3": None, ".5": "0.5", "100\n200": "100200"}
    got = spark.createDataFrame([(c,) for c in cells], "c string").select(Q.parse_decimal(F.col("c")).alias("d")).collect()
    assert [r.d for r in got] == [None if v is None else Decimal(v) for v in cells.values()]
    days = {"2026-09-30": date(2026, 9, 30), " 1.2.2026 ": date(2026, 2, 1), "31/02/2026": None, "30 Sep": None, None: None}
    got = spark.createDataFrame([(c,) for c in days], "c string").select(Q.parse_date(F.col("c")).alias("d")).collect()
    assert [r.d for r in got] == list(days.values())


def test_headers(spark):
    cells = {"Unit Price\n(EUR)": "unit price", " Quotation No. ": "quotation no", None: "", "A(b)c/D": "ac d"}
    got = spark.createDataFrame([(c,) for c in cells], "c string").select(Q.normalize_header(F.col("c")).alias("h")).collect()
    assert [r.h for r in got] == list(cells.values())


ROWS = [("AX-100", "20", "12.50", "250.00"), ("BX-240", "8", "38.75", "310.00"), ("CBL", "30", "9.80", "294.00"), ("PSU", "6", "46.00", "276.00"), ("SNS", "12", "27.25", "327.00")]


def quotation(change=None, subtotal="1457.00"):
    rows = [list(r) for r in ROWS]
    if change:
        rows[0][change[0]] = change[1]
    d = lambda x: None if x is None else Decimal(x)
    items = [(s, s, d(q), "pcs", d(p), None, d(t)) for s, q, p, t in rows]
    return items, d(subtotal), Decimal(20), Decimal("291.40"), Decimal("1748.40")


def test_reconciliation(spark):
    cases = [quotation(), quotation((3, "251.00")), quotation((2, None)), ([], None, None, None, None), quotation(subtotal="1456.99")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"n int, items array<{DECIMAL_ITEM}>, subtotal decimal(18,6), vat_rate decimal(9,4), vat_amount decimal(18,6), total decimal(18,6)")
    got = R.reconcile_quotations(df).orderBy("n").collect()
    status = lambda r: [r.checks[n]["status"] for n in R.CHECKS]
    assert [(r.validation_status, r.confidence) for r in got] == [("valid", 1.0), ("invalid", 0.5), ("incomplete", 0.75), ("incomplete", 0.0), ("valid", 1.0)]
    assert status(got[1]) == ["failed", "failed", "passed", "passed"] and status(got[2]) == ["skipped", "passed", "passed", "passed"]
    assert got[1].checks["line_totals"]["details"] == {"mismatches": '[{"item_index":1,"sku":"AX-100","expected":"250.00","actual":"251.00"}]'}
    assert got[2].checks["line_totals"]["details"] == {"item_indexes": "[1]"}
    assert got[1].checks["subtotal"]["details"] == {"expected": "1458.00", "actual": "1457.00"}
    assert got[3].checks["line_totals"]["message"] == R.MESSAGES["line_totals", "none"]
    header = df.select("n", "subtotal", "vat_rate", "vat_amount", "total")
    flat = R.reconcile_relational(header, df.select("n", F.inline("items")), "n").orderBy("n").collect()
    assert [(r.validation_status, r.confidence) for r in flat] == [(r.validation_status, r.confidence) for r in got]


def test_money_rounds_halves_away_from_zero(spark):
    got = spark.createDataFrame([(Decimal(x),) for x in ("-0.125", "0.005", "1.004999")], "x decimal(18,6)").select(R.money(F.col("x")).alias("m")).collect()
    assert [r.m for r in got] == [Decimal("-0.13"), Decimal("0.01"), Decimal("1.00")]


def test_texts_reconcile_like_decimals(spark):
    cases = [quotation(), quotation((3, "251.00")), quotation((2, None)), ([], None, None, None, None), quotation(subtotal="1456.99")]
    kinds = f"n int, items array<{DECIMAL_ITEM}>, subtotal decimal(18,6), vat_rate decimal(9,4), vat_amount decimal(18,6), total decimal(18,6)"
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], kinds)
    plain = lambda c: F.regexp_replace(c.cast("string"), r"\.?0+$", "")
    texts = df.withColumns({n: plain(F.col(n)) for n in ("subtotal", "vat_rate", "vat_amount", "total")})
    texts = texts.withColumn("items", F.transform("items", lambda i: i.withField("quantity", i["quantity"].cast("string")).withField("unit_price", i["unit_price"].cast("string")).withField("line_total", i["line_total"].cast("string"))))
    one, two = (R.reconcile_quotations(x).orderBy("n").select("checks", "validation_status", "confidence").collect() for x in (df, texts))
    assert one == two


def test_arithmetic_of_any_width(spark):
    """Against Python's decimals, with up to eighty digits."""
    rng = random.Random(8)

    def some():
        whole, part = ("".join(rng.choices("0123456789", k=rng.choice(k))) for k in ((1, 3, 6, 7, 12, 25, 40), (0, 0, 1, 2, 3, 7, 20)))
        return rng.choice(["", "-"]) + (whole.lstrip("0") or "0") + (f".{part}" if part else "")

    rows = [(some(), some()) for _ in range(150)] + [("999999.995", "0.005"), ("-0.125", "1"), ("-999999999999.995", "-1"), ("0", "0"), (None, "1")]
    a, b = F.col("a"), F.col("b")
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", wide.total(F.array(a, b, a)).alias("sum"), wide.product(a, b).alias("product"), wide.rounded(a, 2).alias("money"), wide.product(a, b, 2, 2).alias("share"), wide.total(F.array(a, wide.negated(b)), 2).alias("apart"))
    cent = Decimal("0.01")
    with localcontext() as context:
        context.prec = 200
        for r in df.withColumn("far", wide.exceeds(F.col("apart"), "0.01")).collect():
            if r.a is None:
                assert r["sum"] is None and r.product is None and r.money is None
                continue
            x, y = Decimal(r.a), Decimal(r.b)
            money = lambda v: v.quantize(cent, ROUND_HALF_UP)
            assert (Decimal(r["sum"]), Decimal(r.product), Decimal(r.money), Decimal(r.share)) == (x + y + x, x * y, money(x), money(x * y / 100)), r
            assert r.money[-3] == "." and r.far == (abs(money(x - y)) > cent)


def test_an_item_of_any_width_is_kept(spark):
    row = ["X", "wide", "1" * 30, "", "0.0000005", "", "9" * 40]
    df = spark.createDataFrame([([(1, 1.0, 1.0, "t", [], [], [(BOX, [ITEMS[0], row])])],)], L.LAYOUT_SCHEMA)
    (item,) = Q.extract_quotations(df).first()["items"]
    assert (item.quantity, item.unit_price, item.line_total) == ("1" * 30, "0.0000005", "9" * 40)
    checked = R.reconcile_quotations(Q.extract_quotations(df)).first().checks["line_totals"]
    assert checked["status"] == "failed" and '"expected":"55555555555555555555555.56"' in checked["details"]["mismatches"]
    (none,) = Q.as_decimals(Q.extract_quotations(df)).first()["items"]
    assert none.quantity is None


@pytest.mark.parametrize("made", [quirk_layouts, wide_layouts])
def test_layouts_are_dealt_to_all_tasks(spark, made):
    """A small file of keys is one task; what is made of a key costs more than it tells."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = made(spark, "/root/testdata/sf0.001")
    assert parts > 1 and df.select(F.spark_partition_id().alias("p")).distinct().count() == parts


def test_cells_are_read_once(spark):
    """Nested expressions are interpreted, and each use of a part would make it anew."""
    df = spark.createDataFrame([("EUR 1,234.50",)], "cell string")
    for made in (Q.parse_number, Q.parse_date, lambda c: wide.exceeds(c, "0.01")):
        uses = df.select(made(F.upper("cell")).alias("x"))._jdf.queryExecution().analyzed().toString()
        assert uses.count("upper(") == 1


def test_strip_equals_its_pattern(spark):
    spaces = [chr(i) for i in range(0x3100) if re.fullmatch(rf"[{text.SPACE}]", chr(i))]
    texts = [a + b + c for a in (*spaces, "", "\r\n \t") for b in ("x", "é y", "", "​", "퟿") for c in (*spaces[::3], "", "　 ")]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.strip(F.col("t")).alias("got"))
    assert all(r.got == re.sub(rf"\A[{text.SPACE}]+|[{text.SPACE}]+\Z", "", r.t) for r in df.collect())
    assert text.SPACES == "".join(spaces)


def test_headers_are_normalised_once_a_table(spark):
    """Once for the first rows of tables, whatever asks for them, and once for the keys of metadata."""
    df = Q.extract_quotations(spark.createDataFrame([], L.LAYOUT_SCHEMA))
    assert df._jdf.queryExecution().analyzed().toString().count("[^a-z0-9]+") == 2
