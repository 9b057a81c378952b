"""Queries over quotations: parsing, layout documents made from orders, extraction and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.functions.nested import exploded
from ledgerleaf.operators import layout as L
from ledgerleaf.operators import quotation as Q
from ledgerleaf.operators import reconcile as R
from ledgerleaf.plans.transcripts import dealt_keys, table


def header_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header cells made of each part's type, brand and name."""
    cell = F.concat_ws("", F.col("p_type"), F.lit(" ("), F.col("p_brand"), F.lit(")\n"), F.col("p_name"), F.lit("/No."))
    return table(spark, sf_dir, "part").select("p_partkey", Q.normalize_header(cell).alias("header"))


def parse_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written in seven ways, by line number."""
    price = F.col("l_extendedprice").cast("decimal(12,2)").cast("string")
    shapes = [price, F.concat(F.lit("EUR "), price), F.replace(price, F.lit("."), F.lit(",")), F.concat(F.lit("1,"), price), F.concat(F.lit("-"), price, F.lit(" ")), F.lit("n/a"), F.concat(price, F.lit("-"))]
    cell = F.element_at(F.array(*shapes), F.least("l_linenumber", F.lit(7)))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", Q.parse_decimal(cell).alias("amount"))


def parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in four ways, by key; the last can't be read."""
    shapes = [F.date_format("o_orderdate", f) for f in ("yyyy-MM-dd", "dd.MM.yyyy", "d/M/yyyy", "MMM d yyyy")]
    cell = F.element_at(F.array(*shapes), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", Q.parse_date(cell).alias("day"))


def quotation_items_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as quotation items. Line 5 is half a unit off, line 7 has no total."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    quantity, price = F.col("l_quantity").cast("decimal(18,6)"), F.col("p_retailprice").cast("decimal(18,6)")
    exact = F.round(quantity * price, 2).cast("decimal(18,6)")
    total = F.when(F.col("l_linenumber") == 7, None).when(F.col("l_linenumber") == 5, exact + F.lit("0.5").cast("decimal(18,6)")).otherwise(exact)
    sku = F.concat(F.lit("P-"), F.col("l_partkey"))
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(F.col("l_orderkey").alias("quotation"), F.col("l_linenumber").alias("line"), sku.alias("sku"), F.col("p_name").alias("description"), quantity.alias("quantity"), F.lit("pcs").alias("unit"), price.alias("unit_price"), F.lit(None).cast("int").alias("lead_time_days"), total.cast("decimal(18,6)").alias("line_total"), exact.alias("exact"))


def quotation_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as quotation heads. Status O is one unit off, status P has no subtotal."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("quotation"), "o_orderstatus", "o_orderdate")
    sums = quotation_items_table(spark, sf_dir).groupBy("quotation").agg(F.sum("exact").cast("decimal(18,6)").alias("exact"))
    exact = F.coalesce("exact", F.lit(0).cast("decimal(18,6)"))
    subtotal = F.when(F.col("o_orderstatus") == "P", None).when(F.col("o_orderstatus") == "O", exact + 1).otherwise(exact).cast("decimal(18,6)")
    vat = F.round(exact * F.lit("0.2").cast("decimal(3,2)"), 2).cast("decimal(18,6)")
    return orders.join(sums, "quotation", "left").select("quotation", "o_orderdate", subtotal.alias("subtotal"), F.lit(20).cast("decimal(9,4)").alias("vat_rate"), vat.alias("vat_amount"), (exact + vat).cast("decimal(18,6)").alias("total"))


def quotation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reconciliation of flat headers and items."""
    return R.reconcile_relational(quotation_headers(spark, sf_dir), quotation_items_table(spark, sf_dir), "quotation")


def nested_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct("line", *(c for c in ("sku", "description", "quantity", "unit", "unit_price", "lead_time_days", "line_total")))
    items = quotation_items_table(spark, sf_dir).groupBy("quotation").agg(F.sort_array(F.collect_list(item)).alias("items"))
    return quotation_headers(spark, sf_dir).join(items, "quotation", "left").withColumn("items", F.coalesce("items", F.array().cast(items.schema["items"].dataType)))


def quotation_line_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reconciliation of nested quotations: every check's outcome and what the line check tells."""
    done = R.reconcile_quotations(nested_quotations(spark, sf_dir))
    outcome = lambda n: F.element_at("checks", n)["status"]
    details = F.element_at("checks", "line_totals")["details"]
    told = F.coalesce(F.try_element_at(details, F.lit("mismatches")), F.try_element_at(details, F.lit("item_indexes")), F.try_element_at(details, F.lit("checked_items")))
    return done.select("quotation", *(outcome(n).alias(n) for n in R.CHECKS), F.regexp_replace(told, r'[^0-9.,]+', "").alias("told"), "validation_status", "confidence")


def quotation_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout documents of all orders with lines: a metadata table, an item table whose headers vary, text blocks."""
    n = F.col("quotation")
    cell = lambda c: c.cast("string")
    amount = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    head = lambda *names: F.array(*map(F.lit, names))
    box = lambda x, y: F.struct(*(F.lit(float(v)).alias(k) for k, v in (("x0", x), ("y0", y), ("x1", x + 10), ("y1", y + 10))))
    block = lambda i, y, c: F.struct(F.lit(i).alias("block_number"), c.alias("text"), box(0, y).alias("bbox"))
    titles = F.when(n % 2 == 0, head("SKU", "Description", "Qty", "Unit", "Unit Price\n(EUR)", "Lead time (days)", "Line Total")).otherwise(head("SKU", "Description", "Quantity", "UOM", "Price", "Lead Time", "Amount (EUR)"))
    rows = F.transform("items", lambda i: F.array(i["sku"], i["description"], cell(i["quantity"].cast("decimal(18,2)")), i["unit"], cell(i["unit_price"].cast("decimal(18,2)")), F.lit("5"), cell(i["line_total"].cast("decimal(18,2)"))))
    day = F.when(n % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    meta = F.array(F.array(F.lit("Quotation No."), F.concat(F.lit("QT-"), n), F.lit("Currency"), F.lit("EUR")), F.array(F.lit("Quotation date"), day, F.lit("Valid until"), F.lit("")))
    blocks = F.array(
        block(0, 0, F.lit("QUOTATION\nsales@example.com")),
        block(1, 5, F.lit("Example Supplies Ltd.\nVAT DE1\nsales@example.com")),
        block(2, 50, F.concat(F.lit("Subtotal EUR "), F.coalesce(amount("subtotal"), F.lit("n/a")))),
        block(3, 60, F.concat(F.lit("VAT 20%: EUR "), amount("vat_amount"))),
        block(4, 70, F.concat(F.lit("Total EUR "), amount("total"))),
        block(5, 80, F.lit("Payment terms: 30 days\nPrepared by: A. Clerk")),
    )
    made = lambda y, r: F.struct(box(0, y).alias("bbox"), r.alias("rows"))
    tables = F.array(made(20, meta), made(30, F.concat(F.array(titles), rows)))
    page = F.struct(F.lit(1).alias("page_number"), F.lit(595.0).alias("width"), F.lit(842.0).alias("height"), F.array_join(F.transform(blocks, lambda b: b["text"]), "\n").alias("text"), blocks.alias("blocks"), F.array().cast("array<struct<text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,block_number:int,line_number:int,word_number:int>>").alias("words"), tables.alias("tables"))
    blank = page.withField("page_number", F.lit(2)).withField("text", F.lit(" \n")).withField("blocks", F.array().cast("array<struct<block_number:int,text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>")).withField("tables", F.array().cast("array<struct<bbox:struct<x0:double,y0:double,x1:double,y1:double>,rows:array<array<string>>>>"))
    quotations = nested_quotations(spark, sf_dir).where(F.size("items") > 0)
    return quotations.select("quotation", F.when(n % 5 == 0, F.array(page, blank)).otherwise(F.array(page)).alias("pages"))


def quotation_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads, terms and line fields extracted from the layouts."""
    return Q.extract_quotations(quotation_layouts(spark, sf_dir)).select("quotation", "engine", "document_type", "supplier_name", "quotation_number", "quotation_date", "valid_until", "currency", "payment_terms", "prepared_by")


def quotation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals extracted from the layouts."""
    return Q.as_decimals(Q.extract_quotations(quotation_layouts(spark, sf_dir))).select("quotation", "subtotal", "vat_rate", "vat_amount", "total")


def quotation_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items extracted from the layouts, one row each."""
    items = exploded(Q.as_decimals(Q.extract_quotations(quotation_layouts(spark, sf_dir))), "items", "at", "item", "quotation")
    return items.select("quotation", (F.col("at") + 1).alias("line"), "item.*")


def wide_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts of all orders with amounts of forty digits and of seven decimals; some are off by a few hundredths."""
    n = F.col("o_orderkey")
    row = lambda *cells: F.array(*((F.lit(x) if isinstance(x, str) else x).cast("string") for x in cells))
    large = lambda times, zeros, rest: F.concat((n * times).cast("string"), F.lit("0" * zeros + rest))
    box = F.struct(*(F.lit(float(v)).alias(k) for k, v in (("x0", 0), ("y0", 0), ("x1", 1), ("y1", 1))))
    ends = F.when(n % 4 == 0, "7").when(n % 4 == 1, "6").otherwise("5")
    rows = F.array(row("SKU", "Description", "Qty", "Unit Price", "Line Total"), row("A", "large", "3", large(1, 32, ".25"), F.concat(large(3, 32, ".7"), ends)), row("B", "small", "0.0000005", "20000000", "10,00"))
    texts = [F.concat(F.lit("Subtotal "), large(3, 30, "10."), F.when(n % 5 == 0, "95").otherwise("75")), F.concat(F.lit("VAT 20%: "), large(6, 30, "2.15")), F.concat(F.lit("Total "), large(36, 29, "12.90"))]
    blocks = F.array(*(F.struct(F.lit(i).alias("block_number"), t.alias("text"), box.alias("bbox")) for i, t in enumerate(texts)))
    page = F.struct(blocks.alias("blocks"), F.array(F.struct(rows.alias("rows"))).alias("tables"))
    return dealt_keys(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", F.array(page).alias("pages"))


def quotation_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of any width extracted and reconciled: one item's price, and every check."""
    done = R.reconcile_quotations(Q.extract_quotations(wide_layouts(spark, sf_dir)))
    check = lambda n: F.element_at("checks", n)
    told = [F.try_element_at(check(n)["details"], F.lit("expected")).alias(f"{n}_expected") for n in R.CHECKS[1:]]
    return done.select("o_orderkey", F.get("items", F.lit(0))["unit_price"].alias("unit_price"), F.size("items").alias("n_items"), *(check(n)["status"].alias(n) for n in R.CHECKS), *told, "validation_status", "confidence")


def layout_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page, text and table statistics of the layouts."""
    done = L.layout_stats(quotation_layouts(spark, sf_dir))
    return done.select("quotation", "page_count", "pages_with_text", F.array_join(F.col("empty_page_numbers").cast("array<string>"), ",").alias("empty_pages"), "needs_ocr", "word_count", "block_count", "table_count")


def table_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and columns of every table of the layouts."""
    tables = L.explode_layout(L.clean_layout(quotation_layouts(spark, sf_dir)), "table", "quotation")
    rows, columns = L.table_dims(F.col("rows"))
    return tables.select("quotation", "page_index", "table_index", rows.alias("n_rows"), columns.alias("n_columns"))


QUERIES = {f.__name__: f for f in (header_normalize, parse_decimal, parse_date, quotation_status, quotation_line_checks, quotation_metadata, quotation_totals, quotation_items, quotation_wide, layout_stats, table_dims)}

_ITEMS = """
  items as (select l_orderkey as quotation, l_linenumber as line, 'P-' || l_partkey as sku, p_name as description,
      cast(l_quantity as decimal(18,6)) as quantity, cast(p_retailprice as decimal(18,6)) as unit_price,
      cast(round(cast(cast(l_quantity as decimal(18,6)) as decimal(38,6)) * cast(p_retailprice as decimal(18,6)), 2) as decimal(18,6)) as exact
    from lineitem join part on l_partkey = p_partkey),
  priced as (select *, case when line = 7 then null when line = 5 then exact + 0.5 else exact end::decimal(18,6) as line_total from items),
  sums as (select quotation, sum(exact)::decimal(18,6) as exact, count(*) as n, count(*) filter (where line_total is null) as lacking,
      count(*) filter (where abs(round(exact, 2) - round(line_total, 2)) > 0.01) as wrong, sum(line_total) as lines from priced group by quotation),
  heads as (select o_orderkey as quotation, o_orderdate, n, lacking, wrong, lines, coalesce(exact, 0)::decimal(18,6) as exact,
      case o_orderstatus when 'P' then null when 'O' then coalesce(exact, 0) + 1 else coalesce(exact, 0) end::decimal(18,6) as subtotal,
      round(coalesce(exact, 0)::decimal(38,6) * 0.2, 2)::decimal(18,6) as vat_amount from orders left join sums on o_orderkey = quotation),
  checked as (select quotation, n, lacking, wrong, exact, subtotal, vat_amount, o_orderdate,
      case when n is null then 'skipped' when wrong > 0 then 'failed' when lacking > 0 then 'skipped' else 'passed' end as line_totals,
      case when subtotal is null or n is null or lacking > 0 then 'skipped' when abs(round(lines, 2) - round(subtotal, 2)) > 0.01 then 'failed' else 'passed' end as subtotal_check,
      case when subtotal is null then 'skipped' when abs(round(subtotal::decimal(38,6) * 0.2, 2) - round(vat_amount, 2)) > 0.01 then 'failed' else 'passed' end as vat_check,
      case when subtotal is null then 'skipped' when abs(round(subtotal + vat_amount, 2) - round(exact + vat_amount, 2)) > 0.01 then 'failed' else 'passed' end as grand_total_check
    from heads),
  judged as (select *, case when 'failed' in (line_totals, subtotal_check, vat_check, grand_total_check) then 'invalid'
      when 'skipped' in (line_totals, subtotal_check, vat_check, grand_total_check) then 'incomplete' else 'valid' end as validation_status,
      ((line_totals = 'passed')::int + (subtotal_check = 'passed')::int + (vat_check = 'passed')::int + (grand_total_check = 'passed')::int) / 4.0::double as confidence from checked)"""

ORACLES = {
    "header_normalize": r"""select p_partkey, trim(regexp_replace(lower(regexp_replace(replace(p_type || ' (' || p_brand || ')' || chr(10) || p_name || '/No.', chr(10), ' '), '\([^)]*\)', '', 'g')), '[^a-z0-9]+', ' ', 'g')) as header from part""",
    "parse_decimal": """with p as (select l_orderkey, l_linenumber, cast(l_extendedprice as decimal(12,2)) as v from lineitem)
        select l_orderkey, l_linenumber, case least(l_linenumber, 7) when 1 then v when 2 then v when 3 then v when 4 then cast('1' || v::varchar as decimal(18,6)) when 5 then -v end::decimal(18,6) as amount from p""",
    "parse_date": "select o_orderkey, case when o_orderkey % 4 < 3 then o_orderdate::date end as day from orders",
    "quotation_status": f"with {_ITEMS} select quotation, line_totals, subtotal_check, vat_check, grand_total_check, validation_status, confidence from judged",
    "quotation_line_checks": f"""with {_ITEMS}, placed as (select *, row_number() over (partition by quotation order by line, sku, description, quantity) as place from priced), wrong_lines as (select quotation, string_agg(regexp_replace(to_json({{'item_index': place, 'sku': sku, 'expected': cast(exact as decimal(38,2))::varchar, 'actual': cast(line_total as decimal(38,2))::varchar}})::varchar, '[^0-9.,]+', '', 'g'), ',' order by place) as t
          from placed where line = 5 group by quotation),
        lacking_lines as (select quotation, string_agg(place::varchar, ',' order by place) as t from placed where line = 7 group by quotation)
        select quotation, line_totals, subtotal_check as subtotal, vat_check as vat, grand_total_check as grand_total,
          case line_totals when 'failed' then w.t when 'passed' then n::varchar else l.t end as told, validation_status, confidence
        from judged left join wrong_lines w using (quotation) left join lacking_lines l using (quotation)""",
    "quotation_metadata": f"""with {_ITEMS} select quotation, 'deterministic_supplier_quotation_v1' as engine, 'supplier_quotation' as document_type, 'Example Supplies Ltd.' as supplier_name,
        'QT-' || quotation as quotation_number, o_orderdate::date as quotation_date, null::date as valid_until, 'EUR' as currency, '30 days' || chr(10) || 'Prepared by: A. Clerk' as payment_terms, 'A. Clerk' as prepared_by
        from heads where n > 0""",
    "quotation_totals": f"""with {_ITEMS} select quotation, subtotal, 20::decimal(9,4) as vat_rate, vat_amount, (exact + vat_amount)::decimal(18,6) as total from heads where n > 0""",
    "quotation_items": f"""with {_ITEMS} select quotation, row_number() over (partition by quotation order by line, sku, description, quantity)::int as line, sku, description, quantity, 'pcs' as unit, unit_price, 5 as lead_time_days, line_total from priced""",
    "quotation_wide": """with made as (select o_orderkey as n, case when o_orderkey = 0 then '' else '0' end as z, case o_orderkey % 4 when 0 then 2 when 1 then 1 else 0 end as off, case when o_orderkey % 5 = 0 then 20 else 0 end as more from orders),
        told as (select n, z, case when off > 1 then 'failed' else 'passed' end as line_totals, case when abs(off - more) > 1 then 'failed' else 'passed' end as subtotal,
          case when more > 0 then 'failed' else 'passed' end as vat, off, more from made)
        select n as o_orderkey, n::varchar || repeat(z, 32) || '.25' as unit_price, 2 as n_items, line_totals, subtotal, vat, vat as grand_total,
          case when n > 0 then (3 * n)::varchar || repeat(z, 30) else '' end || '10.7' || (5 + off) as subtotal_expected, case when n > 0 then (6 * n)::varchar || repeat(z, 30) else '' end || case when more > 0 then '2.19' else '2.15' end as vat_expected,
          case when n > 0 then (36 * n)::varchar || repeat(z, 29) else '' end || case when more > 0 then '13.10' else '12.90' end as grand_total_expected,
          case when 'failed' in (line_totals, subtotal, vat) then 'invalid' else 'valid' end as validation_status,
          ((line_totals = 'passed')::int + (subtotal = 'passed')::int + 2 * (vat = 'passed')::int) / 4.0::double as confidence from told""",
    "layout_stats": f"""with {_ITEMS} select quotation, case when quotation % 5 = 0 then 2 else 1 end as page_count, 1 as pages_with_text, case when quotation % 5 = 0 then '2' else '' end as empty_pages,
        false as needs_ocr, 0 as word_count, 6 as block_count, 2 as table_count from heads where n > 0""",
    "table_dims": f"""with {_ITEMS} select quotation, 0 as page_index, t as table_index, case t when 0 then 2 else n + 1 end::int as n_rows, case t when 0 then 4 else 7 end as n_columns
        from heads, (values (0), (1)) v(t) where n > 0""",
}
