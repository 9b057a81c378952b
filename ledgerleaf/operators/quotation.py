"""Supplier quotations from layout documents: header, items, totals and terms, as one projection per document."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions import text, wide

ENGINE, DOCUMENT_TYPE = "deterministic_supplier_quotation_v1", "supplier_quotation"
#: The type of amounts in ``as_decimals``; those extracted are text, of any width.
MONEY, RATE = "decimal(18,6)", "decimal(9,4)"

#: What headers and labels are called, in order of preference.
NUMBER_LABELS = ("quotation no", "quotation number", "quote no", "quote number")
HEADER_FIELDS = {
    "quotation_number": NUMBER_LABELS,
    "quotation_date": ("quotation date", "quote date"),
    "valid_until": ("valid until", "valid through"),
    "currency": ("currency",),
    "customer_reference": ("customer ref", "customer reference"),
    "incoterms": ("incoterms",),
}
EXACT_COLUMNS = {
    "sku": ("sku", "item code", "product code", "part number", "part no"),
    "description": ("description", "item description", "product description", "item"),
    "quantity": ("qty", "quantity"),
    "unit": ("unit", "uom"),
}
PREFIX_COLUMNS = {
    "unit_price": ("unit price", "price"),
    "lead_time": ("lead time",),
    "line_total": ("line total", "total price", "amount"),
}
TERMS = {"payment_terms": "payment terms:", "delivery": "delivery:", "warranty": "warranty:", "notes": "notes:"}
LINE_FIELDS = {"prepared_by": "prepared by:", "quote_status": "quote status:"}
NUMBER = rf"[-+]?\d[\d.,{text.SPACE}]*"
ITEM = "struct<sku:string,description:string,quantity:string,unit:string,unit_price:string,lead_time_days:int,line_total:string>"
AMOUNTS, ITEM_AMOUNTS = ("subtotal", "vat_amount", "total"), ("quantity", "unit_price", "line_total")


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value made once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalize_header(c: Column) -> Column:
    """Lower-case words of a header cell without what stands in brackets; null is empty."""

    def words(low: Column) -> Column:
        plain = F.regexp_replace(F.replace(low, F.lit("\n"), F.lit(" ")), r"\([^)]*\)", "")
        return F.when(low.rlike(r"\A[a-z0-9]+(?: [a-z0-9]+)*\z"), low).otherwise(F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " ")))

    return bind(F.lower(F.coalesce(c, F.lit(""))), words)


def clean_cell(c: Column) -> Column:
    return text.strip(F.coalesce(c, F.lit("")))


def parse_number(c: Column) -> Column:
    """The number in a cell, exactly, as plain text: with both marks a comma groups, alone it is the decimal mark;
    otherwise null."""

    def plain(digits: Column) -> Column:
        comma, dot = F.contains(digits, F.lit(",")), F.contains(digits, F.lit("."))
        return F.when(~comma, digits).when(dot, F.replace(digits, F.lit(","), F.lit(""))).otherwise(F.replace(digits, F.lit(","), F.lit(".")))

    return wide.number(bind(F.regexp_replace(c, r"[^\d,.\-+]+", ""), plain))


def parse_decimal(c: Column) -> Column:
    """``parse_number`` of a cell as a decimal; null where it has too many digits."""
    return parse_number(c).try_cast(MONEY)


def parse_date(c: Column) -> Column:
    """Year-month-day, or day, month and year between dots or slashes; otherwise null."""
    def read(value: Column) -> Column:
        shaped = lambda pattern, form: F.when(value.rlike(pattern), F.try_to_date(value, form))
        return F.coalesce(shaped(r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), shaped(r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"), shaped(r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"))

    return bind(text.strip(c), read)


def _flat(pages: Column, part: str) -> Column:
    """All tables or blocks of a document in reading order."""
    return F.flatten(F.transform(pages, lambda p: p[part]))


def headed_tables(pages: Column) -> Column:
    """All tables in reading order: their rows, and the cells of the first row as headers."""
    headers = lambda rows: F.transform(F.get(rows, F.lit(0)), normalize_header)
    return F.transform(_flat(pages, "tables"), lambda t: F.struct(t["rows"].alias("rows"), headers(t["rows"]).alias("headers")))


def is_metadata_table(table: Column) -> Column:
    """Whether a table's first row has a quotation number's label and the currency's."""
    h = table["headers"]
    return F.coalesce(F.arrays_overlap(h, F.array(*map(F.lit, NUMBER_LABELS))) & F.array_contains(h, "currency"), F.lit(False))


def is_item_table(table: Column) -> Column:
    h = table["headers"]
    return F.coalesce(F.array_contains(h, "sku") & F.array_contains(h, "description") & (F.array_contains(h, "qty") | F.array_contains(h, "quantity")), F.lit(False))


def metadata_pairs(tables: Column) -> Column:
    """(key, value) cells of all metadata tables in order: columns 0 and 1, 2 and 3, ...; half-empty ones dropped."""

    def of_row(row: Column) -> Column:
        numbers = F.when(F.size(row) > 1, F.sequence(F.lit(0), F.floor(F.size(row) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda i: F.struct(normalize_header(F.get(row, i * 2)).alias("key"), clean_cell(F.get(row, i * 2 + 1)).alias("value")))

    pairs = F.flatten(F.flatten(F.transform(F.filter(tables, is_metadata_table), lambda t: F.transform(t["rows"], of_row))))
    return F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != ""))


def _has_key(key: str):
    return lambda p: p["key"] == key


def _field(name: str):
    return lambda x: x[name]


def metadata_value(pairs: Column, aliases: tuple[str, ...]) -> Column:
    """The last value of the first alias that has one."""
    return F.coalesce(*(F.try_element_at(F.filter(pairs, _has_key(a)), F.lit(-1))["value"] for a in aliases))


def header_index(headers: Column, aliases: tuple[str, ...]) -> Column:
    """0-based place of the first alias that is a header; null if none is."""
    return F.coalesce(*(F.nullif(F.array_position(headers, a), F.lit(0)) for a in aliases)) - 1


def header_prefix(headers: Column, prefixes: tuple[str, ...]) -> Column:
    """0-based place of the first header that begins with any prefix; null if none does."""
    hits = F.transform(headers, lambda h: reduce(or_, (h.startswith(p) for p in prefixes)))
    return F.nullif(F.array_position(hits, True), F.lit(0)) - 1


def extract_items(table: Column) -> Column:
    """Items of an item table: rows with sku, description and a numeric quantity."""

    def with_places(at: Column) -> Column:
        def cell(row: Column, name: str) -> Column:
            return F.when(at[name].isNotNull(), clean_cell(F.get(row, at[name].cast("int"))))

        def item(row: Column) -> Column:
            lead = parse_number(cell(row, "lead_time"))
            return F.struct(
                cell(row, "sku").alias("sku"),
                cell(row, "description").alias("description"),
                parse_number(cell(row, "quantity")).alias("quantity"),
                cell(row, "unit").alias("unit"),
                parse_number(cell(row, "unit_price")).alias("unit_price"),
                F.regexp_replace(lead, r"\.0*$", "").try_cast("int").alias("lead_time_days"),
                parse_number(cell(row, "line_total")).alias("line_total"),
            )

        rows = F.slice(table["rows"], 2, F.greatest(F.size(table["rows"]) - 1, F.lit(0)))
        return F.filter(F.transform(rows, item), lambda i: F.coalesce((i["sku"] != "") & (i["description"] != ""), F.lit(False)) & i["quantity"].isNotNull())

    places = lambda h: F.struct(*(header_index(h, a).alias(n) for n, a in EXACT_COLUMNS.items()), *(header_prefix(h, p).alias(n) for n, p in PREFIX_COLUMNS.items()))
    return F.coalesce(bind(bind(table["headers"], places), with_places), F.array().cast(f"array<{ITEM}>"))


def supplier_name(pages: Column) -> Column:
    """First line of the first block, from the top, that looks like an address head and doesn't name a quotation."""

    def of_block(b: Column) -> Column:
        low = F.lower(b["text"])
        lines = F.filter(F.transform(text.split_lines(text.strip(b["text"])), text.strip), lambda x: x != "")
        looks = bind(low, lambda t: ~F.contains(t, F.lit("quotation")) & (F.contains(t, F.lit("@")) | F.contains(t, F.lit("vat"))))
        return F.when(looks, bind(lines, lambda x: F.when(F.size(x) > 1, F.get(x, F.lit(0)))))

    def of_page(p: Column) -> Column:
        placed = F.transform(p["blocks"], lambda b, i: F.struct(b["bbox"]["y0"].alias("y"), b["bbox"]["x0"].alias("x"), i.alias("i"), b["text"].alias("text")))
        return F.transform(F.array_sort(placed), of_block)

    return F.get(F.array_compact(F.flatten(F.transform(pages, of_page))), F.lit(0))


def _last(values: Column) -> Column:
    return F.try_element_at(F.array_compact(values), F.lit(-1))


def _after_colon(c: Column) -> Column:
    return text.strip(F.regexp_replace(c, r"(?s)\A[^:]*:", ""))


def block_facts(pages: Column) -> Column:
    """What each block says of totals and terms, in reading order."""

    def of_block(raw: Column) -> Column:
        body = text.strip(F.coalesce(raw["text"], F.lit("")))
        return bind(bind(body, lambda t: F.struct(t.alias("body"), F.lower(t).alias("low"))), lambda x: of_text(x["body"], x["low"]))

    def of_text(body: Column, low: Column) -> Column:
        said = low.rlike(r"\A(subtotal|vat|total)")
        numbers = F.array_compact(F.transform(F.regexp_extract_all(body, F.lit(NUMBER), F.lit(0)), parse_number))

        def told(n: Column) -> Column:
            some, last = F.size(n) > 0, F.try_element_at(n, F.lit(-1))
            is_sub, is_vat, is_total = (low.startswith(w) & some for w in ("subtotal", "vat", "total"))
            return F.struct(
                F.when(is_sub, last).alias("subtotal"),
                F.when(is_vat & F.contains(body, F.lit("%")) & (F.size(n) >= 2), F.get(n, F.lit(0))).alias("vat_rate"),
                F.when(is_vat, last).alias("vat_amount"),
                F.when(is_total, last).alias("total"),
                *(F.when(low.startswith(p), _after_colon(body)).alias(name) for name, p in TERMS.items()),
            )

        # Numbers are looked for only where a total may be said; no such text begins as a term does.
        return bind(F.when(said, numbers).otherwise(F.array().cast("array<string>")), told)

    return F.transform(_flat(pages, "blocks"), of_block)


def line_facts(pages: Column) -> Column:
    """What single lines of any block say, in reading order."""
    lines = F.flatten(F.transform(_flat(pages, "blocks"), lambda b: F.transform(text.split_lines(text.strip(F.coalesce(b["text"], F.lit("")))), text.strip)))
    told = lambda x, low: F.struct(*(F.when(low.startswith(p), _after_colon(x)).alias(name) for name, p in LINE_FIELDS.items()))
    return F.transform(lines, lambda x: bind(F.lower(x), lambda low: told(x, low)))


def extract_quotations(df: DataFrame) -> DataFrame:
    """Add the quotation of each layout document: engine, document_type, confidence and the quotation's columns.

    Amounts are texts that hold every digit; ``as_decimals`` makes them decimals.
    """
    pages = F.coalesce("pages", F.array().cast(df.schema["pages"].dataType))
    df = df.withColumn("_tables", headed_tables(pages))
    item_table = F.get(F.filter("_tables", is_item_table), F.lit(0))
    df = df.withColumns({"_pairs": metadata_pairs(F.col("_tables")), "_blocks": block_facts(pages), "_lines": line_facts(pages), "_items": item_table})
    fields = {name: metadata_value(F.col("_pairs"), aliases) for name, aliases in HEADER_FIELDS.items()}
    for name in ("quotation_date", "valid_until"):
        fields[name] = parse_date(fields[name])
    told = {name: _last(F.transform("_blocks", _field(name))) for name in ("subtotal", "vat_rate", "vat_amount", "total", *TERMS)}
    lines = {name: _last(F.transform("_lines", _field(name))) for name in LINE_FIELDS}
    made = {"engine": F.lit(ENGINE), "document_type": F.lit(DOCUMENT_TYPE), "confidence": F.lit(None).cast("double"), "supplier_name": supplier_name(pages)}
    return df.withColumns({**made, **fields, "items": extract_items(F.col("_items")), **told, **lines}).drop("_tables", "_pairs", "_blocks", "_lines", "_items")


def as_decimals(df: DataFrame) -> DataFrame:
    """Extracted quotations with their amounts as decimals, rounded to six digits; null where one has too many."""
    items = F.transform("items", lambda i: reduce(lambda x, n: x.withField(n, i[n].try_cast(MONEY)), ITEM_AMOUNTS, i))
    return df.withColumns({"items": items, **{n: F.col(n).try_cast(MONEY) for n in AMOUNTS}, "vat_rate": F.col("vat_rate").try_cast(RATE)})
