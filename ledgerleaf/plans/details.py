"""Queries of single rules: times, malformed documents, page contents, quirks of quotations, schema keywords, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.functions import text
from ledgerleaf.functions.nested import exploded
from ledgerleaf.operators import documents as D
from ledgerleaf.operators import jsonschema as J
from ledgerleaf.operators import layout as L
from ledgerleaf.operators import quotation as Q
from ledgerleaf.operators import registry as G
from ledgerleaf.operators import results as X
from ledgerleaf.plans import quotations as P
from ledgerleaf.plans import validation as V
from ledgerleaf.plans.transcripts import dealt_keys, table


def backend_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of backends whose models are called like parts: plain, padded, blank or of two lines."""
    n = F.col("p_partkey")
    model = F.when(n % 4 == 0, F.col("p_name")).when(n % 4 == 1, F.concat(F.lit("\t "), F.col("p_name"), F.lit(" \r\n"))).when(n % 4 == 2, " \n ").otherwise(F.concat("p_name", F.lit("\r"), "p_brand"))
    (plain, wrong), (chat, _) = X.backend_name("openai", model), X.backend_name("groq", model)
    return table(spark, sf_dir, "part").select("p_partkey", F.when(wrong.isNull(), plain).alias("openai"), F.when(wrong.isNull(), chat).alias("groq"), wrong.alias("reason"))


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw documents with times in several offsets; rules are broken by key."""
    n, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    none = F.lit(None).cast("string")
    at = F.concat(day, F.when(n % 3 == 0, "T10:00:00Z").when(n % 3 == 1, "T10:00:00.25+02:00").otherwise("T10:00:00-0330"))
    later = F.concat(day, F.when(n % 10 == 9, "T01:00:00").otherwise("T20:00:00Z"))
    source = F.struct(F.lit(" orders ").alias("provider"), none.alias("source_uri"), n.cast("string").alias("source_document_id"), at.alias("source_timestamp"), none.alias("published_at"), later.alias("retrieved_at"))
    person = lambda i, name: F.struct(i.alias("participant_id"), F.lit(name).alias("display_name"), none.alias("role"), none.alias("organization"))
    people = F.array(person(F.lit("a"), "A"), person(F.when(n % 5 == 4, " a").otherwise("b"), "B"))
    said = lambda k, who, t: F.struct(F.lit(k).cast("long").alias("sequence"), F.lit(who).alias("participant_id"), t.alias("text"))
    segments = F.array(said(2, "b", F.col("o_orderpriority")), said(1, "a", F.when(n % 6 == 5, " \r\n").otherwise(F.concat("o_orderstatus", F.lit("\r\n")))))
    segments = F.when(n % 7 == 6, F.slice(segments, 1, 0)).otherwise(segments)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Order "), n).alias("title"), F.lit("order").alias("document_type"), source.alias("source"), people.alias("participants"), segments.alias("segments"))


def dated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of documents with times, and their times as they are written in JSON."""
    good = D.split_valid(D.normalize_documents(order_documents(spark, sf_dir)))[0]
    iso = lambda c: text.canonical_datetime(F.col(f"source.{c}"))
    return good.select("o_orderkey", "fingerprint", iso("source_timestamp").alias("made"), iso("retrieved_at").alias("retrieved"))


def malformed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reasons why documents are rejected, in the order of the checks."""
    _, bad = D.split_valid(D.normalize_documents(order_documents(spark, sf_dir)))
    return bad.select("o_orderkey", "first_error", F.array_join("errors", ",").alias("errors"))


def unknown_document_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undeclared members of raw documents, at every level."""
    n = F.col("o_orderkey")
    more = lambda k, t: F.when(n % k == k - 1, t).otherwise("")
    raw = F.concat(F.lit('{"title":"t"'), more(2, ',"zeta":1'), F.lit(',"source":{"provider":"p"'), more(3, ',"Provider":"p"'), F.lit('},"participants":[{"participant_id":"a"'), more(5, ',"age":[1]'), F.lit('},{"role":"r"}],"segments":[{"sequence":1},{"text":"x"'), more(7, ',"text2":null'), F.lit("}]}"))
    raw = F.when(n % 11 == 10, "[]").when(n % 13 == 12, "{").otherwise(raw)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(D.unknown_fields(raw), ",").alias("unknown"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of the layouts, as digests, and their lengths."""
    layouts = P.quotation_layouts(spark, sf_dir)
    whole = L.layout_stats(layouts).select("quotation", "text_length", L.document_text(F.col("pages")).alias("text"))
    return whole.select("quotation", "text_length", F.sha2("text", 256).alias("text_sha256"))


def layout_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the layouts, one row each."""
    pages = L.explode_layout(L.clean_layout(P.quotation_layouts(spark, sf_dir)), "page", "quotation")
    return pages.select("quotation", "page_index", "page_number", "width", F.size("blocks").alias("n_blocks"), F.size("tables").alias("n_tables"))


def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text blocks of the layouts after padding and blank blocks are added to them."""
    padded = lambda b: b.withField("text", F.concat(F.lit(" \n"), b["text"], F.lit(" ")))
    blank = lambda b: b.withField("text", F.lit(" \n"))
    pages = F.transform("pages", lambda p: p.withField("blocks", F.flatten(F.transform(p["blocks"], lambda b: F.array(padded(b), blank(b))))))
    blocks = L.explode_layout(L.clean_layout(P.quotation_layouts(spark, sf_dir).withColumn("pages", pages)), "block", "quotation")
    return blocks.select("quotation", "page_index", "block_index", "block_number", F.sha2("text", 256).alias("text_sha256"))


def layout_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of layouts whose pages list the words of their blocks."""
    none = F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>")
    word = lambda t, b, i: F.struct(t.alias("text"), none.alias("bbox"), b["block_number"].alias("block_number"), F.lit(0).alias("line_number"), i.alias("word_number"))
    words = lambda p: F.flatten(F.transform(p["blocks"], lambda b: F.transform(F.split(b["text"], r"\s+"), lambda t, i: word(t, b, i))))
    made = P.quotation_layouts(spark, sf_dir).withColumn("pages", F.transform("pages", lambda p: p.withField("words", words(p))))
    return L.explode_layout(made, "word", "quotation").groupBy("quotation", "block_number").agg(F.count(F.lit(1)).alias("n_words"), F.max("word_index").alias("last_index"))


def layout_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of all tables of the layouts; blank ones are null."""
    cells = L.explode_layout(L.clean_layout(P.quotation_layouts(spark, sf_dir)), "cell", "quotation")
    return cells.select("quotation", "page_index", "table_index", "row_index", "column_index", "cell")


def quirk_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts of all orders that hold what real quotations do: see the query's SQL for what each is read as."""
    n = F.col("o_orderkey")
    row = lambda *cells: F.array(*((F.lit(c) if isinstance(c, str) else c).cast("string") for c in cells))
    box = lambda y: F.struct(F.lit(0.0).alias("x0"), y.cast("double").alias("y0"), F.lit(1.0).alias("x1"), (y + 1).cast("double").alias("y1"))
    made = lambda rows: F.struct(box(F.lit(0)).alias("bbox"), rows.alias("rows"))
    # Two metadata tables; the second says the number again, and an alias that comes first in order of preference.
    first = F.array(row("Quote No", F.concat(F.lit("OLD-"), n), "Currency", " usd "), row("Valid through", "1/2/2026", "Customer ref.", ""))
    second = F.array(row("Quote No.", F.concat(F.lit("NEW-"), n), "Currency (ISO)", "EUR", "odd"), row("Incoterms", "DAP", "Customer Reference", F.concat(F.lit("C"), n)))
    second = F.when(n % 2 == 0, F.concat(second, F.array(row("Quotation No", F.concat(F.lit("BEST-"), n))))).otherwise(second)
    other = F.array(row("Total", "1"), row("x", "y"))
    full = F.array(row("Item", "Part No.", "SKU", "Description", "Quantity (pcs)", "Unit price EUR", "Amount"), row("1", "p", " S1 ", "first", F.concat(n % 90 + 1, F.lit(",5")), F.concat(F.lit("1,"), 100 + n % 900, F.lit(".25")), "-"), row("2", "p", "S2", "short", F.concat(n % 7, F.lit(" pcs"))), row("3", "p", "S3", "no number", "n/a", "1", "1"), row("4", "p", "", "no sku", "1", "1", "1"))
    lean = F.array(row("SKU", "Description", "Qty"), row("S1", "only these", F.concat(F.lit("+"), n % 90 + 1)))
    tables = F.array(made(other), made(first), made(F.when(n % 3 == 0, lean).otherwise(full)), made(second))
    rate = n % 20 + 5
    vat, ident = F.concat(F.lit("VAT "), rate, F.lit("%: "), n % 1000, F.lit(",75 EUR")), F.concat(F.lit("VAT ID: DE"), n % 1000 + 7)
    texts = [
        F.concat(F.lit("Quotation\nsales@example.com "), n),
        F.concat(F.lit("  Acme "), n % 10, F.lit("\n\nVAT office")),
        F.lit("Later Ltd.\nx@example.com"),
        F.concat(F.lit("Subtotal EUR 1\n"), n % 900 + 100, F.lit(".50")),
        F.when(n % 4 < 2, vat).otherwise(ident),
        F.when(n % 4 < 2, ident).otherwise(vat),
        F.lit("Total to be agreed"),
        F.concat(F.lit("TOTAL: "), n % 1000, F.lit(".10\nEUR and "), n % 100, F.lit(".20")),
        F.lit("Delivery: four weeks\nfrom now"),
        F.lit("delivery: five weeks"),
        F.lit("Warranty:24 months"),
        F.lit("Notes: see: below"),
        F.lit("Prepared by: A\nQuote status: draft\nPrepared by: B"),
    ]
    # Written from the bottom to the top: what comes first is told by places on the page, facts by the blocks' order.
    block = lambda i, t: F.struct(F.lit(i).alias("block_number"), t.alias("text"), box(F.lit(i if i not in (1, 2) else 3 - i)).alias("bbox"))
    blocks = F.array(*(block(i, t) for i, t in enumerate(texts)))
    words = F.array().cast("array<struct<text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,block_number:int,line_number:int,word_number:int>>")
    page = F.struct(F.lit(1).alias("page_number"), F.lit(1.0).alias("width"), F.lit(1.0).alias("height"), F.lit("x").alias("text"), blocks.alias("blocks"), words.alias("words"), tables.alias("tables"))
    return dealt_keys(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", F.array(page).alias("pages"))


def quotation_quirks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What quotations with quirks are read as; the items are told one by one."""
    done = Q.as_decimals(Q.extract_quotations(quirk_layouts(spark, sf_dir)))
    kept = ["quotation_number", "valid_until", "currency", "customer_reference", "incoterms", "supplier_name", "subtotal", "vat_rate", "vat_amount", "total", "delivery", "warranty", "notes", "prepared_by", "quote_status"]
    return exploded(done, "items", "place", "item", "o_orderkey", *kept).select("o_orderkey", *kept, "place", "item.*")


def keyword_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their lines as JSON, with members that break keywords by key."""
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("q"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_list(line))).alias("lines"))
    n = F.col("o_orderkey")
    wide = F.lit(9007199254740990).cast("decimal(20,0)") + n % 6
    body = F.concat(F.lit('{"status":"'), F.col("o_orderstatus"), F.lit('","lines":'), F.coalesce("lines", F.lit("[]")), F.lit(',"x-a\\"b":'), n % 3, F.lit(',"wide":'), wide, F.when(n % 4 == 3, ',"paid":true').otherwise(""), F.lit(',"pair":['), n % 2, F.lit(',"'), F.col("o_orderpriority"), F.lit('"]}'))
    return table(spark, sf_dir, "orders").join(lines, n == F.col("l_orderkey"), "left").select("o_orderkey", body.alias("body"))


def keyword_request() -> J.SchemaRequest:
    line = {"type": "object", "properties": {"n": {"not": {"const": 6}}, "q": {"type": "integer", "exclusiveMaximum": 48, "multipleOf": 1}}}
    schema = {
        "$defs": {"line": line},
        "type": "object",
        "properties": {
            "status": {"enum": ["O", "F"]},
            "lines": {"type": "array", "minItems": 1, "maxItems": 6, "items": {"$ref": "#/$defs/line"}},
            "wide": {"maximum": 9007199254740993},
            "pair": {"prefixItems": [{"const": 0}, {"type": "string", "pattern": "^[1-4]", "maxLength": 8}]},
        },
        "patternProperties": {"^x-": {"maximum": 1}},
        "dependentRequired": {"paid": ["by"]},
        "if": {"properties": {"status": {"const": "F"}}},
        "then": {"required": ["closed"]},
    }
    return J.schema_request("keywords", 1, schema)


def schema_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of many keywords, in nested arrays and under keys that need quoting."""
    done = J.validate_json(keyword_payloads(spark, sf_dir), "body", keyword_request())
    return exploded(done, "schema_errors", "at", "e", "o_orderkey").select("o_orderkey", "e.path", "e.schema_path", "e.validator")


def document_row_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of registry rows, most rules broken by some, after defaults are filled in and texts trimmed."""
    n = F.col("doc_id")
    broken = lambda k, bad, good: F.when(n % k == k - 1, bad).otherwise(good)
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        broken(3, G.EMPTY_ID, F.col("source")).alias("customer_id"),
        broken(5, " \n", F.lit(" a.pdf ")).alias("original_file_name"),
        broken(7, F.repeat(F.lit("x"), 101), F.lit("application/pdf")).alias("content_type"),
        broken(11, F.lit(None).cast("string"), F.lit("k")).alias("storage_key"),
        broken(13, F.lit(0).cast("long"), n + 1).alias("size"),
        broken(17, F.repeat(F.lit("t"), 101), F.lit(None).cast("string")).alias("document_type"),
        broken(2, F.lit(None).cast("string"), F.lit("Valid")).alias("status"),
        F.lit(None).cast("timestamp").alias("created_at"),
    )
    done = G.check_document_rows(rows)
    return done.select("doc_id", "status", "original_file_name", F.col("created_at").isNotNull().alias("dated"), F.array_join("problems", ",").alias("problems"))


def document_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One registry row by its id."""
    found = G.get_document(V.registry_documents(spark, sf_dir), "42")
    return found.select("id", "customer_id", "storage_key", "size", "status")


def result_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored result of one document, its JSON parsed."""
    first = table(spark, sf_dir, "labels").agg(F.min("doc_id")).first()[0]
    stored = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("document_id"), F.concat(F.lit('{"quality": '), "quality", F.lit(', "toxic": '), "toxic", F.lit("}")).alias("structured_data_json"))
    value = lambda k: F.try_variant_get("structured_data", f"$.{k}", "int")
    return G.get_extraction_result(stored, str(first)).select("document_id", value("quality").alias("quality"), value("toxic").alias("toxic"))


def newest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three newest documents of each customer; all are of one time, so their ids decide."""
    return G.latest_by_customer(V.registry_documents(spark, sf_dir), 3).select("customer_id", "place", "id")


def minted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New storage keys of the orders: their month, and whether the rest has the right form."""
    key: Column = G.mint_storage_key(F.col("o_orderdate"), F.lit(".pdf"))
    made = table(spark, sf_dir, "orders").select("o_orderkey", key.alias("key"))
    return made.select("o_orderkey", F.substring("key", 1, 7).alias("month"), F.col("key").rlike(r"^\d{4}/\d{2}/[0-9a-f]{32}\.pdf$").alias("formed"))


QUERIES = {
    f.__name__: f
    for f in (backend_names, dated_documents, malformed_documents, unknown_document_fields, page_texts, layout_pages, layout_blocks, layout_words, layout_cells, quotation_quirks, schema_keywords, document_row_checks, document_lookup, result_lookup, newest_documents, minted_keys)
}

_AMOUNT = "coalesce(cast({} as decimal(18,2))::varchar, 'n/a')"
_BLOCKS = f"""blocks as (select quotation, unnest(range(0, 6))::int as b, unnest(['QUOTATION' || chr(10) || 'sales@example.com', 'Example Supplies Ltd.' || chr(10) || 'VAT DE1' || chr(10) || 'sales@example.com',
      'Subtotal EUR ' || {_AMOUNT.format("subtotal")}, 'VAT 20%: EUR ' || {_AMOUNT.format("vat_amount")}, 'Total EUR ' || {_AMOUNT.format("exact + vat_amount")}, 'Payment terms: 30 days' || chr(10) || 'Prepared by: A. Clerk']) as t from heads where n > 0)"""

_ORDER_DOCS = """made as (select o_orderkey as n, strftime(o_orderdate, '%Y-%m-%d') as day, o_orderdate, o_orderstatus, o_orderpriority from orders),
  timed as (select *, case n % 3 when 0 then day || 'T10:00:00Z' when 1 then day || 'T08:00:00.250000Z' else day || 'T13:30:00Z' end as stamp, day || 'T20:00:00Z' as later from made)"""

ORACLES = {
    "backend_names": """select p_partkey, case when p_partkey % 4 < 2 then 'openai_responses_v1:' || p_name end as openai, case when p_partkey % 4 < 2 then 'groq_chat_completions_v1:' || p_name end as groq,
        case p_partkey % 4 when 2 then 'model_blank' when 3 then 'model_multiline' end as reason from part""",
    "dated_documents": f"""with {_ORDER_DOCS} select n as o_orderkey, stamp as made, later as retrieved,
        sha256(to_json({{'documentType': 'order', 'participants': [{{'displayName': 'A', 'organization': null::varchar, 'participantId': 'a', 'role': null::varchar}}, {{'displayName': 'B', 'organization': null::varchar, 'participantId': 'b', 'role': null::varchar}}],
          'segments': [{{'participantId': 'a', 'sequence': 1, 'text': o_orderstatus}}, {{'participantId': 'b', 'sequence': 2, 'text': o_orderpriority}}],
          'source': {{'provider': 'orders', 'publishedAt': null::varchar, 'retrievedAt': later, 'sourceDocumentId': n::varchar, 'sourceTimestamp': stamp, 'sourceUri': null::varchar}}, 'title': 'Order ' || n}})::varchar) as fingerprint
        from timed where n % 10 <> 9 and n % 5 <> 4 and n % 6 <> 5 and n % 7 <> 6""",
    "malformed_documents": """with bad as (select o_orderkey, concat_ws(',', case when o_orderkey % 10 = 9 then 'retrieved_at_without_offset' end, case when o_orderkey % 5 = 4 then 'participants_not_unique' end,
          case when o_orderkey % 7 = 6 then 'segments_missing' end, case when o_orderkey % 5 = 4 and o_orderkey % 7 <> 6 then 'participant_unknown' end, case when o_orderkey % 6 = 5 and o_orderkey % 7 <> 6 then 'segment_text_blank' end) as errors from orders)
        select o_orderkey, split_part(errors, ',', 1) as first_error, errors from bad where errors <> ''""",
    "unknown_document_fields": """select o_orderkey, case when o_orderkey % 11 <> 10 and o_orderkey % 13 <> 12 then concat_ws(',', case when o_orderkey % 5 = 4 then 'participants[].age' end, case when o_orderkey % 7 = 6 then 'segments[].text2' end,
          case when o_orderkey % 3 = 2 then 'source.Provider' end, case when o_orderkey % 2 = 1 then 'zeta' end) end as unknown from orders""",
    "page_texts": f"""with {P._ITEMS}, {_BLOCKS}, whole as (select quotation, string_agg(t, chr(10) order by b) as t from blocks group by quotation) select quotation, length(t)::int as text_length, sha256(t) as text_sha256 from whole""",
    "layout_pages": f"""with {P._ITEMS} select quotation, p::int as page_index, (p + 1)::int as page_number, 595.0::double as width, case p when 0 then 6 else 0 end as n_blocks, case p when 0 then 2 else 0 end as n_tables
        from heads, (values (0), (1)) v(p) where n > 0 and (p = 0 or quotation % 5 = 0)""",
    "layout_blocks": f"with {P._ITEMS}, {_BLOCKS} select quotation, 0 as page_index, b as block_index, b as block_number, sha256(t) as text_sha256 from blocks",
    "layout_words": f"""with {P._ITEMS}, {_BLOCKS}, split as (select quotation, b, len(regexp_split_to_array(t, '\\s+')) as n from blocks)
        select quotation, b as block_number, n::bigint as n_words, (sum(n) over (partition by quotation order by b) - 1)::int as last_index from split""",
    "layout_cells": f"""with {P._ITEMS}, tabled as (
          select quotation, 0 as table_index, 0 as row_index, ['Quotation No.', 'QT-' || quotation, 'Currency', 'EUR'] as cells from heads where n > 0
          union all select quotation, 0, 1, ['Quotation date', case when quotation % 3 = 0 then strftime(o_orderdate, '%Y-%m-%d') else strftime(o_orderdate, '%d.%m.%Y') end, 'Valid until', null] from heads where n > 0
          union all select quotation, 1, 0, case when quotation % 2 = 0 then ['SKU', 'Description', 'Qty', 'Unit', 'Unit Price' || chr(10) || '(EUR)', 'Lead time (days)', 'Line Total']
            else ['SKU', 'Description', 'Quantity', 'UOM', 'Price', 'Lead Time', 'Amount (EUR)'] end from heads where n > 0
          union all select quotation, 1, (row_number() over (partition by quotation order by line, sku, description, quantity))::int, [sku, description, cast(quantity as decimal(18,2))::varchar, 'pcs', cast(unit_price as decimal(18,2))::varchar, '5', cast(line_total as decimal(18,2))::varchar] from priced)
        select quotation, 0 as page_index, table_index, row_index, unnest(range(0, len(cells)))::int as column_index, unnest(cells) as cell from tabled""",
    "quotation_quirks": """with q as (select o_orderkey, case when o_orderkey % 2 = 0 then 'BEST-' else 'NEW-' end || o_orderkey as quotation_number, date '2026-02-01' as valid_until, 'EUR' as currency, 'C' || o_orderkey as customer_reference, 'DAP' as incoterms,
          'Later Ltd.' as supplier_name, (1000 + o_orderkey % 900 + 100 + 0.5)::decimal(18,6) as subtotal, (o_orderkey % 20 + 5)::decimal(9,4) as vat_rate,
          case when o_orderkey % 4 < 2 then o_orderkey % 1000 + 7 else o_orderkey % 1000 + 0.75 end::decimal(18,6) as vat_amount, (o_orderkey % 100 + 0.2)::decimal(18,6) as total,
          'five weeks' as delivery, '24 months' as warranty, 'see: below' as notes, 'B' as prepared_by, 'draft' as quote_status from orders),
        items as (select o_orderkey, 0 as place, 'S1' as sku, 'only these' as description, (o_orderkey % 90 + 1)::decimal(18,6) as quantity, null::decimal(18,6) as unit_price from orders where o_orderkey % 3 = 0
          union all select o_orderkey, 0, 'S1', 'first', (o_orderkey % 90 + 1.5)::decimal(18,6), (1000 + 100 + o_orderkey % 900 + 0.25)::decimal(18,6) from orders where o_orderkey % 3 <> 0
          union all select o_orderkey, 1, 'S2', 'short', (o_orderkey % 7)::decimal(18,6), null from orders where o_orderkey % 3 <> 0)
        select q.*, place, sku, description, quantity, null::varchar as unit, unit_price, null::int as lead_time_days, null::decimal(18,6) as line_total from q join items using (o_orderkey)""",
    "schema_keywords": """with lines as (select l_orderkey, l_linenumber as n, l_quantity::int as q, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity::int) - 1 as pos, count(*) over (partition by l_orderkey) as many from lineitem)
        select l_orderkey as o_orderkey, '$["lines"][' || pos || ']["q"]' as path, '#/properties/lines/items/properties/q/exclusiveMaximum' as schema_path, 'exclusiveMaximum' as validator from lines where q >= 48
        union all select l_orderkey, '$["lines"][' || pos || ']["n"]', '#/properties/lines/items/properties/n/not', 'not' from lines where n = 6
        union all select distinct l_orderkey, '$["lines"]', '#/properties/lines/maxItems', 'maxItems' from lines where many > 6
        union all select o_orderkey, '$["lines"]', '#/properties/lines/minItems', 'minItems' from orders where o_orderkey not in (select l_orderkey from lineitem)
        union all select o_orderkey, '$["status"]', '#/properties/status/enum', 'enum' from orders where o_orderstatus not in ('O', 'F')
        union all select o_orderkey, '$["x-a\\"b"]', '#/patternProperties/^x-/maximum', 'maximum' from orders where o_orderkey % 3 = 2
        union all select o_orderkey, '$["wide"]', '#/properties/wide/maximum', 'maximum' from orders where o_orderkey % 6 > 3
        union all select o_orderkey, '$["pair"][0]', '#/properties/pair/prefixItems/0/const', 'const' from orders where o_orderkey % 2 = 1
        union all select o_orderkey, '$["pair"][1]', '#/properties/pair/prefixItems/1/maxLength', 'maxLength' from orders where length(o_orderpriority) > 8
        union all select o_orderkey, '$["pair"][1]', '#/properties/pair/prefixItems/1/pattern', 'pattern' from orders where not regexp_matches(o_orderpriority, '^[1-4]')
        union all select o_orderkey, '$', '#/dependentRequired', 'dependentRequired' from orders where o_orderkey % 4 = 3
        union all select o_orderkey, '$', '#/then/required', 'required' from orders where o_orderstatus = 'F'""",
    "document_row_checks": """select doc_id, case when doc_id % 2 = 1 then 'Uploaded' else 'Valid' end as status, case when doc_id % 5 = 4 then '' else 'a.pdf' end as original_file_name, true as dated,
        concat_ws(',', case when doc_id % 3 = 2 then 'customer_id_empty' end, case when doc_id % 5 = 4 then 'original_file_name_blank' end, case when doc_id % 11 = 10 then 'storage_key_blank' end,
          case when doc_id % 13 = 12 then 'size_not_positive' end, case when doc_id % 7 = 6 then 'content_type_too_long' end, case when doc_id % 17 = 16 then 'document_type_too_long' end) as problems from documents""",
    "document_lookup": "select doc_id::varchar as id, source as customer_id, '2026/09/42.pdf' as storage_key, n_chars as size, 'Uploaded' as status from documents where doc_id = 42",
    "result_lookup": "select doc_id::varchar as document_id, quality, toxic from labels where doc_id = (select min(doc_id) from labels)",
    "newest_documents": "select * from (select source as customer_id, (row_number() over (partition by source order by doc_id::varchar desc))::int as place, doc_id::varchar as id from documents) where place <= 3",
    "minted_keys": "select o_orderkey, strftime(o_orderdate, '%Y/%m') as month, true as formed from orders",
}
