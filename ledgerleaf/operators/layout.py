"""Layout documents: statistics, text, cells, blocks and tables of pages, as projections over nested rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions import text
from ledgerleaf.functions.nested import exploded

_BOX = "struct<x0 double, y0 double, x1 double, y1 double>"
LAYOUT_SCHEMA = (
    "pages array<struct<page_number int, width double, height double, text string, "
    f"blocks array<struct<block_number int, text string, bbox {_BOX}>>, "
    f"words array<struct<text string, bbox {_BOX}, block_number int, line_number int, word_number int>>, "
    f"tables array<struct<bbox {_BOX}, rows array<array<string>>>>>>"
)
PAGE_BREAK = "\n\n\f\n\n"


def _size(c: Column) -> Column:
    return F.greatest(F.size(c), F.lit(0))


def _total(pages: Column, part: str) -> Column:
    return F.aggregate(pages, F.lit(0), lambda n, p: n + F.greatest(F.coalesce(F.size(p[part]), F.lit(0)), F.lit(0)))


def document_text(pages: Column) -> Column:
    """Texts of all pages, joined by page breaks and stripped."""
    return text.strip(F.array_join(F.transform(pages, lambda p: F.coalesce(p["text"], F.lit(""))), PAGE_BREAK))


def layout_stats(df: DataFrame) -> DataFrame:
    """Add page_count, pages_with_text, empty_page_numbers, needs_ocr, text_length and counts of words, blocks, tables."""
    pages = F.coalesce("pages", F.array().cast(df.schema["pages"].dataType))
    empty = F.transform(F.filter(pages, lambda p: text.is_blank(p["text"])), lambda p: p["page_number"])
    with_text = F.size(F.filter(pages, lambda p: ~text.is_blank(p["text"])))
    return df.withColumns(
        {
            "page_count": F.size(pages),
            "pages_with_text": with_text,
            "empty_page_numbers": empty,
            "needs_ocr": (F.size(pages) > 0) & (with_text == 0),
            "text_length": F.length(document_text(pages)),
            "word_count": _total(pages, "words"),
            "block_count": _total(pages, "blocks"),
            "table_count": _total(pages, "tables"),
        }
    )


def clean_cells(rows: Column) -> Column:
    """Cells stripped; blank ones are null."""
    return F.transform(rows, lambda r: F.transform(r, lambda c: F.nullif(text.strip(c), F.lit(""))))


def text_blocks(blocks: Column) -> Column:
    """Blocks with text, stripped, in their order."""
    kept = F.filter(blocks, lambda b: F.coalesce(text.strip(b["text"]) != "", F.lit(False)))
    return F.transform(kept, lambda b: b.withField("text", text.strip(b["text"])))


def table_dims(rows: Column) -> tuple[Column, Column]:
    """(row count, columns of the longest row)."""
    return _size(F.coalesce(rows, F.array().cast("array<array<string>>"))), F.coalesce(F.array_max(F.transform(rows, lambda r: F.greatest(F.size(r), F.lit(0)))), F.lit(0))


def clean_layout(df: DataFrame) -> DataFrame:
    """Layout rows with stripped blocks and cleaned table cells on every page."""
    pages = F.transform("pages", lambda p: p.withField("blocks", text_blocks(p["blocks"])).withField("tables", F.transform(p["tables"], lambda t: t.withField("rows", clean_cells(t["rows"])))))
    return df.withColumn("pages", pages)


def explode_layout(df: DataFrame, level: str, *keys: str) -> DataFrame:
    """One row a page, block, word, table or cell, with its position, beside the columns ``keys``."""
    pages = exploded(df, "pages", "page_index", "page", *keys)
    if level == "page":
        return pages.select(*keys, "page_index", "page.*")
    inner = {"block": "blocks", "word": "words", "table": "tables", "cell": "tables"}[level]
    parts = exploded(pages, f"page.{inner}", "part_index", "part", *keys, "page_index")
    if level != "cell":
        return parts.select(*keys, "page_index", F.col("part_index").alias(f"{level}_index"), "part.*")
    rows = exploded(parts, "part.rows", "row_index", "cells", *keys, "page_index", F.col("part_index").alias("table_index"))
    return exploded(rows, "cells", "column_index", "cell", *keys, "page_index", "table_index", "row_index")
