"""Arithmetic reconciliation of quotations in exact decimals: nested rows, or header and items as two tables.

Nested quotations have amounts as decimals, or as texts of any width, as they are extracted; flat ones have decimals.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerleaf.functions import wide

TOLERANCE = "0.01"
CHECKS = ("line_totals", "subtotal", "vat", "grand_total")
#: What each check says, by outcome.
MESSAGES = {
    ("line_totals", "none"): "No quotation items were extracted.",
    ("line_totals", "failed"): "One or more item line totals do not equal quantity × unit price.",
    ("line_totals", "skipped"): "Some item line totals could not be checked because values are missing.",
    ("line_totals", "passed"): "All item line totals equal quantity × unit price.",
    ("subtotal", "none"): "Subtotal was not extracted.",
    ("subtotal", "skipped"): "Subtotal cannot be checked because item line totals are incomplete.",
    ("subtotal", "failed"): "Subtotal does not equal the sum of item line totals.",
    ("subtotal", "passed"): "Subtotal equals the sum of item line totals.",
    ("vat", "skipped"): "VAT cannot be checked because subtotal, VAT rate, or VAT amount is missing.",
    ("vat", "failed"): "VAT amount does not equal subtotal × VAT rate.",
    ("vat", "passed"): "VAT amount equals subtotal × VAT rate.",
    ("grand_total", "skipped"): "Grand total cannot be checked because subtotal, VAT amount, or total is missing.",
    ("grand_total", "failed"): "Grand total does not equal subtotal + VAT amount.",
    ("grand_total", "passed"): "Grand total equals subtotal + VAT amount.",
}
_NO_DETAILS = "map<string,string>"


def money(c: Column) -> Column:
    """Two decimals, halves away from zero."""
    return F.round(c, 2)


def differs(expected: Column, actual: Column) -> Column:
    """Whether two amounts, each rounded to two decimals, are more than the tolerance apart."""
    return F.abs(money(expected) - money(actual)) > F.lit(TOLERANCE).cast("decimal(3,2)")


def vat_of(subtotal: Column, rate: Column) -> Column:
    return subtotal * rate.cast("decimal(9,4)") * F.lit("0.01").cast("decimal(3,2)")


def _check(name: str, status: Column, details: Column, none: Column | None = None) -> Column:
    message = F.when(F.lit(False), "") if none is None else F.when(none, MESSAGES[name, "none"])
    for outcome in ("passed", "failed", "skipped"):
        message = message.when(status == outcome, MESSAGES[name, outcome])
    return F.struct(status.alias("status"), message.alias("message"), details.alias("details"))


def _compared(name: str, missing: Column, expected: Column, actual: Column, wrong: Column, none: Column | None = None) -> Column:
    """A check of two amounts of two decimals; ``wrong``: whether they are too far apart."""
    status = F.when(missing, "skipped").when(wrong, "failed").otherwise("passed")
    amounts = F.create_map(F.lit("expected"), expected.cast("string"), F.lit("actual"), actual.cast("string"))
    return _check(name, status, F.when(~missing, amounts).otherwise(F.create_map().cast(_NO_DETAILS)), none)


def _line_check(items: Column, lines: Column) -> Column:
    """Quantity times unit price against each line total; a mismatch outranks a missing value.

    ``lines``: of each item its sku, both amounts as ``expected`` and ``actual``, and whether they are ``wrong``.
    """
    numbered = F.transform(lines, lambda i, k: F.struct((k + 1).alias("item_index"), i["sku"].alias("sku"), i["expected"].cast("string").alias("expected"), i["actual"].cast("string").alias("actual"), i["wrong"].alias("wrong")))
    lacking = F.filter(numbered, lambda i: i["expected"].isNull() | i["actual"].isNull())
    wrong = F.transform(F.filter(numbered, lambda i: F.coalesce(i["wrong"], F.lit(False))), lambda i: i.dropFields("wrong"))
    empty = F.coalesce(F.size(items), F.lit(0)) <= 0
    status = F.when(empty, "skipped").when(F.size(wrong) > 0, "failed").when(F.size(lacking) > 0, "skipped").otherwise("passed")
    details = (
        F.when(empty, F.create_map().cast(_NO_DETAILS))
        .when(status == "failed", F.create_map(F.lit("mismatches"), F.to_json(wrong)))
        .when(status == "skipped", F.create_map(F.lit("item_indexes"), F.to_json(F.transform(lacking, lambda i: i["item_index"]))))
        .otherwise(F.create_map(F.lit("checked_items"), F.size(items).cast("string")))
    )
    return _check("line_totals", status, details, empty)


def _amounts(name: str, expected: Column, actual: Column) -> Column:
    return F.struct(expected.alias("expected"), actual.alias("actual")).alias(name)


def _in_decimals(df: DataFrame) -> DataFrame:
    """Add what the checks compare: _lines, and _subtotal, _vat and _grand_total."""
    c = F.col
    line = lambda i: F.struct(i["sku"].alias("sku"), money(i["quantity"] * i["unit_price"]).alias("expected"), money(i["line_total"]).alias("actual"))
    told = lambda i: i.withField("wrong", differs(i["expected"], i["actual"]))
    lines = F.transform(F.transform("items", line), told)
    total = F.aggregate("items", F.lit(0).cast("decimal(38,6)"), lambda s, i: (s + i["line_total"]).cast("decimal(38,6)"))
    pairs = {"_subtotal": (total, c("subtotal")), "_vat": (vat_of(c("subtotal"), c("vat_rate")), c("vat_amount")), "_grand_total": (c("subtotal") + c("vat_amount"), c("total"))}
    return df.withColumns({"_lines": lines, **{n: F.struct(money(e).alias("expected"), money(a).alias("actual"), differs(e, a).alias("wrong")) for n, (e, a) in pairs.items()}})


def _in_texts(df: DataFrame) -> DataFrame:
    """The same of amounts of any width; products first, then their differences, as columns of their own."""
    c = F.col
    line = lambda i: F.struct(i["sku"].alias("sku"), wide.product(i["quantity"], i["unit_price"], 2).alias("expected"), wide.rounded(i["line_total"], 2).alias("actual"))
    pairs = {
        "_subtotal": (wide.total(F.transform("items", lambda i: i["line_total"]), 2), c("subtotal")),
        "_vat": (wide.product(c("subtotal"), c("vat_rate"), 2, shift=2), c("vat_amount")),
        "_grand_total": (wide.total(F.array("subtotal", "vat_amount"), 2), c("total")),
    }
    df = df.withColumns({"_lines": F.transform("items", line), **{n: _amounts(n, e, wide.rounded(a, 2)) for n, (e, a) in pairs.items()}})
    apart = lambda x: wide.exceeds(wide.total(F.array(x["expected"], wide.negated(x["actual"]))), TOLERANCE)
    far = lambda x: F.when(x["expected"] == x["actual"], F.lit(False)).otherwise(apart(x))
    return df.withColumns({"_lines": F.transform("_lines", lambda i: i.withField("wrong", far(i))), **{n: c(n).withField("wrong", far(c(n))) for n in pairs}})


def overall(statuses: Column) -> tuple[Column, Column]:
    """(validation status, confidence) of the four checks' statuses."""
    status = F.when(F.array_contains(statuses, "failed"), "invalid").when(F.array_contains(statuses, "skipped"), "incomplete").otherwise("valid")
    return status, F.size(F.filter(statuses, lambda s: s == "passed")) / F.lit(4.0)


def reconcile_quotations(df: DataFrame) -> DataFrame:
    """Add checks (a map of status, message and details), validation_status and confidence to quotations."""
    c, columns = F.col, df.columns
    items = df.schema["items"].dataType.elementType
    texts = isinstance(items["line_total"].dataType, T.StringType)
    df = _in_texts(df) if texts else _in_decimals(df)
    lacks = lambda *names: reduce(or_, (c(n).isNull() for n in names))
    incomplete = (F.coalesce(F.size("items"), F.lit(0)) <= 0) | c("_subtotal.expected").isNull()
    told = lambda n: (c(n)["expected"], c(n)["actual"], c(n)["wrong"])
    checks = (
        _line_check(c("items"), c("_lines")),
        _compared("subtotal", lacks("subtotal") | incomplete, *told("_subtotal"), lacks("subtotal")),
        _compared("vat", lacks("subtotal", "vat_rate", "vat_amount"), *told("_vat")),
        _compared("grand_total", lacks("subtotal", "vat_amount", "total"), *told("_grand_total")),
    )
    df = df.withColumn("checks", F.create_map(*(x for name, check in zip(CHECKS, checks, strict=True) for x in (F.lit(name), check))))
    status, confidence = overall(F.array(*(F.element_at("checks", n)["status"] for n in CHECKS)))
    return df.withColumns({"validation_status": status, "confidence": confidence}).select(*dict.fromkeys([*columns, "checks", "validation_status", "confidence"]))


def reconcile_relational(header: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """The same outcome from two flat tables.

    ``header``: key, subtotal, vat_rate, vat_amount, total. ``items``: key, quantity, unit_price, line_total. Items are
    summed before they meet the headers; a header without items is kept and its item checks are skipped.
    """
    wrong = F.coalesce(differs(F.col("quantity") * F.col("unit_price"), F.col("line_total")), F.lit(False))
    lacking = F.col("unit_price").isNull() | F.col("line_total").isNull()
    sums = items.groupBy(key).agg(F.count(F.lit(1)).alias("_items"), F.count_if(wrong & ~lacking).alias("_wrong"), F.count_if(lacking).alias("_lacking"), F.count_if(F.col("line_total").isNull()).alias("_untotalled"), F.sum(F.col("line_total").cast("decimal(28,6)")).alias("_lines"))
    c = F.col
    joined = header.join(sums, key, "left")
    lines = F.when(c("_items").isNull(), "skipped").when(c("_wrong") > 0, "failed").when(c("_lacking") > 0, "skipped").otherwise("passed")

    def compared(missing: Column, expected: Column, actual: Column) -> Column:
        return F.when(missing, "skipped").when(differs(expected, actual), "failed").otherwise("passed")

    joined = joined.withColumns(
        {
            "line_totals": lines,
            "subtotal_check": compared(c("subtotal").isNull() | c("_items").isNull() | (c("_untotalled") > 0), c("_lines"), c("subtotal")),
            "vat_check": compared(c("subtotal").isNull() | c("vat_rate").isNull() | c("vat_amount").isNull(), vat_of(c("subtotal"), c("vat_rate")), c("vat_amount")),
            "grand_total_check": compared(c("subtotal").isNull() | c("vat_amount").isNull() | c("total").isNull(), c("subtotal") + c("vat_amount"), c("total")),
        }
    )
    status, confidence = overall(F.array("line_totals", "subtotal_check", "vat_check", "grand_total_check"))
    return joined.select(key, "line_totals", "subtotal_check", "vat_check", "grand_total_check", status.alias("validation_status"), confidence.alias("confidence"))
