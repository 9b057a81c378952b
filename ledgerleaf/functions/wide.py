"""Exact decimals of any width as Columns.

A number is plain text: a minus or none, whole digits without leading zeros, and a fraction or none, as it is stored in
JSON. Arithmetic cuts the digits, brought to a common scale, into limbs of six, lowest first, each with the number's
sign; sums and products of limbs fit 64 bits and are carried once at the end. Null in, null out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTH = 6
BASE = 10**WIDTH


def _bind(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def number(c: Column) -> Column:
    """Text of an optional sign, digits and a point, in plain form; null for any other."""

    def made(c: Column) -> Column:
        plain = c.rlike(r"\A-?(0|[1-9][0-9]*)(\.[0-9]+)?\z")
        fits = c.rlike(r"\A[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)\z")
        whole = F.regexp_extract(c, r"\A[-+]?0*([0-9]*)", 1)
        fraction = F.regexp_extract(c, r"(\.[0-9]+)\z", 1)
        sign = F.when(c.startswith("-"), "-").otherwise("")
        return F.when(plain, c).when(fits, F.concat(sign, F.when(whole == "", "0").otherwise(whole), fraction))

    return _bind(c, made)


def scale_of(c: Column) -> Column:
    """Digits behind the point."""
    at = F.instr(c, ".")
    return F.when(at > 0, F.length(c) - at).otherwise(0)


def limbs(c: Column, scale: Column) -> Column:
    """Limbs of a number times ten to the power of ``scale``, which is at least its own."""
    plain = F.regexp_replace(c, r"[-.]", "")
    digits = F.concat(plain, F.repeat(F.lit("0"), scale - scale_of(c)))
    cut = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit(f"[0-9]{{1,{WIDTH}}}"), F.lit(0)), lambda x: F.reverse(x).cast("long"))
    return F.when(c.startswith("-"), F.transform(cut, lambda x: -x)).otherwise(cut)


def _sum(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def _times(a: Column, b: Column) -> Column:
    """Limbs of a product: every limb of one times the other, moved by its place."""

    def made(x: Column) -> Column:
        moved = lambda v, i: F.concat(F.array_repeat(F.lit(0).cast("long"), i), F.transform(x["b"], lambda y: v * y))
        return F.aggregate(F.transform(x["a"], moved), F.array().cast("array<bigint>"), _sum)

    return _bind(F.struct(a.alias("a"), b.alias("b")), made)


def _carried(c: Column) -> Column:
    """(limbs from 0 to BASE - 1, what is carried out of them)."""
    start = F.struct(F.array().cast("array<bigint>").alias("limbs"), F.lit(0).cast("long").alias("carry"))

    def step(acc: Column, x: Column) -> Column:
        value = x + acc["carry"]
        low = F.pmod(value, F.lit(BASE).cast("long"))
        return F.struct(F.concat(acc["limbs"], F.array(low)).alias("limbs"), ((value - low) / BASE).cast("long").alias("carry"))

    # Empty limbs more, so that what is carried out is the sign alone.
    return F.aggregate(F.concat(c, F.array_repeat(F.lit(0).cast("long"), 3)), start, step)


def _text(c: Column, scale: Column, places: int | None) -> Column:
    """The number with these limbs over ten to the power of ``scale``; with ``places`` digits behind the point, halves
    away from zero, unless that is None."""
    kept = lambda x: x["scale"] if places is None else F.lit(places)
    cut = lambda x: F.greatest(x["scale"] - kept(x), F.lit(0))

    def half(x: Column) -> Column:
        """Limbs of half a unit of the last digit kept."""
        at = cut(x) - 1
        return F.when(at >= 0, F.concat(F.array_repeat(F.lit(0).cast("long"), F.floor(at / WIDTH).cast("int")), F.array((F.pow(F.lit(10), at % WIDTH) * 5).cast("long")))).otherwise(F.array().cast("array<bigint>"))

    def signed(x: Column) -> Column:
        negative = _carried(x["c"])["carry"] < 0
        low = _carried(_sum(F.when(negative, F.transform(x["c"], lambda v: -v)).otherwise(x["c"]), half(x)))["limbs"]
        return F.struct(negative.alias("negative"), x["scale"].alias("scale"), F.array_join(F.transform(F.reverse(low), lambda v: F.lpad(v.cast("string"), WIDTH, "0")), "").alias("digits"))

    def pointed(x: Column) -> Column:
        full = F.concat(F.repeat(F.lit("0"), x["scale"] + 1), x["digits"], F.repeat(F.lit("0"), F.greatest(kept(x) - x["scale"], F.lit(0))))
        return _bind(F.struct(full.alias("full"), (F.length(full) - cut(x)).alias("long")), lambda y: cut_at(x, y["full"], y["long"]))

    def cut_at(x: Column, full: Column, long: Column) -> Column:
        whole = F.regexp_replace(F.substring(full, F.lit(1), long - kept(x)), r"\A0+(?=.)", "")
        return F.concat(F.when(x["negative"], "-").otherwise(""), whole, F.when(kept(x) > 0, F.concat(F.lit("."), F.substring(full, long - kept(x) + 1, kept(x)))).otherwise(""))

    return _bind(_bind(F.struct(c.alias("c"), scale.alias("scale")), signed), pointed)


def total(numbers: Column, places: int | None = None) -> Column:
    """The sum of an array, rounded if asked; null if any is null, zero if there are none."""
    zero = F.array(F.lit(0).cast("long"))

    def made(x: Column) -> Column:
        return F.aggregate(x["numbers"], zero, lambda acc, n: _sum(acc, limbs(n, x["scale"])))

    scale = F.coalesce(F.array_max(F.transform(numbers, scale_of)), F.lit(0))
    summed = _bind(F.struct(numbers.alias("numbers"), scale.alias("scale")), made)
    return F.when(~F.exists(numbers, lambda x: x.isNull()), _text(summed, scale, places))


def product(a: Column, b: Column, places: int | None = None, shift: int = 0) -> Column:
    """The product over ten to the power of ``shift``, rounded if asked."""
    made = _text(_times(limbs(a, scale_of(a)), limbs(b, scale_of(b))), scale_of(a) + scale_of(b) + shift, places)
    return F.when(a.isNotNull() & b.isNotNull(), made)


def rounded(c: Column, places: int) -> Column:
    """``c`` with so many digits behind the point, halves away from zero."""
    made = lambda c: F.when(c.rlike(rf"\A(0|[1-9][0-9]*)\.[0-9]{{{places}}}\z"), c).when(c.isNotNull(), _text(limbs(c, scale_of(c)), scale_of(c), places))
    return _bind(c, made)


def negated(c: Column) -> Column:
    return F.when(c.startswith("-"), F.substring(c, F.lit(2), F.length(c))).otherwise(F.concat(F.lit("-"), c))


def exceeds(c: Column, limit: str) -> Column:
    """Whether the number without its sign is more than ``limit``, a number of the same scale."""
    b = F.lit(limit.replace(".", "").lstrip("0"))
    return _bind(F.regexp_replace(F.regexp_replace(c, r"[-.]", ""), r"\A0+", ""), lambda a: (F.length(a) > F.length(b)) | ((F.length(a) == F.length(b)) & (a > b)))
