"""Scalar text and time functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the code points that count as white space, for use inside a character class.
SPACE = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same code points one by one.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Fixed value: what ends a line.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
OFFSET = r"(?i)(Z|[+-][0-9]{2}:?[0-9]{2})$"


def normalize_line_endings(c: Column) -> Column:
    """CRLF and CR become LF."""
    return F.regexp_replace(c, "\r\n?", "\n")


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(SPACES))


def clean_text(c: Column) -> Column:
    """Line endings normalised, both ends stripped; blank stays an empty string."""
    return strip(normalize_line_endings(c))


def optional_text(c: Column) -> Column:
    """As ``clean_text``; blank is null."""
    return F.nullif(clean_text(c), F.lit(""))


def is_blank(c: Column) -> Column:
    """Null, or nothing but white space."""
    return F.coalesce(clean_text(c) == "", F.lit(True))


def has_inner_break(c: Column) -> Column:
    """Whether a cleaned identifier still holds a line break; false for null."""
    return F.coalesce(F.contains(clean_text(c), F.lit("\n")), F.lit(False))


def required_text(c: Column, field: str) -> tuple[Column, Column]:
    """(cleaned value, reason or null): blank is rejected."""
    return clean_text(c), F.when(is_blank(c), F.lit(f"{field}_blank"))


def identifier(c: Column, field: str) -> tuple[Column, Column]:
    """(cleaned value, reason or null): blank and line breaks inside are rejected."""
    value, blank = required_text(c, field)
    return value, F.coalesce(blank, F.when(has_inner_break(c), F.lit(f"{field}_multiline")))


def optional_identifier(c: Column, field: str) -> tuple[Column, Column]:
    """(cleaned value or null, reason or null): line breaks inside are rejected."""
    return optional_text(c), F.when(has_inner_break(c), F.lit(f"{field}_multiline"))


def utc_timestamp(c: Column, field: str) -> tuple[Column, Column]:
    """(instant, reason or null): the offset is mandatory. The session's time zone must be UTC."""
    text = strip(c)
    has_offset = text.rlike(OFFSET)
    value = F.when(has_offset, F.try_to_timestamp(text))
    reason = F.when(c.isNull(), None).when(~has_offset, f"{field}_without_offset").when(value.isNull(), f"{field}_invalid")
    return value, reason


def canonical_datetime(c: Column) -> Column:
    """ISO 8601 in UTC; six digits of a second where there are any."""
    whole = F.date_trunc("second", c) == c
    return F.when(whole, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def split_lines(c: Column) -> Column:
    return F.split(c, LINE_BREAK)
