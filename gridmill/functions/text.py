"""Text functions as Column expressions; all stay inside code generation."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space at the ends of a cell (Unicode white space and the four separators).
_EDGES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_NOT_WORD = r"[^\p{L}\p{N}_]+"


def strip(value: Column) -> Column:
    """The text without white space at its ends."""
    return F.btrim(value, F.lit(_EDGES))


def is_blank(value: Column) -> Column:
    return strip(value) == ""


#: What case folding does to characters other than lower case does, by Unicode's rules as Python has them.
_FOLDS = json.dumps({chr(c): chr(c).casefold() for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).casefold() != chr(c).lower()})


#: Characters of lower case that fold otherwise: those that are common, and ranges that hold all others.
_COMMON_FOLDS = {c: c.casefold() for c in "\xdf\xb5\u017f\u03c2"}
_RARE = "[\u0149\u01f0\u0345\u0390\u03b0\u03d0-\u03f5\u0587\u13a0-\u13fd\u1c80-\u1c88\u1e96-\u1e9e\u1f50-\u1fff\uab70-\uabbf\ufb00-\ufb17]"


def is_ascii(value: Column) -> Column:
    return F.octet_length(value) == F.char_length(value)


def casefold(value: Column) -> Column:
    """Unicode case folding: lowered, then the few characters that fold otherwise; only texts with a rare one go letter by letter."""
    table = F.from_json(F.lit(_FOLDS), "map<string,string>")
    each = F.transform(F.split(value, ""), lambda c: F.coalesce(F.element_at(table, c), F.lower(c)))
    lowered = folded = F.lower(value)
    for c, fold in _COMMON_FOLDS.items():
        folded = F.replace(folded, F.lit(c), F.lit(fold))
    return F.when(is_ascii(value), lowered).when(lowered.rlike(_RARE), F.array_join(each, "")).otherwise(folded)


def normalize_header(value: Column) -> Column:
    """Case folded, every run of characters that are no letter, digit or underscore one space, trimmed."""
    plain = F.regexp_replace(F.lower(value), "[^a-z0-9_]+", " ")
    return F.trim(F.when(is_ascii(value), plain).otherwise(F.regexp_replace(casefold(value), _NOT_WORD, " ")))


_CONTROLS = [chr(c) for c in range(32) if c not in (9, 10, 13)]


def spreadsheet_safe(value: Column) -> Column:
    """Control characters written out as ``\\xNN``; an apostrophe before what a spreadsheet would take for a formula."""
    escaped = value
    has = value.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
    for c in _CONTROLS:
        escaped = F.replace(escaped, F.lit(c), F.lit(f"\\x{ord(c):02x}"))
    shown = F.when(has, escaped).otherwise(value)
    return F.when(shown.rlike(r"^(?:[\t\r\n]|[ \t\r\n]*[=+\-@])"), F.concat(F.lit("'"), shown)).otherwise(shown)


def csv_field(value: Column) -> Column:
    """One field with minimal quoting; null is empty."""
    text = F.coalesce(value, F.lit(""))
    return F.when(text.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(values: Column) -> Column:
    """One line of an array of fields, without its line end.  A single empty field is quoted, so that the line is not lost."""
    line = F.array_join(F.transform(values, csv_field), ",")
    return F.when((F.size(values) == 1) & (line == ""), F.lit('""')).otherwise(line)


def clipped(value: Column, size: int = 160) -> Column:
    """The text, or its beginning and three dots where it is longer than ``size``."""
    return F.when(F.length(value) > size, F.concat(F.substring(value, 1, size - 3), F.lit("..."))).otherwise(value)


def output_filename(value: Column, extension: str) -> Column:
    """A safe file name for the tables of an uploaded file."""
    stem = F.regexp_replace(value, r"\.[^.]*$", "")
    safe = F.substring(F.regexp_replace(stem, r"[^A-Za-z0-9._ -]+", "_"), 1, 100)
    return F.concat(F.when(safe == "", F.lit("document")).otherwise(safe), F.lit(f"-tables.{extension}"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Rounded to six places; 1 where there is nothing to count."""
    return F.when(denominator == 0, F.lit(1.0)).otherwise(F.round(numerator / denominator, 6))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, F.lit(0.0)).otherwise(F.round(2 * precision * recall / (precision + recall), 6))
