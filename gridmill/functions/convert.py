"""Typed values: each profile column becomes one Column expression from raw text to (value, issue codes).

``value`` is canonical text: digits for whole numbers, plain notation with its
zeros kept for decimals, ``true``/``false``, ISO dates.  A value that does not
convert stays as it was read.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from datetime import datetime
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, IntegerType, StringType

from ..plans.profile import Column as Field
from .text import strip

# The words for true and false.
TRUE, FALSE = ("true", "yes", "y", "1"), ("false", "no", "n", "0")
_PLAIN = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"
_CANONICAL = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?\z"
_EXOTIC = r"(?U)^[\s\d_.eE+-]+$"
#: Plain numbers of up to so many characters compare as decimal(38, 18); longer ones by the slow path.
_SHORT = 19


def _of_given(one):
    """Arrow function of ``one`` of each text that is not null; the others, which are nearly all, cost nothing.

    Functions within functions are sent to workers whole, which then need no module of ours.
    """

    def run(raw: pd.Series) -> pd.Series:
        out, given = pd.Series([None] * len(raw), dtype=object), raw.notna()
        if given.any():
            out[given.to_numpy()] = [one(v) for v in raw[given]]
        return out

    return pandas_udf(run, StringType())


def _decimal_reader():
    def one(text):
        try:
            number = Decimal(text)
        except (InvalidOperation, TypeError):
            return None
        return format(number, "f") if number.is_finite() and abs(number.adjusted()) < 10_000 else None

    return one


#: Canonical text of decimals in other than plain ASCII notation; null where it is no finite number.
_exotic_decimal = _of_given(_decimal_reader())


@pandas_udf(IntegerType())
def _compare_long(value: pd.Series, bound: pd.Series) -> pd.Series:
    """Sign of value minus bound, exactly."""
    if not value.notna().any():
        return pd.Series([None] * len(value), dtype="Int32")
    return pd.Series([None if v is None else int(Decimal(v).compare(Decimal(b))) for v, b in zip(value, bound, strict=True)], dtype="Int32")


#: Digits of whole numbers written in digits of other scripts.
_exotic_integer = _of_given(lambda text: str(int(text)))

_DIGITS = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.decimal(c, None) is not None]
#: For ``translate``: digits of other scripts and the ASCII digits that they stand for.
_OTHER_DIGITS = "".join(_DIGITS), "".join(str(unicodedata.decimal(c)) for c in _DIGITS)


def _read_decimal(raw: Column) -> Column:
    """What ``_exotic_decimal`` gives, without a Python worker: exponents written out, underscores left out, digits of other scripts read."""
    # characters without a counterpart, here the underscore, are deleted
    text = F.translate(strip(raw), _OTHER_DIGITS[0] + "_", _OTHER_DIGITS[1])
    body = F.lower(F.regexp_replace(text, r"^[+-]", ""))
    mantissa, exponent = F.substring_index(body, "e", 1), F.when(body.contains("e"), F.substring_index(body, "e", -1).try_cast("int")).otherwise(F.lit(0))
    part = F.when(mantissa.contains("."), F.substring_index(mantissa, ".", -1)).otherwise(F.lit(""))
    digits = F.regexp_replace(F.concat(F.substring_index(mantissa, ".", 1), part), r"^0+(?=[0-9])", "")
    power = exponent.cast("long") - F.length(part)
    fits = F.abs(power + F.length(digits) - 1) < 10_000
    # a point inside the digits, which are filled with zeros before it
    filled = F.when(F.length(digits) > -power, digits).otherwise(F.concat(F.repeat(F.lit("0"), (1 - power - F.length(digits)).cast("int")), digits))
    split = (F.length(filled) + power).cast("int")
    plain = (
        F.when(power == 0, digits)
        .when(power > 0, F.when(digits == "0", digits).otherwise(F.concat(digits, F.repeat(F.lit("0"), power.cast("int")))))
        .otherwise(F.concat(F.substring(filled, F.lit(1), split), F.lit("."), F.substring(filled, split + 1, F.length(filled))))
    )
    number = text.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z")
    return F.when(number & fits, F.concat(F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit("")), plain))


def _compare_texts(value: Column, limit: str) -> Column:
    """What ``_compare_long`` gives, without a Python worker: sign, length and digits of canonical numbers are compared."""
    sign = (Decimal(limit) > 0) - (Decimal(limit) < 0)
    whole_at, _, part_at = limit.lstrip("-").partition(".")
    part_at = part_at.rstrip("0")
    body = F.regexp_replace(value, "^-", "")
    whole = F.substring_index(body, ".", 1)
    part = F.when(body.contains("."), F.rtrim(F.substring_index(body, ".", -1), F.lit("0"))).otherwise(F.lit(""))
    own = F.when((whole == "0") & (part == ""), F.lit(0)).when(value.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    size = (
        F.when(F.length(whole) < len(whole_at), F.lit(-1)).when(F.length(whole) > len(whole_at), F.lit(1))
        .when(whole < whole_at, F.lit(-1)).when(whole > whole_at, F.lit(1)).when(part < part_at, F.lit(-1)).when(part > part_at, F.lit(1)).otherwise(F.lit(0))
    )
    return F.when(value.isNotNull(), F.when(own < sign, F.lit(-1)).when(own > sign, F.lit(1)).when(own == 0, F.lit(0)).otherwise(own * size))


def plain_integer(raw: Column) -> Column:
    """Digits without leading zeros, with a minus sign; null where they are no ASCII digits."""
    digits = F.regexp_replace(raw, r"^[+-]?0*(?=[0-9])", "")
    value = F.when(raw.startswith("-") & (digits != "0"), F.concat(F.lit("-"), digits)).otherwise(digits)
    return F.when(raw.rlike(r"^[+-]?[0-9]+$") & ~raw.contains("\n"), value)


def _other_digits(raw: Column, plain: Column, jvm: bool = False) -> Column:
    """Whole numbers in digits of other scripts; only those go through an Arrow function, with ``jvm`` none."""
    odd = F.when(plain.isNull() & raw.rlike(r"(?U)^[+-]?\d+\z"), raw)
    return F.when(odd.isNotNull(), plain_integer(F.translate(odd, *_OTHER_DIGITS)) if jvm else _exotic_integer(odd))


def canonical_integer(raw: Column) -> Column:
    """Digits without leading zeros, with a minus sign; null where it is no whole number."""
    plain = plain_integer(raw)
    return F.coalesce(plain, _other_digits(raw, plain))


def plain_decimal(raw: Column) -> Column:
    """Canonical text of decimals in plain notation, zeros after the point kept; else null."""
    body = F.regexp_replace(raw, r"^[+-]", "")
    whole = F.regexp_replace(F.substring_index(body, ".", 1), r"^0+(?=[0-9])", "")
    whole = F.when(whole == "", F.lit("0")).otherwise(whole)
    part = F.when(body.contains("."), F.substring_index(body, ".", -1)).otherwise(F.lit(""))
    text = F.concat(F.when(raw.startswith("-"), F.lit("-")).otherwise(F.lit("")), whole, F.when(part != "", F.concat(F.lit("."), part)).otherwise(F.lit("")))
    # most numbers are canonical as they are written
    return F.when(raw.rlike(_CANONICAL), raw).when(raw.rlike(_PLAIN) & ~raw.contains("\n"), text)


def _other_decimals(raw: Column, plain: Column, jvm: bool = False) -> Column:
    """Decimals with exponents, underscores or other digits; only those go through an Arrow function, with ``jvm`` none."""
    odd = F.when(plain.isNull() & raw.rlike(_EXOTIC), raw)
    return F.when(odd.isNotNull(), _read_decimal(odd) if jvm else _exotic_decimal(odd))


def canonical_decimal(raw: Column) -> Column:
    """As ``plain_decimal``, in whatever notation the number is written."""
    plain = plain_decimal(raw)
    return F.coalesce(plain, _other_decimals(raw, plain))


def canonical_boolean(raw: Column) -> Column:
    folded = F.lower(raw)
    return F.when(folded.isin(*TRUE), F.lit("true")).when(folded.isin(*FALSE), F.lit("false"))


# Date directives as a pattern letter and the digits they take.
_DIRECTIVES = {"Y": ("yyyy", "[0-9]{4}"), "m": ("M", "[0-9]{1,2}"), "d": ("d", "[0-9]{1,2}"), "y": ("yy", "[0-9]{2}"), "b": ("MMM", "[A-Za-z]{3}"), "B": ("MMMM", "[A-Za-z]+"), "%": ("%", "%")}


def _date_format(directive: str) -> tuple[str, str]:
    """A date pattern and the regular expression of the texts it may read."""
    pattern, shape, i = "", "^", 0
    while i < len(directive):
        c = directive[i]
        if c == "%":
            i += 1
            if i >= len(directive) or directive[i] not in _DIRECTIVES:
                raise ValueError(f"date format {directive!r} has a directive that is not supported")
            letters, digits = _DIRECTIVES[directive[i]]
            pattern, shape = pattern + letters, shape + digits
        else:
            pattern += f"'{c}'" if c.isalpha() else "''" if c == "'" else c
            shape += f"\\x{ord(c):02x}" if ord(c) < 128 and not c.isalnum() else c
        i += 1
    return pattern, shape + "$"


def _any_date(formats: tuple[str, ...]):
    """Function that reads dates by directives which Spark's patterns do not have."""

    def one(text):
        for f in formats:
            try:
                return datetime.strptime(text, f).date().isoformat()
            except (ValueError, TypeError):
                pass
        return None

    @pandas_udf(StringType())
    def read(raw: pd.Series) -> pd.Series:
        return raw.map(one)

    return read


def canonical_date(raw: Column, formats: tuple[str, ...]) -> Column:
    """ISO text by the first format that reads it, else null."""
    try:
        shapes = [_date_format(f) for f in formats]
    except ValueError:
        return _any_date(tuple(formats))(raw)
    tried = []
    for pattern, shape in shapes:
        tidy = F.initcap(raw) if "MMM" in pattern else raw
        tried.append(F.when(raw.rlike(shape), F.try_to_date(tidy, pattern)))
    return F.date_format(F.coalesce(*tried), "yyyy-MM-dd")


def plain(raw: Column, field: Field) -> Column:
    """Canonical text as far as it needs no Python; null where it is not of the field's type, or in other notation."""
    match field.kind:
        case "integer":
            return plain_integer(raw)
        case "decimal":
            return plain_decimal(raw)
        case "boolean":
            return canonical_boolean(raw)
        case "date":
            return canonical_date(raw, field.formats)
    return raw


def completed(raw: Column, simple: Column, field: Field, jvm: bool = False) -> Column:
    """Canonical text from ``simple`` (what ``plain`` gave, best a column of its own) and, where it is null, from other notations.

    With ``jvm`` numbers are read without Arrow functions, which every row passes
    through, to the same text.
    """
    match field.kind:
        case "integer":
            return F.coalesce(simple, _other_digits(raw, simple, jvm))
        case "decimal":
            return F.coalesce(simple, _other_decimals(raw, simple, jvm))
    return simple


def is_plain(field: Field, jvm: bool = False) -> bool:
    """Whether the canonical text needs no Arrow function."""
    if jvm and field.kind in ("integer", "decimal"):
        return True
    if field.kind == "date":
        try:
            return bool([_date_format(f) for f in field.formats])
        except ValueError:
            return False
    return field.kind in ("string", "boolean")


def canonical(raw: Column, field: Field) -> Column:
    """Canonical text of ``raw``, null where it is not of the field's type."""
    return completed(raw, plain(raw, field), field)


def _sign(value: Column, bound: Decimal, jvm: bool = False) -> Column:
    """-1, 0 or 1 as a canonical number is below, at or above ``bound``; exact at any length."""
    limit = format(bound, "f")
    exact = len(limit.lstrip("-")) <= _SHORT
    short = F.length(value) <= (_SHORT if exact else -1)
    number, at = F.when(short, value.try_cast("decimal(38,18)")), F.lit(limit if exact else "0").cast("decimal(38,18)")
    quick = F.when(number < at, F.lit(-1)).when(number > at, F.lit(1)).when(number == at, F.lit(0))
    slow = F.when(~short, value)
    whole = F.coalesce(quick, F.when(slow.isNotNull(), _compare_texts(slow, limit) if jvm else _compare_long(slow, F.lit(limit))))
    # rounding to a double keeps the order, so only equal doubles need the exact numbers
    near, close = value.try_cast("double"), F.lit(float(bound))
    return F.when(near < close, F.lit(-1)).when(near > close, F.lit(1)).otherwise(whole)


#: Patterns that Java reads as Python does: plain characters, digits, simple classes, groups, repeats and alternatives.
_COMMON = re.compile(r"(?:[A-Za-z0-9 _#%@,:;/'\"=!~-]|\\[.\-+*?()\[\]{}|^$\\/d]|\[\^?(?:[A-Za-z0-9 _.#%@,:;/+*()-]|\\[.\-\]\\/d])+\]|\((?!\?)|\(\?:|[)|.]|[*+?]\??|\{[0-9]+(?:,[0-9]*)?\})*")


def _matches(value: Column, pattern: str) -> Column:
    """Whether the whole text matches, as Python's ``fullmatch`` has it; patterns beyond ``_COMMON`` go through an Arrow function."""
    body = pattern.removeprefix("^").removesuffix("$") if pattern.endswith("$") and not pattern.endswith("\\$") else pattern
    if _COMMON.fullmatch(body):
        return value.rlike(rf"(?dU)^(?:{body})\z")
    whole = re.compile(pattern)

    @pandas_udf(BooleanType())
    def found(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else whole.fullmatch(t) is not None)

    return found(value)


def _shown(value: Column, field: Field) -> Column:
    """The text that a pattern is held against."""
    return F.initcap(value) if field.kind == "boolean" else value


def _enum_texts(field: Field) -> list[str]:
    """Canonical texts that the allowed values of a field's type stand for."""
    out = []
    for v in field.enum or ():
        if field.kind in ("string", "decimal", "date") and isinstance(v, str):
            out.append(v)
        elif field.kind == "integer" and isinstance(v, bool | int | float) and v == int(v):
            out.append(str(int(v)))
        elif field.kind == "boolean" and isinstance(v, bool | int | float) and v in (0, 1):
            out.append("true" if v else "false")
    return out


# Issue codes of a cell, in the order in which they are given.
CODES = ("blank_required_value", "invalid_type", "pattern_mismatch", "value_not_allowed", "below_minimum", "above_maximum")


def message(code: str, field: Field) -> str:
    return {
        "blank_required_value": f"{field.name} may not be blank",
        "invalid_type": f"{field.name} is not a valid {field.kind}",
        "pattern_mismatch": f"{field.name} does not match its required pattern",
        "value_not_allowed": f"{field.name} is not an allowed value",
        "below_minimum": f"{field.name} is below its minimum",
        "above_maximum": f"{field.name} is above its maximum",
    }[code]


def codes(raw: Column, value: Column, field: Field, jvm: bool = False) -> Column:
    """Issue codes (``array<string>``) of stripped text and what ``canonical`` made of it.

    Built by concatenation, which stays inside code generation; ``value`` is read
    several times and had best be a column of its own.
    """
    none = F.array().cast("array<string>")
    found = lambda bad, code: F.when(bad, F.array(F.lit(code))).otherwise(none)
    later = []
    if field.pattern is not None:
        later.append(found(~_matches(_shown(value, field), field.pattern), "pattern_mismatch"))
    if field.enum is not None:
        later.append(found(~value.isin(*_enum_texts(field)) if _enum_texts(field) else F.lit(True), "value_not_allowed"))
    if field.minimum is not None:
        later.append(found(_sign(value, field.minimum, jvm) < 0, "below_minimum"))
    if field.maximum is not None:
        later.append(found(_sign(value, field.maximum, jvm) > 0, "above_maximum"))
    blank = none if field.allow_blank else F.array(F.lit("blank_required_value"))
    return F.when(raw == "", blank).when(value.isNull(), F.array(F.lit("invalid_type"))).otherwise(F.concat(*later) if later else none)


def check(raw: Column, field: Field) -> Column:
    """``struct<value string, codes array<string>>`` of stripped text."""
    value = canonical(raw, field)
    return F.struct(F.when(raw != "", F.coalesce(value, raw)).alias("value"), codes(raw, value, field).alias("codes"))
