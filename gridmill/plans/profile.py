"""Profiles: versioned JSON contracts that say which tables to accept and how to read them.

A profile is checked once on the driver and becomes a frozen ``Profile``; from
there on it only produces Column expressions and two tiny tables (columns,
aliases), so no profile object travels with the data.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from copy import deepcopy
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation
from functools import cached_property
from pathlib import Path

from ..functions.paths import checked_path

SCHEMA_VERSION = "1.0"
MAX_PROFILE_BYTES = 1_000_000
_ID = re.compile(r"[a-z0-9][a-z0-9._-]{1,63}")
_NAME = re.compile(r"[a-z][a-z0-9_]{0,63}")
NUMERIC = ("integer", "decimal")
TYPES = ("string", "integer", "decimal", "boolean", "date")
_KEYS = {
    "profile": {"$schema", "profile_schema_version", "id", "version", "description", "table"},
    "table": {"columns", "header_search_rows", "minimum_header_match", "allow_extra_columns", "min_records", "unique_by"},
    "column": {"name", "aliases", "type", "required", "allow_blank", "pattern", "enum", "minimum", "maximum", "formats"},
}


class ProfileError(ValueError):
    """The profile breaks its contract."""


def normalize_header_text(value: object) -> str:
    """Driver-side twin of ``functions.text.normalize_header``, for aliases and tests."""
    text = str(value).casefold()
    kept = "".join(c if c == "_" or unicodedata.category(c)[0] in "LN" else " " for c in text)
    return " ".join(kept.split(" ")).strip() if "  " not in kept else re.sub(" +", " ", kept).strip(" ")


def _fail(where: str, what: str):
    raise ProfileError(f"{where} {what}")


def _known_keys(value: object, kind: str, where: str) -> dict:
    if not isinstance(value, dict):
        _fail(where, "must be an object")
    if extra := sorted(set(value) - _KEYS[kind]):
        _fail(where, f"has unknown keys: {', '.join(extra)}")
    return value


def _text(value: object, where: str) -> str:
    if not isinstance(value, str) or not value.strip():
        _fail(where, "must be a non-empty string")
    return value.strip()


def _texts(value: object, where: str, allow_empty: bool = False) -> list[str]:
    good = isinstance(value, list) and (value or allow_empty) and all(isinstance(v, str) and v.strip() for v in value)
    if not good:
        _fail(where, "must be an array of non-empty strings")
    return value


def _bound(value: object, where: str) -> Decimal:
    try:
        number = Decimal(str(value))
    except InvalidOperation:
        number = None
    if number is None or not number.is_finite():
        _fail(where, "must be a finite number")
    return number


def _whole(value: object, low: int, high: int | None, where: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < low or (high is not None and value > high):
        _fail(where, f"must be a whole number from {low}" + (f" to {high}" if high is not None else ""))
    return value


def _check_column(column: object, where: str, owners: dict[str, str]) -> str:
    """Fill in a column's defaults; ``owners`` maps every normalised alias so far to its column."""
    _known_keys(column, "column", where)
    name = _text(column.get("name"), f"{where}.name")
    if not _NAME.fullmatch(name):
        _fail(f"{where}.name", "must be lower-case letters, digits and underscores")
    if name in owners.values():
        _fail(where, f"repeats the column name {name!r}")
    kind = column.setdefault("type", "string")
    if kind not in TYPES:
        _fail(f"{where}.type", f"must be one of {', '.join(TYPES)}")
    for flag in ("required", "allow_blank"):
        if not isinstance(column.get(flag, False), bool):
            _fail(f"{where}.{flag}", "must be true or false")
    column["aliases"] = list(dict.fromkeys([name, *_texts(column.get("aliases", []), f"{where}.aliases", allow_empty=True)]))
    for alias in column["aliases"]:
        key = normalize_header_text(alias)
        if not key:
            _fail(f"{where}.aliases", "hold an alias without a letter or digit")
        if owners.setdefault(key, name) != name:
            _fail(where, f"shares the alias {alias!r} with {owners[key]!r}")
    if "pattern" in column:
        try:
            re.compile(_text(column["pattern"], f"{where}.pattern"))
        except re.error as error:
            _fail(f"{where}.pattern", f"is no regular expression: {error}")
    if "enum" in column and not (isinstance(column["enum"], list) and column["enum"]):
        _fail(f"{where}.enum", "must be a non-empty array")
    if kind == "date" and "formats" in column:
        _texts(column["formats"], f"{where}.formats")
    limits = {}
    for side in ("minimum", "maximum"):
        if side in column:
            if kind not in NUMERIC:
                _fail(f"{where}.{side}", "needs a numeric column")
            limits[side] = _bound(column[side], f"{where}.{side}")
    if len(limits) == 2 and limits["minimum"] > limits["maximum"]:
        _fail(where, "has a minimum above its maximum")
    return name


def validate(profile: object) -> dict:
    """A checked copy with defaults filled in; raises ``ProfileError``."""
    checked = deepcopy(_known_keys(profile, "profile", "profile"))
    if checked.get("profile_schema_version") != SCHEMA_VERSION:
        _fail("profile_schema_version", f"must be {SCHEMA_VERSION!r}")
    if not _ID.fullmatch(_text(checked.get("id"), "id")):
        _fail("id", "must be 2 to 64 lower-case letters, digits, dots, dashes or underscores")
    for key in ("version", "description"):
        _text(checked.get(key), key)
    table = _known_keys(checked.get("table"), "table", "table")
    columns = table.get("columns")
    if not isinstance(columns, list) or not columns:
        _fail("table.columns", "must be a non-empty array")
    owners: dict[str, str] = {}
    names = [_check_column(c, f"table.columns[{i}]", owners) for i, c in enumerate(columns)]
    _whole(table.setdefault("header_search_rows", 3), 1, 20, "table.header_search_rows")
    match = table.get("minimum_header_match", 1.0)
    if isinstance(match, bool) or not isinstance(match, int | float) or not 0 < match <= 1:
        _fail("table.minimum_header_match", "must be above 0 and at most 1")
    table["minimum_header_match"] = float(match)
    _whole(table.setdefault("min_records", 1), 1, None, "table.min_records")
    if not isinstance(table.setdefault("allow_extra_columns", True), bool):
        _fail("table.allow_extra_columns", "must be true or false")
    unique = table.setdefault("unique_by", [])
    if not isinstance(unique, list) or any(u not in names for u in unique) or len(set(unique)) != len(unique):
        _fail("table.unique_by", "must hold declared column names, each once")
    return checked


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def profile_sha256(profile: dict) -> str:
    return hashlib.sha256(canonical_json(validate(profile)).encode()).hexdigest()


def parse_object(text: str, name: str) -> dict:
    """A JSON object in which no key repeats."""

    def unique(pairs):
        out = dict(pairs)
        if len(out) < len(pairs):
            raise ProfileError(f"{name} repeats a JSON key")
        return out

    try:
        value = json.loads(text, object_pairs_hook=unique)
    except json.JSONDecodeError as error:
        raise ProfileError(f"{name} is not JSON: {error}") from error
    if not isinstance(value, dict):
        raise ProfileError(f"{name} must hold a JSON object")
    return value


_BUILTIN = Path(__file__).with_name("profiles")


@dataclass(frozen=True)
class Column:
    name: str
    kind: str
    required: bool
    allow_blank: bool
    aliases: tuple[str, ...]
    pattern: str | None
    enum: tuple | None
    minimum: Decimal | None
    maximum: Decimal | None
    formats: tuple[str, ...]


@dataclass(frozen=True)
class Profile:
    """A checked profile."""

    source: str  # canonical JSON

    @cached_property
    def raw(self) -> dict:
        return json.loads(self.source)

    @cached_property
    def table(self) -> dict:
        return self.raw["table"]

    @cached_property
    def sha256(self) -> str:
        return profile_sha256(self.raw)

    @cached_property
    def columns(self) -> tuple[Column, ...]:
        out = []
        for c in self.table["columns"]:
            required = c.get("required", False)
            limits = [Decimal(str(c[k])) if k in c else None for k in ("minimum", "maximum")]
            enum = tuple(c["enum"]) if "enum" in c else None
            out.append(
                Column(c["name"], c["type"], required, c.get("allow_blank", not required), tuple(c["aliases"]), c.get("pattern"), enum, *limits, tuple(c.get("formats", ["%Y-%m-%d"])))
            )
        return tuple(out)

    @cached_property
    def fields(self) -> list[str]:
        return [c.name for c in self.columns]

    @cached_property
    def required(self) -> list[str]:
        return sorted(c.name for c in self.columns if c.required)

    @cached_property
    def aliases(self) -> dict[str, str]:
        """Normalised alias -> column name."""
        return {normalize_header_text(a): c.name for c in self.columns for a in c.aliases}


def load(reference: str | dict | Profile) -> Profile:
    """A profile from a built-in id, a path to a JSON file, or an object."""
    if isinstance(reference, Profile):
        return reference
    if isinstance(reference, str) and reference.strip():
        name = reference.strip()
        builtin = _BUILTIN / f"{name}.json"
        if _ID.fullmatch(name) and builtin.is_file():
            reference = parse_object(builtin.read_text("utf-8"), name)
        else:
            path = Path(checked_path(name))
            if path.suffix.lower() != ".json":
                raise ProfileError("a profile file must be JSON")
            if not path.is_file():
                raise ProfileError(f"no such profile: {name}")
            if path.stat().st_size > MAX_PROFILE_BYTES:
                raise ProfileError("a profile file has at most 1 MB")
            reference = parse_object(path.read_text("utf-8"), name)
    if not isinstance(reference, dict):
        raise ProfileError("a profile is a built-in id, a path to a JSON file, or an object")
    return Profile(canonical_json(validate(reference)))


def builtin_profiles() -> list[dict]:
    """Metadata of the profiles that come with the package, by file name."""
    out = []
    for path in sorted(_BUILTIN.glob("*.json"), key=lambda p: p.name):
        p = load(path.stem)
        out.append({"id": p.raw["id"], "version": p.raw["version"], "description": p.raw["description"], "columns": p.fields, "sha256": p.sha256})
    return out
