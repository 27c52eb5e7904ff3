"""JSON values to typed Python values. Each parser returns the value or raises ``ParseError`` with the text for the client.

The texts for clients and the names of JSON kinds and types in them are fixed values of the wire format.
Narrower than a lenient parser on purpose: dates and times are ISO 8601 only, a JSON number for an integer has no
fraction or exponent, identifiers have the hyphenated form of 36 characters."""

from __future__ import annotations

import datetime as dt
import math
import re
import struct
import uuid
from collections.abc import Callable
from decimal import Decimal, InvalidOperation
from typing import Any

from ..model import UNDEFINED

Parser = Callable[[Any], Any]


class ParseError(ValueError):
    pass


def kind(value: Any) -> str:
    for test, name in ((UNDEFINED, "Undefined"), (None, "Null"), (True, "True"), (False, "False")):
        if value is test:
            return name
    for kinds, name in (((int, float, Decimal), "Number"), (str, "String"), ((list, tuple), "Array"), (dict, "Object")):
        if isinstance(value, kinds):
            return name
    raise TypeError(f"not a JSON value: {value!r}")


_INTEGER, _DECIMAL = re.compile(r"[+-]?[0-9]+"), re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)")
_FLOAT = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|NaN|[+-]?Infinity")
#: Fixed value: the largest decimal of the wire format.
_MOST = Decimal("79228162514264337593543950335")


def _numeric(name: str, style: re.Pattern, convert: Callable[[Any], Any]) -> Parser:
    def parse(value: Any) -> Any:
        k = kind(value)
        if k == "Number":
            try:
                return convert(value)
            except (ValueError, OverflowError, InvalidOperation):
                raise ParseError(f"Number out of range for {name}.") from None
        if k == "String":
            try:
                if style.fullmatch(value):
                    return convert(Decimal(value) if style is not _INTEGER else int(value))
            except (ValueError, OverflowError, InvalidOperation):
                pass
            raise ParseError(f"String '{value}' is not a valid invariant {name}.")
        raise ParseError(f"Expected JSON Number or String for {name}, got {k}.")

    return parse


def integer(name: str, low: int, high: int) -> Parser:
    def convert(value: Any) -> int:
        if not isinstance(value, int) or not low <= value <= high:
            raise ValueError
        return value

    return _numeric(name, _INTEGER, convert)


def _to_decimal(value: Any) -> Decimal:
    d = Decimal(str(value)) if isinstance(value, float) else Decimal(value)
    if not d.is_finite() or abs(d) > _MOST:
        raise ValueError
    return d


def _to_single(value: Any) -> float:
    x = float(value)
    return x if math.isnan(x) or math.isinf(x) else struct.unpack("f", struct.pack("f", x))[0]


byte = integer("Byte", 0, 255)
int16 = integer("Int16", -(2**15), 2**15 - 1)
int32 = integer("Int32", -(2**31), 2**31 - 1)
int64 = integer("Int64", -(2**63), 2**63 - 1)
decimal = _numeric("Decimal", _DECIMAL, _to_decimal)
single = _numeric("Single", _FLOAT, _to_single)
double = _numeric("Double", _FLOAT, float)


def string(value: Any) -> str:
    if kind(value) != "String":
        raise ParseError(f"Expected JSON String, got {kind(value)}.")
    return value


def boolean(value: Any) -> bool:
    if kind(value) not in ("True", "False"):
        raise ParseError(f"Expected JSON True/False, got {kind(value)}.")
    return value


def _text(name: str, what: str, convert: Callable[[str], Any]) -> Parser:
    def parse(value: Any) -> Any:
        if kind(value) != "String":
            raise ParseError(f"Expected JSON String for {name}, got {kind(value)}.")
        try:
            return convert(value)
        except (ValueError, OverflowError):
            raise ParseError(f"String '{value}' is not a valid {what}.") from None

    return parse


_GUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_ISO_DATE_TIME = re.compile(r"(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,7})?)?)(Z|[+-]\d{2}:\d{2})?)?", re.ASCII)


def _guid(text: str) -> str:
    if not _GUID.fullmatch(text):
        raise ValueError
    return str(uuid.UUID(text))


def _moment(text: str) -> tuple[dt.datetime, bool]:
    m = _ISO_DATE_TIME.fullmatch(text)
    if not m:
        raise ValueError
    clock = re.sub(r"(\.\d{6})\d+", r"\1", m[2] or "00:00")
    zone = "+00:00" if m[3] in ("Z", None) else m[3]
    return dt.datetime.fromisoformat(f"{m[1]}T{clock}{zone}").astimezone(dt.UTC), m[3] is not None


def _local(text: str) -> str:
    """Wall clock; a text with a zone is turned to UTC."""
    return _moment(text)[0].replace(tzinfo=None).isoformat(sep=" ", timespec="microseconds")


def _instant(text: str) -> str:
    """An instant; a text without a zone is read as UTC."""
    return _moment(text)[0].isoformat(sep=" ", timespec="microseconds")


def _date(text: str) -> str:
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text, re.ASCII):
        raise ValueError
    return dt.date.fromisoformat(text).isoformat()


def _time(text: str) -> str:
    if not re.fullmatch(r"\d{2}:\d{2}(?::\d{2}(?:\.\d{1,7})?)?", text, re.ASCII):
        raise ValueError
    return dt.time.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", text)).isoformat(timespec="microseconds")


guid = _text("Guid", "Guid", _guid)
date_time = _text("DateTime", "ISO 8601 DateTime", _local)
date_time_offset = _text("DateTimeOffset", "ISO 8601 DateTimeOffset", _instant)
date_only = _text("DateOnly", "ISO 8601 DateOnly", _date)
time_only = _text("TimeOnly", "ISO 8601 TimeOnly", _time)


def enum(name: str, members: list[str], stored: str) -> Parser:
    """A member's name in any case, or its number. ``stored``: "name" or "number"; a number that no member has passes and,
    where names are stored, matches nothing."""
    by_name = {m.upper(): i for i, m in enumerate(members)}

    def parse(value: Any) -> Any:
        k = kind(value)
        if k == "String":
            number = by_name.get(value.strip().upper())
            if number is None and re.fullmatch(r"[+-]?[0-9]+", value.strip(), re.ASCII):
                number = int(value) if len(value) < 4000 else None
            if number is None:
                raise ParseError(f"String '{value}' is not a valid member of enum {name}.")
        elif k == "Number":
            if not isinstance(value, int) or not -(2**31) <= value < 2**31:
                raise ParseError(f"Number out of range for enum {name}.")
            number = value
        else:
            raise ParseError(f"Expected JSON String or Number for enum {name}, got {k}.")
        if stored == "number":
            return number
        return members[number] if 0 <= number < len(members) else str(number)

    return parse


def array(element: Parser) -> Parser:
    def parse(value: Any) -> list:
        if kind(value) != "Array":
            raise ParseError(f"Expected JSON Array, got {kind(value)}.")
        out = []
        for i, x in enumerate(value):
            try:
                out.append(element(x))
            except ParseError as error:
                raise ParseError(f"Array element [{i}]: {error}") from None
        return out

    return parse


def typed(operator: str, like: Any) -> Parser:
    """For operators with a value of a declared Python type: int, float, str, bool, Decimal, list[...] or a callable."""

    def fits(value: Any, want: Any) -> Any:
        origin = getattr(want, "__origin__", None)
        if origin in (list, tuple):
            if not isinstance(value, (list, tuple)):
                raise ValueError
            return [fits(x, want.__args__[0]) for x in value]
        if want is bool:
            if not isinstance(value, bool):
                raise ValueError
            return value
        if want in (int, float, Decimal):
            if isinstance(value, bool) or not isinstance(value, (int, float, Decimal)) or want is int and not isinstance(value, int):
                raise ValueError
            return want(value)
        if want in (str, dict, list):
            if not isinstance(value, want):
                raise ValueError
            return value
        return want(value)

    def parse(value: Any) -> Any:
        if value is UNDEFINED or value is None:
            raise ParseError(f"Expected a JSON value for operator '{operator}', got {kind(value)}.")
        try:
            return fits(value, like)
        except (ValueError, TypeError, KeyError):
            raise ParseError(f"The value of operator '{operator}' is not a valid {getattr(like, '__name__', like)}.") from None

    return parse
