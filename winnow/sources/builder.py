"""Builds requests in Python: ``request(where=and_(field("age").gte(18), not_(field("name").is_null())), sort=[desc("age")])``."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterable
from decimal import Decimal
from typing import Any

from ..model import UNDEFINED, Dir, FilterRequest, Group, Leaf, SortItem


def _value(value: Any) -> Any:
    """Times become ISO texts (instants in UTC, ending in Z); numbers have to be finite; arrays item by item."""
    if isinstance(value, dt.datetime):
        moment = value.astimezone(dt.UTC) if value.tzinfo else value
        return moment.replace(tzinfo=None).isoformat(timespec="milliseconds") + "Z"
    if isinstance(value, (dt.date, dt.time)):
        return value.isoformat()
    if isinstance(value, (float, Decimal)) and not math.isfinite(value):
        raise TypeError(f"Filter values must be finite numbers, got {value}.")
    return [_value(v) for v in value] if isinstance(value, (list, tuple)) else value


class Field:
    def __init__(self, name: str):
        self.name = name

    def op(self, name: str, value: Any = UNDEFINED) -> Leaf:
        return Leaf(self.name, name, _value(value))

    def is_null(self) -> Leaf:
        return Leaf(self.name, "isNull")

    def in_(self, values: Iterable[Any]) -> Leaf:
        return self.op("in", list(values))


for _method, _op in (("eq", "eq"), ("ne", "ne"), ("gt", "gt"), ("gte", "gte"), ("lt", "lt"), ("lte", "lte"), ("contains", "contains"), ("starts_with", "startsWith"), ("ends_with", "endsWith")):
    setattr(Field, _method, lambda self, value, _op=_op: self.op(_op, value))


def field(name: str) -> Field:
    return Field(name)


def _group(op: str, children: Iterable[Any]) -> Group | None:
    kept = tuple(c for c in children if c)
    return Group(op, kept) if kept else None


def and_(*children: Any) -> Group | None:
    """Without children (or only falsy ones) there is no group."""
    return _group("and", children)


def or_(*children: Any) -> Group | None:
    return _group("or", children)


def not_(child: Any) -> Group | None:
    return _group("not", [child])


def asc(name: str) -> SortItem:
    return SortItem(name, Dir.ASC)


def desc(name: str) -> SortItem:
    return SortItem(name, Dir.DESC)


def sort_by(name: str, direction: int | None = None) -> SortItem:
    return SortItem(name, direction)


def with_tiebreakers(sort: Iterable[SortItem] | None, *items: SortItem) -> list[SortItem]:
    """Appends those whose field is not sorted by yet, in any case of letters."""
    out = list(sort or ())
    seen = {s.field.upper() for s in out}
    for s in items:
        if s.field.upper() not in seen:
            seen.add(s.field.upper())
            out.append(s)
    return out


def request(where: Any = None, sort: Iterable[SortItem] | None = None, page: int | None = None, page_size: int | None = None) -> FilterRequest:
    return FilterRequest(where or None, tuple(sort or ()) or None, page, page_size)
