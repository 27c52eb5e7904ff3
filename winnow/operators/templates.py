"""Leaf predicates. Each gives a Column for either polarity, such that a WHERE keeps the right rows.

Requests know two truth values: a null column makes a comparison false, and its negation true. As negation is pushed down
to the leaves, every operator says itself what its negation keeps; so no leaf is wrapped and filters still reach the scan."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import parsers
from ..model import FilterConfigurationError

Build = Callable[[Column, Any, bool], Column]


@dataclass(frozen=True)
class Operator:
    """``form``: "value", "array", "unary", or "typed" (parsed by its own parser, seen by no interceptor)."""

    name: str
    form: str
    build: Build
    parse: parsers.Parser | None = None


def _kept_if_null(p: Column, column: Column) -> Column:
    return p | column.isNull()


def equality(name: str, parse: parsers.Parser, lit: Callable[[Any], Column], differs: bool = False) -> Operator:
    def build(column: Column, value: Any, negated: bool) -> Column:
        unequal = differs != negated
        if value is None:
            return column.isNotNull() if unequal else column.isNull()
        return ~column.eqNullSafe(lit(value)) if unequal else column == lit(value)

    return Operator(name, "value", build, parse)


#: name: (comparison, its complement, whether NaN would pass)
_ORDER = {
    "gt": (lambda c, v: c > v, lambda c, v: c <= v, True),
    "gte": (lambda c, v: c >= v, lambda c, v: c < v, True),
    "lt": (lambda c, v: c < v, lambda c, v: c >= v, False),
    "lte": (lambda c, v: c <= v, lambda c, v: c > v, False),
}


def order(name: str, parse: parsers.Parser, lit: Callable[[Any], Column], floating: bool = False) -> Operator:
    """Spark has NaN above all numbers; here a comparison with NaN is false, so its negation keeps NaN."""
    compare, complement, nan_passes = _ORDER[name]

    def build(column: Column, value: Any, negated: bool) -> Column:
        if value is None or floating and value != value:
            return F.lit(negated)
        p = (complement if negated else compare)(column, lit(value))
        if floating and nan_passes:
            p = p | F.isnan(column) if negated else p & ~F.isnan(column)
        return _kept_if_null(p, column) if negated else p

    return Operator(name, "value", build, parse)


def membership(parse: parsers.Parser, lit: Callable[[Any], Column]) -> Operator:
    def build(column: Column, values: Any, negated: bool) -> Column:
        some = [lit(v) for v in values if v is not None]
        with_null = len(some) < len(values)
        if negated:
            out = ~column.isin(some) if some else F.lit(True)
            return out & column.isNotNull() if with_null else _kept_if_null(out, column) if some else out
        out = column.isin(some) if some else F.lit(False)
        return out | column.isNull() if with_null else out

    return Operator("in", "array", build, parsers.array(parse))


def matching(name: str, parse: parsers.Parser, method: str) -> Operator:
    """Literal text, no pattern: % and _ are ordinary characters."""

    def build(column: Column, value: Any, negated: bool) -> Column:
        if value is None:
            return F.lit(negated)
        p = getattr(column, method)(F.lit(value))
        return F.coalesce(~p, F.lit(True)) if negated else p

    return Operator(name, "value", build, parse)


def is_null() -> Operator:
    return Operator("isNull", "unary", lambda column, _, negated: column.isNotNull() if negated else column.isNull())


def _arity(name: str, body: Callable, n: int) -> None:
    try:
        inspect.signature(body).bind(*range(n))
    except TypeError:
        raise FilterConfigurationError(f"Operator '{name}' has to take {n} argument{'s' * (n > 1)}.") from None


def _custom(name: str, make: Callable[[Column, Any], Column]) -> Build:
    def build(column: Column, value: Any, negated: bool) -> Column:
        p = make(column, value)
        if not isinstance(p, Column):
            raise FilterConfigurationError(f"Operator '{name}' has to return a Column.")
        return F.coalesce(~p, F.lit(True)) if negated else p

    return build


def value_op(name: str, body: Callable[[Column, Any], Column], parse: parsers.Parser | None = None, type: Any = None) -> Operator:
    """An operator with a value: parsed by ``parse``, or decoded into the Python type ``type``."""
    _arity(name, body, 2)
    if (parse is None) == (type is None):
        raise FilterConfigurationError(f"Operator '{name}' needs a parser or a type, and not both.")
    return Operator(name, "value" if parse else "typed", _custom(name, body), parse or parsers.typed(name, type))


def unary_op(name: str, body: Callable[[Column], Column]) -> Operator:
    _arity(name, body, 1)
    return Operator(name, "unary", _custom(name, lambda column, _: body(column)))
