"""Named, immutable operator sets by column type. Names are case-insensitive and keep the order of declaration."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parsers
from ..model import FilterConfigurationError
from . import templates as t


@dataclass(frozen=True)
class Profile:
    """``types``: Spark types of the columns it fits."""

    name: str
    operators: tuple[t.Operator, ...]
    types: tuple[type, ...] = ()

    def __post_init__(self):
        if not self.name or not self.name.strip():
            raise FilterConfigurationError("A filter profile name must be a non-empty string.")
        seen = set()
        for op in self.operators:
            if op is None:
                raise FilterConfigurationError(f"Profile '{self.name}' was given a null operator.")
            if op.name.upper() in seen:
                raise FilterConfigurationError(f"Profile '{self.name}' declares operator '{op.name}' more than once.")
            seen.add(op.name.upper())

    @staticmethod
    def create(name: str, *operators: t.Operator, types: Iterable[type] = ()) -> Profile:
        return Profile(name, operators, tuple(types))

    def extend(self, name: str, *operators: t.Operator) -> Profile:
        """All of this profile's operators and new ones; to declare one again is an error."""
        return Profile(name, (*self.operators, *operators), self.types)

    def extend_with_overrides(self, name: str, *operators: t.Operator) -> Profile:
        """As ``extend``, but an operator of the same name takes the inherited one's place."""
        Profile(name, operators)
        new = {op.name.upper(): op for op in operators}
        kept = [new.pop(op.name.upper(), op) for op in self.operators]
        return Profile(name, (*kept, *new.values()), self.types)

    @property
    def names(self) -> list[str]:
        return [op.name for op in self.operators]


def _cast(kind: str) -> Callable[[Any], Column]:
    return lambda value: F.lit(value).cast(kind)


def _decimal(value: Any) -> Column:
    """A literal of just the digits it has, so that a column is not widened more than it must be."""
    _, digits, exponent = value.as_tuple()
    scale = max(0, -exponent)
    return F.lit(value).cast(f"decimal({min(38, max(len(digits) + max(0, exponent), scale, 1))},{min(scale, 38)})")


def _ordered(name: str, parse: parsers.Parser, lit: Callable[[Any], Column], types: tuple, with_in: bool = True, floating: bool = False) -> Profile:
    ops = [t.equality("eq", parse, lit), t.equality("ne", parse, lit, differs=True), *(t.order(o, parse, lit, floating) for o in ("gt", "gte", "lt", "lte"))]
    return Profile(name, (*ops, *[t.membership(parse, lit)] * with_in, t.is_null()), types)


def _named(name: str, parse: parsers.Parser, lit: Callable[[Any], Column], types: tuple) -> Profile:
    return Profile(name, (t.equality("eq", parse, lit), t.equality("ne", parse, lit, differs=True), t.membership(parse, lit), t.is_null()), types)


_s = parsers.string
STRING = Profile(
    "StringFilter",
    (t.equality("eq", _s, F.lit), t.equality("ne", _s, F.lit, differs=True), t.matching("contains", _s, "contains"), t.matching("startsWith", _s, "startswith"), t.matching("endsWith", _s, "endswith"), t.membership(_s, F.lit), t.is_null()),
    (T.StringType,),
)
BOOL = Profile("BoolFilter", (t.equality("eq", parsers.boolean, F.lit), t.is_null()), (T.BooleanType,))
BYTE = _ordered("ByteFilter", parsers.byte, _cast("smallint"), ())
INT16 = _ordered("Int16Filter", parsers.int16, _cast("smallint"), (T.ShortType, T.ByteType))
INT32 = _ordered("Int32Filter", parsers.int32, _cast("int"), (T.IntegerType,))
INT64 = _ordered("Int64Filter", parsers.int64, _cast("bigint"), (T.LongType,))
DECIMAL = _ordered("DecimalFilter", parsers.decimal, _decimal, (T.DecimalType,))
SINGLE = _ordered("SingleFilter", parsers.single, _cast("float"), (T.FloatType,), floating=True)
DOUBLE = _ordered("DoubleFilter", parsers.double, _cast("double"), (T.DoubleType,), floating=True)
GUID = _named("GuidFilter", parsers.guid, F.lit, ())
DATE_TIME = _ordered("DateTimeFilter", parsers.date_time, _cast("timestamp_ntz"), (T.TimestampNTZType,), with_in=False)
DATE_TIME_OFFSET = _ordered("DateTimeOffsetFilter", parsers.date_time_offset, _cast("timestamp"), (T.TimestampType,), with_in=False)
DATE_ONLY = _ordered("DateOnlyFilter", parsers.date_only, _cast("date"), (T.DateType,), with_in=False)
TIME_ONLY = _ordered("TimeOnlyFilter", parsers.time_only, _cast("time(6)"), (T.TimeType,), with_in=False)

BUILT_IN = [STRING, BOOL, BYTE, INT16, INT32, INT64, DECIMAL, SINGLE, DOUBLE, GUID, DATE_TIME, DATE_TIME_OFFSET, DATE_ONLY, TIME_ONLY]


def enum_profile(name: str, members: list[str], stored: str = "name") -> Profile:
    """For a column that has an enum's member names, or their numbers."""
    return _named(f"{name}Filter", parsers.enum(name, members, stored), F.lit if stored == "name" else _cast("int"), (T.StringType,) if stored == "name" else (T.IntegerType, T.ShortType, T.LongType))


def infer(kind: T.DataType, known: Iterable[Profile] = BUILT_IN) -> Profile:
    """The one profile that fits a column type."""
    fitting = [p for p in known if isinstance(kind, p.types)]
    if len(fitting) != 1:
        raise FilterConfigurationError(f"No profile can be inferred for type '{kind.simpleString()}'." if not fitting else f"More than one profile fits type '{kind.simpleString()}': {', '.join(p.name for p in fitting)}.")
    return fitting[0]
