"""Filters as classes. The decorator checks the declaration against the rows' type when the class is defined:

    @filter_for(orders.schema)
    class Orders:
        key = map_("o_orderkey", sortable=True)
        customer = nested("customer", lambda: Customers, table="customer", on={"o_custkey": "c_custkey"})

        @rule("year", sortable=True)
        def year(r):
            return r.of(lambda s: F.year(s["o_orderdate"])).operator(...)

        @intercept("o_clerk")
        def clerk(value, context): ...

``Orders.definition(customer=...)`` then gives a FilterDefinition."""

from __future__ import annotations

import inspect
import warnings
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .model import Dir, FilterConfigurationError, Settings
from .operators.profiles import BUILT_IN, Profile, infer
from .operators.templates import Operator, unary_op, value_op
from .plans.engine import FilterDefinition
from .plans.schema import MAX_DEPTH, Accessor, Hop, SchemaBuilder, prop
from .plans.schema import rule as computed

_DEFAULTS = [Settings()]
#: Filters by name, for nestings that name their target: under a name, by where they were defined; a class that is defined
#: again takes its own place.
REGISTRY: dict[str, dict[tuple[str, str], type]] = {}
#: Types of columns that are mostly sorted by.
_MEASURES = (T.IntegerType, T.LongType, T.ShortType, T.DecimalType, T.DoubleType, T.FloatType, T.DateType, T.TimestampType, T.TimestampNTZType)


def set_defaults(**limits: int) -> None:
    """Limits of filters defined from now on: default_page_size, max_page_size, max_nesting_depth, max_leaf_conditions."""
    _DEFAULTS[0] = Settings(**(vars(_DEFAULTS[0]) | limits))


@dataclass(frozen=True)
class Map:
    name: str
    profile: Profile | None = None
    only: tuple[str, ...] | None = None
    except_: tuple[str, ...] | None = None
    alias: str | None = None
    sortable: bool = False
    default_dir: int | None = None


def map_(name: str, profile: Profile | None = None, only: Iterable[str] | None = None, except_: Iterable[str] | None = None, alias: str | None = None, sortable: bool = False, default_dir: int | None = None) -> Map:
    return Map(name, profile, None if only is None else tuple(only), None if except_ is None else tuple(except_), alias, sortable, default_dir)


@dataclass(frozen=True)
class Nested:
    name: str
    target: Any
    hops: tuple[Hop, ...]
    prefix: str | None = None
    only: tuple[str, ...] | None = None
    except_: tuple[str, ...] | None = None
    disable_sorting: bool = False
    max_depth: int = 0


def nested(name: str, target: Any, table: str, on: Mapping[str, str], via: Iterable[Hop] = (), **options: Any) -> Nested:
    """``target``: a filter class, its name, or a function that gives it. ``via``: hops before the last one."""
    return Nested(name, target, (*via, Hop(name, table, tuple(on), tuple(on.values()))), **options)


class RuleBuilder:
    def __init__(self):
        self.accessor: Accessor | None = None
        self.operators: list[Operator] = []

    def of(self, accessor: Accessor) -> RuleBuilder:
        if self.accessor:
            raise FilterConfigurationError("A rule calls of(...) more than once; declare exactly one accessor.")
        self.accessor = accessor
        return self

    def operator(self, *operators: Operator) -> RuleBuilder:
        for op in operators:
            if op.name.upper() in {o.name.upper() for o in self.operators}:
                raise FilterConfigurationError(f"A rule declares operator '{op.name}' more than once.")
            self.operators.append(op)
        return self


@dataclass(frozen=True)
class Rule:
    name: str
    body: Callable
    alias: str | None
    sortable: bool
    default_dir: int | None


def rule(name: str, alias: str | None = None, sortable: bool = False, default_dir: int | None = None):
    def wrap(body: Callable) -> Rule:
        _takes(body, 1, f"Rule '{name}'")
        return Rule(name, body, alias, sortable, default_dir)

    return wrap


@dataclass(frozen=True)
class Intercept:
    name: str
    body: Callable
    form: str


def intercept(name: str, form: str = "scalar"):
    """``form``: "scalar", "array" or "raw"."""

    def wrap(body: Callable) -> Intercept:
        _takes(body, 2, f"Interceptor of '{name}'")
        return Intercept(name, body, form)

    return wrap


def profile(*types: type, based_on: Profile | None = None):
    """A profile from a class: each attribute that is an Operator, as ``operator`` makes them, in order."""

    def wrap(cls: type) -> Profile:
        if based_on is not None and not isinstance(based_on, Profile):
            raise FilterConfigurationError(f"'{based_on}' that '{cls.__name__}' is based on is not a profile.")
        ops = [v for v in vars(cls).values() if isinstance(v, Operator)]
        out = based_on.extend_with_overrides(cls.__name__, *ops) if based_on else Profile.create(cls.__name__, *ops)
        return Profile(cls.__name__, out.operators, types or out.types)

    return wrap


def operator(name: str, parse: Callable | None = None, type: Any = None):
    """An operator from a function: (column) or (column, value)."""

    def wrap(body: Callable) -> Operator:
        return value_op(name, body, parse, type) if parse or type else unary_op(name, body)

    return wrap


def _takes(body: Callable, n: int, what: str) -> None:
    try:
        inspect.signature(body).bind(*range(n))
    except TypeError:
        raise FilterConfigurationError(f"{what} has to take {n} argument{'s' * (n > 1)}.") from None


def _type_at(struct: T.StructType, path: str) -> T.DataType:
    kind: T.DataType = struct
    for part in path.split("."):
        if not isinstance(kind, T.StructType):
            raise FilterConfigurationError(f"'{path}' reads a member of something that is no struct.")
        if part not in kind.fieldNames():
            raise FilterConfigurationError(f"Property '{path}' was not found.")
        kind = kind[part].dataType
    return kind


def _through_null(struct: T.StructType, path: str) -> bool:
    *parents, _ = path.split(".")
    for part in parents:
        if struct[part].nullable:
            return True
        struct = struct[part].dataType
    return False


def _check_links(builder: SchemaBuilder, tables: Mapping[str, DataFrame]) -> None:
    """Each hop of this filter's own nestings against the tables that are given: their columns exist and are no collections."""
    for n in builder.nested:
        for i, hop in enumerate(n.hops):
            after = n.hops[i + 1].local if i + 1 < len(n.hops) else ()
            for c in (*hop.remote, *after) if hop.table in tables else ():
                if isinstance(_type_at(tables[hop.table].schema, c), (T.ArrayType, T.MapType)):
                    raise FilterConfigurationError(f"'{builder.key}.{hop.name}' links by '{c}', which is a collection.")


def _resolved(target: Any) -> SchemaBuilder:
    if isinstance(target, str):
        named = REGISTRY.get(target, {})
        if len(named) != 1:
            places = ", ".join(".".join(place) for place in named)
            raise FilterConfigurationError(f"Several filters are named '{target}': {places}." if named else f"No filter is named '{target}'.")
        (target,) = named.values()
    elif callable(target) and not isinstance(target, type):
        target = target()
    if not isinstance(getattr(target, "builder", None), SchemaBuilder):
        raise FilterConfigurationError(f"'{getattr(target, '__name__', target)}' is not a filter class.")
    return target.builder


def filter_for(rows: T.StructType | DataFrame, known: Iterable[Profile] = BUILT_IN, **limits: int):
    struct = rows.schema if isinstance(rows, DataFrame) else rows

    def wrap(cls: type) -> type:
        builder = SchemaBuilder(cls.__name__, Settings(**(vars(_DEFAULTS[0]) | limits)))
        members = list(vars(cls).values())
        taken: dict[str, str] = {}
        intercepts: dict[str, dict[str, Callable]] = {}
        for m in members:
            if isinstance(m, Intercept):
                if m.form in intercepts.setdefault(m.name, {}):
                    raise FilterConfigurationError(f"'{m.name}' has more than one {m.form} interceptor.")
                intercepts[m.name][m.form] = m.body
        mapped = {m.name for m in members if isinstance(m, Map)}
        for name in intercepts.keys() - mapped:
            raise FilterConfigurationError(f"'{name}' has an interceptor but is not mapped.")

        def take(name: str, kind: str) -> None:
            if name in taken:
                raise FilterConfigurationError(f"'{name}' is mapped twice." if taken[name] == kind else f"'{name}' is both mapped and a rule.")
            taken[name] = kind

        for m in members:
            if isinstance(m, Map):
                take(m.name, "map")
                kind = _type_at(struct, m.name)
                if _through_null(struct, m.name):
                    warnings.warn(f"'{m.name}' reads a member of a struct that may be null.", stacklevel=2)
                if not m.sortable and isinstance(kind, _MEASURES):
                    warnings.warn(f"'{m.name}' is of type '{kind.simpleString()}' and not sortable.", stacklevel=2)
                own = m.profile
                if own is not None and not isinstance(own, Profile):
                    raise FilterConfigurationError(f"The profile of '{m.name}' is not a profile.")
                if own is not None and own.types and not isinstance(kind, own.types):
                    raise FilterConfigurationError(f"Profile '{own.name}' does not fit '{m.name}' of type '{kind.simpleString()}'.")
                p = prop(m.name, own or infer(kind, known))
                p = p.only(*m.only) if m.only is not None else p
                p = p.except_(*m.except_) if m.except_ is not None else p
                p = p.intercept(**intercepts.get(m.name, {}))
            elif isinstance(m, Rule):
                take(m.name, "rule")
                made = m.body(RuleBuilder())
                if not isinstance(made, RuleBuilder) or made.accessor is None:
                    raise FilterConfigurationError(f"Rule '{m.name}' must call of(...) and return the builder.")
                p = computed(m.name, made.accessor, *made.operators)
            elif isinstance(m, Nested):
                for hop in m.hops[:1]:
                    for c in hop.local:
                        if isinstance(_type_at(struct, c), (T.ArrayType, T.MapType)):
                            raise FilterConfigurationError(f"Nesting '{m.name}' goes through a collection.")
                if not 0 <= m.max_depth <= MAX_DEPTH:
                    raise FilterConfigurationError(f"MaxDepth of '{m.name}' must be between 0 and {MAX_DEPTH}.")
                builder.nest(m.hops, lambda t=m.target: _resolved(t), m.prefix, m.only, m.except_, m.disable_sorting, m.max_depth)
                continue
            else:
                continue
            p = p.alias(m.alias) if m.alias is not None else p
            if m.default_dir is not None and not m.sortable:
                warnings.warn(f"'{m.name}' has a default sort direction but is not sortable.", stacklevel=2)
            p = p.sort(Dir.ASC if m.default_dir is None else m.default_dir) if m.sortable else p
            made = p.build()
            if not made.operators and not made.sortable:
                warnings.warn(f"'{m.name}' has no operators left.", stacklevel=2)
            builder.add(made)
        cls.builder = builder

        def definition(**tables: DataFrame) -> FilterDefinition:
            _check_links(builder, tables)
            return FilterDefinition(builder.build(), tables)

        cls.definition = staticmethod(definition)
        REGISTRY.setdefault(cls.__name__, {})[cls.__module__, cls.__qualname__] = cls
        return cls

    return wrap


def lint(filters: Iterable[type], profiles: Iterable[Profile]) -> list[str]:
    """Profiles that no filter uses, and operators that no filter offers."""
    used = {id(op) for f in filters for p in f.builder.build().properties for op in p.operators.values()}
    out = []
    for p in profiles:
        idle = [op.name for op in p.operators if id(op) not in used]
        out += [f"Profile '{p.name}' is not used."] if len(idle) == len(p.operators) else [f"Operator '{n}' of profile '{p.name}' is not used." for n in idle]
    return out
