"""Declared properties, and the schema that is the allow-list of a filter.

An accessor is a function of a scope; ``scope["column"]`` reads a column of the row, ``scope.to(hop)`` goes through a
many-to-one link. A nested schema's properties get its scope, so an accessor works wherever its schema is nested."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Dir, FilterConfigurationError, Settings
from ..operators.profiles import Profile
from ..operators.templates import Operator

MAX_DEPTH = 64


@dataclass(frozen=True)
class Hop:
    """A link to another table: rows whose ``local`` columns equal the ``remote`` ones, of which there is at most one."""

    name: str
    table: str
    local: tuple[str, ...]
    remote: tuple[str, ...]


@dataclass(frozen=True)
class Scope:
    """Where a row's columns are: the alias of its table in the joined frame, or a struct column below it."""

    alias: str
    hops: tuple[Hop, ...] = ()

    def __getitem__(self, name: str) -> Column:
        return F.col(".".join(f"`{part}`" for part in (self.alias, *name.split("."))))

    def to(self, hops: Iterable[Hop]) -> Scope:
        out = self
        for hop in hops:
            out = Scope(f"{out.alias}__{hop.name}", (*out.hops, hop))
        return out


Accessor = Callable[[Scope], Column]


@dataclass(frozen=True)
class FilterProperty:
    field: str
    accessor: Accessor
    operators: dict[str, Operator]
    alias: str | None = None
    sortable: bool = False
    default_dir: int = Dir.ASC
    hops: tuple[Hop, ...] = ()
    scalar: Callable | None = None
    array: Callable | None = None
    raw: Callable | None = None

    @property
    def keys(self) -> list[str]:
        return [self.field] if self.alias is None or self.alias.upper() == self.field.upper() else [self.field, self.alias]

    def column(self, root: Scope) -> Column:
        return self.accessor(root.to(self.hops))

    def lifted(self, hops: tuple[Hop, ...], prefix: str | None, sorting: bool) -> FilterProperty:
        path = ".".join(h.name for h in hops)
        shown = prefix or path
        alias = f"{shown}.{self.alias or self.field}"
        new = replace(self, field=f"{path}.{self.field}", alias=alias, hops=hops + self.hops, sortable=self.sortable and sorting)
        return replace(new, alias=None) if alias == new.field else new


def _operators(name: str, operators: Iterable[Operator]) -> dict[str, Operator]:
    out: dict[str, Operator] = {}
    for op in operators:
        if op.name.upper() in out:
            raise FilterConfigurationError(f"'{name}': two operators are named '{op.name}'.")
        out[op.name.upper()] = op
    return out


class PropertyBuilder:
    """``prop("name", STRING).alias("n").only("eq").sort(default=Dir.DESC)``"""

    def __init__(self, name: str, profile: Profile | Iterable[Operator], accessor: Accessor | None = None):
        if not name or not name.strip():
            raise FilterConfigurationError("A property needs a name.")
        self.name, self.accessor = name, accessor or (lambda s: s[name])
        self.profile = profile.name if isinstance(profile, Profile) else name
        self.all = _operators(name, profile.operators if isinstance(profile, Profile) else profile)
        self._only: list[str] | None = None
        self._except: list[str] | None = None
        self.options: dict[str, Any] = {}

    def alias(self, name: str) -> PropertyBuilder:
        if not name or not name.strip():
            raise FilterConfigurationError(f"'{self.name}': an alias needs at least one character that is no blank.")
        self.options["alias"] = name
        return self

    def sort(self, default: int = Dir.ASC) -> PropertyBuilder:
        self.options |= {"sortable": True, "default_dir": default}
        return self

    def only(self, *names: str) -> PropertyBuilder:
        self._only = list(names)
        return self

    def except_(self, *names: str) -> PropertyBuilder:
        self._except = list(names)
        return self

    def intercept(self, scalar: Callable | None = None, array: Callable | None = None, raw: Callable | None = None) -> PropertyBuilder:
        """``scalar`` and ``array`` rewrite parsed values, ``raw`` replaces the scalar parser; each takes (value, context)."""
        self.options |= {k: v for k, v in (("scalar", scalar), ("array", array), ("raw", raw)) if v}
        return self

    def build(self) -> FilterProperty:
        for option, names in (("Only", self._only), ("Except", self._except)):
            for n in names or ():
                if n.upper() not in self.all:
                    raise FilterConfigurationError(f"'{self.name}': {option.lower()} lists '{n}', but '{self.profile}' has no such operator.")
        allowed = None if self._only is None else {n.upper() for n in self._only}
        barred = {n.upper() for n in self._except or ()}
        kept = {k: op for k, op in self.all.items() if (allowed is None or k in allowed) and k not in barred}
        return FilterProperty(self.name, self.accessor, kept, **self.options)


def prop(name: str, profile: Profile | Iterable[Operator], accessor: Accessor | None = None) -> PropertyBuilder:
    return PropertyBuilder(name, profile, accessor)


def rule(name: str, accessor: Accessor, *operators: Operator) -> PropertyBuilder:
    """A computed property with operators of its own."""
    return PropertyBuilder(name, operators, accessor)


@dataclass(frozen=True)
class Nesting:
    """Another schema behind one or several hops; ``schema`` may be a function, for schemas that nest each other."""

    hops: tuple[Hop, ...]
    schema: Any
    prefix: str | None = None
    only: tuple[str, ...] | None = None
    except_: tuple[str, ...] | None = None
    disable_sorting: bool = False
    max_depth: int = 0


@dataclass(frozen=True)
class FilterSchema:
    properties: tuple[FilterProperty, ...]
    settings: Settings = field(default_factory=Settings)
    by_key: dict[str, FilterProperty] = field(default_factory=dict, repr=False)

    def find(self, key: str | None) -> FilterProperty | None:
        return None if key is None else self.by_key.get(key.upper())

    def describe(self, spark: SparkSession) -> DataFrame:
        rows = [(p.field, p.alias, [o.name for o in p.operators.values()], p.sortable) for p in self.properties]
        return spark.createDataFrame(rows, "field string, alias string, operators array<string>, sortable boolean")


class SchemaBuilder:
    """``key``: what names this schema in messages about cycles."""

    def __init__(self, key: str, settings: Settings | None = None):
        self.key, self.settings = key, settings or Settings()
        self.own: list[FilterProperty] = []
        self.nested: list[Nesting] = []

    def add(self, *properties: PropertyBuilder | FilterProperty) -> SchemaBuilder:
        self.own += [p.build() if isinstance(p, PropertyBuilder) else p for p in properties]
        return self

    def nest(self, hops: Hop | Iterable[Hop], schema: Any, prefix: str | None = None, only: Iterable[str] | None = None, except_: Iterable[str] | None = None, disable_sorting: bool = False, max_depth: int = 0) -> SchemaBuilder:
        hops = (hops,) if isinstance(hops, Hop) else tuple(hops)
        if not hops:
            raise FilterConfigurationError("A nested schema is reached by one hop at least.")
        if prefix is not None and not prefix.strip():
            raise FilterConfigurationError(f"'{self.key}': a blank prefix names nothing.")
        name = ".".join(h.name for h in hops)
        if not 0 <= max_depth <= MAX_DEPTH:
            raise FilterConfigurationError(f"'{self.key}.{name}': max_depth is {max_depth}; 0 is no limit, and {MAX_DEPTH} the highest one.")
        self.nested.append(Nesting(hops, schema, prefix, None if only is None else tuple(only), None if except_ is None else tuple(except_), disable_sorting, max_depth))
        return self

    def _expand(self, path: tuple[tuple[str, int], ...]) -> list[tuple[FilterProperty, bool]]:
        """Properties with whether they are this schema's own. ``path``: the nestings gone through, with their depth limits."""
        out = [(p, True) for p in self.own]
        for n in self.nested:
            key = f"{self.key}.{'.'.join(h.name for h in n.hops)}"
            times = [i for i, (k, _) in enumerate(path) if k == key]
            if n.max_depth and len(times) >= n.max_depth:
                continue
            if times and not any(limit for _, limit in path[times[-1] :]) and not n.max_depth:
                chain = " -> ".join([*(k for k, _ in path[times[-1] :]), key])
                raise FilterConfigurationError(f"An endless cycle: {chain}. One of these needs a max_depth.")
            inner = n.schema() if callable(n.schema) else n.schema
            props = inner._expand((*path, (key, n.max_depth)))
            direct = {k.upper() for p, own in props if own for k in p.keys}
            for option, names in (("Only", n.only), ("Except", n.except_)):
                unknown = [x for x in names or () if x is None or "." not in x and x.upper() not in direct]
                if unknown:
                    raise FilterConfigurationError(f"'{key}': {option.lower()} lists {', '.join(map(repr, unknown))}, but '{inner.key}' has no such property of its own.")
            only = None if n.only is None else {x.upper() for x in n.only}
            barred = {x.upper() for x in n.except_ or ()}
            for p, own in props:
                keys = {k.upper() for k in p.keys}
                if own and (only is not None and not keys & only or keys & barred):
                    continue
                out.append((p.lifted(n.hops, n.prefix, not n.disable_sorting), False))
        return out

    def build(self) -> FilterSchema:
        props = tuple(p for p, _ in self._expand(()))
        by_key: dict[str, FilterProperty] = {}
        for p in props:
            for k in p.keys:
                if k.upper() in by_key:
                    raise FilterConfigurationError(f"'{by_key[k.upper()].field}' and '{p.field}' both answer to '{k}'.")
                by_key[k.upper()] = p
        return FilterSchema(props, self.settings, by_key)
