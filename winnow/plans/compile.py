"""From a bound tree to one Column: negation is pushed down to the leaves (De Morgan), where each operator knows what its
negation keeps. The Column is for a WHERE only, where null and false are the same."""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import FilterDispatchError, SortItem
from .schema import FilterProperty, FilterSchema, Hop, Scope
from .validate import Bound, BoundGroup

ROOT = Scope("__row")


def predicate(node: Bound | BoundGroup, negated: bool = False) -> Column:
    if isinstance(node, Bound):
        return node.operator.build(node.prop.column(ROOT), node.value, negated)
    if not isinstance(node, BoundGroup) or not node.children:
        raise FilterDispatchError("Only bound leaves and groups with children compile.")
    if node.op == "not":
        return predicate(node.children[0], not negated)
    if node.op not in ("and", "or"):
        raise FilterDispatchError(f"'{node.op}' combines nothing: and, or, not do.")
    both = (node.op == "and") != negated
    return reduce(operator.and_ if both else operator.or_, [predicate(c, negated) for c in node.children])


def properties(node: Bound | BoundGroup | None) -> Iterator[FilterProperty]:
    if isinstance(node, Bound):
        yield node.prop
    elif isinstance(node, BoundGroup):
        for c in node.children:
            yield from properties(c)


def ordering(schema: FilterSchema, items: tuple[SortItem, ...]) -> tuple[list[Column], list[FilterProperty]]:
    """Nulls first ascending, last descending."""
    columns, used = [], []
    for item in items:
        prop = schema.find(item.field) if item else None
        if prop is None or not prop.sortable:
            raise FilterDispatchError(f"No order by '{item.field if item else None}' is declared.")
        direction = prop.default_dir if item.dir is None else item.dir
        if direction not in (0, 1):
            raise FilterDispatchError(f"'{prop.field}' sorts by direction 0 or 1, not {direction}.")
        column = prop.column(ROOT)
        columns.append(column.desc_nulls_last() if direction else column.asc_nulls_first())
        used.append(prop)
    return columns, used


def joined(df: DataFrame, used: list[FilterProperty], tables: dict[str, DataFrame], verified: set[tuple] | None = None) -> DataFrame:
    """``df`` with the tables that ``used`` reads, each link once. Left joins: a row without a partner has nulls there, and
    Catalyst makes them inner joins where the filter rejects nulls. A link's table has at most one row for a key."""
    df = df.alias(ROOT.alias)
    done: set[str] = set()
    for prop in used:
        scope = ROOT
        for hop in prop.hops:
            inner = scope.to([hop])
            if inner.alias not in done:
                done.add(inner.alias)
                other = _table(hop, tables, verified).alias(inner.alias)
                same = reduce(operator.and_, [scope[a] == inner[b] for a, b in zip(hop.local, hop.remote, strict=True)])
                df = df.join(other, same, "left")
            scope = inner
    return df


def _table(hop: Hop, tables: dict[str, DataFrame], verified: set[tuple] | None) -> DataFrame:
    """``verified``: keys that are known to be unique; None to take that on trust."""
    if hop.table not in tables:
        raise FilterDispatchError(f"Nesting '{hop.name}' needs table '{hop.table}', which was not given.")
    table = tables[hop.table]
    if verified is not None and (hop.table, hop.remote) not in verified:
        known = reduce(operator.and_, [F.col(c).isNotNull() for c in hop.remote])
        if not table.filter(known).groupBy(*hop.remote).agg(F.count("*").alias("__n")).filter("__n > 1").isEmpty():
            raise FilterDispatchError(f"Table '{hop.table}' has several rows for a key of '{hop.name}'.")
        verified.add((hop.table, hop.remote))
    return table
