"""Walks a request once: collects every error, and keeps the parsed value of every leaf for the compiler. Paths, codes and texts of errors are fixed values of the wire format."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from ..functions.parsers import ParseError
from ..model import UNDEFINED, Code, FilterRequest, FilterValidationError, Group, Leaf, Settings, ValidationIssue, ValidationResult
from ..operators.templates import Operator
from .schema import FilterProperty, FilterSchema

MAX_SKIP = 2**31 - 1


@dataclass(frozen=True)
class Context:
    """What an interceptor sees beside the value: the node's path, the field as the client wrote it, and the operator."""

    path: str
    field: str
    operator: str


@dataclass(frozen=True)
class Bound:
    """A valid leaf: property, operator and typed value."""

    prop: FilterProperty
    operator: Operator
    value: Any


@dataclass(frozen=True)
class BoundGroup:
    op: str
    children: tuple


def bind(prop: FilterProperty, op: Operator, leaf: Leaf, path: str) -> Any:
    """The typed value of a leaf, intercepted."""
    if op.form == "typed":
        return op.parse(leaf.value)
    context = Context(path, leaf.field, op.name)
    if op.form == "array":
        values = op.parse(leaf.value)
        values = [prop.scalar(v, context) for v in values] if prop.scalar else values
        return prop.array(values, context) if prop.array else values
    value = prop.raw(leaf.value, context) if prop.raw else op.parse(leaf.value)
    return prop.scalar(value, context) if prop.scalar else value


class Walk:
    def __init__(self, schema: FilterSchema):
        self.schema, self.errors, self.leaves = schema, [], 0

    def fail(self, path: str, code: Code, message: str, field: str | None = None, operator: str | None = None) -> None:
        self.errors.append(ValidationIssue(path, code, message, field, operator))

    def node(self, node: Any, path: str, depth: int) -> Bound | BoundGroup | None:
        if depth > self.schema.settings.max_nesting_depth:
            return self.fail(path, Code.NestingTooDeep, f"Filter nesting depth exceeds the configured maximum of {self.schema.settings.max_nesting_depth}.")
        if isinstance(node, Leaf):
            return self.leaf(node, path)
        if not isinstance(node, Group):
            return self.fail(path, Code.InvalidNodeShape, f"'{type(node).__name__}' is not a group or a leaf.")
        if not node.children:
            return self.fail(path, Code.GroupEmpty, "Group has no children.")
        if node.op not in ("and", "or", "not"):
            return self.fail(path, Code.InvalidNodeShape, f"Group combinator '{node.op}' is not And, Or, or Not.")
        if node.op == "not" and len(node.children) != 1:
            return self.fail(path, Code.InvalidNodeShape, f"A 'not' group requires exactly one child, got {len(node.children)}.")
        return BoundGroup(node.op, tuple(self.node(c, f"{path}.{node.op}[{i}]", depth + 1) for i, c in enumerate(node.children)))

    def leaf(self, leaf: Leaf, path: str) -> Bound | None:
        self.leaves += 1
        prop = self.schema.find(leaf.field)
        if prop is None:
            return self.fail(path, Code.UnknownField, f"Field '{leaf.field if leaf.field is not None else ''}' is not configured for filtering.", leaf.field, leaf.op)
        op = prop.operators.get((leaf.op or "").upper())
        if op is None:
            return self.fail(f"{path}.op", Code.OperatorNotAllowed, f"Operator '{leaf.op}' is not supported on field '{leaf.field}'.", leaf.field, leaf.op)
        if op.form == "unary":
            if leaf.value is not UNDEFINED and leaf.value is not None:
                return self.fail(f"{path}.value", Code.InvalidValueType, f"Operator '{leaf.op}' takes no value.", leaf.field, leaf.op)
            return Bound(prop, op, None)
        try:
            return Bound(prop, op, bind(prop, op, leaf, path))
        except ParseError as error:
            return self.fail(f"{path}.value", Code.InvalidValueType, str(error), leaf.field, leaf.op)
        except FilterValidationError as error:
            return self.fail(f"{path}.value", Code.InterceptorRejected, error.result.errors[0].message, leaf.field, leaf.op)

    def where(self, node: Any) -> Bound | BoundGroup | None:
        out = self.node(node, "where", 1)
        most = self.schema.settings.max_leaf_conditions
        if self.leaves > most:
            self.fail("where", Code.TooManyConditions, f"Filter has {self.leaves} conditions, exceeding the configured maximum of {most}.")
        return out

    def sort(self, items: Any) -> None:
        for i, item in enumerate(items or ()):
            if item is None or item.field is None:
                self.fail(f"sort[{i}].field", Code.NotSortable, "A sort item must name a field.")
                continue
            prop = self.schema.find(item.field)
            if prop is None or not prop.sortable:
                self.fail(f"sort[{i}].field", Code.NotSortable, f"Field '{item.field}' is not configured as sortable.", item.field)
            if item.dir is not None and item.dir not in (0, 1):
                self.fail(f"sort[{i}].dir", Code.InvalidSortDirection, f"Sort direction '{int(item.dir)}' is not Asc or Desc.", item.field)

    def page(self, request: FilterRequest) -> None:
        page, size, settings = request.page, request.page_size, self.schema.settings
        if page is not None and page < 1:
            self.fail("page", Code.PageInvalid, f"page must be 1 or greater (was {page}).")
        elif page is not None and (page - 1) * resolve_page_size(size, settings) > MAX_SKIP:
            self.fail("page", Code.PageInvalid, f"page {page} is too large for a page size of {resolve_page_size(size, settings)}.")
        if size is not None and size < 1:
            self.fail("pageSize", Code.PageSizeInvalid, f"pageSize must be 1 or greater (was {size}).")
        elif size is not None and size > settings.max_page_size:
            self.fail("pageSize", Code.PageSizeTooLarge, f"pageSize {size} exceeds the configured maximum of {settings.max_page_size}.")


def resolve_page_size(requested: int | None, settings: Settings) -> int:
    return min(max(1, settings.default_page_size if requested is None else requested), settings.max_page_size)


def validate(schema: FilterSchema, request: FilterRequest) -> tuple[ValidationResult, Bound | BoundGroup | None]:
    walk = Walk(schema)
    tree = walk.where(request.where) if request.where is not None else None
    walk.sort(request.sort)
    walk.page(request)
    return ValidationResult(tuple(walk.errors)), tree
