"""Requests, results and errors."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import IntEnum
from math import ceil
from typing import Any

from pyspark.sql import Row


class _Undefined:
    """A leaf without a value, which is not the same as null."""

    def __repr__(self) -> str:
        return "UNDEFINED"

    def __bool__(self) -> bool:
        return False

    def __reduce__(self):
        return "UNDEFINED"


UNDEFINED = _Undefined()


class Dir(IntEnum):
    ASC = 0
    DESC = 1


@dataclass(frozen=True)
class Leaf:
    field: str | None
    op: str
    value: Any = UNDEFINED


@dataclass(frozen=True)
class Group:
    """``op``: "and", "or" or "not"."""

    op: str
    children: tuple = ()


@dataclass(frozen=True)
class SortItem:
    """``dir``: 0 or 1 (other numbers fail validation); None for the property's default."""

    field: str | None
    dir: int | None = None


@dataclass(frozen=True)
class FilterRequest:
    where: Leaf | Group | None = None
    sort: tuple[SortItem | None, ...] | None = None
    page: int | None = None
    page_size: int | None = None


@dataclass(frozen=True)
class Settings:
    default_page_size: int = 50
    max_page_size: int = 200
    max_nesting_depth: int = 10
    max_leaf_conditions: int = 50


class Code(IntEnum):
    """Codes on the wire; 3 and 4 are not in use."""

    UnknownField = 0
    OperatorNotAllowed = 1
    InvalidValueType = 2
    InterceptorRejected = 5
    NotSortable = 6
    InvalidSortDirection = 7
    PageInvalid = 8
    PageSizeTooLarge = 9
    PageSizeInvalid = 10
    NestingTooDeep = 11
    TooManyConditions = 12
    GroupEmpty = 13
    InvalidNodeShape = 14


@dataclass(frozen=True)
class ValidationIssue:
    path: str
    code: Code
    message: str
    field: str | None = None
    operator: str | None = None

    def to_dict(self) -> dict[str, Any]:
        return {"path": self.path, "code": self.code.name, "message": self.message, "field": self.field, "operatorName": self.operator}


@dataclass(frozen=True)
class ValidationResult:
    errors: tuple[ValidationIssue, ...] = ()

    @property
    def is_valid(self) -> bool:
        return not self.errors


class FilterError(Exception):
    """Base of all errors of this library."""


class FilterConfigurationError(FilterError):
    """A declaration is wrong."""


class FilterDispatchError(FilterError):
    """Something was compiled or run that validation would have refused."""


class FilterValidationError(FilterError):
    """The request is wrong; ``result`` says where."""

    def __init__(self, result: ValidationResult | str):
        if isinstance(result, str):
            result = ValidationResult((ValidationIssue("", Code.InterceptorRejected, result),))
        if result.is_valid:
            raise ValueError("A validation error needs a result with errors.")
        n, first = len(result.errors), result.errors[0]
        super().__init__(f"Filter request is invalid ({n} {'error' if n == 1 else 'errors'}). First: {first.path} — {first.message}")
        self.result = result


@dataclass(frozen=True)
class PageResult:
    items: list[Row] = field(default_factory=list)
    total_count: int = 0
    page: int = 1
    page_size: int = 0

    @property
    def total_pages(self) -> int:
        return 1 if self.page_size <= 0 else ceil(self.total_count / self.page_size)

    @property
    def has_previous(self) -> bool:
        return self.page > 1

    @property
    def has_next(self) -> bool:
        return self.page < self.total_pages
