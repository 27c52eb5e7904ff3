"""Applies requests to DataFrames. The output has the input's columns, whatever was joined on the way; nothing runs before
a request is valid."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from ..model import FilterRequest, FilterValidationError, PageResult, ValidationResult
from ..streaming import guard
from .compile import ROOT, joined, ordering, predicate, properties
from .schema import FilterSchema, SchemaBuilder
from .validate import MAX_SKIP, resolve_page_size, validate


class FilterDefinition:
    """``tables``: by name, what nested schemas link to; ``verify_keys`` checks that links are many-to-one (one job a table and
    key, the first time a request reads it)."""

    def __init__(self, schema: FilterSchema | SchemaBuilder, tables: Mapping[str, DataFrame] | None = None, verify_keys: bool = False):
        self.schema = schema.build() if isinstance(schema, SchemaBuilder) else schema
        self.tables, self.verify_keys = dict(tables or {}), verify_keys
        self._verified: set[tuple] = set()

    def with_tables(self, **tables: DataFrame) -> FilterDefinition:
        return FilterDefinition(self.schema, self.tables | tables, self.verify_keys)

    def validate(self, request: FilterRequest) -> ValidationResult:
        return validate(self.schema, request)[0]

    def resolve_page_size(self, requested: int | None) -> int:
        return resolve_page_size(requested, self.schema.settings)

    def _valid(self, request: FilterRequest):
        result, tree = validate(self.schema, request)
        if not result.is_valid:
            raise FilterValidationError(result)
        return tree

    def _run(self, df: DataFrame, tree=None, sort=None) -> DataFrame:
        """Filtered and sorted; each link that either reads is joined once."""
        if tree is None and not sort:
            return df
        columns, used = ordering(self.schema, sort or ())
        out = joined(df, [*properties(tree), *used], self.tables, self._verified if self.verify_keys else None)
        out = out if tree is None else out.filter(predicate(tree))
        out = out.orderBy(*columns) if columns else out
        return out.select(f"{ROOT.alias}.*")

    def _page(self, df: DataFrame, request: FilterRequest) -> DataFrame:
        if request.page is None and request.page_size is None:
            return df
        guard(df, "paged")
        size = self.resolve_page_size(request.page_size)
        skip = (max(1, request.page or 1) - 1) * size
        if skip > MAX_SKIP:
            raise FilterValidationError(validate(self.schema, FilterRequest(page=request.page, page_size=request.page_size))[0])
        df = df.offset(skip) if skip else df
        return df.limit(min(size, MAX_SKIP - skip))

    def apply_filter(self, df: DataFrame, request: FilterRequest) -> DataFrame:
        """The rows that ``where`` keeps; ``df`` itself without one."""
        return self._run(df, self._valid(FilterRequest(request.where)))

    def apply_sorting(self, df: DataFrame, request: FilterRequest) -> DataFrame:
        """Sorted, and the page if one is asked for; a page below 1 and a page size outside the limits are clamped here."""
        if request.sort:
            guard(df, "sorted")
        return self._page(self._run(df, None, request.sort), request)

    def apply(self, df: DataFrame, request: FilterRequest) -> DataFrame:
        """Validates, filters, sorts and pages; lazy."""
        tree = self._valid(request)
        if request.sort:
            guard(df, "sorted")
        return self._page(self._run(df, tree, request.sort), request)

    def apply_paged(self, df: DataFrame, request: FilterRequest, cache: bool = False) -> PageResult:
        """Two jobs: the count of the filtered rows, and the page. ``cache`` keeps the filtered rows between them."""
        guard(df, "paged")
        tree = self._valid(request)
        filtered = self._run(df, tree)
        filtered = filtered.persist() if cache else filtered
        try:
            total = filtered.count()
            items = (self.apply_sorting(filtered, request) if cache else self._page(self._run(df, tree, request.sort), request)).collect()
        finally:
            if cache:
                filtered.unpersist()
        paged = request.page is not None or request.page_size is not None
        return PageResult(items, total, max(1, request.page or 1), self.resolve_page_size(request.page_size) if paged else total)
