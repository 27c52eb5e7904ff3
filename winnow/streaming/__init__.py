"""Streams take filters only; sorting and paging have no meaning on an unbounded frame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..model import FilterDispatchError


def guard(df: DataFrame, part: str) -> None:
    """Refuses what a streaming frame cannot do, before Spark would."""
    if df.isStreaming:
        raise FilterDispatchError(f"A streaming DataFrame can be filtered, but not {part}.")
