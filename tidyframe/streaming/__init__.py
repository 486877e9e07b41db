"""Recipes on streams: steps that look at one row at a time need no state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.filters import FilterSpec, predicate
from ..plans.recipe import ROW_WISE, Step, apply_recipe


def stream_recipe(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """A recipe on a streaming table; steps that need the whole table are refused."""
    whole = [s.op for s in steps if s.op not in ROW_WISE]
    if whole:
        raise ValueError(f"these steps need the whole table: {whole}")
    return apply_recipe(df, steps)


def stream_filter(df: DataFrame, specs: Sequence[FilterSpec]) -> DataFrame:
    for s in specs:
        df = df.filter(predicate(df, s))
    return df
