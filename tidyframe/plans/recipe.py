"""Recipes: ordered cleaning steps folded over a table into one lazy plan."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame

from ..operators import aggregate, by_example, clean, encode, filters, ordering


def custom(df: DataFrame, step: Callable[[DataFrame], DataFrame] | str) -> DataFrame:
    """A callable on the table, or SQL text that names it {df}."""
    return df.sparkSession.sql(step, df=df) if isinstance(step, str) else step(df)


OPS: dict[str, Callable[..., DataFrame]] = {
    "sort": ordering.sort_step,
    "filter": filters.filter_step,
    "calc_text_length": clean.calc_text_length,
    "one_hot_encode": encode.one_hot_encode,
    "multi_label_binarizer": encode.multi_label_binarizer,
    "formula_column": clean.formula_column,
    "change_type": clean.change_type,
    "drop_column": clean.drop_column,
    "select_columns": clean.select_columns,
    "rename_column": clean.rename_column,
    "clone_column": clean.clone_column,
    "drop_missing": clean.drop_missing,
    "drop_duplicates": clean.drop_duplicates,
    "fill_missing": clean.fill_missing,
    "find_replace": clean.find_replace,
    "group_by_agg": aggregate.group_by_agg,
    "strip_whitespace": clean.strip_whitespace,
    "split_text": clean.split_text,
    "capitalize": clean.capitalize,
    "lowercase": clean.lowercase,
    "uppercase": clean.uppercase,
    "title_case": clean.title_case,
    "scale_min_max": clean.scale_min_max,
    "round": clean.round_column,
    "floor": clean.floor_column,
    "ceiling": clean.ceiling_column,
    "by_example": by_example.by_example,
    "custom": custom,
}

#: Steps that look at one row at a time and so work on streams too.
ROW_WISE = frozenset({"formula_column", "change_type", "drop_column", "select_columns", "rename_column", "clone_column", "drop_missing", "find_replace", "strip_whitespace", "capitalize", "lowercase", "uppercase", "title_case", "calc_text_length", "round", "floor", "ceiling", "by_example"})


@dataclass(frozen=True)
class Step:
    op: str
    params: dict[str, Any] = field(default_factory=dict)
    id: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self):
        if self.op not in OPS:
            raise ValueError(f"unknown step {self.op!r}")


def apply_recipe(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    return reduce(lambda d, s: OPS[s.op](d, **s.params), steps, df)


def undo_step(steps: Sequence[Step], step_id: str) -> list[Step]:
    """The recipe without one step, from anywhere in it; apply it to the source again."""
    if all(s.id != step_id for s in steps):
        raise ValueError(f"no step {step_id!r}")
    return [s for s in steps if s.id != step_id]


def to_json(steps: Sequence[Step]) -> str:
    return json.dumps([asdict(s) for s in steps])


def from_json(text: str) -> list[Step]:
    return [Step(**s) for s in json.loads(text)]
