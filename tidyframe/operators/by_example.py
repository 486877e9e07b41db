"""A column from examples: the first rule that fits all (input, output) pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..dtypes import name
from ..functions import text

DELIMITERS = (" ", ",", "-", "/", "_", ".")
LONGEST = 8


def _title(s: str) -> str:
    return " ".join(w[:1].upper() + w[1:].lower() for w in s.split(" "))


def _rules():
    """(name, argument, what it makes of a text, what it makes of a column), in order of choice."""
    yield "identity", None, lambda s: s, lambda c: c
    yield "lower", None, str.lower, F.lower
    yield "upper", None, str.upper, F.upper
    yield "capitalize", None, lambda s: s[:1].upper() + s[1:].lower(), lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))
    yield "title", None, _title, text.title_case
    for d in DELIMITERS:
        yield "first_part", d, lambda s, d=d: s.split(d)[0], lambda c, d=d: F.element_at(text.split_text(c, d), 1)
        yield "last_part", d, lambda s, d=d: s.split(d)[-1], lambda c, d=d: F.element_at(text.split_text(c, d), -1)
    for n in range(1, LONGEST + 1):
        yield "prefix", n, lambda s, n=n: s[:n], lambda c, n=n: F.left(c, F.lit(n))
    for n in range(1, LONGEST + 1):
        yield "suffix", n, lambda s, n=n: s[-n:] if len(s) >= n else None, lambda c, n=n: F.right(c, F.lit(n))
    yield "strip", None, str.strip, text.strip_whitespace


def infer_rule(pairs: Sequence[tuple[str, str]], constant: bool = False) -> tuple[str, object]:
    """(rule, argument). One output alone means a constant only if ``constant`` says so; else other rules are tried."""
    if not pairs:
        raise ValueError("examples are needed")
    if constant and len({o for _, o in pairs}) == 1:
        return "constant", pairs[0][1]
    for rule, argument, made, _ in _rules():
        if all(made(i) == o for i, o in pairs):
            return rule, argument
    raise ValueError("no rule fits the examples")


def rule_column(c: Column, rule: str, argument: object = None) -> Column:
    if rule == "constant":
        return F.when(c.isNotNull(), F.lit(argument))
    return next(column for r, a, _, column in _rules() if (r, a) == (rule, argument))(c)


def by_example(df: DataFrame, column: str, new_name: str, pairs: Sequence[tuple[str, str]], constant: bool = False) -> DataFrame:
    return df.withColumn(new_name, rule_column(name(column), *infer_rule(pairs, constant)))
