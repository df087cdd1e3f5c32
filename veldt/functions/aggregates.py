"""Aggregates by name, over Columns, DISTINCT ones too. All pass over NULL."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import number


#: Aggregates that were registered: name to a function of a Column.
REGISTERED: dict[str, Callable[[Column], Column]] = {}


def register(name: str, build: Callable[[Column], Column]) -> None:
    """An aggregate made of Spark's own, such as ``lambda v: F.exp(F.avg(F.ln(v)))``: it is
    combined ahead of the shuffle like they are."""
    REGISTERED[name.lower()] = build


def register_fold(name: str, init: Callable[[], Any], step: Callable[[Any, Any], Any], finalize: Callable[[Any], Any], kind: str) -> None:
    """An aggregate given by its first state, the state after a value, and the result of a state.

    It runs in Python over each group's values, NULLs left out, in no particular order, and a
    group's values are in one task: where groups are large, register a composition instead.
    """
    import pandas as pd

    def fold(values):
        state = init()
        for value in values.dropna():
            state = step(state, value)
        return finalize(state)

    fold.__annotations__ = {"values": pd.Series, "return": Any}  # a grouped aggregate, by its hints
    REGISTERED[name.lower()] = F.pandas_udf(fold, kind)


def aggregate(name: str, value: Column | str = "*", distinct: bool = False) -> Column:
    """count, sum, avg, min, max, and what was registered. ``*`` counts rows."""
    name = name.lower()
    if isinstance(value, str) and value == "*":
        if name != "count" or distinct:
            raise ValueError("only count takes *")
        return F.count("*")
    value = F.col(value) if isinstance(value, str) else value
    if name in REGISTERED:
        if distinct:
            raise ValueError("a registered aggregate takes no DISTINCT")
        return REGISTERED[name](value)
    plain = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
    apart = {"count": F.count_distinct, "sum": F.sum_distinct, "avg": lambda v: F.sum_distinct(v) / F.count_distinct(v), "min": F.min, "max": F.max}
    try:
        return (apart if distinct else plain)[name](value)
    except KeyError:
        raise ValueError(f"no aggregate is called {name}") from None


def exact_sum(value: Column) -> Column:
    """Sum of doubles that is the same in whatever order they come, so that groups of the same
    values have equal sums; a sum of doubles is rounded at each step.

    Each value is split in two decimals, which add up without rounding: its first ten decimals
    and the rest, scaled. NaN, infinities and sums beyond 10^28 give what SUM gives.
    """
    value = value.cast("double")
    scale, kind = F.lit(2.0**100), "decimal(38,10)"
    head = value.try_cast(kind)
    tail = ((value - head.cast("double")) * scale).try_cast(kind)
    exact = F.try_sum(head).cast("double") + F.try_sum(tail).cast("double") / scale
    return F.when(F.count(value) == F.count(head), F.coalesce(exact, F.sum(value))).otherwise(F.sum(value))


def text_sum(value: Column) -> Column:
    """Sum of a text column's numbers; what isn't a number is passed over."""
    return F.sum(number(value))


def first_row(columns: list[str], order: Column | str) -> Column:
    """Of a group, the named columns of the row that comes first by ``order``, as a struct.

    The order must be total for a definite result; Spark's plain first() has none.
    """
    return F.min_by(F.struct(*columns), order)
