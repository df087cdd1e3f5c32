"""The engine's scalar functions, by name, over Columns.

NULL gives NULL, but for coalesce, greatest and least, which pass over it. Names are
case-insensitive; an unknown one raises.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def log(value, base=None) -> Column:
    """Value first, then base; natural without one."""
    return F.ln(value) if base is None else F.ln(value) / F.ln(base)


def _cot(v) -> Column:
    return F.cot(v)


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "asin": F.asin,
    "acos": F.acos,
    "atan": F.atan,
    "atan2": F.atan2,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "cot": _cot,
    "abs": F.abs,
    "sign": F.signum,
    "mod": F.try_mod,
    "ceiling": F.ceil,
    "ceil": F.ceil,
    "floor": F.floor,
    "sqrt": F.sqrt,
    "exp": F.exp,
    "power": F.pow,
    "ln": F.ln,
    "log": log,
    "log10": F.log10,
    "rand": F.rand,
    "greatest": F.greatest,
    "least": F.least,
    "coalesce": F.coalesce,
    # text
    "position": lambda part, text: F.position(part, text),
    "substr": lambda text, start, length=None: F.substr(text, start) if length is None else F.substr(text, start, length),
    "trim": lambda text, signs=None: F.trim(text) if signs is None else F.trim(text, signs),
    "ltrim": lambda text, signs=None: F.ltrim(text) if signs is None else F.ltrim(text, signs),
    "rtrim": lambda text, signs=None: F.rtrim(text) if signs is None else F.rtrim(text, signs),
    "regexp": F.rlike,
    "rlike": F.rlike,
    "binary": lambda v: v.cast("binary"),
    # dates, with an interval
    "adddate": lambda day, by: day + by,
    "subdate": lambda day, by: day - by,
    "date_add": lambda day, by: day + by,
    "date_sub": lambda day, by: day - by,
    "extract": F.extract,
}


def call(name: str, *args) -> Column:
    try:
        function = FUNCTIONS[name.lower()]
    except KeyError:
        raise ValueError(f"no function is called {name}") from None
    return function(*args)


def number(value: Column) -> Column:
    """The value as a number; NULL where it isn't one."""
    return value.try_cast("double")


def text(value: Column) -> Column:
    return value.cast("string")


def truth(value: Column) -> Column:
    """Numbers other than zero are true."""
    return number(value) != 0
