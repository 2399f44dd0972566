"""Column functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, also where it is used inside lambdas (which compute outer expressions for each item)."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def fresh(columns: Iterable[str], stem: str) -> str:
    """``stem``, lengthened until no column has that name in whatever case."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem
