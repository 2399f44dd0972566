"""Numbers and running sums in an order, without one window over a whole group.

Rows are dealt to ranges of (group, order) and written, so that each row's range is fixed. A window runs inside a group's part of
one range only; what lies before it comes from one row for each group and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fresh
from ..session import stored


def running(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], following: dict[str, Column] | None = None) -> DataFrame:
    """Adds for each of ``sums`` the sum up to and including the row in its group, and for each of ``following`` the value of the row after it (null at the end).

    The order must be total in each group.
    """
    following = following or {}
    part, seen, key, place = (fresh([*df.columns, *sums, *following], c) for c in ("_part", "_seen", "_group", "_place"))
    ranged = stored(df.repartitionByRange(*[F.col(c) for c in by], *order).withColumn(part, F.spark_partition_id()), "ranges")
    inside = Window.partitionBy(*by, part).orderBy(*order)
    first = {f"{seen}_{name}": F.min_by(c, F.col(place)) for name, c in following.items()}
    local = ranged.withColumn(place, F.row_number().over(inside))
    parts = local.groupBy(*by, part).agg(*[F.sum(c).alias(f"{seen}_{name}") for name, c in sums.items()], *[c.alias(name) for name, c in first.items()])
    # one row for each group and range that holds some of it
    across = Window.partitionBy(*(by or [F.lit(0)])).orderBy(part)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        F.struct(*by, part).alias(key),
        *[F.sum(f"{seen}_{name}").over(before).alias(f"{seen}_{name}") for name in sums],
        *[F.lead(f"{seen}_{name}").over(across).alias(f"{seen}_{name}") for name in following],
    )
    joined = local.withColumn(key, F.struct(*by, part)).join(parts, key)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = joined.select(
        *df.columns,
        *[(F.sum(c).over(upto) + F.coalesce(F.col(f"{seen}_{name}"), F.lit(0))).alias(name) for name, c in sums.items()],
        *[F.when(F.lead(F.lit(1)).over(inside).isNotNull(), F.lead(c).over(inside)).otherwise(F.col(f"{seen}_{name}")).alias(name) for name, c in following.items()],
    )
    return out


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds the number of a row in its group, from 1."""
    return running(df, by, order, {name: F.lit(1).cast("long")})
