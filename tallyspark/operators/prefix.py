"""Running sums over an order without sending all rows of a group to one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

PARTS = 4096


def part_of(x: Column) -> Column:
    """A number of one of PARTS parts, rising with x, whatever x's range."""
    return F.floor((F.atan(x.cast("double")) / F.lit(math.pi) + 0.5) * PARTS).cast("int")


def running(rows: DataFrame, by: list[str], lead: str, falling: bool, ties: list[str], values: dict[str, Column], inclusive: bool = False) -> DataFrame:
    """Adds, for each name, the sum of its value over the rows before (with ``inclusive``: and at) a row, in the order of ``lead``, then of ``ties``.

    Rows are ordered inside parts of the lead's range; a part's start is the sum of the parts before it, PARTS rows for each group.
    """
    keyed = rows.withColumn("__part", part_of(F.col(lead))).withColumns({f"__v_{n}": v for n, v in values.items()})
    sums = keyed.groupBy(*by, "__part").agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in values])
    order = F.desc if falling else F.asc
    before = W.partitionBy(*by).orderBy(order("__part")).rowsBetween(W.unboundedPreceding, -1)
    base = sums.select(*[F.col(c).alias(f"__b_{c}") for c in by], F.col("__part").alias("__b_part"), *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__s_{n}") for n in values])
    inside = W.partitionBy(*by, "__part").orderBy(order(lead), *ties).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    keyed = keyed.withColumns({f"__i_{n}": F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0)) for n in values})
    match = F.col("__part").eqNullSafe(F.col("__b_part"))
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"__b_{c}"))
    out = keyed.join(base, match)
    return out.select(*rows.columns, *[(F.col(f"__s_{n}") + F.col(f"__i_{n}")).alias(n) for n in values])


def totals(rows: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """Adds each name's sum over the whole group: pre-aggregated, then joined."""
    sums = rows.groupBy(*by).agg(*[F.sum(v).alias(n) for n, v in values.items()])
    if not by:
        return rows.join(F.broadcast(sums))  # one row
    renamed = sums.select(*[F.col(c).alias(f"__t_{c}") for c in by], *values)
    match = None
    for c in by:
        m = F.col(c).eqNullSafe(F.col(f"__t_{c}"))
        match = m if match is None else match & m
    return rows.join(renamed, match).select(*rows.columns, *values)
