"""Running sums over hash buckets, in parts, so that no task orders all of a group's buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

#: Neighbouring buckets that one task adds up.
PART = 4096


def running(sums: DataFrame, group: list[str], bucket: str, value: str) -> DataFrame:
    """Rows (one for each group and bucket, numbered from 0) with ``before``: the sum of ``value`` over the group's smaller buckets.

    Sums inside parts of PART neighbouring buckets, each a task's, then over the parts' totals, which are by PART fewer.
    """
    part = F.floor(F.col(bucket) / PART)
    names = [F.col(g).alias(f"__g{i}") for i, g in enumerate(group)]
    totals = sums.groupBy(*names, part.alias("__part")).agg(F.sum(value).alias("__total"))
    over = W.partitionBy(*[f"__g{i}" for i in range(len(group))]).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("__lead", F.coalesce(F.sum("__total").over(over), F.lit(0))).drop("__total")
    same = F.col("__p") == F.col("__part")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    inside = W.partitionBy(*group, "__p").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    rows = sums.withColumn("__p", part).withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(totals, same)
    return rows.withColumn("before", F.col("__lead") + F.col("__in")).drop("__p", "__part", "__lead", "__in", *[f"__g{i}" for i in range(len(group))])
