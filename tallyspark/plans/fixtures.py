"""Decision rows from the test tables: a deterministic scorer stands in for a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import hashing, probs as P
from .catalog import table, unit_sql


def decisions(spark, d: str) -> DataFrame:
    """A row for each order: K from 2 to 5 candidates and the null, logits, probabilities, a label (-1: null; null for soft rows), a target."""
    k = (2 + F.col("o_orderkey") % 4).cast("int")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("grp"), F.col("o_orderpriority").alias("task"), F.col("o_orderstatus").alias("qtype"), k.alias("k"))
    u = lambda tag, *more: hashing.unit(tag, F.col("row_id"), *more)
    o = o.withColumn("logits", F.transform(F.sequence(F.lit(0), F.col("k")), lambda j: F.round(u("z", j) * 4, 6)))
    o = o.withColumn("label", F.when(u("soft") < 0.05, F.lit(None)).when(u("null") < 0.2, -1).otherwise(F.floor(u("label") * F.col("k"))).cast("int"))
    o = o.withColumn("probs", P.softmax(F.col("logits")))
    at = F.when(F.coalesce("label", F.lit(0)) == -1, F.col("k")).otherwise(F.coalesce("label", F.lit(0)))
    return o.withColumn("target", P.one_hot(F.col("k") + 1, at))


DECISIONS_SQL = f"""
d0 AS (SELECT o_orderkey AS row_id, o_custkey AS grp, o_orderpriority AS task, o_orderstatus AS qtype, (2 + o_orderkey % 4)::INT AS k FROM orders),
d1 AS (SELECT *, list_transform(range(0, k + 1), lambda j: round({unit_sql("'z:' || row_id || ':' || j")} * 4, 6)) AS logits,
  CASE WHEN {unit_sql("'soft:' || row_id")} < 0.05 THEN NULL WHEN {unit_sql("'null:' || row_id")} < 0.2 THEN -1 ELSE floor({unit_sql("'label:' || row_id")} * k)::INT END AS label FROM d0),
d2 AS (SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM d1),
d3 AS (SELECT * EXCLUDE (e), list_transform(e, lambda x: x / list_sum(e)) AS probs, CASE WHEN coalesce(label, 0) = -1 THEN k ELSE coalesce(label, 0) END AS gold_at FROM d2),
decisions AS (SELECT *, list_transform(range(0, k + 1), lambda i: CASE WHEN i = gold_at THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS target FROM d3)"""


def R(c, n: int = 6):
    """Rounded as by DuckDB, whose scaled value decides: a value just below a half goes down, though its shortest decimal may end in 5 (0.5000005)."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double") * 10.0**n) / 10.0**n


def rounded(xs, n: int = 6):
    return F.transform(xs, lambda x: R(x, n))
