"""Comparisons of runs: cluster bootstraps, contrasts, gates, reveals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import hashing


def cluster_bootstrap(clusters: DataFrame, key: str, num: str, den: str, replicates: int, seed: str, spark) -> DataFrame:
    """(replicate, ratio): sums over as many clusters as there are, each drawn by hash with replacement.

    ``clusters`` has a row for each cluster with its sums (aggregate first; the bootstrap's cost is clusters x replicates).
    """
    n = W.orderBy(key)
    numbered = clusters.select((F.row_number().over(n) - 1).alias("i"), F.col(num).cast("double").alias("num"), F.col(den).cast("double").alias("den"))
    size = numbered.agg(F.count("*").alias("size"))
    draws = spark.range(replicates).withColumnRenamed("id", "replicate").join(F.broadcast(size))  # one row
    draws = draws.select("replicate", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias("draw"))
    draws = draws.select("replicate", F.floor(hashing.unit(seed, F.col("replicate"), F.col("draw")) * F.col("size")).alias("pick"))
    return draws.join(numbered, F.col("pick") == F.col("i")).groupBy("replicate").agg((F.sum("num") / F.sum("den")).alias("ratio"))


def index_interval(values: DataFrame, value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """The sorted values at places int(low B) and int(high B), the latter at most B - 1."""
    ranked = values.withColumn("r", F.row_number().over(W.orderBy(value)) - 1).withColumn("b", F.count("*").over(W.partitionBy()))
    at = lambda q: F.max(F.when(F.col("r") == F.least(F.col("b") - 1, F.floor(F.lit(q) * F.col("b"))), F.col(value)))
    return ranked.agg(at(low).alias("low"), at(high).alias("high"))


def transitions(a: DataFrame, b: DataFrame, keys: list[str], state: str) -> DataFrame:
    """Counts of state_to_state over keys that both runs have."""
    x = a.select(*keys, F.col(state).alias("x"))
    y = b.select(*keys, F.col(state).alias("y"))
    return x.join(y, keys).groupBy(F.concat_ws("_to_", "x", "y").alias("transition")).agg(F.count("*").alias("n"))


def fail_closed(rows: DataFrame, predictions: DataFrame, key: str, checks: dict[str, Column], worst: dict[str, float], metrics: dict[str, Column]) -> DataFrame:
    """Every row with its metrics; a missing or malformed prediction has the worst ones and a reason, and is never dropped."""
    joined = rows.join(predictions, key, "left")
    reason = None
    for name, bad in checks.items():
        reason = F.when(bad, name) if reason is None else reason.when(bad, name)
    joined = joined.withColumn("reason", reason)
    return joined.withColumns({m: F.when(F.col("reason").isNull(), c).otherwise(worst[m]) for m, c in metrics.items()})


def gates(metrics: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(gate, passed) of a one-row table, and the row ``all``; a null check fails."""
    held = {k: F.coalesce(c, F.lit(False)) for k, c in checks.items()}
    every = None
    for c in held.values():
        every = c if every is None else every & c
    rows = F.array(*[F.struct(F.lit(k).alias("gate"), c.alias("passed")) for k, c in {**held, "all": every}.items()])
    return metrics.select(F.explode(rows).alias("g")).select("g.*")


def reveal(rows: DataFrame, *by: str) -> DataFrame:
    """Of columns gold, a, b (answers of two scorers) and a_null, b_null: agreements, fixed, broken and abstained."""
    ok = lambda c: (F.col(c) == F.col("gold"))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(ok("a").cast("double")).alias("a_agrees"), F.avg(ok("b").cast("double")).alias("b_agrees"),
        F.count_if(~ok("a") & ok("b")).alias("fixed"), F.count_if(ok("a") & ~ok("b")).alias("broken"), F.count_if(F.col("b_null") >= 0.5).alias("abstained"),
    )
