"""Filters, validations and self-tests of decision rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import probs as P


def hard_targets(rows: DataFrame) -> DataFrame:
    """Soft targets by the one-hot of their argmax; p_null rounded."""
    best = P.argmax(F.col("target"))
    return rows.withColumns({"target": P.one_hot(F.size("target"), best), "p_null": F.bround("p_null")})


def without_null(rows: DataFrame) -> DataFrame:
    """Rows whose p_null isn't 1, with p_null 0."""
    return rows.where(F.col("p_null") != 1).withColumn("p_null", F.lit(0.0))


def truncated_dropped(rows: DataFrame, text: str, tokens: Column, most: int) -> DataFrame:
    """Rows with more tokens than ``most`` go; tokens are only looked at where there are over 3.5 characters for each allowed one."""
    return rows.where(~((F.length(text) > 3.5 * most) & (tokens > most)))


def blanks_dropped(rows: DataFrame, exempt: list[str]) -> DataFrame:
    """Rows whose stripped state has three characters or more, or whose task is exempt or ends in _noev."""
    from ..functions.text import strip

    return rows.where((F.length(strip(F.col("state"))) >= 3) | F.col("task").isin(exempt) | F.col("task").endswith("_noev"))


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): in one pass, how many rows break each rule; a null check is a violation."""
    counts = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in rules])).alias("r")).select("r.*")


def decision_rules() -> dict[str, Column]:
    t, n = F.col("target"), F.size("target")
    return {
        "lengths": n == F.col("k") + 1,
        "sums_to_one": F.abs(P.total(t) - 1) <= 1e-6,
        "p_null_in_range": F.element_at(t, -1).between(0, 1),
        "label_is_argmax": F.col("label").isNull() | (P.argmax(t) == F.when(F.col("label") == -1, F.col("k")).otherwise(F.col("label"))),
        "has_candidates": F.col("k") > 0,
    }


def first_failure(checks: dict[str, Column]) -> Column:
    """The name of the first check that doesn't hold (null counts as failing), null when all hold."""
    out = None
    for name, good in checks.items():
        bad = ~F.coalesce(good, F.lit(False))
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return out


def degenerate_columns(rows: DataFrame, columns: list[str], least: int, share: float, needs: dict[str, str] | None = None) -> list[str]:
    """Columns with fewer than ``least`` answers (null and empty are none), or of which one value has at least ``share``, or whose prerequisite
    (``needs``: column to column) went before them. One pass for all columns."""
    entries = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])
    counts = rows.select(F.explode(entries).alias("e")).where("e.v <> ''").groupBy("e.c", "e.v").agg(F.count("*").alias("n"))
    per = counts.groupBy("c").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    good = {r["c"] for r in per.where((F.col("n") >= least) & (F.col("top") < share * F.col("n"))).collect()}  # a row for each column
    gone: list[str] = []
    for c in columns:
        if c not in good or (needs or {}).get(c) in gone:
            gone.append(c)
    return gone


def grid_gaps(rows: DataFrame, unit: str, grid: DataFrame, factors: list[str]) -> DataFrame:
    """(unit, factors, n): cells of the full grid that a unit doesn't have exactly once (n is 0 or above 1)."""
    want = rows.select(unit).distinct().join(F.broadcast(grid))  # the grid is a design's few cells
    have = rows.groupBy(unit, *factors).agg(F.count("*").alias("n"))
    return want.join(have, [unit, *factors], "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n <> 1")
