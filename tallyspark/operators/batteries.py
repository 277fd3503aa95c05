"""Paired batteries over variants of decision rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .joins import variant_pairs


def choice_set_effects(rows: DataFrame, pair: str) -> DataFrame:
    """Means over pairs of what adding, removing, doubling and reordering options does (columns variant, candidates, p with the null last)."""
    v = lambda name: F.max(F.when(F.col("variant") == name, F.struct("candidates", "p"))).alias(name)
    w = rows.groupBy(pair).agg(*[v(n) for n in ("base", "add_irr", "remove_gold", "dup", "reorder")]).where("base IS NOT NULL")
    last = lambda n: F.element_at(f"{n}.p", -1)
    # the added option and the doubled one stand before the null
    added, doubled, first = F.element_at("add_irr.p", -2), F.element_at("dup.p", -2), F.get("dup.p", F.lit(0))
    at = lambda n, c: F.get(f"{n}.p", F.array_position(f"{n}.candidates", c).cast("int") - 1)
    moved = F.array_max(F.transform("base.candidates", lambda c: F.abs(at("base", c) - at("reorder", c))))
    return w.agg(
        F.avg(added).alias("p_irr"), F.avg(last("remove_gold") - last("base")).alias("dp_null"),
        F.avg(F.abs(first + doubled - F.get("base.p", F.lit(0)))).alias("mass_err"), F.avg(F.abs(first - doubled)).alias("slot_gap"), F.avg(moved).alias("max_dp"),
    )


def rubric_flip(rows: DataFrame, group: str, key: str) -> DataFrame:
    """Of the first pair with different gold labels in each group: pairs, share of changed answers, share with both right."""
    pairs = variant_pairs(rows.select(group, key, "label"), group, key, "label")
    side = lambda s: rows.select(F.col(key).alias(s), F.col("label").alias(f"{s}_label"), F.col("pred").alias(f"{s}_pred"))
    x = pairs.join(side("a"), "a").join(side("b"), "b")
    right = (F.col("a_pred") == F.col("a_label")) & (F.col("b_pred") == F.col("b_label"))
    return x.agg(F.count("*").alias("pairs"), F.avg((F.col("a_pred") != F.col("b_pred")).cast("int")).alias("flip_rate"), F.avg(right.cast("int")).alias("both_correct"))
