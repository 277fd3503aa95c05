"""Selections that depend on what was taken before: one group at a time, in pandas."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import hashing


def case_quota(cases: DataFrame, group: str, key: str, size: str, most: int, seed: str) -> DataFrame:
    """(group, key, size): in hash order, whole cases while their sizes sum to at most ``most``; a case too large for the rest is skipped.

    A case can only be taken if it alone fits, and each taken one leaves less room, so the rows of a group that reach the grouped task are narrow
    (key, size, hash); a group's selection is one task.
    """
    kind = cases.schema
    ranked = cases.where(F.col(size) <= most).select(group, key, F.col(size).cast("long").alias("size"), hashing.rank_key(seed, F.col(key)).alias("h"))

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        left, keep = most, []
        for i, n in zip(pdf.sort_values("h").index, pdf.sort_values("h")["size"]):
            if n <= left:
                keep.append(i)
                left -= n
            if not left:
                break
        return pdf.loc[keep, [group, key, "size"]]

    return ranked.groupBy(group).applyInPandas(take, f"{group} {kind[group].dataType.simpleString()}, {key} {kind[key].dataType.simpleString()}, size long")


def group_batches(rows: DataFrame, group: str, length: str, most: int, chunk: int, seed: str) -> DataFrame:
    """(group, chunk, batch): groups dealt by hash to chunks of about ``chunk`` batches, sorted by their longest row there, and filled into batches of at most ``most`` rows; a group is never split."""
    kind = rows.schema[group].dataType.simpleString()
    units = rows.groupBy(group).agg(F.count("*").alias("n"), F.max(length).alias("m")).withColumn("h", hashing.rank_key(seed, F.col(group)))
    count = max(1, units.agg(F.sum("n")).first()[0] // (most * chunk)) if rows.take(1) else 1
    dealt = units.withColumn("chunk", F.floor(hashing.unit(seed, F.col(group)) * count).cast("int"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["m", "h"])
        batch, held, out = 0, 0, []
        for n in pdf["n"]:
            if held and held + n > most:
                batch, held = batch + 1, 0
            out.append(batch)
            held += n
        return pd.DataFrame({group: pdf[group], "chunk": pdf["chunk"], "batch": out})

    return dealt.groupBy("chunk").applyInPandas(fill, f"{group} {kind}, chunk int, batch int")


def capped_round_robin(rows: DataFrame, kind: str, task: str, key: str, soft: str, quota: int, cap: int, seed: str) -> DataFrame:
    """(kind, task, key): of each kind up to ``quota`` rows, soft ones first, one task after the other and at most ``cap`` of a task.

    Only the ``cap`` first rows of each (kind, task, soft) can be taken; they are ranked before, so a kind's pass sees no more.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy(kind, task, soft).orderBy(hashing.rank_key(seed, F.col(key)))
    ranked = rows.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= cap).select(kind, task, key, soft, "turn")
    types = {c: rows.schema[c].dataType.simpleString() for c in (kind, task, key)}

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        used, keep = {}, []
        for i, t in zip(pdf.sort_values([soft, "turn", task], ascending=[False, True, True]).index, pdf.sort_values([soft, "turn", task], ascending=[False, True, True])[task]):
            if len(keep) == quota:
                break
            if used.get(t, 0) < cap:
                used[t] = used.get(t, 0) + 1
                keep.append(i)
        return pdf.loc[keep, [kind, task, key]]

    return ranked.groupBy(kind).applyInPandas(pick, ", ".join(f"{c} {t}" for c, t in types.items()))


def hard_then_even(rows: DataFrame, family: str, cell: str, key: str, hardness: str, hard: int, per_cell: int, per_family: int) -> DataFrame:
    """(family, cell, key): the hardest rows, then cells in turn, with caps by cell and family that both parts share.

    No more than ``per_cell`` rows of a cell can be taken, so each cell's hardest are kept before the grouped pass over a family.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy(family, cell).orderBy(F.desc(hardness), key)
    ranked = rows.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= per_cell).select(family, cell, key, hardness, "turn")
    types = {c: rows.schema[c].dataType.simpleString() for c in (family, cell, key)}

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.sort_values([hardness, key], ascending=[False, True]).head(min(hard, per_family))
        rest = pdf.drop(first.index).sort_values(["turn", cell]).head(max(0, per_family - len(first)))
        return pd.concat([first, rest])[[family, cell, key]]

    return ranked.groupBy(family).applyInPandas(pick, ", ".join(f"{c} {t}" for c, t in types.items()))
