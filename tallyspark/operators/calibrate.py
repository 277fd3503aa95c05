"""Calibration: temperature grids and fits, fusion sweeps, isotonic regression."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import probs as P


def temperature_grid(rows: DataFrame, by: str, low: float, high: float, steps: int, least: int) -> DataFrame:
    """For each ``by`` with at least ``least`` rows the step of a logarithmic grid with the smallest mean NLL (the first on ties): rows, step, t, nll.

    The grid is an array inside each row's aggregate, so rows are read once and shuffled as partial sums.
    """
    grid = [math.exp(math.log(low) + i * (math.log(high) - math.log(low)) / (steps - 1)) for i in range(steps)]
    losses = F.transform(F.array(*[F.lit(t) for t in grid]), lambda t: P.nll(P.softmax(F.col("logits"), t), F.col("target")))
    held = rows.select(by, losses.alias("losses"))
    sums = held.groupBy(by).agg(F.count("*").alias("rows"), *[F.avg(F.get("losses", F.lit(i))).alias(f"t{i}") for i in range(steps)])
    all_ = F.array(*[F.struct(F.round(f"t{i}", 9).alias("key"), F.lit(i).alias("step"), F.lit(t).alias("t"), F.col(f"t{i}").alias("nll")) for i, t in enumerate(grid)])
    return sums.where(F.col("rows") >= least).select(by, "rows", F.array_min(all_).alias("b")).select(by, "rows", "b.step", "b.t", "b.nll")


def fusion_sweep(rows: DataFrame, gs: Sequence[float], mode: str = "log") -> DataFrame:
    """Accuracy and NLL of fused candidates (columns a, b, label) for every g: g, n, acc, nll."""
    out = None
    swept = rows.select("a", "b", "label", F.explode(F.array(*[F.lit(float(g)) for g in gs])).alias("g"))
    p = P.fused(F.col("a"), F.col("b"), F.col("g"), mode)
    out = swept.select("g", "label", p.alias("p"))
    hit = (P.argmax(F.col("p")) == F.col("label")).cast("double")
    return out.groupBy("g").agg(F.count("*").alias("n"), F.avg(hit).alias("acc"), F.avg(-F.ln(F.get("p", F.col("label")))).alias("nll"))


def golden_section(rows: DataFrame, by: str, low: float, high: float, rounds: int, bins: int = 512) -> DataFrame:
    """(by, t, nll): the temperature with the smallest mean NLL for each type, by a golden-section search on log t.

    Every round is one aggregate over all rows, in which each type has its own two probes; what the driver holds is a row for each type.
    """
    ratio = (math.sqrt(5) - 1) / 2
    spark = rows.sparkSession
    state = {r[by]: [math.log(low), math.log(high)] for r in rows.select(by).distinct().limit(bins + 1).collect()}
    if len(state) > bins:
        raise ValueError(f"more than {bins} types")
    for _ in range(rounds):
        probes = [(k, math.exp(b - ratio * (b - a)), math.exp(a + ratio * (b - a))) for k, (a, b) in state.items()]
        found = _at(spark, rows, by, probes)
        for k, t1, t2 in probes:
            state[k] = [state[k][0], math.log(t2)] if found[k][0] < found[k][1] else [math.log(t1), state[k][1]]
    final = [(k, math.exp((a + b) / 2), math.exp((a + b) / 2)) for k, (a, b) in state.items()]
    found = _at(spark, rows, by, final)
    return spark.createDataFrame([(k, t, found[k][0]) for k, t, _ in final], f"{by} {rows.schema[by].dataType.simpleString()}, t double, nll double")


def _at(spark, rows: DataFrame, by: str, probes: list) -> dict:
    probes_df = spark.createDataFrame(probes, f"probe_key {rows.schema[by].dataType.simpleString()}, t1 double, t2 double")
    joined = rows.join(F.broadcast(probes_df), F.col(by) == F.col("probe_key"))  # a row for each type
    loss = lambda t: F.avg(P.nll(P.softmax(F.col("logits"), F.col(t)), F.col("target")))
    return {r["probe_key"]: (r["a"], r["b"]) for r in joined.groupBy("probe_key").agg(loss("t1").alias("a"), loss("t2").alias("b")).collect()}


def isotonic_fit(rows: DataFrame, key: str, x: str, y: str, folds: int, bins: int = 4096) -> DataFrame:
    """(fold, n, raw, fitted): squared error of x itself and of an isotonic fit learnt on the other folds (by hash of the key).

    x from 0 to 1 is summed in ``bins`` equal parts before the fit, so a fold's fit works on at most that many rows.
    """
    from ..functions import hashing

    fold = F.floor(hashing.unit("fold", F.col(key)) * folds).cast("int")
    parts = rows.select(fold.alias("fold"), F.least(F.lit(bins - 1), F.floor(F.col(x) * bins)).alias("bin"), F.col(x).alias("x"), F.col(y).alias("y"))
    parts = parts.groupBy("fold", "bin").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    spread = parts.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        held = int(pdf["held"].iloc[0])
        train = pdf[pdf.fold != held].groupby("bin", as_index=False)[["n", "sx", "sy"]].sum().sort_values("bin")
        level, weight, size = [], [], []
        for m, w in zip(train.sy / train.n, train.n):  # pool adjacent violators
            level.append(m), weight.append(w), size.append(1)
            while len(level) > 1 and level[-2] >= level[-1]:
                w = weight[-2] + weight[-1]
                level[-2:] = [(level[-2] * weight[-2] + level[-1] * weight[-1]) / w]
                weight[-2:] = [w]
                size[-2:] = [size[-2] + size[-1]]
        fitted = np.repeat(level, size)
        test = pdf[pdf.fold == held]
        at = np.interp(test.sx / test.n, train.sx / train.n, fitted) if len(train) else test.sx / test.n
        n = test.n.sum()
        raw = (test.sxx - 2 * test.sxy + test.syy).sum() / max(n, 1)
        err = (test.syy - 2 * at * test.sy + at * at * test.n).sum() / max(n, 1)
        return pd.DataFrame({"fold": [held], "n": [n], "raw": [round(raw, 6)], "fitted": [round(err, 6)]})

    return spread.groupBy("held").applyInPandas(fit, "fold int, n long, raw double, fitted double")
