"""Scorers: what gives a decision row its scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import hashing, probs as P


class Scorer(Protocol):
    """Adds ``logits`` (a number for each candidate, then one for the null) to rows with state, query and candidates."""

    def __call__(self, rows: DataFrame) -> DataFrame: ...


def precomputed(scores: DataFrame, key: str) -> Scorer:
    """Logits by key from a table; rows without any fail the query, as a silent gap would look like an answer."""
    return lambda rows: rows.join(scores.select(key, "logits"), key, "left").withColumn("logits", F.when(F.col("logits").isNull(), F.raise_error(F.lit("a row without scores"))).otherwise(F.col("logits")))


def pseudo(seed: str, key: str) -> Scorer:
    """Deterministic numbers by md5, for tests."""
    return lambda rows: rows.withColumn("logits", F.transform(F.sequence(F.lit(0), F.size("candidates")), lambda j: 4 * hashing.unit(seed, F.col(key), j)))


def lexical() -> Scorer:
    """Shared words of the state with each candidate; the null has a constant."""
    words = lambda s: F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit(r"(?U)\w+"), F.lit(0)))

    def score(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("__w", words(F.col("state")))
        z = F.transform("candidates", lambda c: F.size(F.array_intersect("__w", words(c))).cast("double"))
        return rows.withColumn("logits", F.concat(z, F.array(F.lit(0.5)))).drop("__w")

    return score


def batched(fn: Callable[[list[str], list[str], list[list[str]]], list[list[float]]]) -> Scorer:
    """A Python model on Arrow batches: (states, queries, candidate lists) to logits."""

    def score(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(logits=[np.asarray(z, dtype=float) for z in fn(list(pdf.state), list(pdf["query"]), [list(c) for c in pdf.candidates])])

        return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField("logits", ArrayType(DoubleType()))]))

    return score


def once_a_state(rows: DataFrame, encode: Callable, score: Callable, state: str, schema: str) -> DataFrame:
    """Questions grouped by their state: ``encode(state)`` once, then ``score(encoded, questions of the state)``.

    States are dealt by hash and sorted, so a task sees a state's questions one after the other and holds only one encoded state.
    """
    dealt = rows.repartition(state).sortWithinPartitions(state)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, encoded = None, None
        for pdf in batches:
            for s, part in pdf.groupby(state, sort=False):
                if s != last:
                    last, encoded = s, encode(s)
                yield score(encoded, part)

    return dealt.mapInPandas(run, schema)


def decide(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """probs, pred (the null is K) and p_null of every row."""
    out = scorer(rows).withColumn("probs", P.softmax(F.col("logits")))
    return out.withColumns({"pred": P.argmax(F.col("probs")), "p_null": P.null_of(F.col("probs"))})
