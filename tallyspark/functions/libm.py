"""exp and pow of the C library, by Arrow batches: DuckDB has these, and those of the JVM differ from them in the last place, which decides beside a rounding half."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import probs as P


def c_exp(x: float) -> float:
    try:
        return math.exp(x)
    except OverflowError:
        return math.inf


def c_pow(x: float, y: float) -> float:
    """As in C, where Python raises: nan for a root of a negative number, infinite for overflow or a negative power of zero."""
    try:
        return math.pow(x, y)
    except OverflowError:
        return -math.inf if x < 0 and y % 2 == 1 else math.inf
    except ValueError:
        return math.nan if x else math.copysign(math.inf, x) if y % 2 == 1 else math.inf


def _each(f: Callable[[float], float], xs: pa.Array) -> pa.Array:
    """f of each element of the lists."""
    flat = xs.flatten()
    if xs.null_count or flat.null_count:
        return pa.array([None if x is None else [None if v is None else f(v) for v in x] for x in xs.to_pylist()], xs.type)
    ends = xs.offsets.to_numpy()
    values = pa.array(list(map(f, flat.to_numpy().tolist())), pa.float64())  # numpy's own exp and pow may be others than the C library's
    return type(xs).from_arrays(pa.array(ends - ends[0], xs.offsets.type), values, type=xs.type)


def mapped(rows: DataFrame, column: str, f: Callable[[float], float]) -> DataFrame:
    """The column, an array of doubles, with f of each element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index(column)
            yield b.set_column(i, b.schema.field(i), _each(f, b.column(i)))

    return rows.mapInArrow(run, rows.schema)


def softmax(rows: DataFrame, column: str) -> DataFrame:
    """Of the column's logits."""
    away = P.bound(F.col(column), lambda zs: P.bound(F.array_max(zs), lambda top: F.transform(zs, lambda x: x - top)))
    return mapped(rows.withColumn(column, away), column, c_exp).withColumn(column, P.shares(F.col(column)))


def tempered(rows: DataFrame, column: str, t: float) -> DataFrame:
    return mapped(rows, column, lambda x: c_pow(x, 1.0 / t)).withColumn(column, P.shares(F.col(column)))
