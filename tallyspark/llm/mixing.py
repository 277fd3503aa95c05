"""Mixing sources to target weights along a time-varying curriculum.

Each source's weight schedule is integrated over training time, which gives its cumulative demand for tokens. A document stands at an offset in
its source's stream (streams repeat until the demand is met); the inverse of the demand at this offset is the training position, by which the
documents are range-sorted.

Scale: documents are only ever joined with per-source and per-bucket sums. Offsets are prefix sums of three levels: inside hash buckets of a
bounded number of documents, over a bounded number of buckets, and over those parts, so one source may hold any share of the rows. What reaches the driver is a row per source (at most
``MAX_SOURCES``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .prefix import running
from .storage import written

MAX_SOURCES = 100_000
#: Documents of one source that a hash bucket holds on average.
BUCKET_ROWS = 128
#: Pieces of a source's cumulative demand; inside a piece the weights count as constant.
STEPS = 32


@dataclass(frozen=True)
class Schedule:
    """Weights over training time: at ``times`` (rising, from 0 to 1) a weight each, linear between them."""

    times: Sequence[float]
    weights: Sequence[float]

    def at(self, t: float) -> float:
        for (a, x), (b, y) in zip(zip(self.times, self.weights), zip(self.times[1:], self.weights[1:])):
            if t <= b:
                return x if b == a else x + (y - x) * (t - a) / (b - a)
        return self.weights[-1]


def constant(weight: float) -> Schedule:
    return Schedule((0.0, 1.0), (weight, weight))


def cyclic_weights(sources: Sequence[str | None], weights: Sequence[float] = (5, 2, 1)) -> dict[str | None, Schedule]:
    """The weights, repeating, over the sources by code point, null last."""
    ordered = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: constant(weights[i % len(weights)]) for i, s in enumerate(ordered)}


def capped_targets(sizes: dict, shares: dict, total: float, cap: float) -> dict:
    """Shares of ``total`` by weight, none above ``cap`` times its source's size: the excess is shared again by weight until no source is above."""
    target = dict.fromkeys(sizes, 0.0)
    open_, left = {s for s in sizes if shares[s] > 0 and sizes[s] > 0}, float(total)
    while open_:
        mass = sum(shares[s] for s in sorted(open_, key=str))
        full = {s for s in open_ if left * shares[s] / mass > cap * sizes[s]}
        if not full:
            return target | {s: left * shares[s] / mass for s in open_}
        for s in sorted(full, key=str):
            target[s] = cap * float(sizes[s])
            left -= target[s]
        open_ -= full
    return target


def demand_curves(schedules: dict, targets: dict, steps: int = STEPS) -> dict:
    """Cumulative demand of each source at 0, 1/steps, .. 1 (trapezoids over its share of all weights), scaled to end at its target."""
    grid = [i / steps for i in range(steps + 1)]
    raw = {s: [max(0.0, c.at(t)) for t in grid] for s, c in schedules.items()}
    mass = [sum(v[i] for v in raw.values()) or 1.0 for i in range(steps + 1)]
    out = {}
    for s, v in raw.items():
        share, total = [x / m for x, m in zip(v, mass)], [0.0]
        for a, b in zip(share, share[1:]):
            total.append(total[-1] + (a + b) / 2 / steps)
        out[s] = [x * targets[s] / total[-1] if total[-1] > 0 else 0.0 for x in total]
    return out


def counted(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``size``: the number of ``[^\\x20\\x09-\\x0D]+`` in the text, 0 for null."""
    source = docs.select(*keys, F.col(text).cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *rest, raw = batch.columns
            yield pa.RecordBatch.from_arrays([*rest, pa.array([len((x.as_py() or b"").split()) for x in raw], pa.int64())], names=[*keys, "size"])

    return source.mapInArrow(run, f"{source.drop('__text').schema.simpleString()[7:-1]}, size long")


def placed(sizes: DataFrame, weights=cyclic_weights, cap: float = 3.0, seed: int = 7, whole: bool = False, rows: DataFrame | None = None) -> DataFrame:
    """Where a mix places the documents of ``sizes`` (columns doc_id, source, size, and any others).

    ``weights`` gets the list of sources and returns a Schedule for each. The mix has as many words as all documents; a source's target stops at
    ``cap`` times its size. Adds source_size, target and placements, an array of (copy, position, words): the copy's training position from 0 to 1
    and the words taken of it (all, but for the copy at which the source's demand ends; with ``whole``, a copy is taken whole or not at all,
    by whether its middle lies before that end). A document that isn't taken has an empty array.

    Null sizes count as 0, such documents and those without words are never placed; a null source is a source of its own; an empty table gives
    no rows. Repeated rows have offsets of their own. The order in a source is by hash of doc_id, then by doc_id, size and, where there is one, column
    ``__key``; rows that are alike in all of these are interchangeable, so reruns agree. ``rows``: the same documents, with more columns, which
    are placed instead of ``sizes`` (that then only serves the sums, without their columns).
    """
    size = F.coalesce(F.col("size"), F.lit(0))
    totals = {r["source"]: (r["n"], r["words"]) for r in sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum(size).alias("words")).limit(MAX_SOURCES + 1).collect()}
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    spark = sizes.sparkSession
    words = {s: w for s, (_, w) in totals.items()}
    schedules = weights(list(words))
    mean = {s: sum(demand) for s, demand in _shares(schedules).items()}
    targets = capped_targets(words, mean, sum(words.values()), cap)
    curves = demand_curves(schedules, targets)
    plan = spark.createDataFrame(
        [(s, max(1, -(-n // BUCKET_ROWS)), words[s], targets[s], curves[s]) for s, (n, _) in totals.items()],
        "source string, buckets long, source_size long, target double, curve array<double>",
    )

    def known(of: DataFrame) -> DataFrame:
        # One row per source, at most MAX_SOURCES rows of STEPS numbers.
        hashed = of.withColumns({"source": F.col("source").cast("string"), "size": size, "__h": F.xxhash64("doc_id", F.lit(seed))})
        return _join_sources(hashed, plan).withColumn("__bucket", F.pmod(F.shiftrightunsigned("__h", 20), F.col("buckets")))

    sums = known(sizes.select("source", "doc_id", "size")).groupBy("source", "__bucket").agg(F.sum("size").alias("__sum"))
    base = running(sums, ["source"], "__bucket", "__sum").select(F.col("source").alias("__s"), F.col("__bucket").alias("__b"), F.col("before").alias("__base"))
    base, _ = written(base, "mix-bases")  # so that it is broadcast only if it is small
    here = known(sizes if rows is None else rows)
    inside = W.partitionBy("source", "__bucket").orderBy("__h", "doc_id", "size", *[c for c in here.columns if c == "__key"]).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        here.withColumn("__in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(base, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b")))
        .withColumn("__start", F.col("__base") + F.col("__in"))
    )
    return _with_placements(offsets, cap, whole).drop("__h", "__bucket", "__in", "__base", "__start", "__s", "__b", "buckets", "curve")


def _shares(schedules: dict) -> dict:
    grid = [i / STEPS for i in range(STEPS + 1)]
    raw = {s: [max(0.0, c.at(t)) for t in grid] for s, c in schedules.items()}
    mass = [sum(v[i] for v in raw.values()) or 1.0 for i in range(len(grid))]
    share = {s: [x / m for x, m in zip(v, mass)] for s, v in raw.items()}
    return {s: [(a + b) / 2 for a, b in zip(v, v[1:])] for s, v in share.items()}


def _join_sources(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with their source's plan; the plan has a row per source (at most MAX_SOURCES, checked above), so it is broadcast."""
    plan = plan.withColumnRenamed("source", "__src")
    return rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("__src"))).drop("__src")


def _with_placements(rows: DataFrame, cap: float, whole: bool) -> DataFrame:
    """From each document's offset, its copies: copy k starts at offset + k * source_size in the stream, which ends at the target."""
    copies = int(-(-cap // 1))
    # a copy's words: what of [start, start + size) lies before the whole number of words nearest the target
    end = F.round(F.col("target")).cast("long")

    def position(start):
        # the piece of the curve that start lies in, then linear inside it
        i = F.greatest(F.lit(1), F.least(F.lit(STEPS), F.size(F.filter("curve", lambda c: c <= start))))
        low, high = F.element_at("curve", i), F.element_at("curve", i + 1)
        return (i - 1 + F.when(high > low, (start - low) / (high - low)).otherwise(0.0)) / STEPS

    def copy(k):
        start = F.col("__start") + k * F.col("source_size")
        part = F.when(start + F.col("size") / 2 < end, F.col("size")).otherwise(F.lit(0)) if whole else F.greatest(F.lit(0), F.least(F.col("size"), end - start))
        return F.struct(k.cast("int").alias("copy"), position(start.cast("double")).alias("position"), part.cast("long").alias("words"))

    all_ = F.transform(F.sequence(F.lit(0), F.lit(max(0, copies - 1))), copy)
    return rows.withColumn("placements", F.filter(all_, lambda p: p["words"] > 0))


def ordered_mix(docs: DataFrame, weights=cyclic_weights, cap: float = 3.0, seed: int = 7) -> DataFrame:
    """The documents as often as the mix takes them, whole, range-sorted by training position; the columns are those of ``docs``.

    Repeated rows each have a place of their own. Documents without words (null or empty texts) are never taken; a null source is a source; columns
    may have any names; an empty table gives no rows.
    """
    # the documents' columns travel as one, so their names can't clash with any other
    row = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "text", F.xxhash64("text").alias("__key"))
    sizes, _ = written(counted(row, ["doc_id", "source"]), "mix-sizes")
    rows = row.withColumn("size", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")).drop("text")
    plan = placed(sizes, weights, cap, seed, whole=True, rows=rows)
    out = plan.select("row", F.explode("placements.position").alias("__position"))
    return out.repartitionByRange("__position").sortWithinPartitions("__position").select("row.*")
