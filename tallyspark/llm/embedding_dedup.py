"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with cosine at least c lie within epsilon = sqrt(2 - 2c). Vectors are sorted by their grid cells of width epsilon on the leading principal
dimensions; the sequence is cut into blocks, and intervals of blocks form a tree. Pairs of intervals are joined from the root downwards:
a pair whose bounding boxes on the principal dimensions, or whose balls in the whole space, are further apart than epsilon is skipped, a pair
that is left splits into its children. The pairs of blocks that remain compare their vectors in double precision.

Scale: equal vectors are one row with a count. A block is one row of at most ``BLOCK`` vectors, so a hot group fills many blocks and many
tasks. A pair of blocks gives, for each vector, its number of partners, and a spanning forest of its links: never more rows than vectors,
however many pairs there are; pairs of blocks that lie wholly within epsilon need no comparing. What reaches the driver are sums of a
dimension's square, the number of blocks and the levels' pair counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components, spanning
from .storage import written

LEADING, BLOCK, FANOUT = 4, 2048, 8
#: Pairs of blocks in an Arrow batch (a pair has about a megabyte).
PAIRS_AT_ONCE = 2
#: What double precision may add to a distance of unit vectors.
SLACK = 1e-7
#: Different vector lengths of a table; each is grouped by itself, more raise.
LENGTHS = 1000


def clean(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Distinct usable vectors as (rep, copies, x): x is the vector's numbers in binary, in the column's own precision; rep is the smallest vec_id of the copies.

    Null vectors and those with null or non-finite components, or without length, are left out.
    """
    usable = vectors.where(F.col(vector).isNotNull() & F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))))
    kind = number_kind(vectors, vector)
    same = usable.where(F.exists(vector, lambda v: v != 0)).select("vec_id", F.col(vector).cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))
    same = same.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, copies, v = batch.columns
            out = [np.asarray(row.values.to_numpy(zero_copy_only=False), dtype=kind).tobytes() for row in v]
            yield pa.RecordBatch.from_arrays([rep, copies, pa.array(out, pa.binary())], names=["rep", "copies", "x"])

    return same.select("rep", "copies", "v").mapInArrow(run, f"rep {vectors.schema['vec_id'].dataType.simpleString()}, copies long, x binary")


def number_kind(vectors: DataFrame, vector: str) -> str:
    """Single precision travels as such, anything else as doubles."""
    return "<f4" if vectors.schema[vector].dataType.elementType.simpleString() == "float" else "<f8"


def units(raw: bytes, rows: int, kind: str) -> np.ndarray:
    """Rows as unit vectors in double precision; scaled first, so that squares neither vanish nor overflow."""
    m = np.frombuffer(raw, dtype=kind).reshape(rows, -1).astype(np.float64)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def principal(reps: DataFrame, leading: int, number: str) -> np.ndarray:
    """The leading principal axes (dimension x leading) of vectors of one dimension; partial sums come from the executors (dimension squared numbers each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column(0), number)
                part = np.concatenate((m.T @ m, m.sum(axis=0)[None], np.full((1, m.shape[1]), len(m))))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["k", "s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for s in batch.column(0):
                part = np.frombuffer(s.as_py())
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    sums = reps.select("x").mapInArrow(run, "k int, s binary")
    # partial sums meet in a few tasks before the driver adds those
    parts = [np.frombuffer(r["s"]) for r in sums.select("s").repartition(8).mapInArrow(add, "s binary").collect()]
    total = sum(parts)
    d = int((np.sqrt(1 + 4 * (len(total) + 1)) - 1) / 2)  # (d + 2) * d numbers
    while (d + 2) * d > len(total):
        d -= 1
    total = total.reshape(d + 2, d)
    n = total[-1, 0]
    mean = total[-2] / n
    _, axes = np.linalg.eigh(total[:d] / n - np.outer(mean, mean))
    return np.ascontiguousarray(axes[:, ::-1][:, : min(leading, d)])


def _matrix(column: pa.Array, number: str) -> np.ndarray:
    rows = [r.as_py() for r in column]
    return units(b"".join(rows), len(rows), number)


def blocks(reps: DataFrame, axes: np.ndarray, epsilon: float, number: str) -> tuple[DataFrame, int]:
    """Blocks (block, reps, copies, xs, low, high, centre, radius) in epsilon grid order, numbered from 0 without gaps, and how many there are."""
    kind = reps.schema["rep"].dataType.simpleString()
    k = axes.shape[1]
    cells = ", ".join(f"c{i} int" for i in range(k))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = np.floor(_matrix(batch.column(2), number) @ axes / epsilon).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c[:, i]) for i in range(k))], names=["rep", "copies", "x", *(f"c{i}" for i in range(k))])

    order = [f"c{i}" for i in range(k)] + ["rep"]
    placed = reps.select("rep", "copies", "x").mapInArrow(place, f"rep {kind}, copies long, x binary, {cells}")
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n, held = TaskContext.get().partitionId(), 0, []

        def block():
            whole = pa.Table.from_batches(held).combine_chunks()
            raw = b"".join(whole.column("x").to_pylist())
            m = units(raw, whole.num_rows, number)
            p, centre = m @ axes, m.mean(axis=0)
            radius = float(np.sqrt(((m - centre) ** 2).sum(axis=1)).max())
            return pa.RecordBatch.from_arrays(
                [pa.array([task], pa.int32()), pa.array([n], pa.int64()), pa.array([whole.column("rep").to_pylist()], pa.list_(whole.schema.field("rep").type)), pa.array([whole.column("copies").to_pylist()], pa.list_(pa.int64())), pa.array([raw]),
                 pa.array([p.min(axis=0).tolist()]), pa.array([p.max(axis=0).tolist()]), pa.array([centre.tolist()]), pa.array([radius])],
                names=["task", "n", "reps", "copies", "xs", "low", "high", "centre", "radius"])

        rows = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, BLOCK - rows)
                held.append(part)
                at, rows = at + part.num_rows, rows + part.num_rows
                if rows == BLOCK:
                    yield block()
                    n, held, rows = n + 1, [], 0
        if rows:
            yield block()

    schema = f"task int, n long, reps array<{kind}>, copies array<long>, xs binary, low array<double>, high array<double>, centre array<double>, radius double"
    cut, _ = written(ordered.mapInArrow(gather, schema), "ego-blocks")
    # a row for each range partition: where its blocks start in the sequence
    counts = sorted((r["task"], r["n"]) for r in cut.groupBy("task").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for task, n in counts:
        starts.append((task, total))
        total += n
    if not total:
        return cut.withColumn("block", F.lit(0).cast("long")).drop("task", "n"), 0
    first = cut.sparkSession.createDataFrame(starts, "s_task int, first long")
    # as many rows as range partitions
    return cut.join(F.broadcast(first), F.col("task") == F.col("s_task")).withColumn("block", F.col("first") + F.col("n")).drop("task", "s_task", "n", "first"), total


def _fold(xs, best):
    """Element by element over an array of arrays."""
    return F.aggregate(F.slice(xs, 2, F.size(xs)), F.get(xs, F.lit(0)), lambda a, x: F.zip_with(a, x, lambda p, q: best(p, q)))


def near_blocks(found: DataFrame, total: int, epsilon: float) -> DataFrame:
    """Pairs (i, j) of blocks, i <= j, that may hold vectors within epsilon, by recursion over intervals of FANOUT to the power of the level."""
    small = found.select("block", "low", "high", "centre", "radius")
    depth = 0
    while FANOUT**depth < total:
        depth += 1

    def intervals(level: int) -> DataFrame:
        """Boxes and balls of a level's intervals; an interval has at most FANOUT members, so its lists are short."""
        rows = small.select(F.col("block").alias("id"), "low", "high", "centre", "radius")
        for _ in range(level):
            up = rows.groupBy(F.floor(F.col("id") / FANOUT).alias("id")).agg(F.collect_list("low").alias("ls"), F.collect_list("high").alias("hs"), F.collect_list(F.struct("centre", "radius")).alias("bs"))
            centre = F.get(F.col("bs.centre"), F.lit(0))
            reach = F.array_max(F.transform("bs", lambda b: b["radius"] + _apart(b["centre"], F.get(F.col("bs.centre"), F.lit(0)))))
            rows = up.select("id", _fold(F.col("ls"), F.least).alias("low"), _fold(F.col("hs"), F.greatest).alias("high"), centre.alias("centre"), reach.alias("radius"))
        return rows

    spark = found.sparkSession
    pairs = spark.createDataFrame([(0, 0)], "i long, j long")
    for level in range(depth, -1, -1):
        if level < depth:
            i = F.explode(F.sequence(F.col("i") * FANOUT, F.col("i") * FANOUT + (FANOUT - 1)))
            j = F.explode(F.sequence(F.col("j") * FANOUT, F.col("j") * FANOUT + (FANOUT - 1)))
            pairs = pairs.select(i.alias("i"), "j").select("i", j.alias("j")).where("i <= j")
        boxes = intervals(level)
        a = boxes.select(*[F.col(c).alias(f"a_{c}") for c in boxes.columns])
        b = boxes.select(*[F.col(c).alias(f"b_{c}") for c in boxes.columns])
        gap = F.transform(F.arrays_zip("a_low", "a_high", "b_low", "b_high"), lambda z: F.greatest(z["a_low"] - z["b_high"], z["b_low"] - z["a_high"], F.lit(0.0)))
        far = F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g))
        ball = _apart(F.col("a_centre"), F.col("b_centre")) - F.col("a_radius") - F.col("b_radius")
        near = (F.greatest(far, ball) <= epsilon + SLACK) | (F.col("i") == F.col("j"))
        pairs = pairs.join(a, F.col("i") == F.col("a_id")).join(b, F.col("j") == F.col("b_id")).where(near).select("i", "j")
        pairs, _ = written(pairs, f"ego-level{level}")
    return pairs


def _apart(a, b):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def compare(x: np.ndarray, y: np.ndarray | None, cosine: float, slab: int = 256):
    """Number matrices aside: yields (row, column) index arrays of linked vectors, for slabs of rows; y None: within x, once for each pair."""
    other = x if y is None else y
    for at in range(0, len(x), slab):
        hit = x[at : at + slab] @ other.T >= cosine
        if y is None:
            hit &= np.arange(len(x))[None, :] > np.arange(at, min(at + slab, len(x)))[:, None]
        a, b = np.nonzero(hit)
        yield a + at, b


def block_links(found: DataFrame, pairs: DataFrame, cosine: float, number: str) -> DataFrame:
    """(vec, n, other): for each pair of blocks, each vector's partners (counting copies), and links of a spanning forest (n is 0 there)."""
    kind = found.schema["reps"].dataType.elementType.simpleString()
    a = found.select(*[F.col(c).alias(f"a_{c}") for c in ("block", "reps", "copies", "xs")])
    b = found.select(*[F.col(c).alias(f"b_{c}") for c in ("block", "reps", "copies", "xs")])
    rows = pairs.join(a, F.col("i") == F.col("a_block")).join(b, F.col("j") == F.col("b_block")).select("i", "j", "a_reps", "a_copies", "a_xs", "b_reps", "b_copies", "b_xs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                i, j, ra, ca, xa, rb, cb, xb = (batch.column(c)[k] for c in range(8))
                same = i.as_py() == j.as_py()
                ra, rb = ra.values, rb.values
                ca, cb = ca.values.to_numpy(), cb.values.to_numpy()
                x = units(xa.as_py(), len(ra), number)
                y = None if same else units(xb.as_py(), len(rb), number)
                na, nb = np.zeros(len(ra), np.int64), np.zeros(len(rb), np.int64)
                ends = []
                for p, q in compare(x, y, cosine):
                    na += np.bincount(p, cb[q], len(ra)).astype(np.int64)
                    nb += np.bincount(q, ca[p], len(rb)).astype(np.int64)
                    if len(p):
                        # a slab's links, then those kept so far with them: never more than there are vectors
                        s, t = spanning(p, q if same else q + len(ra))
                        ends.append((s, t))
                        if len(ends) > 8:
                            ends = [spanning(*(np.concatenate(z) for z in zip(*ends)))]
                ids = pa.concat_arrays([ra, rb])
                counts = np.concatenate((na + nb, np.zeros(len(rb), np.int64))) if same else np.concatenate((na, nb))
                who = np.flatnonzero(counts)
                s, t = spanning(*(np.concatenate(z) for z in zip(*ends))) if ends else (np.zeros(0, np.int64),) * 2
                vec = pa.concat_arrays([ids.take(pa.array(who)), ids.take(pa.array(s))])
                n = pa.array(np.concatenate((counts[who], np.zeros(len(s), np.int64))))
                other = pa.concat_arrays([pa.nulls(len(who), ids.type), ids.take(pa.array(t))])
                yield pa.RecordBatch.from_arrays([vec, n, other], names=["vec", "n", "other"])

    return rows.mapInArrow(run, f"vec {kind}, n long, other {kind}")


def grouped(vectors: DataFrame, cosine: float = 0.9, vector: str = "embedding") -> DataFrame:
    """Every row of ``vectors`` as vec_id, n_links, component_id and kept.

    Null, zero and unusable vectors (null or non-finite components) link with nothing, and vectors of different lengths don't link with each
    other. Equal vectors link. A repeated vec_id counts as a vector of its own in n_links. An empty table gives no rows. Other columns, labels
    among them, don't matter.
    """
    if not 0 < cosine <= 1:
        raise ValueError("the cosine must be above 0")
    epsilon = float(np.sqrt(2 - 2 * cosine)) + SLACK
    ids = vectors.select("vec_id", F.col(vector).cast("array<double>").alias("v"))
    reps, _ = written(clean(vectors, vector), "unit-vectors")
    sizes = [r["n"] for r in reps.select(F.octet_length("x").alias("n")).groupBy("n").count().orderBy("n").limit(LENGTHS + 1).collect()]
    if len(sizes) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} different lengths")
    number, links = number_kind(vectors, vector), None
    for size in sizes:  # the embedding's dimension; several only in a mixed table
        mine = reps.where(F.octet_length("x") == size)
        found, total = blocks(mine, principal(mine, LEADING, number), epsilon, number)
        found, _ = written(found, "ego-sequence")
        part = block_links(found, near_blocks(found, total, epsilon), cosine, number)
        links = part if links is None else links.union(part)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if links is None:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links, _ = written(links, "ego-links", PAIRS_AT_ONCE)  # rows of this step hold whole blocks
    counts = links.where("n > 0").groupBy(F.col("vec").alias("r")).agg(F.sum("n").alias("n"))
    found = components(links.where(F.col("other").isNotNull()).select(F.col("vec").alias("a"), F.col("other").alias("b")))
    known = reps.select("rep", "copies").join(counts, F.col("rep") == F.col("r"), "left").join(found, F.col("rep") == F.col("vertex"), "left")
    known = known.select("rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    # each row finds its class by its vector's digest: the classes are written, so that they are broadcast while they are small and a hot vector's rows
    # are split beyond that
    usable = clean_keys(ids).withColumn("d", F.sha2(F.array_join(F.transform("v", lambda x: (x + F.lit(0.0)).cast("string")), ",").cast("binary"), 256))
    classes = usable.where("usable").groupBy(F.col("d").alias("k")).agg(F.min("vec_id").alias("c"))
    classes, _ = written(classes.join(known, F.col("c") == F.col("rep"), "left").select("k", "n_links", "component_id"), "ego-classes")
    member = usable.where("usable").join(classes, F.col("d") == F.col("k"))
    member = member.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    alone = usable.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast(kind).alias("component_id"))
    return member.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def clean_keys(ids: DataFrame) -> DataFrame:
    """vec_id, v (an array of doubles) and whether it is usable: not null, all components finite, not all zero."""
    good = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0), F.lit(False))
    return ids.withColumn("usable", good)
