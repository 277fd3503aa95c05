"""SimHash near-duplicates through pivot distance tables.

Fingerprints that differ in at most ``distance`` bits have, to every reference fingerprint (pivot), Hamming distances that differ by at most
``distance``. Two kinds of tables use it. A candidate table holds distances restricted to the bits of some blocks: as no two blocks
more than ``distance`` can be touched, linked fingerprints have exactly equal restricted distances in one of the tables, so candidates come from
equi-joins. Candidates whose unrestricted distances differ by more than ``distance`` in any coordinate are discarded; survivors are verified.

Scale: documents with equal fingerprints are one row. A candidate bucket above ``BUCKET`` fingerprints is refined: the bits that its table leaves
free are cut into blocks in turn, and its members go to the finer tables of these, whose keys again are equal for linked ones. So every pair is
found, discarded or verified in the same way, a bucket's members meet BUCKET others at most, and after three levels the eight free bits
bound a bucket by themselves. The cost is linear in the fingerprints; hot copies and hot buckets never give a quadratic number of pairs.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .components import components, spanning
from .storage import forget, release, remove, trimmed, written

SEED = 42
BITS, BLOCKS = 64, 4
#: Fingerprints that a bucket has at most before it is refined, and the free bits at which it isn't any more.
BUCKET, FREE = 32, 8
#: Pivots of a candidate table (their restricted distances are its key) and of the filter.
TABLE_PIVOTS, FILTER_PIVOTS = 20, 16

_ASCII_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
#: Each byte's bits, as eight byte-wide counters; the lowest byte counts the lowest bit.
_SPREAD = np.array([sum(((v >> i) & 1) << (8 * i) for i in range(8)) for v in range(256)], dtype="<u8")
_CHUNK = 255


def pivots(n: int, seed: int) -> list[int]:
    draw = random.Random(seed)
    return [draw.getrandbits(BITS) for _ in range(n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints_of(texts: list[bytes], width: int) -> np.ndarray:
    """Of lower-cased UTF-8 texts: a bit is set if it is set in over half the hashes of the word shingles."""
    xx = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), dtype="<u8")
    for i, raw in enumerate(texts):
        words = raw.translate(_ASCII_LOWER).split()
        if not words:
            continue
        if len(words) <= width:
            out[i] = xx(b" ".join(words), SEED)
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        starts = np.concatenate(([0], ends[:-width])).tolist()
        hashes = np.array([xx(line[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())], dtype="<u8")
        lanes = _SPREAD[hashes.view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(lanes, np.arange(0, len(hashes), _CHUNK), axis=0)  # at most 255 in a counter
        counts = np.ascontiguousarray(sums).view(np.uint8).reshape(len(sums), BITS).sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, keep: list[str], width: int = 3, text: str = "text") -> DataFrame:
    """``keep`` and fp, the fingerprint as a signed 64-bit number; 0 for a null text or one without words."""
    source = docs.select(*keep, F.col(text).cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *rest, raw = batch.columns
            fp = fingerprints_of([x.as_py() or b"" for x in raw], width)
            yield pa.RecordBatch.from_arrays([*rest, pa.array(fp.view("<i8"))], names=[*keep, "fp"])

    return source.mapInArrow(run, f"{source.drop('__text').schema.simpleString()[7:-1]}, fp long")


def _distance(fp: Column, pivot: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(_signed(pivot))))


def _tables(mask: int, distance: int) -> list[int]:
    """Masks: the bits of ``mask`` and every choice of BLOCKS - distance of the blocks that the other bits are cut into."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    size = len(free) // BLOCKS
    blocks = [sum(1 << i for i in free[size * b : size * (b + 1)]) for b in range(BLOCKS)]
    return [mask | sum(chosen) for chosen in combinations(blocks, BLOCKS - distance)]


def _restricted(rows: DataFrame) -> DataFrame:
    """Rows (fp, mask) with the key of fp in the mask's table: distances to TABLE_PIVOTS pivots restricted to the mask, six bits each, ten to a number."""
    ds = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p))).bitwiseAND(F.col("mask"))).cast("long") for p in pivots(TABLE_PIVOTS, 100)]
    packed = [sum((F.shiftleft(d, 6 * i) for i, d in enumerate(ds[a : a + 10])), F.lit(0).cast("long")) for a in range(0, TABLE_PIVOTS, 10)]
    return rows.select("fp", "mask", *[x.alias(f"k{i}") for i, x in enumerate(packed)])


def linked(prints: DataFrame, distance: int = 2) -> DataFrame:
    """Edges (a, b) between all distinct fingerprints (column fp) that differ in at most ``distance`` bits, a < b; an edge may occur twice."""
    if distance not in (1, 2):
        raise ValueError("the distance must be 1 or 2")
    spark = prints.sparkSession
    key = ["mask", *[f"k{i}" for i in range(TABLE_PIVOTS // 10)]]
    masks, out, last = _tables(0, distance), None, None
    rows = prints.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    while True:
        rows, free = _restricted(rows), BITS - masks[0].bit_count()
        # written before the join, so that a hot bucket's rows are split there
        sizes, at_sizes = written(rows.groupBy(*[F.col(c).alias(f"s_{c}") for c in key]).agg(F.count("*").alias("n")).where("n > 1"), "simhash-sizes")
        same = F.lit(True)
        for c in key:
            same = same & (F.col(c) == F.col(f"s_{c}"))
        shared, at_shared = written(rows.join(sizes, same).select("fp", *key, "n"), "simhash-buckets")
        remove(spark, at_sizes, *([last] if last else []))
        small = shared if free <= FREE else shared.where(F.col("n") <= BUCKET)
        left, right = (small.select(F.col("fp").alias(c), *key) for c in "ab")
        near = left.join(right, key).where("a < b")
        for p in pivots(FILTER_PIVOTS, 7):  # the maximum coordinate difference
            near = near.where(F.abs(_distance(F.col("a"), p) - _distance(F.col("b"), p)) <= distance)
        near, _ = written(near.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b"), "simhash-edges")
        out, last = near if out is None else out.union(near), at_shared
        big = shared.where(F.col("n") > BUCKET)
        if free <= FREE or big.isEmpty():
            break
        # a row for each table, 216 at most
        finer = spark.createDataFrame([(_signed(m), _signed(f)) for m in masks for f in _tables(m, distance)], "m long, finer long")
        rows = big.join(F.broadcast(finer), F.col("mask") == F.col("m")).select("fp", F.col("finer").alias("mask")).distinct()
        masks = [f for m in masks for f in _tables(m, distance)]
    remove(spark, last)
    return out


def grouped(docs: DataFrame, width: int = 3, distance: int = 2, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (doc_id where None) with fp and component_id, the smallest doc_id reachable over fingerprints that differ in at most ``distance`` bits.

    Null and empty texts have fingerprint 0 and are linked like any other; fewer words than ``width`` count as one shingle. Rows with equal
    fingerprints (copies, repeated rows) are in one group without any pair being made of them. A null doc_id gets its group's component, but
    names none unless the group has no other. An empty table gives no rows.
    """
    kept = keep or ["doc_id"]
    prints, _ = written(fingerprints(docs, kept, width, text), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    reps, _ = written(distinct, "fingerprint-classes")
    found = components(linked(reps.select("fp"), distance))
    # per fingerprint its component, and per component the smallest doc_id
    named = reps.join(found, reps["fp"] == found["vertex"], "left").withColumn("root", F.coalesce("component", "fp"))
    least = named.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    member = named.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    return prints.join(member, F.col("fp") == F.col("f")).drop("f")


# Near copies at a similarity of 0.8: candidates are, first, what the pivot tables link among the 64-bit fingerprints of the sets. At that similarity
# many more bits may differ, so that differences of pivot distances exclude nothing and no table's key stays equal; so candidates are, second,
# documents that share one of their SMALLEST least shingle hashes; there the fingerprint is longer (SIGNATURES numbers), and members of a candidate
# group are compared block by block. Fingerprints only filter, with a limit LOOSE deviations above the mean: what either way gives is verified by
# the Jaccard similarity of the sets of shingle hashes. A block has about MEMBERS rows and HASHES hashes.
SIGNATURES, SMALLEST, MEMBERS, LOOSE, HASHES = 4, 4, 512, 6, 1 << 18


def differing_bits(similarity: float) -> int:
    """Of SIGNATURES * 64 bits, those that differ on average between two sets of shingles with this Jaccard similarity, and LOOSE deviations."""
    n, angle = SIGNATURES * BITS, np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(n * angle + LOOSE * np.sqrt(n * angle * (1 - angle)))


def _rehash(x: np.ndarray, k: int) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles_of(raw: bytes, width: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, ascending; one zero for a text without words."""
    words = raw.translate(_ASCII_LOWER).split()
    if not words:
        return np.zeros(1, dtype="<u8")
    line, n = b" ".join(words), min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:-n])).tolist()
    return np.unique(np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist())], dtype="<u8"))


def digest_of(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def signature_of(hashes: np.ndarray) -> list[int]:
    """The long fingerprint of a set of shingle hashes; zeros for that of a text without words."""
    if len(hashes) == 1 and not hashes[0]:
        return [0] * SIGNATURES
    out = []
    for k in range(SIGNATURES):
        lanes = _SPREAD[_rehash(hashes, k).view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(lanes, np.arange(0, len(hashes), _CHUNK), axis=0)
        counts = np.ascontiguousarray(sums).view(np.uint8).reshape(len(sums), BITS).sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0]))
    return out


def near_pairs(a: np.ndarray, b: np.ndarray | None, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows (SIGNATURES numbers each) that differ in at most ``limit`` bits; b None: within a, once for each pair."""
    other = a if b is None else b
    apart = np.zeros((len(a), len(other)), dtype=np.uint16)
    for k in range(a.shape[1]):
        apart += np.bitwise_count(a[:, None, k] ^ other[None, :, k])
    hit = apart <= limit
    return np.nonzero(np.triu(hit, 1) if b is None else hit)


def similar_sets(sets: list[np.ndarray], prints: np.ndarray, first: int, similarity: float, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between sets whose Jaccard similarity is at least ``similarity``, enough to join all that such pairs connect.

    Pairs have one end among the ``first`` sets and the other behind them, or both among all where ``first`` is the number of sets. Those that
    differ in more than ``limit`` bits of their prints aren't compared, nor are pairs that former links connect already.
    """
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark, label, left, right = np.zeros(codes.max() + 1, dtype=bool), np.arange(len(sets)), [], []
    for i in range(first):
        js = np.arange(i + 1 if first == len(sets) else first, len(sets))
        js = js[label[js] != label[i]]
        js = js[np.minimum(sizes[js], sizes[i]) >= similarity * np.maximum(sizes[js], sizes[i]) - 1e-9]
        js = js[np.bitwise_count(prints[js] ^ prints[i]).sum(axis=1, dtype=np.int64) <= limit]
        if not len(js):
            continue
        own = codes[starts[i] : ends[i]]
        mark[own] = True
        found = mark[np.concatenate([codes[starts[j] : ends[j]] for j in js])]
        mark[own] = False
        common = np.add.reduceat(found, np.cumsum(sizes[js]) - sizes[js], dtype=np.int64)
        for j in js[common >= similarity * (sizes[js] + sizes[i] - common) - 1e-9]:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                left.append(i)
                right.append(j)
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def _block_pairs(blocks: DataFrame, group: str, lists: dict[str, str]) -> DataFrame:
    """Of a table of blocks (of a group, numbered): every pair of one group, the second's columns with _b and null where a block meets itself."""
    a = blocks.select(F.col(group).alias("k"), F.col("block").alias("i"), *[F.col(c).alias(f"{c}_a") for c in lists], F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j"))
    b = blocks.select(F.col(group).alias("l"), F.col("block").alias("m"), *[F.col(c).alias(f"{c}_b") for c in lists])
    alone = a.where("i = j").select(*[f"{c}_a" for c in lists], *[F.lit(None).cast(t).alias(f"{c}_b") for c, t in lists.items()])
    two = a.where("i < j").join(b, (F.col("k") == F.col("l")) & (F.col("j") == F.col("m"))).select(*[f"{c}_a" for c in lists], *[f"{c}_b" for c in lists])
    return alone.union(two)


def _similar(docs: DataFrame, reps: DataFrame, links: DataFrame, width: int, similarity: float, text: str) -> DataFrame:
    """Links (a, b) between classes of ``reps`` that have the similarity. Only what ``links`` connect is compared, block by block, on sets of its texts."""
    spark, limit = docs.sparkSession, differing_bits(similarity)
    kind = docs.schema["doc_id"].dataType.simpleString()
    loose = components(links).select("vertex", F.col("component").alias("loose"))
    members = reps.join(loose, F.col("id") == F.col("vertex")).select("id", "digest", "n", "loose")
    sizes = members.groupBy(F.col("loose").alias("l")).agg(F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("n") / HASHES)).alias("blocks"))
    placed = members.join(sizes, F.col("loose") == F.col("l")).withColumn("block", F.pmod(F.xxhash64("id", "digest", F.lit(5)), "blocks"))
    placed, at_placed = written(placed.select("id", "digest", "loose", "blocks", "block"), "near-members")
    texts = docs.select("doc_id", F.col(text).cast("binary").alias("__text")).where("doc_id IS NOT NULL")
    # the hash table holds ids, the texts stream past it; repeated rows count once
    rows = texts.join(placed.hint("shuffle_hash"), F.col("doc_id") == F.col("id")).withColumn("hash", F.xxhash64("__text")).dropDuplicates(["doc_id", "digest", "hash"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, digests, *rest = batch.columns
            found = [shingles_of(x.as_py() or b"", width) for x in raw]
            own = pa.array([digest_of(x) == d.as_py() for x, d in zip(found, digests)], pa.bool_())  # a doc_id may have other texts
            out = [*rest, pa.array([signature_of(x) for x in found], pa.list_(pa.int64())), pa.array([x.view("<i8") for x in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, names=["id", "loose", "blocks", "block", "fp", "hashes"]).filter(own)

    found = rows.select("__text", "digest", "id", "loose", "blocks", "block").mapInArrow(sets, f"id {kind}, loose {kind}, blocks long, block long, fp array<long>, hashes array<long>")
    lists = {"ids": f"array<{kind}>", "fps": "array<long>", "sizes": "array<int>", "sets": "array<long>"}
    # about MEMBERS rows and HASHES hashes
    collected = [F.collect_list("id"), F.flatten(F.collect_list("fp")), F.collect_list(F.size("hashes")), F.flatten(F.collect_list("hashes"))]
    blocks, at_blocks = written(found.groupBy("loose", "block", "blocks").agg(*[x.alias(c) for x, c in zip(collected, lists)]), "near-blocks")
    remove(spark, at_placed)
    release(spark)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for row in zip(*batch.columns, strict=True):
                sides = [row[:4], row[4:]] if row[4].is_valid else [row[:4]]
                ids = pa.concat_arrays([x[0].values for x in sides])
                prints = np.concatenate([x[1].values.to_numpy() for x in sides]).view(np.uint64).reshape(-1, SIGNATURES)
                ends = np.cumsum(np.concatenate([x[2].values.to_numpy() for x in sides]))
                parts = np.split(np.concatenate([x[3].values.to_numpy() for x in sides]), ends[:-1])
                x, y = similar_sets(parts, prints, len(row[0].values), similarity, limit)
                left.append(ids.take(pa.array(x)))
                right.append(ids.take(pa.array(y)))
            if left:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(left), pa.concat_arrays(right)], names=["a", "b"])
        trimmed()

    out, _ = written(_block_pairs(blocks, "loose", lists).mapInArrow(compare, f"a {kind}, b {kind}"), "near-links", batch_rows=16)
    remove(spark, at_blocks)
    return out


def _pivot_links(reps: DataFrame) -> DataFrame:
    """Links (a, b) between classes whose 64-bit fingerprints, the first number of their signatures, the pivot tables link; equal ones join their least."""
    prints = reps.select("id", F.col("fp")[0].alias("fp"))
    # written, so that a hot fingerprint's rows are split beside it
    least, _ = written(prints.groupBy(F.col("fp").alias("f")).agg(F.min("id").alias("least")), "near-fingerprints")
    equal = prints.join(least, F.col("fp") == F.col("f")).where("id != least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    left, right = (least.select(F.col("f").alias(f"f{c}"), F.col("least").alias(f"n{c}")) for c in "ab")
    near = linked(least.select(F.col("f").alias("fp"))).join(left, F.col("a") == F.col("fa")).join(right, F.col("b") == F.col("fb"))
    return equal.union(near.select(F.col("na").alias("a"), F.col("nb").alias("b")))


def near_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): near copies of a similarity of word shingles share a component_id, their smallest doc_id; fp is their signature.

    Null and empty texts are copies of each other. Texts with fewer words than ``width`` are one shingle. Equal sets of shingles (copies) are one
    member however many they are. Candidates come from the pivot tables and from shared least hashes; a candidate group of the latter is cut into
    blocks of about MEMBERS, pairs of blocks are compared by tasks of their own, and each gives no more links than it has members. What
    candidates connect loosely is then compared by the sets themselves, in such blocks too; only pairs of at least the similarity link. An empty
    table gives no rows.
    """
    limit = differing_bits(similarity)
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.col(text).cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            ids, raw = batch.columns
            found = [(signature_of(x), x[:SMALLEST].view("<i8").tolist(), digest_of(x), len(x)) for x in (shingles_of(x.as_py() or b"", width) for x in raw)]
            kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int32()]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([x[i] for x in found], t) for i, t in enumerate(kinds)]], names=["doc_id", "fp", "keys", "digest", "n"])

    prints, _ = written(source.mapInArrow(run, f"doc_id {kind}, fp array<long>, keys array<long>, digest binary, n int"), "signatures")
    classes = prints.groupBy("digest").agg(F.min("doc_id").alias("id"), F.min("fp").alias("fp"), F.min("keys").alias("keys"), F.min("n").alias("n"))
    reps, _ = written(classes.where("id IS NOT NULL"), "signature-classes")
    rows = reps.select("id", "fp", F.explode("keys").alias("key"))
    sizes = rows.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / MEMBERS))
    placed = rows.join(sizes, F.col("key") == F.col("k")).withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), "blocks"))
    # about MEMBERS rows, by hash
    blocks, _ = written(placed.groupBy("key", "block", "blocks").agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("fp")).alias("fps")), "signature-blocks")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for ia, fa, ib, fb in zip(*batch.columns, strict=True):
                first = fa.values.to_numpy().view(np.uint64).reshape(-1, SIGNATURES)
                second = fb.values.to_numpy().view(np.uint64).reshape(-1, SIGNATURES) if fb.is_valid else None
                x, y = near_pairs(first, second, limit)
                if len(x):
                    ids = pa.concat_arrays([ia.values, ib.values]) if fb.is_valid else ia.values
                    x, y = spanning(x, y + len(first) if fb.is_valid else y)
                    left.append(ids.take(pa.array(x)))
                    right.append(ids.take(pa.array(y)))
            if left:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(left), pa.concat_arrays(right)], names=["a", "b"])
        trimmed()

    links = _block_pairs(blocks, "key", {"ids": f"array<{kind}>", "fps": "array<long>"}).mapInArrow(compare, f"a {kind}, b {kind}")
    found = components(_similar(docs, reps, links.union(_pivot_links(reps)), width, similarity, text))
    member = reps.join(found, reps["id"] == found["vertex"], "left").select(F.col("digest").alias("d"), F.coalesce("component", "id").alias("component_id"))
    return prints.select("doc_id", "fp", "digest").join(member, F.col("digest") == F.col("d"), "left").drop("d", "digest")


def deduplicated(docs: DataFrame, width: int = 5, similarity: float = 0.8, text: str = "text") -> DataFrame:
    """The documents of which each group of near_groups keeps one: that with the smallest doc_id (repeated rows of it as one). Columns are those of ``docs``.

    Rows without doc_id aren't compared with others; of equal texts among them one stays.
    """
    groups = near_groups(docs, width, similarity, text)
    keys = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("id")).distinct()
    # the documents' columns travel as one, so their names can't clash with any other
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64(text)).alias("hash"))
    # the hash table holds ids, the texts stream past it
    kept = rows.where("doc_id IS NOT NULL").join(keys.hint("shuffle_hash"), F.col("doc_id") == F.col("id"), "left_semi")
    return kept.union(rows.where("doc_id IS NULL")).dropDuplicates(["doc_id", "hash"]).select("row.*")
