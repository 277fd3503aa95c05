"""Substring dedup on a de Bruijn graph of words.

Edges are the k-word windows of the documents (k the shortest repeat, 50). Each window lies in the bucket of its minimizer (its smallest
ANCHOR-word hash, leftmost on ties); a document's consecutive windows in one bucket are one row (a super-k-mer), known by its words' digest.
Equal rows collapse in an aggregate; those whose minimizer occurs in one document only are dropped. What repeats is compacted by Spark joins: a
path P has the successor Q joined to it where P has no other successor, and Q as many occurrences as P, so that Q has no other predecessor; joined
paths are one nonbranching path (a unitig) wherever they occur. Where several paths share a minimizer the graph may branch inside a bucket, and
only these are expanded into single windows. Source coordinates (document, place, length) of the smallest document verify each long span: the
words there and the words at the occurrence must have the same 128-bit BLAKE2 digest, and single windows are compared by that digest of their words.

Exactness: equal windows have equal minimizers at equal places, so none is missed. A span that isn't verified stays.

Scale: a row per path, about one for 22 windows. Frequent passages only make frequent join keys, on the side that Spark splits beside a written
table; a document's rows come together, no group of documents ever does. Written tables cut the lineage; shuffle files of finished steps are released.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .storage import release, remove, written

ANCHOR = 8
DOCS_AT_ONCE = 400
#: Words whose hashes a worker keeps.
KEPT_WORDS = 400_000

_P1, _P2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_INV1, _INV2 = pow(_P1, -1, 1 << 64), pow(_P2, -1, 1 << 64)


class _Words(dict):
    """Hash of a word, kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, 1)
        return found


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(p: int, n: int) -> np.ndarray:
    out = np.full(n, p, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Digests:
    """128-bit digests of runs of words in one sequence of word hashes: sums of hash * p**place, made independent of the place."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes) + 1
        zero = np.zeros(1, dtype=np.uint64)
        self.sums = [np.concatenate((zero, np.cumsum(h * _powers(p, n)[:-1], dtype=np.uint64))) for h, p in ((hashes, _P1), (_mix(hashes), _P2))]
        self.back = [_powers(p, n) for p in (_INV1, _INV2)]

    def of(self, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = (stop - start).astype(np.uint64)
        return tuple(_mix((s[stop] - s[start]) * b[start] + n).view(np.int64) for s, b in zip(self.sums, self.back))


def _sequence(raws: list[bytes], words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words in one sequence, and where each text's begin (and the last ends)."""
    parts = [r.split() for r in raws]
    cuts = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    hashes = np.fromiter((words[w] for p in parts for w in p), dtype=np.uint64, count=int(cuts[-1]))
    return hashes, cuts


def _minimizers(hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """For the window at each place, its smallest anchor's value and place (leftmost on ties). Windows may reach over texts' ends."""
    value, p, n = hashes, _P1, 1
    while n < anchor:  # a power of two
        value = value[:-n] * np.uint64(p) + value[n:]
        p, n = p * p % (1 << 64), 2 * n
    value = _mix(value)
    place = np.arange(len(value), dtype=np.int32)

    def left_or(v, at, u, bt):
        first = v <= u
        return np.where(first, v, u), np.where(first, at, bt)

    span, n = window - anchor + 1, 1
    while 2 * n <= span:
        value, place = left_or(value[:-n], place[:-n], value[n:], place[n:])
        n *= 2
    if n < span:
        k = span - n
        value, place = left_or(value[:-k], place[:-k], value[k:], place[k:])
    return value, place


def paths_of(raws: list[bytes], window: int, anchor: int, words: _Words) -> tuple[np.ndarray, ...]:
    """Of each text's windows the paths by minimizer: (text, first window, windows, minimizer, digest 1, digest 2)."""
    hashes, cuts = _sequence(raws, words)
    none = np.zeros(0, dtype=np.int64)
    if len(hashes) < window:
        return (none,) * 6
    value, place = _minimizers(hashes, window, anchor)
    owner = np.repeat(np.arange(len(raws)), np.diff(cuts))[: len(value)]
    inside = np.arange(len(value)) + window <= cuts[owner + 1]
    at = np.flatnonzero(inside)
    if not len(at):
        return (none,) * 6
    new = np.ones(len(at), dtype=bool)
    new[1:] = (place[at[1:]] != place[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(np.concatenate((first, [len(at)])))
    start = at[first]
    d1, d2 = Digests(hashes).of(start, start + n + window - 1)
    text = owner[start]
    return text, start - cuts[text], n, value[start].view(np.int64), d1, d2


def paths(docs: DataFrame, window: int, anchor: int, text: str) -> DataFrame:
    """A row for each path of each document, with the digests of the next one (s1, s2; null behind the last); rows without doc_id have none."""
    source = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64(text).alias("key"), F.col(text).cast("binary").alias("__text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for whole in batches:
            for at in range(0, whole.num_rows, DOCS_AT_ONCE):
                batch = whole.slice(at, DOCS_AT_ONCE)
                ids, keys, texts = batch.columns
                i, a, n, h, d1, d2 = paths_of([t.as_py() or b"" for t in texts], window, anchor, words)
                last = np.append(i[1:] != i[:-1], True)[: len(i)]
                after = [pa.array(np.roll(d, -1), mask=last) for d in (d1, d2)]
                i = pa.array(i)
                cols = [ids.take(i), keys.take(i), pa.array(a, pa.int32()), pa.array(n, pa.int32()), pa.array(h), pa.array(d1), pa.array(d2), *after]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "a", "n", "h", "d1", "d2", "s1", "s2"])

    return source.mapInArrow(run, f"doc_id {kind}, key long, a int, n int, h long, d1 long, d2 long, s1 long, s2 long")


class Spans:
    """The words of a text, and digests of runs of them as they stand, one blank between."""

    def __init__(self, words: list[bytes]):
        self.line = b" ".join(words)
        self.at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1))).tolist()

    def digest(self, start: int, stop: int) -> bytes:
        return blake2b(self.line[self.at[start] : self.at[stop] - 1], digest_size=16).digest()


def continued(found: DataFrame) -> DataFrame:
    """(c1, c2) of paths that continue their only predecessor: it has no other successor and as many occurrences."""
    nodes = found.where("again").groupBy("d1", "d2").agg(F.count("*").alias("n"), F.count("s1").alias("followed"), F.min(F.struct("s1", "s2")).alias("s"), F.max(F.struct("s1", "s2")).alias("t"))
    before = nodes.where((F.col("followed") == F.col("n")) & (F.col("s") == F.col("t"))).select(F.col("s.s1").alias("c1"), F.col("s.s2").alias("c2"), F.col("n").alias("c"))
    return before.join(nodes, (F.col("c1") == F.col("d1")) & (F.col("c2") == F.col("d2")) & (F.col("c") == F.col("n"))).select("c1", "c2").distinct()


def unitigs(found: DataFrame, after: DataFrame) -> DataFrame:
    """Occurrences (doc_id, key, a, n, d1, d2, m) of compacted paths: the first path's digests, all their windows; ``after`` are the paths that continue another."""
    kind = found.schema["doc_id"].dataType.simpleString()
    flagged = found.where("again").join(after, (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")), "left")
    lists = flagged.groupBy("doc_id", "key").agg(F.collect_set(F.struct("a", "n", "d1", "d2", "m", F.col("c1").isNull().alias("head"))).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, lists = batch.columns
            w = lists.flatten()
            if not len(w):
                continue
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            a, n, head = w.field("a").to_numpy(), w.field("n").to_numpy(), w.field("head").to_numpy(zero_copy_only=False)
            order = np.lexsort((a, owner))
            a, n, head, owner = a[order], n[order], head[order], owner[order]
            head[0] = True
            head[1:] |= (owner[1:] != owner[:-1]) | (a[1:] != a[:-1] + n[:-1])
            first = np.flatnonzero(head)
            at, i = pa.array(order[first]), pa.array(owner[first])
            cols = [ids.take(i), keys.take(i), pa.array(a[first]), pa.array(np.add.reduceat(n, first).astype(np.int32)), *(w.field(c).take(at) for c in ("d1", "d2", "m"))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "a", "n", "d1", "d2", "m"])

    return lists.mapInArrow(run, f"doc_id {kind}, key long, a int, n int, d1 long, d2 long, m {kind}")


def _windows(docs: DataFrame, wanted: DataFrame, window: int, text: str) -> DataFrame:
    """Digests of words at source coordinates (doc_id, key, list of (a, n, m, d1, d2, whole)): (w, j, m, d1, d2), one for each window j of a path, or one (j is -1) for a whole one."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("i"), F.xxhash64(text).alias("k"), F.col(text).cast("binary").alias("__text"))
    rows = source.join(wanted.hint("shuffle_hash"), (F.col("i") == F.col("doc_id")) & (F.col("k") == F.col("key"))).select("__text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, list_ in zip(*batch.columns, strict=True):
                w, spans = list_.values, Spans(raw.as_py().split())
                a, whole = w.field("a").to_numpy(), w.field("whole").to_numpy(zero_copy_only=False)
                n = w.field("n").to_numpy()
                each = np.where(whole, 1, n)
                own = np.repeat(np.arange(len(a)), each)
                j = np.arange(len(own)) - np.repeat(np.cumsum(each) - each, each)
                start = a[own].astype(np.int64) + j
                stop = start + window + np.where(whole, n - 1, 0)[own]
                found = [spans.digest(x, y) for x, y in zip(start.tolist(), stop.tolist())]
                at = pa.array(own)
                cols = [pa.array(found, pa.binary()), pa.array(np.where(whole[own], -1, j), pa.int32()), *(w.field(c).take(at) for c in ("m", "d1", "d2"))]
                yield pa.RecordBatch.from_arrays(cols, names=["w", "j", "m", "d1", "d2"])

    return rows.mapInArrow(run, f"w binary, j int, m {kind}, d1 long, d2 long")


def repeats(docs: DataFrame, window: int = 50, anchor: int = ANCHOR, text: str = "text") -> DataFrame:
    """(doc_id, key, spans): runs of words [start, stop) covered by windows that also start in a document with a smaller doc_id; key is the text's hash.

    A span's ``source`` is the digest of the words at its source coordinates, null where its windows were compared one by one.
    """
    spark = docs.sparkSession
    path = ["h", "d1", "d2"]
    rows, at_rows = written(paths(docs, window, anchor, text), "paths")
    classes = rows.groupBy(*path).agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("last"))
    shared = classes.groupBy(F.col("h").alias("h_")).agg(F.min("m").alias("least"), F.max("last").alias("most"), F.count("*").alias("paths")).where("least < most")
    repeated, at_repeated = written(classes.join(shared, F.col("h") == F.col("h_")).select(*path, "m", (F.col("m") < F.col("last")).alias("again"), (F.col("paths") > 1).alias("branching")), "repeated-paths")
    del classes, shared
    release(spark)
    known = repeated.select(*[F.col(c).alias(f"{c}_") for c in path], "m", "again", "branching")
    match = (F.col("h") == F.col("h_")) & (F.col("d1") == F.col("d1_")) & (F.col("d2") == F.col("d2_"))
    # occurrences: repeated paths, and of branching ones the earliest document's
    found, at_found = written(rows.join(known, match).select("doc_id", "key", "a", "n", "d1", "d2", "s1", "s2", "m", "again", "branching"), "occurrences")
    del known, repeated
    remove(spark, at_rows, at_repeated)
    release(spark)
    after, at_after = written(continued(found), "continued")
    long, at_long = written(unitigs(found, after), "unitigs")
    del after
    release(spark)
    first = found.where("doc_id = m AND branching")
    inside = first.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "key", "a", "n")).alias("s")).select("s.*", "d1", "d2", F.lit(False).alias("whole"))
    sources = long.where("doc_id = m").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "key", "a", "n")).alias("s")).select("s.*", "d1", "d2", F.lit(True).alias("whole"))
    wanted = inside.union(sources).groupBy("doc_id", "key").agg(F.collect_list(F.struct("a", "n", F.col("doc_id").alias("m"), "d1", "d2", "whole")).alias("wanted"))
    digests, at_digests = written(_windows(docs, wanted, window, text), "windows")
    del inside, sources, wanted
    release(spark)
    single = digests.where("j >= 0")
    earliest = single.groupBy(F.col("w").alias("v")).agg(F.min("m").alias("least"), F.max("m").alias("most")).where("least < most").select("v", "least")
    later = single.join(earliest, F.col("w") == F.col("v")).where("m > least")
    # both are written, so that Spark knows their size before it deals the frequent side by digest, and splits that side where it must
    later, at_later = written(later.groupBy(F.col("d1").alias("e1"), F.col("d2").alias("e2")).agg(F.collect_set("j").alias("js")), "later-windows")  # at most window - anchor + 1 places
    source, at_source = written(digests.where("j = -1").select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.col("w").alias("source")), "sources")
    part = first.join(later, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2"))).select(
        "doc_id", "key", F.explode(F.transform("js", lambda j: F.struct((F.col("a") + j).alias("start"), (F.col("a") + j + window).alias("stop"), F.lit(None).cast("binary").alias("source")))).alias("span")
    )
    whole = long.where("doc_id > m").join(source, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")))
    whole = whole.select("doc_id", "key", F.struct(F.col("a").alias("start"), (F.col("a") + F.col("n") + (window - 1)).alias("stop"), "source").alias("span"))
    spans, _ = written(whole.union(part).groupBy("doc_id", "key").agg(F.collect_list("span").alias("spans")), "spans")
    del first, later, part, whole, single, digests, source, found, long, earliest
    remove(spark, at_found, at_after, at_long, at_digests, at_later, at_source)
    release(spark)
    return spans


def deduplicated(docs: DataFrame, window: int = 50, anchor: int = ANCHOR, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns but the text where None) with n_words, n_removed and kept (the kept words, one blank between).

    Words are runs of anything but ASCII white space, compared as they are. A null or empty text has no words; texts shorter than a window stay whole.
    "Smaller" compares doc_ids: rows with the same doc_id never remove each other's words; a row without doc_id neither removes nor loses any.
    Repeats inside one document stay. An empty table gives no rows.
    """
    if anchor & (anchor - 1) or not 0 < anchor <= window:
        raise ValueError("anchor must be a power of two, at most the window")
    own = ["n_words", "n_removed", "kept"]
    kept = [c for c in docs.columns if c != text and c not in own] if keep is None else keep
    spans = repeats(docs, window, anchor, text).select(F.col("doc_id").alias("__i"), F.col("key").alias("__k"), "spans")
    # the kept columns travel as one, so their names can't clash with any other
    rows = docs.select(F.struct(F.lit(0).alias("__"), *kept).alias("row"), F.col("doc_id").alias("__id"), F.xxhash64(text).alias("__key"), F.col(text).cast("binary").alias("__text"))
    # the hash table holds spans, the texts stream past it unsorted
    rows = rows.join(spans.hint("shuffle_hash"), (F.col("__id") == F.col("__i")) & (F.col("__key") == F.col("__k")), "left").select("row", "__text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, texts, lists = batch.columns
            n, gone, out = [], [], []
            for raw, spans_ in zip(texts, lists, strict=True):
                words = (raw.as_py() or b"").split()
                total = len(words)
                if spans_.is_valid:
                    start, stop = spans_.values.field("start").to_numpy(), spans_.values.field("stop").to_numpy()
                    line, source = Spans(words), spans_.values.field("source").to_pylist()
                    same = np.array([d is None or line.digest(x, y) == d for x, y, d in zip(start.tolist(), stop.tolist(), source)], dtype=bool)
                    start, stop = start[same], stop[same]
                    cover = np.bincount(start, minlength=total + 1)[: total + 1] - np.bincount(stop, minlength=total + 1)[: total + 1]
                    stay = np.cumsum(cover)[:total] == 0
                    words = [w for w, s in zip(words, stay.tolist()) if s]
                n.append(total)
                gone.append(total - len(words))
                out.append(b" ".join(words))
            cols = [row, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["row", *own])

    found = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, n_words long, n_removed long, kept binary")
    return found.select(*[F.col("row")[c].alias(c) for c in kept], "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))
