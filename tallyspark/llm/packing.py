"""Best-fit packing of token sequences, planned on the histogram of lengths.

Best-fit decreasing needs only how many pieces have each length, and the histogram has at most ``capacity`` rows. The plan says for every length
which ranks go to which sequences at which offset; pieces take their slots by their rank within their length.

Scale: the driver holds the histogram and the plan (both bounded by ``capacity``, however many documents there are). Ranks come from prefix
counts of three levels over hash buckets, so a length that a third of the pieces share is numbered by many tasks.
"""

from __future__ import annotations

import bisect
import gc
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .prefix import running
from .storage import kept, trimmed, written

END_ID = 1
#: Encoded chunks that a worker keeps (about 200 bytes each); when it has more it starts anew.
CACHE = 800_000
#: Pieces that a hash bucket holds on average.
BUCKET_ROWS = 128

#: Texts whose chunks are looked up together.
TEXTS = 1000

_encoders: dict[str, "Encoder"] = kept({})


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    The tokenizer's model never looks across white space, so texts are cut at blanks and line ends and each distinct chunk is encoded once. A chunk
    of Latin letters and marks behind them is a lower-case word and a run of marks, as the tokenizer's own pattern parts them; words that
    aren't known yet are encoded many at a time, and the ids that end a word part them again.
    """

    #: ASCII and Latin-1 letters (which composition leaves alone and any lower-casing treats alike), then ASCII marks other than the apostrophe.
    PARTS = re.compile("^([A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)$", re.MULTILINE)

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer, pre_tokenizers

        self.cache = cache
        self.tokenizer = Tokenizer.from_file(path)
        # the same model for lower-case words between single blanks, which need no other preparation
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = self.tokenizer.model.end_of_word_suffix
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        out = []
        for a in range(0, len(words), 3000):
            part = words[a : a + 3000]
            ids = np.array(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
            raw = ids.tobytes()
            out += [raw[x:y] for x, y in zip(cuts, cuts[1:])] if len(cuts) == len(part) + 1 else map(self._ids, part)
        return out

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """One after the other; new chunks of all the texts are encoded first."""
        parted = [t.replace("\n", " ").split(" ") for t in texts]
        # difference() of a dictionary looks the few up in the many; the minus of its keys would go through all of them
        new = set().union(*parted).difference(self.known)
        if len(self.known) + len(new) > self.cache:
            self.known = {"": b""}
            new = set().union(*parted)
            new.discard("")
        get = self.known.__getitem__
        pairs = self.PARTS.findall("\n".join(new))
        lower = [w.lower() for w, _ in pairs]
        words = list(set(lower).difference(self.known))
        self.known.update(zip(words, self._words(words)))
        behind = {m: self._ids(m) for m in {m for _, m in pairs}}
        self.known.update(zip([w + m for w, m in pairs], [get(x) + behind[m] for x, (_, m) in zip(lower, pairs)]))
        new = new.difference(self.known)
        self.known.update([(c, self._ids(c)) for c in new])
        for chunks in parted:
            yield b"".join(map(get, chunks))


def encoder(path: str, cache: int = CACHE) -> Encoder:
    """The worker's encoder, kept between batches and tasks, until another step forgets it."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].cache = cache
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, text: str = "text", cache: int = CACHE) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece: a document's ids and the end id, cut every ``capacity`` ids.

    A null or empty text is one piece, the end id; repeated rows each have their pieces, rows with a null doc_id too; an empty table gives none.
    """
    source = docs.select("doc_id", F.col(text).cast("string").alias("__text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()
        encode = encoder(tokenizer, cache).encode_all
        for whole in batches:
            for batch in (whole.slice(a, TEXTS) for a in range(0, whole.num_rows, TEXTS)):
                gc.disable()  # the many small objects have no cycles
                try:
                    out = cut(batch, encode)
                finally:
                    gc.enable()
                yield out

    def cut(batch: pa.RecordBatch, encode) -> pa.RecordBatch:
        ids, texts = batch.columns
        row, piece, length, crc = [], [], [], []
        for i, stream in enumerate(encode([t.as_py() or "" for t in texts])):
            stream += end
            for k, at in enumerate(range(0, len(stream), 4 * capacity)):
                part = stream[at : at + 4 * capacity]
                row.append(i)
                piece.append(k)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        taken = ids.take(pa.array(row, pa.int64()))
        k = pa.array(piece, pa.int32())
        start = pa.array([x * capacity for x in piece], pa.int64())
        return pa.RecordBatch.from_arrays([taken, k, start, pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return source.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, end rank, first sequence, pieces a sequence, offset of the first of them).

    Sequences with equal contents are runs of consecutive numbers. Each length goes to the runs with the least room that fits; a run that
    isn't used up is split, so a length adds at most three runs, and the plan has a few entries for each of at most ``capacity`` lengths.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # by room left: (first sequence, sequences)
    rooms: list[int] = []  # sorted
    plan: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0

    def put(left: int, first: int, n: int) -> None:
        if left <= 0 or n <= 0:
            return
        if left not in room:
            bisect.insort(rooms, left)
            room[left] = []
        room[left].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def fill(space: int, first: int, n: int) -> None:
            """Up to n sequences with this space get as many of the length as fit into each, one sequence after the other."""
            nonlocal left, rank
            each = space // length
            whole = min(n, left // each)
            if whole:
                plan.append((length, rank, rank + whole * each, first, each, capacity - space))
                rank, left = rank + whole * each, left - whole * each
                put(space - each * length, first, whole)
            if whole < n and left:  # fewer than one sequence takes
                plan.append((length, rank, rank + left, first + whole, left, capacity - space))
                put(space - left * length, first + whole, 1)
                rank, left, whole = rank + left, 0, whole + 1
            put(space, first + whole, n - whole)

        while left and (at := bisect.bisect_left(rooms, length)) < len(rooms):
            space = rooms.pop(at)
            runs = room.pop(space)
            for first, n in runs:
                if left:
                    fill(space, first, n)
                else:
                    put(space, first, n)
        if left:
            n = -(-left // (capacity // length))
            sequences += n
            fill(capacity, sequences - n, n)
    return plan


def packed(docs: DataFrame, tokenizer: str, capacity: int = 4096, text: str = "text", cache: int = CACHE) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are packed as often as they occur; other columns don't matter; an empty table gives
    no rows. ``cache``: chunks that a worker keeps, for less memory or less time; results don't depend on it. Numbering is by a hash of doc_id and then by all columns, so a task that runs again finds the same places.
    """
    spark = docs.sparkSession
    cut, _ = written(pieces(docs, tokenizer, capacity, text, cache), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    schema = "p_length long, p_lo long, p_hi long, p_first long, p_each long, p_offset long"
    plan = spark.createDataFrame(best_fit_plan(histogram, capacity), schema)
    counts = spark.createDataFrame([(k, max(1, -(-n // BUCKET_ROWS))) for k, n in histogram.items()], "c_length long, buckets long")
    # counts and plan are bounded by the capacity, see best_fit_plan
    rows = cut.join(F.broadcast(counts), F.col("length") == F.col("c_length")).withColumn("h", F.xxhash64("doc_id", "piece", F.lit(11)))
    rows = rows.withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 20), F.col("buckets")))
    sums = rows.groupBy(F.col("length").alias("b_length"), F.col("bucket").alias("b_bucket")).agg(F.count("*").alias("n"))
    base, _ = written(running(sums, ["b_length"], "b_bucket", "n").withColumnRenamed("before", "base"), "packing-bases")  # broadcast only if it is small
    inside = W.partitionBy("length", "bucket").orderBy("h", "doc_id", "piece", "ids_crc32")
    ranked = (
        rows.withColumn("in", F.row_number().over(inside) - 1)
        .join(base, (F.col("length") == F.col("b_length")) & (F.col("bucket") == F.col("b_bucket")))
        .withColumn("rank", F.col("base") + F.col("in"))
    )
    slot = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("p_lo")) & (F.col("rank") < F.col("p_hi"))
    at = F.col("rank") - F.col("p_lo")
    return ranked.join(F.broadcast(plan), slot).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("p_first") + F.floor(at / F.col("p_each"))).cast("long").alias("sequence_id"),
        (F.col("p_offset") + at % F.col("p_each") * F.col("length")).cast("long").alias("offset"),
    )
