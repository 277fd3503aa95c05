"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's inputs are its own embedding, the mean and the greatest of its character n-grams' embeddings, and its length. Embeddings are hashed; their
first component starts as a shrunken log-odds of the training documents, and all of them are trained with the network. Overlapping windows of
``WINDOW`` words cover a whole text, each shares half of its words with the next; each gets a probability, and the greatest is the text's score.

Scale: the network is fitted once, on a bounded number of labelled documents (``MAX_LABELLED``, taken by hash) with all windows of their whole
texts, and has a few MB. The driver reads these texts one partition after the other and keeps four bytes a word, besides the distinct words.
Scoring is a map over documents: no shuffle; a worker holds one slice of windows and a bounded table of words' gate inputs.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import forget, trimmed

WINDOW, STRIDE = 64, 32
HIDDEN = 8
#: Labelled documents that the fit uses at most, by label.
MAX_LABELLED = {1: 2000, 0: 3000}
#: Windows that windows_of() gives at most. The fit and the scores take all.
MAX_WINDOWS = 32
HASH_BITS = 16
#: Components of an embedding, and the lengths of the character n-grams.
DEPTH, GRAMS = 4, (3, 5)
#: Pseudo-documents that shrink a weight towards none, and the range of weights.
SHRINK, CLIP = 3.0, 4.0
#: A round over few windows goes over them again until it has so many steps.
ROUNDS, BATCH, RATE, LEAST_STEPS = 6, 256, 0.02, 40
#: Embeddings' own rate.
EMBEDDING_RATE = 0.1
#: Words whose gate inputs a worker keeps; windows that are scored at once; documents whose words are looked up together.
KEPT_WORDS, WINDOWS_AT_ONCE, DOCS_AT_ONCE = 150_000, 1024, 250
INPUTS = 3 * DEPTH + 1
#: Words whose n-grams the training looks up together.
KNOWN_AT_ONCE = 10_000

_KEEP = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TO_WORDS = bytes(c if c in _KEEP else 0x20 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased runs of letters and digits (all of other scripts), as UTF-8."""
    return text.lower().encode("utf-8", "replace").translate(_TO_WORDS).split()


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of ``^word$`` (those of it that are long enough; all have three letters), and where each word's begin."""
    line = np.frombuffer(b"".join([b"^" + w + b"$" for w in words]), dtype=np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(line))  # letters to the word's end
    owner, codes = [], []
    own = np.repeat(np.arange(len(words)), lengths)
    for n in GRAMS:
        code = np.zeros(len(line), dtype=np.uint64)
        for k in range(n):
            code[: len(line) - k] = (code[: len(line) - k] << np.uint64(8)) | line[k:]
        keep = left >= n
        codes.append((code[keep] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - HASH_BITS))
        owner.append(own[keep])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    n = np.bincount(owner, minlength=len(words))
    return np.concatenate(codes)[order].astype(np.int64), np.cumsum(n) - n


def _word_hash(words: list[bytes]) -> np.ndarray:
    import zlib

    return np.fromiter(((zlib.crc32(w) * 2654435761 & 0xFFFFFFFF) >> (32 - HASH_BITS) for w in words), dtype=np.int64, count=len(words))


@dataclass
class Network:
    words: np.ndarray  # embeddings, 2**HASH_BITS x DEPTH
    grams: np.ndarray
    params: dict[str, np.ndarray]
    shift: float = 0.0
    trained: bool = True

    def inputs(self, words: list[bytes]) -> np.ndarray:
        return self.embedded(_word_hash(words), *_grams(words)) if words else np.zeros((0, INPUTS), dtype=np.float32)

    def embedded(self, hashes: np.ndarray, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Inputs of words: their hashes, all their grams in one sequence and where each word's begin."""
        out = np.empty((len(hashes), INPUTS), dtype=np.float32)
        g, n = self.grams[grams], np.diff(np.concatenate((starts, [len(grams)])))
        out[:, :DEPTH] = self.words[hashes]
        out[:, DEPTH : 2 * DEPTH] = np.add.reduceat(g, starts) / n[:, None]
        out[:, 2 * DEPTH : 3 * DEPTH] = np.maximum.reduceat(g, starts)
        out[:, 3 * DEPTH] = np.log1p(n) / 3
        return out

    def embedding_gradients(self, d: np.ndarray, hashes: np.ndarray, grams: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the embeddings of words and grams, from that of the words' inputs."""
        size, n = self.words.shape, np.diff(np.concatenate((starts, [len(grams)])))
        dw, dg = np.zeros(size, np.float32), np.zeros(size, np.float32)
        np.add.at(dw, hashes, d[:, :DEPTH])
        own = np.repeat(np.arange(len(hashes)), n)
        g = self.grams[grams]
        top = g == np.maximum.reduceat(g, starts)[own]
        np.add.at(dg, grams, (d[:, DEPTH : 2 * DEPTH] / n[:, None])[own] + top * d[own, 2 * DEPTH : 3 * DEPTH])
        return dw, dg

    def gates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = self.params
        return x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _direction(gates: np.ndarray, mask: np.ndarray, u: np.ndarray, back: bool, keep: bool):
    """Hidden states (T, B, H) of one direction over gate inputs (T, B, 3H); with ``keep`` also what the gradient needs."""
    t_, b_, _ = gates.shape
    h = np.zeros((b_, HIDDEN), dtype=np.float32)
    out = np.empty((t_, b_, HIDDEN), dtype=np.float32)
    saved = [None] * t_
    for t in reversed(range(t_)) if back else range(t_):
        a = h @ u
        rz = _sigmoid(gates[t, :, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
        r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
        n = np.tanh(gates[t, :, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
        m = mask[t][:, None]
        if keep:
            saved[t] = (h, r, z, n, a[:, 2 * HIDDEN :], m)
        h = h + m * (1.0 - z) * (n - h)
        out[t] = h
    return out, saved


def _direction_gradient(dout: np.ndarray, saved: list, u: np.ndarray, back: bool):
    t_, b_, _ = dout.shape
    dh = np.zeros((b_, HIDDEN), dtype=np.float32)
    dgates = np.empty((t_, b_, 3 * HIDDEN), dtype=np.float32)
    du = np.zeros_like(u)
    for t in range(t_) if back else reversed(range(t_)):
        h, r, z, n, an, m = saved[t]
        dh = dh + dout[t]
        dz = dh * m * (h - n) * z * (1 - z)
        dn = dh * m * (1 - z) * (1 - n * n)
        dr = dn * an * r * (1 - r)
        da = np.concatenate((dr, dz, dn * r), axis=1)
        dgates[t] = np.concatenate((dr, dz, dn), axis=1)
        du += h.T @ da
        dh = dh * (1 - m * (1 - z)) + da @ u.T
    return dgates, du


def forward(p: dict, gf: np.ndarray, gb: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows; gate inputs (T, B, 3H) by direction, mask (T, B)."""
    hf, sf = _direction(gf, mask, p["Uf"], False, keep)
    hb, sb = _direction(gb, mask, p["Ub"], True, keep)
    h = np.concatenate((hf, hb), axis=2)
    e = np.tanh(h @ p["A"])
    s = e @ p["v"] + np.where(mask > 0, 0.0, -1e9).astype(np.float32)
    w = np.exp(s - s.max(axis=0))
    w = w * mask
    w = w / np.maximum(w.sum(axis=0), 1e-9)
    pooled = np.einsum("tb,tbh->bh", w, h)
    logit = pooled @ p["w"] + p["b"][0]
    return logit, (h, e, w, pooled, sf, sb)


def gradients(p: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Mean weighted cross-entropy of windows x (T, B, INPUTS) and its gradient, that of x among them."""
    logit, (h, e, w, pooled, sf, sb) = forward(p, x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"], mask, True)
    q = _sigmoid(logit)
    loss = float(-(weight * (y * np.log(q + 1e-7) + (1 - y) * np.log(1 - q + 1e-7))).sum() / weight.sum())
    d = (weight * (q - y) / weight.sum()).astype(np.float32)
    g = {"w": pooled.T @ d, "b": np.array([d.sum()], dtype=np.float32)}
    dpooled = d[:, None] * p["w"]
    dh = w[:, :, None] * dpooled
    dw = np.einsum("bh,tbh->tb", dpooled, h)
    ds = w * (dw - (w * dw).sum(axis=0))
    de = ds[:, :, None] * p["v"] * (1 - e * e)
    g["v"] = np.einsum("tb,tbk->k", ds, e)
    g["A"] = np.einsum("tbh,tbk->hk", h, de)
    dh = dh + de @ p["A"].T
    g["x"] = np.zeros_like(x)
    for name, saved, back, part in (("f", sf, False, slice(0, HIDDEN)), ("b", sb, True, slice(HIDDEN, None))):
        dg, g[f"U{name}"] = _direction_gradient(dh[:, :, part], saved, p[f"U{name}"], back)
        g[f"W{name}"] = np.einsum("tbi,tbg->ig", x, dg)
        g[f"b{name}"] = dg.sum(axis=(0, 1))
        g["x"] += dg @ p[f"W{name}"].T
    return loss, g


def initial(seed: int = 5) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)
    shape = {"Wf": (INPUTS, 3 * HIDDEN), "Wb": (INPUTS, 3 * HIDDEN), "Uf": (HIDDEN, 3 * HIDDEN), "Ub": (HIDDEN, 3 * HIDDEN), "A": (2 * HIDDEN, HIDDEN), "v": (HIDDEN,), "w": (2 * HIDDEN,)}
    p = {k: draw.normal(0, 0.3, s).astype(np.float32) for k, s in shape.items()}
    return p | {"bf": np.zeros(3 * HIDDEN, np.float32), "bb": np.zeros(3 * HIDDEN, np.float32), "b": np.zeros(1, np.float32)}


def window_starts(n: int) -> range:
    """Overlapping windows that cover n words; one (empty) for none."""
    return range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def windows_of(text: str) -> list[str]:
    """An outline of a text: its windows, or MAX_WINDOWS of them evenly over the whole text. Neither fit() nor scored() uses it; they take all windows."""
    words = words_of(text)
    starts = window_starts(len(words))
    if len(starts) > MAX_WINDOWS:
        starts = [starts[k * (len(starts) - 1) // (MAX_WINDOWS - 1)] for k in range(MAX_WINDOWS)]
    return [b" ".join(words[s : s + WINDOW]).decode("utf-8", "replace") for s in starts]


def _log_odds(sets: Iterator[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Of each hash, by the number of documents that have it; shrunken to the classes' shares."""
    n = 1 << HASH_BITS
    with_, without = np.zeros(n), np.zeros(n)
    for s, label in zip(sets, y):
        (with_ if label else without)[s] += 1
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    # as if both classes had the same number of documents
    a, b = with_ / max(1, y.sum()) * len(y) * share, without / max(1, (1 - y).sum()) * len(y) * (1 - share)
    out = np.log((a + SHRINK * share) / (b + SHRINK * (1 - share))) - np.log(share / (1 - share))
    return np.clip(out, -CLIP, CLIP).astype(np.float32)


def train(docs: list[list[str]], labels: list[int], seed: int = 5) -> Network:
    """The network of these documents, each a list of texts. Without both labels it is untrained and scores every text a half."""
    return trained(zip(labels, docs), seed)


def trained(labelled: Iterable[tuple[int, list[str]]], seed: int = 5) -> Network:
    """The network of labels and their documents' texts, each of which is cut into all its windows; read once, one after the other."""
    vocabulary: dict[bytes, int] = {}
    # texts one behind the other, each filled up to its last window's end; where windows begin
    flat, begins, owner, labels = array("i"), array("q"), array("i"), array("f")
    for i, (label, texts) in enumerate(labelled):
        labels.append(label)
        for t in texts:
            found = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)]
            starts = window_starts(len(found))
            begins.extend(range(len(flat), len(flat) + STRIDE * len(starts), STRIDE))
            owner.extend([i] * len(starts))
            flat.extend(found)
            flat.extend([-1] * (starts[-1] + WINDOW - len(found)))
    known = list(vocabulary)
    del vocabulary
    y = np.array(labels, dtype=np.float32)
    draw = np.random.default_rng(seed)
    start = [draw.normal(0, 0.1, (1 << HASH_BITS, DEPTH)).astype(np.float32) for _ in range(2)]
    if not len(y) or y.min() == y.max():
        p = initial(seed)
        return Network(*start, p | {"w": p["w"] * 0}, trained=False)
    # a fourth of the documents only sets the cut, so that the others' accidents don't
    checks = np.arange(len(y)) % 4 == 3
    if min(y[checks].sum(), (1 - y[checks]).sum()) < 5 or y[~checks].min() == y[~checks].max():
        checks[:] = False
    flat, begins, owner = (np.frombuffer(x, dtype=x.typecode) for x in (flat, begins, owner))
    flat[flat < 0] = len(known)
    inside = np.arange(WINDOW)

    def index(windows: np.ndarray | slice) -> np.ndarray:
        """Words of some windows, a row each."""
        return flat[begins[windows][:, None] + inside]

    # in parts, as the driver holds this
    parts = [_grams(known[a : a + KNOWN_AT_ONCE]) for a in range(0, len(known), KNOWN_AT_ONCE)]
    hashes, grams = _word_hash(known).astype(np.int32), np.concatenate([g.astype(np.int32) for g, _ in parts] or [np.zeros(0, np.int32)])
    counts = np.concatenate([np.diff(np.append(s, len(g))) for g, s in parts] or [np.zeros(0, np.int64)])
    starts = np.cumsum(counts) - counts
    n_known, parts = len(known), None
    del known

    def gathered(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, grams and their starts of some known words."""
        n = counts[words]
        begin = np.cumsum(n) - n
        return hashes[words], grams[np.repeat(starts[words] - begin, n) + np.arange(n.sum())], begin

    fitted = np.flatnonzero(~checks)
    cuts = np.searchsorted(owner, np.arange(len(y) + 1))

    def own():
        for i in fitted:
            words = np.unique(flat[begins[cuts[i]] : begins[cuts[i + 1] - 1] + WINDOW] if cuts[i] < cuts[i + 1] else flat[:0])
            yield words[words < n_known]

    for table, sets in zip(start, ((np.unique(hashes[k]) for k in own()), (np.unique(gathered(k)[1]) for k in own()))):
        table[:, 0] = _log_odds(sets, y[fitted])
    net = Network(*start, initial(seed))
    none = np.zeros((1, INPUTS), np.float32)  # the last row is padding

    def inputs():
        return np.concatenate([net.embedded(*gathered(np.arange(a, min(a + KNOWN_AT_ONCE, n_known)))) for a in range(0, n_known, KNOWN_AT_ONCE)] + [none])

    def mask(rows):
        return (rows != n_known).astype(np.float32)

    table = inputs()
    squares = [np.full_like(t, 1e-6) for t in start]
    slices = [slice(a, a + WINDOWS_AT_ONCE) for a in range(0, len(begins), WINDOWS_AT_ONCE)]
    strong = table[:, 0] + table[:, DEPTH]
    score = np.concatenate([strong[index(s)].max(axis=1) for s in slices])  # at first a window counts by its strongest word
    del table
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.params.items()}
    step, best = 0, None
    for _ in range(ROUNDS):
        chosen = _hardest(owner, score, len(y))
        chosen = chosen[~checks[owner[chosen]]]
        parts = max(1, len(chosen) // BATCH)
        passes = range(-(-LEAST_STEPS // parts))
        for batch in (b for _ in passes for b in np.array_split(draw.permutation(chosen), parts)):
            label = y[owner[batch]]
            weight = np.where(label > 0, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum())).astype(np.float32)
            words, places = np.unique(index(batch).T, return_inverse=True)
            places, real = places.reshape(WINDOW, -1), words < n_known
            part = gathered(words[real])
            x = np.concatenate((net.embedded(*part), none)) if len(part[0]) else none
            _, g = gradients(net.params, x[places], mask(index(batch).T), label, weight)
            step += 1
            dx = np.zeros_like(x)
            np.add.at(dx, places, g.pop("x"))
            if len(part[0]):
                for e, s2, d in zip((net.words, net.grams), squares, net.embedding_gradients(dx[: len(part[0])], *part)):
                    s2 += d * d
                    e -= EMBEDDING_RATE * d / np.sqrt(s2)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for k, v in g.items():
                v = v / max(1.0, norm)
                m, s = moments[k]
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                net.params[k] = (net.params[k] - RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        gf, gb = net.gates(inputs())
        score = np.concatenate([forward(net.params, gf[rows], gb[rows], mask(rows))[0] for rows in (index(s).T for s in slices)])
        del gf, gb
        whole = np.full(len(y), -np.inf)
        np.maximum.at(whole, owner, score)
        held = checks if checks.any() else ~checks
        ranks = whole[held].argsort().argsort() + 1.0
        area = ranks[y[held] == 1].mean() - ranks[y[held] == 0].mean()
        if best is None or area >= best[0]:  # the round that ranks the held-back documents best is kept
            best = area, {k: v.copy() for k, v in net.params.items()}, net.words.copy(), net.grams.copy(), whole
    _, net.params, net.words, net.grams, best = best
    part = checks if checks.any() else ~checks
    net.shift = _cut(best[part], y[part])
    return net


def _hardest(owner: np.ndarray, score: np.ndarray, docs: int) -> np.ndarray:
    """Of each document its two windows with the highest scores."""
    order = np.lexsort((-score, owner))
    first = np.searchsorted(owner[order], np.arange(docs))
    last = np.searchsorted(owner[order], np.arange(docs), side="right")
    second = np.minimum(first + 1, last - 1)
    return np.unique(np.concatenate((order[first], order[second])))


def _cut(best: np.ndarray, y: np.ndarray) -> float:
    """The logit that parts the labels best, in the middle of the gap there."""
    order = np.argsort(best)
    s, label = best[order], y[order]
    # clean documents count three times, as they are the more
    right = 3 * np.concatenate(([0], np.cumsum(1 - label))) / max(1, (1 - label).sum()) + 1 - np.concatenate(([0], np.cumsum(label))) / max(1, label.sum())
    k = int(right.argmax())
    return float(s[0] - 1) if k == 0 else float(s[-1] + 1) if k == len(s) else float((s[k - 1] + s[k]) / 2)


class Scorer:
    """Scores texts; keeps words' gate inputs between batches."""

    def __init__(self, net: Network):
        self.net = net
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.size = 1  # row 0 is padding
        self.gf = np.zeros((4096, 3 * HIDDEN), np.float32)
        self.gb = np.zeros((4096, 3 * HIDDEN), np.float32)
        self.gf[0], self.gb[0] = (g[0] for g in self.net.gates(np.zeros((1, INPUTS), np.float32)))

    def _learn(self, words: list[bytes]) -> None:
        while self.size + len(words) > len(self.gf):
            self.gf, self.gb = (np.concatenate((g, np.zeros_like(g))) for g in (self.gf, self.gb))
        stop = self.size + len(words)
        self.gf[self.size : stop], self.gb[self.size : stop] = self.net.gates(self.net.inputs(words))
        self.index.update(zip(words, range(self.size, stop)))
        self.size = stop

    def scores(self, texts: list[str]) -> np.ndarray:
        docs = [words_of(t) for t in texts]
        new = list({w for d in docs for w in d} - self.index.keys())
        if self.size + len(new) > KEPT_WORDS and self.size > 1:
            self.forget()
            new = list({w for d in docs for w in d})
        self._learn(new)
        get = self.index.__getitem__
        out = np.full(len(docs), -np.inf)
        rows, owner = [], []
        for i, d in enumerate(docs):
            at = np.fromiter(map(get, d), dtype=np.int32, count=len(d))
            starts = window_starts(len(d))
            flat = np.zeros((len(starts) - 1) * STRIDE + WINDOW, dtype=np.int32)
            flat[: len(at)] = at
            rows.append(np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[::STRIDE])
            owner.append(np.full(len(starts), i))
        rows, owner = np.concatenate(rows), np.concatenate(owner)
        for a in range(0, len(rows), WINDOWS_AT_ONCE):
            at = rows[a : a + WINDOWS_AT_ONCE].T
            logit, _ = forward(self.net.params, self.gf[at], self.gb[at], (at > 0).astype(np.float32))
            np.maximum.at(out, owner[a : a + WINDOWS_AT_ONCE], logit)
        return _sigmoid(out - self.net.shift)


def is_held_out(doc_id) -> "F.Column":
    """crc32 of doc_id as text, modulo 5, is 0 (null: held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", seed: int = 5) -> Network:
    """Trained on at most MAX_LABELLED documents of each label, by hash of doc_id, none of them held out; null labels don't count.

    All windows of their whole texts are trained on. A doc_id with several rows or labels counts once, with its least label and text. Null or
    empty texts are one empty window.
    """
    known = labels.where(F.col(label).isin(0, 1) & ~is_held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    able = known.join(docs.select(F.col("doc_id").alias("d")), F.col("doc_id") == F.col("d"), "left_semi")
    picked = [r for y, n in MAX_LABELLED.items() for r in able.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n).collect()]
    if not picked:
        return train([], [])
    chosen = docs.sparkSession.createDataFrame(picked, able.schema).withColumnRenamed("doc_id", "k")
    # at most sum(MAX_LABELLED) ids
    rows = docs.join(F.broadcast(chosen), docs["doc_id"] == F.col("k")).select("k", "y", F.coalesce(F.col(text), F.lit("")).alias("t"))
    # a doc_id with several rows or labels counts once, so that as many texts as MAX_LABELLED says are read, a partition at a time
    found = rows.groupBy("k").agg(F.min(F.struct("y", "t")).alias("r")).select("k", "r.*").orderBy("k")
    return trained(((r["y"], [r["t"]]) for r in found.toLocalIterator()), seed)


def scored(docs: DataFrame, net: Network, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``keep`` (all columns where None) and toxicity, from 0 to 1. A null or empty text is one empty window; an empty table gives no rows."""
    kept = keep or [c for c in docs.columns if c != "toxicity"]
    # the kept columns travel as one, so their names can't clash with any other
    source = docs.select(F.struct(*kept).alias("row"), F.col(text).alias("__text"))
    sent = docs.sparkSession.sparkContext.broadcast(net)  # some hundred kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # in a pipeline's next run, the packing's encoder
        scorer = Scorer(sent.value)
        for whole in batches:
            for a in range(0, whole.num_rows, DOCS_AT_ONCE):
                batch = whole.slice(a, DOCS_AT_ONCE)
                row, texts = batch.columns
                found = scorer.scores([t.as_py() or "" for t in texts])
                yield pa.RecordBatch.from_arrays([row, pa.array(found, pa.float64())], names=["row", "toxicity"])
        del scorer
        trimmed()

    found = source.mapInArrow(run, f"row {source.schema['row'].dataType.simpleString()}, toxicity double")
    return found.select(*[F.col("row")[c].alias(c) for c in kept], "toxicity")


def accepted(docs: DataFrame, net: Network, text: str = "text", reject: float = 0.5) -> DataFrame:
    """The documents whose toxicity is below ``reject``, with their own columns; all of them where nothing could be learnt."""
    if not net.trained:
        return docs
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    return scored(rows, net, ["row"]).where(F.col("toxicity") < reject).select("row.*")
