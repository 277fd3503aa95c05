"""Ranking, sampling, splitting and retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import hashing, probs as P
from ..sources.files import stored
from .prefix import running, totals


def caught(rows: DataFrame, p: str, yes: str, key: str, share: float, *by: str) -> DataFrame:
    """The share of yes rows in the top share by p (ties by key), at least one row; half-even rounding."""
    ranked = totals(running(rows, list(by), p, True, [key], {"__r": F.lit(1)}, inclusive=True), list(by), {"__n": F.lit(1)})
    top = F.col("__r") <= F.greatest(F.lit(1), F.bround(F.lit(share) * F.col("__n")))
    return ranked.groupBy(*by).agg((F.count_if(F.col(yes) & top) / F.count_if(F.col(yes))).alias("caught"))


def headroom_score(acc: Column, chance: Column) -> Column:
    return F.greatest(F.lit(0.0), (acc - chance) / (1 - chance))


def log_score(x: Column, points: float, unit: float) -> Column:
    """100, less ``points`` for each power of ten above the unit."""
    return 100.0 - points * F.log10(x / unit)


def bm25(questions: DataFrame, chunks: DataFrame, case: str, question: str, chunk: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(case, question, chunk, score): questions (case, question, words) against the chunks (case, chunk, words) of their own case.

    Query words count with multiplicity; only chunks with a query word have a row.
    """
    corpus = chunks.groupBy(case).agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("avgdl"))
    # what the questions ask is written, so that Spark knows its size: it is broadcast while it is small, and then no posting is shuffled by its word
    asked = stored(questions.select(case, question, F.explode("words").alias("w")).groupBy(case, question, "w").agg(F.count("*").alias("q")), "asked")
    words = stored(asked.select(case, "w").distinct(), "asked-words")
    df = chunks.select(case, F.explode(F.array_distinct("words")).alias("w")).join(words, [case, "w"], "left_semi").groupBy(case, "w").agg(F.count("*").alias("df"))
    idf = F.ln(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = stored(asked.join(df, [case, "w"]).join(corpus, case).select(case, "w", question, (F.col("q") * idf).alias("weight"), "avgdl"), "weights")
    # chunks are dealt once, whole; words are counted inside their row, and all that follows up to the sum stays there
    counted = chunks.repartition(case, chunk).select(case, chunk, F.size("words").alias("dl"), P.bound(F.sort_array("words"), _runs).alias("found"))
    tf = counted.select(case, chunk, "dl", F.inline_outer("found")).join(words, [case, "w"], "left_semi")
    part = F.col("weight") * F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * (1.0 - b + b * F.col("dl") / F.col("avgdl")))
    return tf.join(weights, [case, "w"]).groupBy(case, question, chunk).agg(F.sum(part).alias("score"))


def _runs(ws: Column) -> Column:
    """Of sorted words each distinct one and how often it occurs: (w, tf)."""
    places = F.when(F.size(ws) > 0, F.sequence(F.lit(0), F.size(ws) - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 0) | (F.get(ws, i - 1) != F.get(ws, i)))
    return P.bound(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(ws, i).alias("w"), (F.coalesce(F.get(at, k + 1), F.size(ws)) - i).alias("tf"))))


def top_k(scores: DataFrame, by: list[str], score: str, key: str, k: int) -> DataFrame:
    """The k best of each group with their rank (ties by key)."""
    w = W.partitionBy(*by).orderBy(F.desc(score), key)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return P.total(F.zip_with(a, b, lambda x, y: x * y))


def truncated_unit(v: Column, dims: int | Column) -> Column:
    """The first dims components, of unit length; a zero or non-finite vector fails the query."""
    head = F.transform(F.slice(v, 1, dims), lambda x: x.cast("double"))
    length = F.sqrt(P.total(F.transform(head, lambda x: x * x)))
    return F.when(F.isnan(length) | (length == 0), F.raise_error(F.lit("a vector without direction"))).otherwise(F.transform(head, lambda x: x / length))


def position_third(mid: Column, length: Column) -> Column:
    return F.get(F.array(F.lit("early"), F.lit("middle"), F.lit("late")), F.least(F.lit(2), F.floor(mid * 3 / length)).cast("int"))


def tournament(scores: Column, chunk: int) -> Column:
    """Log-probabilities of a large set: chunks' winners are scored again, log P = log P(chunk) + log P(in chunk)."""

    def scored(parts):
        winners = F.transform(parts, lambda p: F.array_max(p))
        return P.bound(P.log_sum_exp(winners), lambda all_: F.flatten(F.transform(parts, lambda p: P.bound(F.array_max(p) - all_ - P.log_sum_exp(p), lambda lead: F.transform(p, lambda x: x + lead)))))

    cut = lambda z: F.transform(F.sequence(F.lit(0), F.ceil(F.size(z) / chunk).cast("int") - 1), lambda c: F.slice(z, c * chunk + 1, chunk))
    return P.bound(scores, lambda z: P.bound(cut(z), scored))


def routed(rows: DataFrame, signal: str, keys: list[str], percent: int) -> DataFrame:
    """Adds whether a row is among the ``percent`` per cent with the greatest signal (ties by falling keys); half-even rounding of the number.

    The bound is found on the counts of distinct signals; only rows at the bound itself are ordered among themselves.
    """
    counts = rows.groupBy(F.col(signal).alias("s")).agg(F.count("*").alias("n"))
    cells = totals(running(counts, [], "s", True, [], {"before": F.col("n")}), [], {"total": F.col("n")}).withColumn("top", F.bround(F.col("total") * F.lit(percent) / 100))
    edge = cells.where("before < top AND before + n > top").select(F.col("s").alias("edge"), (F.col("top") - F.col("before")).alias("take"))
    full = cells.where("before + n <= top").agg(F.min("s").alias("least"))
    marked = rows.join(F.broadcast(full)).join(F.broadcast(edge), F.col(signal) == F.col("edge"), "left")  # a row each at most
    at_edge = F.row_number().over(W.partitionBy("edge").orderBy(*[F.desc(k) for k in keys]))
    inside = marked.where("edge IS NULL").withColumn("routed", F.coalesce(F.col(signal) >= F.col("least"), F.lit(False)))
    tied = marked.where("edge IS NOT NULL").withColumn("routed", at_edge <= F.col("take"))
    return inside.unionByName(tied).drop("least", "edge", "take")


def apportioned(sizes: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Adds quota: integers in proportion to the sizes that sum to the total (largest remainders; ties by key)."""
    share = F.col(size) * F.lit(total) / F.sum(size).over(W.partitionBy())  # a row for each stratum
    out = sizes.withColumn("__share", share).withColumn("__floor", F.floor("__share"))
    rest = F.lit(total) - F.sum("__floor").over(W.partitionBy())
    place = F.row_number().over(W.orderBy(F.desc(F.round(F.col("__share") - F.col("__floor"), 9)), key))
    return out.withColumn("quota", (F.col("__floor") + (place <= rest).cast("int")).cast("long")).drop("__share", "__floor")


def stratified(rows: DataFrame, stratum: str, key: str, quotas: DataFrame, seed: str) -> DataFrame:
    """Of each stratum its quota of rows, by hash rank."""
    w = W.partitionBy(stratum).orderBy(hashing.rank_key(seed, F.col(key)))
    ranked = rows.join(F.broadcast(quotas.select(stratum, "quota")), stratum)  # a row for each stratum
    return ranked.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= F.col("quota")).drop("__r", "quota")


def round_robin(rows: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """One row of each group in turn until there are n."""
    turns = rows.withColumn("turn", F.row_number().over(W.partitionBy(group).orderBy(key)))
    return turns.orderBy("turn", group).limit(n)


def group_split(rows: DataFrame, group: Column, size: int, seed: str) -> DataFrame:
    """Adds split: whole groups, in hash order, go to val while fewer than ``size`` rows are there."""
    keyed = rows.withColumn("__g", group)
    sizes = keyed.groupBy("__g").agg(F.count("*").alias("n")).withColumn("h", hashing.rank_key(seed, F.col("__g")))
    # prefix sums over 4096 ranges of the hash, then inside the one that holds the bound
    part = sizes.withColumn("part", F.substring("h", 1, 3))
    up = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = part.groupBy("part").agg(F.sum("n").alias("m")).withColumn("base", F.coalesce(F.sum("m").over(up), F.lit(0))).select("part", "base")
    inside = W.partitionBy("part").orderBy("h", "__g").rowsBetween(W.unboundedPreceding, -1)
    placed = part.join(F.broadcast(base), "part").withColumn("before", F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0)))  # 4096 rows
    return keyed.join(placed.select(F.col("__g").alias("__k"), (F.col("before") < size).alias("__v")), F.col("__g").eqNullSafe(F.col("__k"))).withColumn("split", F.when(F.col("__v"), "val").otherwise("train")).drop("__g", "__k", "__v")


def oversampled(rows: DataFrame, label: str, key: str) -> DataFrame:
    """Rows of rare labels repeated until a label has a third of the commonest's rows; copy counts the repetitions from 0."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    want = counts.withColumn("want", F.greatest(F.col("n"), F.ceil(F.max("n").over(W.partitionBy()) / 3)))  # a row for each label
    ranked = rows.join(F.broadcast(want), label).withColumn("r", F.row_number().over(W.partitionBy(label).orderBy(key)) - 1)
    copies = F.sequence(F.lit(0).cast("long"), F.floor((F.col("want") - 1 - F.col("r")) / F.col("n")))
    return ranked.withColumn("copy", F.explode(copies)).drop("n", "want", "r")


def gap_sessions(rows: DataFrame, by: str, ts: str, gap: str) -> DataFrame:
    """Adds session: numbered from 0 in each group; a longer gap than ``gap`` begins a new one."""
    w = W.partitionBy(by).orderBy(ts)
    new = (F.lag(ts).over(w).isNull() | (F.lag(ts).over(w) + F.expr(f"INTERVAL {gap}") < F.col(ts))).cast("int")
    return rows.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).drop("__new")


def merged_buckets(counts: list[tuple[str, int]], least: float) -> list[tuple[str, int]]:
    """Ordered buckets merged from the first until each has at least the share; the rest joins the last."""
    total, out, held, name = sum(n for _, n in counts), [], 0, []
    for label, n in counts:
        held, name = held + n, [*name, label]
        if held >= least * total:
            out.append(("+".join(name), held))
            held, name = 0, []
    if name and out:
        out[-1] = (out[-1][0] + "+" + "+".join(name), out[-1][1] + held)
    elif name:
        out.append(("+".join(name), held))
    return out


def deduplicated_messages(rows: DataFrame, keys: list[Column], order: str, folder: str, keep: list[str]) -> DataFrame:
    """The first message of each key with the folders of all its copies and their number."""
    named = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    out = rows.select(*named, order, folder, *keep).groupBy(*[f"k{i}" for i in range(len(keys))]).agg(
        F.min(F.struct(order, *keep)).alias("m"), F.array_sort(F.collect_set(folder)).alias("folders"), F.count("*").alias("copies")
    )
    return out.select("m.*", "folders", "copies")
