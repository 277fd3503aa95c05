"""Profiles of raw tables: column kinds, purity, conflicts, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T

# The cascade's bounds.
DATE = r"^(\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?|\d{1,2}[/.]\d{1,2}[/.]\d{2,4}( .*)?)$"


def unpivoted(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, raw) of every cell as text; one pass for all columns."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("raw")) for c in columns])
    return rows.select(F.explode(entries).alias("e")).select("e.*")


def column_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: rows, non_empty, empty_rate, distinct, distinct_ratio, median and p95 length, kind, and the share of non-empty cells
    with personal data of each kind (T.PII).

    Cells are counted by distinct value first, so the rest works on distinct values.
    """
    cells = unpivoted(rows, columns).withColumn("raw", F.coalesce(T.strip(F.col("raw")), F.lit("")))
    counts = cells.groupBy("column", "raw").agg(F.count("*").alias("n"))
    v = F.when(F.col("raw") != "", F.col("raw"))
    counts = counts.withColumns({"value": T.value_norm(v), "length": F.length(v), "words": F.size(F.split(v, r"\s+"))})
    ne = F.when(F.col("raw") != "", F.col("n")).otherwise(0)
    of = counts.groupBy("column").agg(
        F.sum("n").alias("rows"), F.sum(ne).alias("non_empty"), F.count_distinct("value").alias("distinct"),
        F.sum(F.when(v.rlike(DATE), F.col("n")).otherwise(0)).alias("dates"),
        F.bool_and(F.coalesce(F.regexp_replace(v, ",", "").rlike(T.NUMBER), F.lit(True))).alias("numeric"),
        F.bool_or(F.coalesce(v.contains("."), F.lit(False))).alias("pointed"),
        *[F.sum(F.when(v.rlike("(?U)" + pattern), F.col("n")).otherwise(0)).alias(f"pii_{name}") for name, pattern in T.PII.items()],
    )
    lengths = _weighted_median(counts.where("raw <> ''"), "length").withColumnsRenamed({"m": "median_length", "p95": "p95_length"})
    words = _weighted_median(counts.where("raw <> ''"), "words").select("column", F.col("m").alias("median_words"))
    out = of.join(lengths, "column", "left").join(words, "column", "left").na.fill(0, ["median_length", "p95_length", "median_words"])
    ratio = F.col("distinct") / F.greatest(F.col("non_empty"), F.lit(1))
    ids = (ratio >= 0.9) & (F.col("non_empty") >= 20)
    kind = (
        F.when(F.col("distinct") <= 1, "constant").when(F.col("dates") >= 0.95 * F.col("non_empty"), "date")
        .when((F.col("median_length") > 40) | (F.col("median_words") >= 6), "text")
        .when(ids & (F.col("median_words") < 3) & ~(F.col("numeric") & F.col("pointed")), "id-like")
        .when(ids | ((F.col("median_words") >= 3) & (F.col("distinct") > 50)), "text")
        .when(F.col("numeric") & (F.col("distinct") > 20), "numeric").otherwise("categorical")
    )
    of_filled = lambda c: F.round(F.col(c) / F.greatest(F.col("non_empty"), F.lit(1)), 4)
    empty = F.round(1 - F.col("non_empty") / F.greatest(F.col("rows"), F.lit(1)), 4)
    return out.select(
        "column", "rows", "non_empty", empty.alias("empty_rate"), "distinct", of_filled("distinct").alias("distinct_ratio"), "median_length", "p95_length", kind.alias("kind"),
        *[of_filled(f"pii_{name}").alias(f"pii_{name}") for name in T.PII],
    )


def _weighted_median(counts: DataFrame, value: str) -> DataFrame:
    """Of counted values the median (m, mean of the two middle ones) and the one at 95 % of the way (p95, rounded down)."""
    sums = counts.groupBy("column", F.col(value).alias("v")).agg(F.sum("n").alias("n"))
    up = W.partitionBy("column").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    ranked = sums.withColumn("upto", F.sum("n").over(up)).withColumn("all", F.sum("n").over(W.partitionBy("column")))
    has = lambda k: (F.col("upto") >= k) & (F.col("upto") - F.col("n") < k)
    low, high = F.floor((F.col("all") + 1) / 2), F.floor((F.col("all") + 2) / 2)
    late = F.floor(0.95 * (F.col("all") - 1)) + 1
    at = lambda k: F.max(F.when(has(k), F.col("v")))
    return ranked.groupBy("column").agg(((at(low) + at(high)) / 2).alias("m"), at(late).alias("p95"))


def top_values(rows: DataFrame, column: str, most: int, raws: int = 3) -> DataFrame:
    """(value, n, raws): the most common values by their identity, with their commonest spellings."""
    raw = T.strip(F.col(column).cast("string"))
    counts = rows.select(raw.alias("raw")).where("raw <> ''").groupBy("raw").agg(F.count("*").alias("n")).withColumn("value", T.value_norm(F.col("raw")))
    ranked = counts.withColumn("r", F.row_number().over(W.partitionBy("value").orderBy(F.desc("n"), "raw"))).withColumn("all", F.sum("n").over(W.partitionBy("value")))
    kept = ranked.where(F.col("r") <= raws).groupBy("value").agg(F.max("all").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("r", "raw"))), lambda x: x["raw"]).alias("raws"))
    return kept.orderBy(F.desc("n"), "value").limit(most)


def purity(rows: DataFrame, x: str, y: str) -> DataFrame:
    """How well the majority label of each x predicts y (1: x gives y away), the share of y's majority, and whether x leaks y."""
    pairs = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count("*").alias("n"))
    per = pairs.groupBy(x).agg(F.max("n").alias("best"), F.sum("n").alias("n")).agg((F.sum("best") / F.sum("n")).alias("purity"))
    base = pairs.groupBy(y).agg(F.sum("n").alias("n")).agg((F.max("n") / F.sum("n")).alias("base"))
    both = per.join(F.broadcast(base))  # one row each
    return both.withColumn("leak", (F.col("purity") >= 0.95) & (F.col("purity") - F.col("base") >= 0.5 * (1 - F.col("base"))))


def conflicts(rows: DataFrame, key: str, answer: str) -> DataFrame:
    """rows in conflict (same key, different answers), their share, and the best accuracy any function of the key can have."""
    n = rows.where(F.col(key).isNotNull() & F.col(answer).isNotNull()).groupBy(key, answer).agg(F.count("*").alias("n"))
    groups = n.groupBy(key).agg(F.count("*").alias("answers"), F.sum("n").alias("n"), F.max("n").alias("best"))
    return groups.agg(F.sum(F.when(F.col("answers") > 1, F.col("n")).otherwise(0)).alias("rows"), F.sum("n").alias("all"), F.sum("best").alias("best")).select(
        "rows", (F.col("rows") / F.col("all")).alias("share"), (F.col("best") / F.col("all")).alias("best_accuracy")
    )


def unmapped_values(rows: DataFrame, column: str, mapped: list[str], share: float) -> DataFrame:
    """(value, n, share) of values that no mapping has and that at least this share of the rows has."""
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))  # distinct values, pre-counted
    return counts.where(~F.col("value").isin(mapped) & (F.col("share") >= share))


def duplicate_groups(rows: DataFrame, key: Column, source: str) -> DataFrame:
    """(a, b, groups): over keys that several rows have, how many have rows of both sources (a = b: two of one)."""
    counts = rows.groupBy(key.alias("key"), source).agg(F.count("*").alias("n"))
    per = counts.groupBy("key").agg(F.sum("n").alias("n"), F.collect_list(F.struct(F.col(source).alias("s"), "n")).alias("g")).where("n > 1")  # a row for each source
    a, b = per.select("key", F.explode("g").alias("a")).select("key", F.col("a.s").alias("a"), F.col("a.n").alias("na")), per.select("key", F.explode("g").alias("b")).select("key", F.col("b.s").alias("b"))
    return a.join(b, "key").where("a < b OR (a = b AND na > 1)").groupBy("a", "b").agg(F.count("*").alias("groups"))


def ordinal_scale(values: Column) -> Column:
    """Distinct values in order where they form a scale: known severities, one prefix with numbers, or three to ten integers; else null."""
    scale = F.array(*[F.lit(v) for v in T.SEVERITY_SCALE])
    n = F.size(values)
    number = lambda v: F.regexp_extract(v, r"(\d+)$", 1).cast("int")
    prefix = lambda v: F.regexp_extract(v, r"^([a-z]+) ?\d+$", 1)
    keyed = lambda key: F.transform(F.array_sort(F.transform(values, lambda v: F.struct(key(v).alias("k"), v.alias("v")))), lambda s: s["v"])
    numbered = F.forall(values, lambda v: v.rlike(r"^[a-z]+ ?\d+$")) & (F.size(F.array_distinct(F.transform(values, prefix))) == 1) & (n >= 2)
    severe = prefix(F.get(values, F.lit(0))).isin("p", "sev", "severity", "priority", "prio", "pri", "s")
    return (
        F.when((n >= 3) & F.forall(values, lambda v: F.array_contains(scale, v)), keyed(lambda v: F.array_position(scale, v)))
        .when(numbered & severe, F.reverse(keyed(number))).when(numbered, keyed(number))
        .when(n.between(3, 10) & F.forall(values, lambda v: v.rlike(r"^-?\d+$")), keyed(lambda v: v.cast("int")))
    )
