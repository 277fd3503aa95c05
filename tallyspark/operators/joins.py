"""Lookups, twins, leak checks, decontamination, near-duplicate and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T


def lookup(rows: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Rows with their prediction; a key with several predictions fails the query, a missing one is counted by ``found``."""
    once = predictions.groupBy(key).agg(F.count("*").alias("__n"), *[F.min(c).alias(c) for c in predictions.columns if c != key])
    once = once.withColumn("found", F.when(F.assert_true(F.col("__n") == 1, F.lit("a key has several predictions")).isNull(), True)).drop("__n")
    return rows.join(once, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order (a struct minimum, so partial results are combined before the shuffle)."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("__b"))
    return best.select(*keys, "__b.*").select(*rows.columns)


def variant_pairs(rows: DataFrame, group: str, pos: str, label: str) -> DataFrame:
    """In each group the first pair of rows (in combinations order) with different labels: (group, a, b).

    The first row that differs from the group's first row decides, unless none does: then all labels are equal.
    """
    known = rows.where(F.col(label).isNotNull())
    first = known.groupBy(group).agg(F.min(F.struct(pos, label)).alias("f"))
    # combinations order fixes the first element; if a pair with it exists, it is the first pair
    other = known.join(first, group).where(F.col(label) != F.col(f"f.{label}"))
    return other.groupBy(group).agg(F.min(f"f.{pos}").alias("a"), F.min(pos).alias("b"))


def aligned(left: DataFrame, right: DataFrame, key: str, names: str, values: str) -> DataFrame:
    """The right side's values in the order of the left side's names; equal names are matched in order of occurrence."""

    def occurrences(df: DataFrame, more: list[str]) -> DataFrame:
        """(name, occurrence) of every place: occurrence counts the same name before it."""
        n = F.transform(F.sequence(F.lit(0), F.size(names) - 1), lambda i: F.struct(F.get(names, i).alias("name"), F.size(F.filter(F.slice(F.col(names), F.lit(1), i), lambda x: x == F.get(names, i))).alias("occ"), *[F.get(m, i).alias(m) for m in more]))
        return df.where(F.size(names) > 0).select(key, n.alias("__o"))

    a, b = occurrences(left, []), occurrences(right, [values]).select(F.col(key).alias("__k"), F.col("__o").alias("__r"))
    pick = F.transform("__o", lambda o: F.get(F.transform(F.filter("__r", lambda r: (r["name"] == o["name"]) & (r["occ"] == o["occ"])), lambda r: r[values]), F.lit(0)))
    return a.join(b, F.col(key) == F.col("__k")).select(key, pick.alias(values))


def protected_split(rows: DataFrame, norm: Column, role: str) -> DataFrame:
    """Training rows whose text is in a protected set go; then rows of other sets whose text is left in training go.

    role: protected, train or other. One aggregate over texts says which roles a text has.
    """
    keyed = rows.withColumn("__t", norm)
    roles = keyed.groupBy(F.col("__t").alias("__u")).agg(F.bool_or(F.col(role) == "protected").alias("__p"), F.bool_or(F.col(role) == "train").alias("__n"))
    joined = keyed.join(roles, F.col("__t").eqNullSafe(F.col("__u")))
    drop = ((F.col(role) == "train") & F.col("__p")) | ((F.col(role) == "other") & F.col("__n") & ~F.col("__p"))
    return joined.where(~drop).select(*rows.columns)


def word_array(s: Column) -> Column:
    return F.regexp_extract_all(F.lower(s), F.lit(r"(?U)\w+"), F.lit(0))


def grams(rows: DataFrame, key: str, words: Column, n: int) -> DataFrame:
    """(key, gram, check) of the distinct n-grams of each row, as 64-bit hashes checked by a second hash."""
    held = rows.select(key, words.alias("__w"))  # else every gram would split the text again
    # outer, else Spark would infer a filter on the whole expression and split the text again inside its lambdas
    return held.select(key, F.inline_outer(T.shingle_hashes(F.col("__w"), n))).where("gram IS NOT NULL")


def rare_grams(items: DataFrame, key: str, words: Column, n: int, most: int) -> DataFrame:
    """Grams of the items that fewer than ``most`` items have: (gram, check, key)."""
    g = grams(items, key, words, n)
    few = g.groupBy("gram", "check").agg(F.count("*").alias("df")).where(F.col("df") < most).drop("df")
    return g.join(few, ["gram", "check"])


def contaminated(docs: DataFrame, key: str, words: Column, index: DataFrame, n: int) -> DataFrame:
    """(key, item) for documents that share a gram of the index with an item."""
    return grams(docs, key, words, n).join(index, ["gram", "check"]).select(key, index.columns[2]).distinct()


def shingle_rows(rows: DataFrame, key: str, words: Column, n: int) -> DataFrame:
    """(key, gram, check, n) of the distinct runs of n words, hashed; n is how many the row has."""
    held = rows.select(key, words.alias("__w")).select(key, T.shingle_hashes(F.col("__w"), n).alias("__g"))
    # the size beside the array first, else every exploded row would hold the array for it
    sized = held.select(key, "__g", F.size("__g").alias("n"))
    return sized.select(key, "n", F.inline_outer("__g")).where("gram IS NOT NULL").select(key, "gram", "check", "n")  # outer: as in grams


def jaccard_pairs(left: DataFrame, right: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """(a, b, jaccard) of rows (key, gram, check, n) with a Jaccard similarity of at least ``least``, by an inverted index.

    Only grams that both sides have matter, so the left side loses the others before it is shuffled (the right one is the smaller). A pair above
    the threshold shares one of the right set's n - ceil(least n) + 1 rarest grams (prefix filter; those that the left hasn't come first), so
    frequent grams rarely make candidates; survivors are verified by their number of common grams. No set travels whole.
    """
    gram = ["gram", "check"]
    mine = left.join(right.select(*gram).distinct(), gram, "left_semi")
    freq = mine.groupBy(*gram).agg(F.count("*").alias("df"))
    sets = right.join(freq, gram, "left").groupBy(b, "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), *gram))).alias("s"))
    size = F.col("n")
    head = F.filter(F.slice(F.col("s"), F.lit(1), (size - F.ceil(F.lit(least) * size) + 1).cast("int")), lambda x: x["df"] > 0)
    prefix = sets.select(b, F.explode(head).alias("h")).select(b, "h.gram", "h.check")
    near = (F.col("na") >= F.lit(least) * F.col("nb")) & (F.col("nb") >= F.lit(least) * F.col("na"))
    sized = prefix.join(right.select(b, F.col("n").alias("nb")).distinct(), b)
    pairs = mine.withColumnRenamed("n", "na").join(sized, gram).where(near).select(a, b, "na", "nb").distinct()
    common = mine.select(a, *gram).join(pairs, a).join(right.select(b, *gram), [b, *gram]).groupBy(a, b, "na", "nb").agg(F.count("*").alias("c"))
    return common.withColumn("jaccard", F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).where(F.col("jaccard") >= least).select(a, b, "jaccard")


def sharing_pairs(rows: DataFrame, key: str, by: str, options: str) -> DataFrame:
    """(a, b), a < b, of rows with equal ``by`` (nulls equal none) that have a common one of their options, an array of two. Null options count for none.

    The join is on the option, so it makes the pairs asked for (some of them in both orders, or at both options) and no others of the group. Those
    with both options in common go at the second.
    """
    held = F.array_sort(F.array_distinct(F.array_compact(options)))
    placed = F.transform(held, lambda x, i: F.struct(x.alias("option"), F.when(i > 0, F.get(held, i - 1)).alias("before")))
    flat = rows.where(F.col(by).isNotNull()).select(key, by, F.explode(placed).alias("o")).select(key, F.col(by).alias("by"), "o.*")
    # a number of tasks that stays: few bytes give many pairs
    flat = flat.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "by", "option")
    left, right = (flat.select("by", "option", F.col(key).alias(c), F.col("before").alias(f"before_{c}")) for c in "ab")
    again = F.coalesce(F.col("before_a") == F.col("before_b"), F.lit(False))
    return left.join(right, ["by", "option"]).where((F.col("a") < F.col("b")) & ~again).select("a", "b")


def char_shingles(s: Column, n: int) -> Column:
    places = F.when(F.length(s) >= n, F.sequence(F.lit(1), F.length(s) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(s, i, F.lit(n))))


def best_match(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """For each b the a with the greatest similarity (the smallest a on ties)."""
    return pairs.groupBy(b).agg(F.max(F.struct("jaccard", (-F.col(a)).alias("m"))).alias("x")).select(b, (-F.col("x.m")).alias(a), F.col("x.jaccard").alias("jaccard"))


def context(messages: DataFrame, key: str, order: str, people: str, latest: int, keep: int) -> DataFrame:
    """(id of a message, id of an earlier one, rank): up to ``keep`` of the ``latest`` messages before it in its thread that share a participant."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(-latest, -1)
    seen = messages.withColumn("__before", F.reverse(F.collect_list(F.struct(order, people)).over(w)))  # at most ``latest``
    shared = F.slice(F.filter("__before", lambda m: F.arrays_overlap(m[people], F.col(people))), 1, keep)
    return seen.select(key, order, F.posexplode(shared).alias("rank", "m")).select(key, order, F.col(f"m.{order}").alias("earlier"), (F.col("rank") + 1).alias("rank"))


def next_where(rows: DataFrame, by: str, order: str, condition: Column, value: Column, name: str) -> DataFrame:
    """Adds the value of the first later row of the group where the condition holds."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(1, W.unboundedFollowing)
    return rows.withColumn(name, F.first(F.when(condition, value), ignorenulls=True).over(w))


def disjointness(rows: DataFrame, kinds: dict[str, Column], split: str) -> DataFrame:
    """(kind, shared): fingerprints of each kind that occur in several splits."""
    entries = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("fp")) for k, c in kinds.items()])
    all_ = rows.select(split, F.explode(entries).alias("e")).groupBy("e.kind", "e.fp").agg(F.min(split).alias("a"), F.max(split).alias("b"))
    return all_.groupBy("kind").agg(F.count_if(F.col("a") != F.col("b")).alias("shared"))


def match_greedily(scores: list[tuple[int, int, int]]) -> dict[int, int]:
    """(score, i, j): one to one, greatest score first, then smaller i and j; zero scores match nothing. For a plan's few questions and columns."""
    taken: dict[int, int] = {}
    for s, i, j in sorted(scores, key=lambda x: (-x[0], x[1], x[2])):
        if s and i not in taken and j not in taken.values():
            taken[i] = j
    return taken
