"""Row generators: variants of candidate sets, null copies, orbits, controls, soft merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import hashing, probs as P


def shuffled(rows: DataFrame, key: str, arrays: list[str], label: str, seed: str) -> DataFrame:
    """Options in hash order, with every array that goes with them; the label moves along (-1 and null stay)."""
    order = F.transform(
        F.array_sort(F.transform(F.sequence(F.lit(0), F.size(arrays[0]) - 1), lambda i: F.struct(hashing.rank_key(seed, F.col(key), i).alias("h"), i.alias("i")))), lambda s: s["i"]
    )
    rows = rows.withColumn("order", order)
    moved = F.when(F.col(label) >= 0, (F.array_position("order", F.col(label)) - 1).cast("int")).otherwise(F.col(label))
    return rows.withColumns({**{a: P.permuted(F.col(a), F.col("order")) for a in arrays}, label: moved})


def choice_set_variants(rows: DataFrame, irrelevant: Column) -> DataFrame:
    """base, add_irr, remove_gold, dup, reorder and near_dup of each row (columns candidates, label): pair-linked rows with new candidates and label.

    Rows without a gold candidate have no variants.
    """
    c, gold = F.col("candidates"), F.get("candidates", F.col("label"))
    first = F.get(c, F.lit(0))
    v = lambda name, cands, label, src=None: F.struct(F.lit(name).alias("variant"), cands.alias("candidates"), label.cast("int").alias("label"), (src if src is not None else F.lit(None).cast("string")).alias("src"))
    variants = F.array(
        v("base", c, F.col("label")), v("add_irr", F.concat(c, F.array(irrelevant)), F.col("label")),
        v("remove_gold", F.filter(c, lambda x: x != gold), F.lit(-1)), v("dup", F.concat(c, F.array(first)), F.col("label"), first),
        v("reorder", F.reverse(c), F.size(c) - 1 - F.col("label")), v("near_dup", F.concat(c, F.array(F.concat(first, F.lit(".")))), F.col("label"), first),
    )
    keep = [x for x in rows.columns if x not in ("candidates", "label")]
    return rows.where("label >= 0").select(*keep, F.explode(variants).alias("v")).select(*keep, "v.*")


def k_sweep(rows: DataFrame, ranked: Column, gold: Column, ks: list[int]) -> DataFrame:
    """Nested candidate sets for each K with and without the gold: ``ranked`` are the other candidates, best first."""
    grid = F.array(*[F.struct(F.lit(k).alias("K"), F.lit(p).alias("present")) for k in ks for p in (True, False)])
    out = rows.select(*rows.columns, F.explode(grid).alias("g")).select(*rows.columns, "g.*")
    cands = F.when(F.col("present"), F.concat(F.slice(ranked, F.lit(1), F.col("K") - 1), F.array(gold))).otherwise(F.slice(ranked, F.lit(1), F.col("K")))
    return out.withColumn("candidates", cands).where(F.size("candidates") == F.col("K")).withColumn("label", F.when(F.col("present"), F.col("K") - 1).otherwise(-1))


def null_copies(rows: DataFrame, key: str, share: float, seed: str, catch_all: list[str]) -> DataFrame:
    """The rows, and copies of a share of them without gold and catch-all options (two at least are left): label -1, null_aug true."""
    gold = F.get("candidates", F.col("label"))
    cut = F.filter("candidates", lambda c: (c != gold) & ~F.lower(c).isin(catch_all))
    copies = rows.where((F.col("label") >= 0) & (hashing.unit(seed, F.col(key)) < share)).withColumn("__cut", cut).where(F.size("__cut") >= 2)
    copies = copies.drop("candidates", "label").withColumnRenamed("__cut", "candidates").withColumn("label", F.lit(-1))
    return rows.withColumn("null_aug", F.lit(False)).unionByName(copies.withColumn("null_aug", F.lit(True)))


def ordinal_smoothed(k: Column, label: Column, tau: float) -> Column:
    """Targets proportional to exp(-|j - label| / tau)."""
    e = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.exp(-F.abs(j - label) / F.lit(tau)))
    return F.transform(e, lambda x: x / P.total(e))


def rotated(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """The value of the next row of the group, the first's for the last; groups of one have none (a row never gets its own)."""
    w = W.partitionBy(*by).orderBy(order)
    whole = W.partitionBy(*by)
    nxt = F.coalesce(F.lead(value).over(w), F.first(value).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return rows.withColumn("rotated", F.when(F.count("*").over(whole) > 1, nxt))


def soft_merged(rows: DataFrame, key: Column, label: str, labels: list[str]) -> DataFrame:
    """One row for each text: target is its answers' mix in label order, label its argmax (label order on ties)."""
    sums = rows.groupBy(key.alias("key")).agg(*[F.count_if(F.col(label) == v).alias(f"n{i}") for i, v in enumerate(labels)])
    n = F.array(*[F.col(f"n{i}").cast("double") for i in range(len(labels))])
    return sums.select("key", F.transform(n, lambda x: x / P.total(n)).alias("target"), P.argmax(n).alias("label")).where(F.col("target")[0].isNotNull())


def orbits(sources: DataFrame, factors: dict[str, list]) -> DataFrame:
    """Each source under every combination of the factors (a design's few cells)."""
    out = sources
    for name, values in factors.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def delta_targets(variants: DataFrame, key: str, top: int) -> DataFrame:
    """(key, variant, a, b, delta): shifts of teacher log-odds of the original's ``top`` best candidates that a variant kept.

    Columns candidates and teacher; the variant named ``orig`` is the reference.
    """
    place = F.transform(F.sequence(F.lit(0), F.size("candidates") - 1), lambda i: F.struct((-F.get("teacher", i)).alias("p"), i.alias("i"), F.get("candidates", i).alias("c")))
    orig = variants.where("variant = 'orig'").select(F.col(key).alias("k"), F.slice(F.array_sort(place), 1, top).alias("best"))
    other = variants.where("variant <> 'orig'").select(key, "variant", F.map_from_arrays("candidates", "teacher").alias("t")).join(orig, F.col(key) == F.col("k"))
    best = F.filter("best", lambda s: F.map_contains_key("t", s["c"]))
    kept = other.select(key, "variant", "t", best.alias("best"))
    i = kept.select(key, "variant", "t", "best", F.posexplode("best").alias("i", "x")).select(key, "variant", "t", "i", "x", F.posexplode("best").alias("j", "y")).where("i < j")
    odds = lambda s: F.ln(F.element_at("t", F.col(f"{s}.c")))
    delta = (odds("x") - odds("y")) - (F.ln(-F.col("x.p")) - F.ln(-F.col("y.p")))
    return i.select(key, "variant", F.col("x.c").alias("a"), F.col("y.c").alias("b"), delta.alias("delta"))


def narrowed(candidates: Column, mass: Column, key: Column, most: int, seed: str) -> Column:
    """At most ``most`` options, in their order: all with mass, and seeded others."""
    n = F.sequence(F.lit(0), F.size(candidates) - 1)
    ranked = F.array_sort(F.transform(n, lambda i: F.struct((F.get(mass, i) <= 0).alias("z"), hashing.rank_key(seed, key, i).alias("h"), i.alias("i"))))
    kept = F.array_sort(F.transform(F.slice(ranked, 1, most), lambda s: s["i"]))
    return F.when(F.size(candidates) <= most, candidates).otherwise(F.transform(kept, lambda i: F.get(candidates, i)))


def regrouped(rows: DataFrame, group: str, state: str, key: str, question: str, reason: Column, most: int) -> DataFrame:
    """Rows without a skip reason as one record for each group: questions q000, q001, .. in key order; groups with several states or over ``most`` questions go."""
    good = rows.where(reason.isNull())
    out = good.groupBy(group).agg(F.count_distinct(state).alias("states"), F.min(state).alias("state"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(key, question))).alias("qs"))
    named = F.map_from_entries(F.transform("qs", lambda s, i: F.struct(F.format_string("q%03d", i).alias("key"), s[question].alias("value"))))
    return out.where((F.col("states") == 1) & (F.col("n") <= most)).select(group, "state", named.alias("questions"))


def permutation_averaged(scores: DataFrame, key: str) -> DataFrame:
    """(key, mean, spread): arrays ``p`` scored under several ``order``s, put back into the original order and averaged."""
    flat = scores.select(key, F.posexplode(F.arrays_zip("order", "p")).alias("at", "z")).select(key, F.col("z.order").alias("i"), F.col("z.p").alias("p"))
    per = flat.groupBy(key, "i").agg(F.avg("p").alias("m"), F.coalesce(F.stddev_samp("p"), F.lit(0.0)).alias("s"))
    return per.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("mean"), F.avg("s").alias("spread"))  # a number for each option
