"""Metrics of scored decision rows (logits or probs over K candidates and the null, target, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import probs as P
from .prefix import running, totals


def judged(rows: DataFrame) -> DataFrame:
    """Adds gold (the null's place for label -1), pred, pred_k (among the candidates), conf, correct and p_null."""
    gold = F.when(F.col("label") == -1, F.col("k")).otherwise(F.col("label"))
    rows = rows.withColumns({"gold": gold, "pred": P.argmax(F.col("probs")), "pred_k": P.argmax(P.candidates(F.col("probs"))), "conf": F.array_max("probs"), "p_null": P.null_of(F.col("probs"))})
    return rows.withColumn("correct", (F.col("pred") == F.col("gold")).cast("double"))


def summary_columns() -> dict[str, Column]:
    """The one-pass part of a summary, over judged rows; null where a metric has no rows."""
    hard, present, null = F.col("label").isNotNull(), F.col("label") >= 0, F.col("label") == -1
    abstain = (F.col("pred") == F.col("k")).cast("double")
    return {
        "n": F.count("*"),
        "nll": F.avg(P.nll(F.col("probs"), F.col("target"))),
        "brier": F.avg(P.brier(F.col("probs"), F.col("target"))),
        "jsd": F.avg(P.jsd(F.col("probs"), F.col("target"))),
        "acc": F.avg(F.when(hard, F.col("correct"))),
        "acc_k": F.avg(F.when(present, (F.col("pred_k") == F.col("label")).cast("double"))),
        "conf_wrong": F.avg(F.when(null, (F.array_max(P.candidates(F.col("probs"))) > 0.9).cast("double"))),
        "coverage": 1.0 - F.avg(F.when(hard, abstain)),
        "false_abstain": F.avg(F.when(present, abstain)),
        "null_recall": F.avg(F.when(null, abstain)),
    }


def summarize(rows: DataFrame, *by: str) -> DataFrame:
    out = judged(rows).groupBy(*by).agg(*[c.alias(name) for name, c in summary_columns().items()])
    return out


def bin_equal(conf: Column, bins: int) -> Column:
    """Equal bins of [0, 1], closed below, the last closed at both ends; edges as evenly spaced doubles."""
    edges = F.array(*[F.lit(i / bins) for i in range(bins)])
    return F.size(F.filter(edges, lambda e: e <= conf)) - 1


def bin_floor(conf: Column, bins: int) -> Column:
    return F.least(F.lit(bins - 1), F.floor(conf * bins).cast("int"))


def calibration_error(rows: DataFrame, conf: Column, correct: Column, bin_: Column, *by: str) -> DataFrame:
    """ece: the mean over bins, weighted by rows, of |accuracy - confidence|."""
    cells = rows.groupBy(*by, bin_.alias("__bin")).agg(F.count("*").alias("__n"), F.avg(correct).alias("__acc"), F.avg(conf).alias("__conf"))
    return cells.groupBy(*by).agg((F.sum(F.col("__n") * F.abs(F.col("__acc") - F.col("__conf"))) / F.sum("__n")).alias("ece"))


def selective_accuracy(rows: DataFrame, share: float, conf: str, correct: str, key: str) -> DataFrame:
    """Accuracy on the most confident share of rows (ties by key), through a histogram of confidences.

    The bound is found on confidences counted in 2**20 parts; only the part that holds the bound is ordered row by row.
    """
    part = F.floor(F.col(conf) * (1 << 20))
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum(correct).alias("s"))
    down = W.orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    cells = counts.withColumn("all", F.sum("n").over(W.partitionBy())).withColumn("before", F.coalesce(F.sum("n").over(down), F.lit(0)))
    cells = cells.withColumn("take", F.greatest(F.lit(0), F.least(F.col("n"), F.ceil(F.col("all") * F.lit(share)) - F.col("before"))))
    edge = cells.where("take > 0 AND take < n").select(F.col("part").alias("edge"), "take")
    ranked = rows.withColumn("part", part).join(F.broadcast(edge), F.col("part") == F.col("edge"))  # one part at most
    ranked = ranked.withColumn("r", F.row_number().over(W.orderBy(F.desc(conf), key))).where("r <= take")
    sums = cells.where("take = n").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).union(ranked.agg(F.sum(correct).alias("s"), F.count("*").alias("n")))
    return sums.agg((F.sum("s") / F.sum("n")).alias("acc"))


def auroc(rows: DataFrame, score: str, label: str, *by: str) -> DataFrame:
    """By mid-ranks, ties half; null with one class only. Scores are counted first, ranks are running sums over distinct scores."""
    counts = rows.groupBy(*by, F.col(score).alias("__score")).agg(F.sum(label).alias("pos_here"), F.count("*").alias("n"))
    ranked = running(counts, list(by), "__score", False, [], {"__below": F.col("n")}).withColumn("mid", F.col("__below") + (F.col("n") + 1) / F.lit(2.0))
    sums = ranked.groupBy(*by).agg(F.sum(F.col("mid") * F.col("pos_here")).alias("r"), F.sum("pos_here").alias("pos"), (F.sum("n") - F.sum("pos_here")).alias("neg"))
    value = (F.col("r") - F.col("pos") * (F.col("pos") + 1) / F.lit(2.0)) / (F.col("pos") * F.col("neg"))
    return sums.select(*by, F.when((F.col("pos") > 0) & (F.col("neg") > 0), value).alias("auroc"))


def auprc(rows: DataFrame, score: str, label: str, key: str, *by: str) -> DataFrame:
    """Step-wise average precision in the order of falling scores (ties by key)."""
    ranked = running(rows, list(by), score, True, [key], {"__k": F.lit(1), "__h": F.col(label)}, inclusive=True)
    return ranked.groupBy(*by).agg((F.sum(F.when(F.col(label) == 1, F.col("__h") / F.col("__k"))) / F.sum(label)).alias("auprc"))


def risk_coverage(rows: DataFrame, conf: str, correct: str) -> DataFrame:
    """(conf, coverage, risk) for each distinct confidence, falling."""
    groups = rows.groupBy(conf).agg(F.count("*").alias("n"), F.sum(1.0 - F.col(correct)).alias("wrong"))
    out = totals(running(groups, [], conf, True, [], {"seen": F.col("n"), "lost": F.col("wrong")}, inclusive=True), [], {"all": F.col("n")})
    return out.select(conf, (F.col("seen") / F.col("all")).alias("coverage"), (F.col("lost") / F.col("seen")).alias("risk"), "n", "all")


def area_under_risk(curve: DataFrame) -> DataFrame:
    """Right-step area: each group's risk times its share of the rows."""
    return curve.agg(F.sum(F.col("risk") * F.col("n") / F.col("all")).alias("aurc"))


def confusion(rows: DataFrame, truth: Column, said: Column, *by: str) -> DataFrame:
    """tp, fp, fn, tn, tpr, tnr and balanced accuracy of two boolean columns."""
    c = lambda a, b: F.count_if((truth == a) & (said == b))
    out = rows.groupBy(*by).agg(c(True, True).alias("tp"), c(False, True).alias("fp"), c(True, False).alias("fn"), c(False, False).alias("tn"))
    tpr = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn")))
    tnr = F.when(F.col("tn") + F.col("fp") > 0, F.col("tn") / (F.col("tn") + F.col("fp")))
    return out.withColumns({"tpr": tpr, "tnr": tnr, "balanced": (tpr + tnr) / 2})


def predicate_quality(rows: DataFrame, said: Column, gold: Column) -> DataFrame:
    """tp, fp, fn, precision (1 where nothing is predicted) and recall (1 where there is no gold)."""
    out = rows.agg(F.count_if(said & gold).alias("tp"), F.count_if(said & ~gold).alias("fp"), F.count_if(~said & gold).alias("fn"))
    p, r = F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")
    return out.withColumns({"precision": F.when(p == 0, 1.0).otherwise(F.col("tp") / p), "recall": F.when(r == 0, 1.0).otherwise(F.col("tp") / r)})


def indexed_quantile(rows: DataFrame, value: str, q: float, *by: str) -> DataFrame:
    """The value at place int(q (n - 1)) of the sorted values."""
    ranked = totals(running(rows, list(by), value, False, [], {"__r": F.lit(1)}), list(by), {"__n": F.lit(1)})
    return ranked.where(F.col("__r") == F.floor(F.lit(q) * (F.col("__n") - 1))).select(*by, F.col(value).alias("q"))


def mcnemar(rows: DataFrame, a: Column, b: Column, *by: str) -> DataFrame:
    """a_only, b_only and the exact two-sided binomial p of the discordant pairs (boolean columns); above 2000 pairs by the normal tail."""
    out = rows.groupBy(*by).agg(F.count_if(a & ~b).alias("a_only"), F.count_if(~a & b).alias("b_only"))
    n, k = F.col("a_only") + F.col("b_only"), F.least("a_only", "b_only")
    kind = "struct<log:double,sum:double>"
    step = lambda s, i: F.struct((s["log"] + F.ln((n - i) / (i + 1))).alias("log"), (s["sum"] + F.exp(s["log"] - n * F.lit(0.6931471805599453))).alias("sum")).cast(kind)
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), k), F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum")).cast(kind), step, lambda s: s["sum"])
    z = (F.abs(F.col("a_only") - F.col("b_only")) - 1) / F.sqrt(n.cast("double"))
    normal = 2.0 / (1.0 + F.exp(1.5976 * z + 0.070566 * z * z * z))
    return out.withColumn("p", F.when(n == 0, 1.0).when(n <= 2000, F.least(F.lit(1.0), 2.0 * tail)).otherwise(F.least(F.lit(1.0), normal)))


def majority(rows: DataFrame, label: str, key: str, *by: str) -> DataFrame:
    """The most common label of each group (the one seen first on ties) and its share."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("n"), F.min(key).alias("first"))
    return counts.groupBy(*by).agg(F.max_by(label, F.struct("n", -F.col("first"))).alias("majority"), (F.max("n") / F.sum("n")).alias("share"), F.sum("n").alias("n"))


def slices(rows: DataFrame, dims: dict[str, Column], *aggs: Column) -> DataFrame:
    """The aggregates for every value of every slice dimension (array columns count for each of their values)."""
    entries = [F.transform(c if kind else F.array(c.cast("string")), _labelled(name)) for name, (c, kind) in dims.items()]
    return rows.withColumn("__s", F.explode(F.array_distinct(F.concat(*entries)))).groupBy(F.col("__s.dim").alias("dim"), F.col("__s.value").alias("value")).agg(*aggs)


def _labelled(name: str):
    return lambda v: F.struct(F.lit(name).alias("dim"), v.cast("string").alias("value"))
