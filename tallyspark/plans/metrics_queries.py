"""Queries of metrics, calibration errors and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, probs as P, text as T
from ..operators import compare as C, metrics as M
from .catalog import query, table, unit_sql
from .fixtures import DECISIONS_SQL, R, decisions

_J = f"""WITH {DECISIONS_SQL},
judged AS (SELECT *, list_position(probs, list_max(probs)) - 1 AS pred, list_position(probs[:-2], list_max(probs[:-2])) - 1 AS pred_k, list_max(probs) AS conf, probs[-1] AS p_null,
  CASE WHEN label = -1 THEN k ELSE label END AS gold FROM decisions),
j AS (SELECT *, (pred = gold)::INT::DOUBLE AS correct, (pred = k)::INT::DOUBLE AS abstain FROM judged)"""
_CL = "least(1.0, greatest(1e-12, {0}))"
_ROW = (
    "-list_sum(list_transform(list_zip(probs, target), lambda z: z[2] * ln(least(1.0, greatest(1e-12, z[1])))))",
    "list_sum(list_transform(list_zip(probs, target), lambda z: (z[1] - z[2]) * (z[1] - z[2])))",
    "list_sum(list_transform(list_zip(probs, target), lambda z: 0.5 * " + _CL.format("z[1]") + " * (ln(" + _CL.format("z[1]") + ") - ln(" + _CL.format("0.5 * (z[1] + z[2])") + ")) + 0.5 * " + _CL.format("z[2]") + " * (ln(" + _CL.format("z[2]") + ") - ln(" + _CL.format("0.5 * (z[1] + z[2])") + "))))",
)
_SUMMARY = (
    f"count(*) AS n, round(avg({_ROW[0]}), 6) AS nll, round(avg({_ROW[1]}), 6) AS brier, round(avg({_ROW[2]}), 6) AS jsd, round(avg(CASE WHEN label IS NOT NULL THEN correct END), 6) AS acc, "
    "round(avg(CASE WHEN label >= 0 THEN (pred_k = label)::INT END), 6) AS acc_k, round(avg(CASE WHEN label = -1 THEN (list_max(probs[:-2]) > 0.9)::INT END), 6) AS conf_wrong, "
    "round(1 - avg(CASE WHEN label IS NOT NULL THEN abstain END), 6) AS coverage, round(avg(CASE WHEN label >= 0 THEN abstain END), 6) AS false_abstain, round(avg(CASE WHEN label = -1 THEN abstain END), 6) AS null_recall"
)


def _rounded(df, *keys):
    return df.select(*[F.col(c) if c in keys or c == "n" else R(c).alias(c) for c in df.columns])


@query("o092_summarize", f"{_J} SELECT {_SUMMARY} FROM j")
def summarize(spark, d):
    return _rounded(M.summarize(decisions(spark, d)))


@query("o106_breakdowns", f"{_J} SELECT task, qtype, {_SUMMARY} FROM j GROUP BY GROUPING SETS ((task), (qtype))")
def breakdowns(spark, d):
    x = M.judged(decisions(spark, d))
    x.createOrReplaceTempView("judged_rows")
    aggs = [c.alias(n) for n, c in M.summary_columns().items()]
    grouped = x.groupingSets([[F.col("task")], [F.col("qtype")]], "task", "qtype").agg(*aggs)
    return _rounded(grouped, "task", "qtype")


_ECE = "round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece"


@query("o094_ece15", f"{_J}, c AS (SELECT len(list_filter(list_transform(range(0, 15), lambda i: i::DOUBLE / 15), lambda e: e <= conf)) AS bin, conf, correct FROM j WHERE label IS NOT NULL), b AS (SELECT bin, count(*) AS n, avg(correct) AS acc, avg(conf) AS conf FROM c GROUP BY bin) SELECT {_ECE} FROM b")
def ece15(spark, d):
    x = M.judged(decisions(spark, d)).where("label IS NOT NULL")
    return M.calibration_error(x, F.col("conf"), F.col("correct"), M.bin_equal(F.col("conf"), 15)).select(R("ece").alias("ece"))


@query("o095_ece10", f"{_J}, b AS (SELECT task, least(9, floor(conf * 10)::INT) AS bin, count(*) AS n, avg(correct) AS acc, avg(conf) AS conf FROM j WHERE label IS NOT NULL GROUP BY ALL) SELECT task, {_ECE} FROM b GROUP BY task")
def ece10(spark, d):
    x = M.judged(decisions(spark, d)).where("label IS NOT NULL")
    return M.calibration_error(x, F.col("conf"), F.col("correct"), M.bin_floor(F.col("conf"), 10), "task").select("task", R("ece").alias("ece"))


@query("o096_selective_accuracy", f"{_J}, r AS (SELECT correct, row_number() OVER (ORDER BY c6 DESC, row_id) AS r, count(*) OVER () AS n FROM (SELECT *, round(conf, 6) AS c6 FROM j WHERE label IS NOT NULL)) SELECT round(avg(correct), 6) AS acc FROM r WHERE r <= ceil(0.8 * n)")
def selective(spark, d):
    x = M.judged(decisions(spark, d)).where("label IS NOT NULL").withColumn("conf", F.round("conf", 6))
    return M.selective_accuracy(x, 0.8, "conf", "correct", "row_id").select(R("acc").alias("acc"))


_AUC = "round((sum(mid * y) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y))), 6) AS auroc"


@query("o098_auroc", f"{_J}, s AS (SELECT task, round(p_null, 6) AS p, (label = -1)::INT AS y FROM j WHERE label IS NOT NULL), r AS (SELECT *, rank() OVER (PARTITION BY task ORDER BY p) + (count(*) OVER (PARTITION BY task, p) - 1) / 2.0::DOUBLE AS mid FROM s) SELECT task, {_AUC} FROM r GROUP BY task")
def auroc(spark, d):
    x = M.judged(decisions(spark, d)).where("label IS NOT NULL").select("task", F.round("p_null", 6).alias("p"), (F.col("label") == -1).cast("int").alias("y"))
    return M.auroc(x, "p", "y", "task").select("task", R("auroc").alias("auroc"))


@query("o099_auprc", f"{_J}, s AS (SELECT task, row_id, round(p_null, 6) AS p, (label = -1)::INT AS y FROM j WHERE label IS NOT NULL), r AS (SELECT *, row_number() OVER w AS k, sum(y) OVER w AS h FROM s WINDOW w AS (PARTITION BY task ORDER BY p DESC, row_id ROWS UNBOUNDED PRECEDING)) SELECT task, round(sum(CASE WHEN y = 1 THEN h / k END) / sum(y), 6) AS auprc FROM r GROUP BY task")
def auprc(spark, d):
    x = M.judged(decisions(spark, d)).where("label IS NOT NULL").select("task", "row_id", F.round("p_null", 6).alias("p"), (F.col("label") == -1).cast("int").alias("y"))
    return M.auprc(x, "p", "y", "row_id", "task").select("task", R("auprc").alias("auprc"))


@query("o112_risk_coverage", f"{_J}, g AS (SELECT round(conf, 3) AS conf, count(*) AS n, sum(1 - correct) AS wrong FROM j WHERE label IS NOT NULL GROUP BY ALL), c AS (SELECT conf, n, sum(n) OVER w AS seen, sum(wrong) OVER w AS lost, sum(n) OVER () AS total FROM g WINDOW w AS (ORDER BY conf DESC ROWS UNBOUNDED PRECEDING)) SELECT conf, round(seen / total::DOUBLE, 6) AS coverage, round(lost / seen, 6) AS risk FROM c")
def risk_coverage(spark, d):
    x = M.judged(decisions(spark, d)).where("label IS NOT NULL").withColumn("conf", F.round("conf", 3))
    return M.risk_coverage(x, "conf", "correct").select("conf", R("coverage").alias("coverage"), R("risk").alias("risk"))


@query("o112_aurc", f"{_J}, g AS (SELECT round(conf, 3) AS conf, count(*) AS n, sum(1 - correct) AS wrong FROM j WHERE label IS NOT NULL GROUP BY ALL), c AS (SELECT n, sum(n) OVER w AS seen, sum(wrong) OVER w AS lost, sum(n) OVER () AS total FROM g WINDOW w AS (ORDER BY conf DESC ROWS UNBOUNDED PRECEDING)) SELECT round(sum(lost / seen * n / total), 6) AS aurc FROM c")
def aurc(spark, d):
    x = M.judged(decisions(spark, d)).where("label IS NOT NULL").withColumn("conf", F.round("conf", 3))
    return M.area_under_risk(M.risk_coverage(x, "conf", "correct")).select(R("aurc").alias("aurc"))


@query("o102_ksweep", f"{_J}, s AS (SELECT k, label >= 0 AS present, round(p_null, 6) AS p, correct, (label = -1)::INT AS y FROM j WHERE label IS NOT NULL), r AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY p) + (count(*) OVER (PARTITION BY k, p) - 1) / 2.0::DOUBLE AS mid FROM s), a AS (SELECT k, avg(CASE WHEN NOT present THEN p END) AS absent, avg(CASE WHEN present THEN p END) AS pres, {_AUC} FROM r GROUP BY k) SELECT k, round(absent, 6) AS p_null_absent, round(pres, 6) AS p_null_present, auroc, round(max(absent) OVER () - min(absent) OVER (), 6) AS absent_range FROM a")
def ksweep(spark, d):
    from pyspark.sql import Window as W

    x = M.judged(decisions(spark, d)).where("label IS NOT NULL").select("k", "label", F.round("p_null", 6).alias("p"), (F.col("label") == -1).cast("int").alias("y"))
    means = x.groupBy("k").agg(F.avg(F.when(F.col("y") == 1, F.col("p"))).alias("absent"), F.avg(F.when(F.col("y") == 0, F.col("p"))).alias("present"))
    out = means.join(M.auroc(x, "p", "y", "k"), "k").withColumn("range", F.max("absent").over(W.partitionBy()) - F.min("absent").over(W.partitionBy()))  # a row for each k
    return out.select("k", R("absent").alias("p_null_absent"), R("present").alias("p_null_present"), R("auroc").alias("auroc"), R("range").alias("absent_range"))


@query("o104_ordinal", f"{_J}, o AS (SELECT row_id, task, label, list_transform(probs[:-2], lambda x: x / list_sum(probs[:-2])) AS p, pred_k FROM j WHERE label >= 0) SELECT task, round(avg(abs(pred_k - label)), 6) AS mae, round(avg(abs(list_sum(list_transform(p, lambda x, i: x * (i - 1))) - label)), 6) AS expected_error FROM o GROUP BY task")
def ordinal(spark, d):
    x = M.judged(decisions(spark, d)).where("label >= 0")
    return x.groupBy("task").agg(R(F.avg(F.abs(F.col("pred_k") - F.col("label")))).alias("mae"), R(F.avg(F.abs(P.expected_level(P.over_labels(F.col("probs"))) - F.col("label")))).alias("expected_error"))


@query("o105_reversed_invariance", f"{_J} SELECT round(max(abs(probs[1] - probs[k])), 6) AS worst, round(avg(abs(probs[1] - probs[k])), 6) AS mean FROM j WHERE k = 2")
def reversed_invariance(spark, d):
    a = decisions(spark, d).where("k = 2").select("row_id", F.get("probs", F.lit(0)).alias("yes"))
    b = decisions(spark, d).where("k = 2").select("row_id", F.get("probs", F.lit(1)).alias("other"))
    gap = F.abs(F.col("yes") - F.col("other"))
    return a.join(b, "row_id").agg(R(F.max(gap)).alias("worst"), R(F.avg(gap)).alias("mean"))


@query("o107_slices", f"{_J}, s AS (SELECT 'task' AS dim, task AS value, correct FROM j WHERE label IS NOT NULL UNION ALL SELECT 'k', k::VARCHAR, correct FROM j WHERE label IS NOT NULL UNION ALL SELECT 'tag', t, correct FROM (SELECT correct, unnest(list_distinct([qtype, substr(task, 1, 1)])) AS t FROM j WHERE label IS NOT NULL)) SELECT dim, value, count(*) AS n, round(avg(correct), 6) AS acc FROM s GROUP BY ALL")
def slices(spark, d):
    x = M.judged(decisions(spark, d)).where("label IS NOT NULL")
    dims = {"task": (F.col("task"), False), "k": (F.col("k"), False), "tag": (F.array("qtype", F.substring("task", 1, 1)), True)}
    return M.slices(x, dims, F.count("*").alias("n"), R(F.avg("correct")).alias("acc"))


@query("o108_confusion", "SELECT quality, tp, fp, fn, tn, round(tpr, 6) AS tpr, round(tnr, 6) AS tnr, round((tpr + tnr) / 2, 6) AS balanced FROM (SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE END AS tpr, CASE WHEN tn + fp > 0 THEN tn / (tn + fp)::DOUBLE END AS tnr FROM (SELECT l.quality, count_if(toxic = 1 AND n_chars % 3 = 0) AS tp, count_if(toxic = 0 AND n_chars % 3 = 0) AS fp, count_if(toxic = 1 AND n_chars % 3 <> 0) AS fn, count_if(toxic = 0 AND n_chars % 3 <> 0) AS tn FROM labels l JOIN documents d USING (doc_id) GROUP BY l.quality))")
def confusion(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    out = M.confusion(x, F.col("toxic") == 1, F.col("n_chars") % 3 == 0, "quality")
    return out.select("quality", "tp", "fp", "fn", "tn", R("tpr").alias("tpr"), R("tnr").alias("tnr"), R("balanced").alias("balanced"))


@query("o108_p05", f"{_J} SELECT task, round(quantile_disc(conf, 0.05), 6) AS p05, round(min(conf), 6) AS least FROM j GROUP BY task")
def p05(spark, d):
    x = M.judged(decisions(spark, d))
    return x.groupBy("task").agg(R(F.expr("percentile_disc(0.05) WITHIN GROUP (ORDER BY conf)")).alias("p05"), R(F.min("conf")).alias("least"))


@query("o110_all_views", f"{_J}, g AS (SELECT grp, avg(1 - correct) AS loss, bool_and(correct = 1) AS every FROM j WHERE label IS NOT NULL GROUP BY grp) SELECT count(*) AS units, round(avg(loss), 6) AS loss, round(avg(every::INT), 6) AS robust FROM g")
def all_views(spark, d):
    x = M.judged(decisions(spark, d)).where("label IS NOT NULL")
    units = x.groupBy("grp").agg(F.avg(1 - F.col("correct")).alias("loss"), F.bool_and(F.col("correct") == 1).alias("every"))
    return units.agg(F.count("*").alias("units"), R(F.avg("loss")).alias("loss"), R(F.avg(F.col("every").cast("int"))).alias("robust"))


@query("o122_null_rate", f"{_J} SELECT k, count(*) AS n, round(avg((label = -1)::INT), 6) AS null_rate FROM j WHERE label IS NOT NULL GROUP BY k")
def null_rate(spark, d):
    return decisions(spark, d).where("label IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), R(F.avg((F.col("label") == -1).cast("int"))).alias("null_rate"))


@query("o123_majority", f"{_J}, c AS (SELECT task, label, count(*) AS n, min(row_id) AS first FROM j WHERE label IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY n DESC, first) AS r, sum(n) OVER (PARTITION BY task) AS total FROM c) SELECT task, label AS majority, round(n / total::DOUBLE, 6) AS share, total::BIGINT AS n FROM r WHERE r = 1")
def majority(spark, d):
    return M.majority(decisions(spark, d), "label", "row_id", "task").select("task", "majority", R("share").alias("share"), "n")


@query("o124_catch20", f"{_J}, y AS (SELECT task, label = 0 AS yes, row_number() OVER (PARTITION BY task ORDER BY round(probs[1], 6) DESC, row_id) AS r, count(*) OVER (PARTITION BY task) AS n FROM j WHERE label >= 0) SELECT task, round(count_if(yes AND r <= greatest(1, round_even(0.2 * n, 0))) / count_if(yes)::DOUBLE, 6) AS caught FROM y GROUP BY task")
def catch20(spark, d):
    from ..operators.ranking import caught

    x = decisions(spark, d).where("label >= 0").select("task", "row_id", F.round(F.get("probs", F.lit(0)), 6).alias("p"), (F.col("label") == 0).alias("yes"))
    return caught(x, "p", "yes", "row_id", 0.2, "task").select("task", R("caught").alias("caught"))


@query("o125_reveal", f"{_J} SELECT task, count(*) AS n, round(avg((pred = gold)::INT), 6) AS a_agrees, round(avg((pred_k = gold)::INT), 6) AS b_agrees, count_if(pred <> gold AND pred_k = gold) AS fixed, count_if(pred = gold AND pred_k <> gold) AS broken, count_if(p_null >= 0.5) AS abstained FROM j WHERE label IS NOT NULL GROUP BY task")
def reveal(spark, d):
    x = M.judged(decisions(spark, d)).where("label IS NOT NULL").select("task", "gold", F.col("pred").alias("a"), F.col("pred_k").alias("b"), F.col("p_null").alias("b_null"))
    out = C.reveal(x, "task")
    return out.withColumns({c: R(c) for c in ("a_agrees", "b_agrees")})


_CLUSTERS = f"{_J}, cl AS (SELECT task, row_number() OVER (ORDER BY task) - 1 AS i, sum(correct) AS num, count(*)::DOUBLE AS den FROM j WHERE label IS NOT NULL GROUP BY task), sz AS (SELECT count(*) AS size FROM cl)"
_DRAWS = _CLUSTERS + f", dr AS (SELECT r.replicate, floor({unit_sql("'boot:' || r.replicate || ':' || w.draw")} * size) AS pick FROM range(200) r(replicate), sz, range(5) w(draw) WHERE w.draw < size), rp AS (SELECT replicate, sum(num) / sum(den) AS ratio FROM dr JOIN cl ON pick = i GROUP BY replicate)"


@query("o126_cluster_bootstrap", f"{_DRAWS}, q AS (SELECT ratio, row_number() OVER (ORDER BY ratio) - 1 AS r, count(*) OVER () AS b FROM rp) SELECT round(max(CASE WHEN r = floor(0.025 * b) THEN ratio END), 6) AS low, round(max(CASE WHEN r = least(b - 1, floor(0.975 * b)) THEN ratio END), 6) AS high FROM q")
def cluster_bootstrap(spark, d):
    x = M.judged(decisions(spark, d)).where("label IS NOT NULL").groupBy("task").agg(F.sum("correct").alias("num"), F.count("*").alias("den"))
    out = C.index_interval(C.cluster_bootstrap(x, "task", "num", "den", 200, "boot", spark), "ratio")
    return out.select(R("low").alias("low"), R("high").alias("high"))


@query("o127_paired_bootstrap", f"{_DRAWS} SELECT round(quantile_cont(ratio, 0.025), 6) AS low, round(quantile_cont(ratio, 0.975), 6) AS high FROM rp")
def paired_bootstrap(spark, d):
    x = M.judged(decisions(spark, d)).where("label IS NOT NULL").groupBy("task").agg(F.sum("correct").alias("num"), F.count("*").alias("den"))
    out = C.cluster_bootstrap(x, "task", "num", "den", 200, "boot", spark)
    return out.agg(R(F.percentile("ratio", F.lit(0.025))).alias("low"), R(F.percentile("ratio", F.lit(0.975))).alias("high"))


@query("o128_arm_contrast", f"{_J}, a AS (SELECT task, avg(CASE WHEN qtype = 'O' THEN correct END) - avg(CASE WHEN qtype = 'F' THEN correct END) AS contrast FROM j WHERE label IS NOT NULL GROUP BY task) SELECT count(*) AS sources, round(avg(contrast), 6) AS contrast FROM a")
def arm_contrast(spark, d):
    x = M.judged(decisions(spark, d)).where("label IS NOT NULL")
    arm = lambda v: F.avg(F.when(F.col("qtype") == v, F.col("correct")))
    return x.groupBy("task").agg((arm("O") - arm("F")).alias("c")).agg(F.count("*").alias("sources"), R(F.avg("c")).alias("contrast"))


@query("o129_mcnemar", f"{_J}, c AS (SELECT task, qtype, k, count_if(pred = gold AND pred_k <> gold)::BIGINT AS a_only, count_if(pred <> gold AND pred_k = gold)::BIGINT AS b_only FROM j WHERE label IS NOT NULL GROUP BY ALL) SELECT task, qtype, k, a_only, b_only, round(CASE WHEN a_only + b_only = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(a_only, b_only) + 1), lambda i: exp(lgamma(a_only + b_only + 1) - lgamma(i + 1) - lgamma(a_only + b_only - i + 1) - (a_only + b_only) * ln(2))))) END, 6) AS p FROM c")
def mcnemar(spark, d):
    x = M.judged(decisions(spark, d)).where("label IS NOT NULL")
    return M.mcnemar(x, F.col("pred") == F.col("gold"), F.col("pred_k") == F.col("gold"), "task", "qtype", "k").withColumn("p", R("p"))


@query("o130_weighted_tvd", f"{_J}, w AS (SELECT probs, target, pred, gold, length(task)::DOUBLE AS w FROM j WHERE label IS NOT NULL) SELECT round(sum(w * 0.5 * list_sum(list_transform(list_zip(probs, target), lambda z: abs(z[1] - z[2])))) / sum(w), 6) AS tvd, round(sum(w * (pred <> gold)::INT) / sum(w), 6) AS flips FROM w")
def weighted_tvd(spark, d):
    x = M.judged(decisions(spark, d)).where("label IS NOT NULL").withColumn("w", F.length("task").cast("double"))
    return x.agg(R(F.sum(F.col("w") * P.total_variation(F.col("probs"), F.col("target"))) / F.sum("w")).alias("tvd"), R(F.sum(F.col("w") * (F.col("pred") != F.col("gold")).cast("int")) / F.sum("w")).alias("flips"))


@query("o131_gates", f"{_J}, m AS (SELECT avg(correct) AS acc, count(*) AS n FROM j WHERE label IS NOT NULL) SELECT unnest(['rows', 'better_than_chance', 'perfect', 'all']) AS gate, unnest([n > 100, acc > 0.2, acc = 1, n > 100 AND acc > 0.2 AND acc = 1]) AS passed FROM m")
def gates(spark, d):
    m = M.judged(decisions(spark, d)).where("label IS NOT NULL").agg(F.avg("correct").alias("acc"), F.count("*").alias("n"))
    return C.gates(m, {"rows": F.col("n") > 100, "better_than_chance": F.col("acc") > 0.2, "perfect": F.col("acc") == 1})


@query("o132_label_sets", f"{_J}, s AS (SELECT list_sort(list_filter(range(0, k), lambda i: probs[i + 1] > 0.3)) AS said, CASE WHEN label >= 0 THEN [label::BIGINT] ELSE [] END AS gold_set FROM j WHERE label IS NOT NULL) SELECT count(*) AS n, round(avg((said = gold_set)::INT), 6) AS acc FROM s")
def label_sets(spark, d):
    said = F.filter(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.when(F.get("probs", i) > 0.3, i)), lambda i: i.isNotNull())
    gold = F.when(F.col("label") >= 0, F.array("label")).otherwise(F.array().cast("array<int>"))
    return decisions(spark, d).where("label IS NOT NULL").agg(F.count("*").alias("n"), R(F.avg((F.array_sort(said) == gold).cast("int"))).alias("acc"))


@query("o133_headroom", f"{_J}, a AS (SELECT task, avg(correct) AS acc, avg(1 / (k + 1)::DOUBLE) AS chance, avg(k) AS secs FROM j WHERE label IS NOT NULL GROUP BY task) SELECT task, round(greatest(0, (acc - chance) / (1 - chance)), 6) AS headroom, round(100 - 20 * log10(secs / 0.1), 6) AS speed, round(100 - 30 * log10(secs / 0.001), 6) AS cost FROM a")
def headroom(spark, d):
    from ..operators.ranking import headroom_score, log_score

    x = M.judged(decisions(spark, d)).where("label IS NOT NULL").groupBy("task").agg(F.avg("correct").alias("acc"), F.avg(1 / (F.col("k") + 1)).alias("chance"), F.avg("k").alias("secs"))
    return x.select("task", R(headroom_score(F.col("acc"), F.col("chance"))).alias("headroom"), R(log_score(F.col("secs"), 20, 0.1)).alias("speed"), R(log_score(F.col("secs"), 30, 0.001)).alias("cost"))


@query("o134_latency", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, round(median(value), 6) AS median, round(max(CASE WHEN r = floor(0.1 * (n - 1)) THEN value END), 6) AS p10, round(max(CASE WHEN r = floor(0.9 * (n - 1)) THEN value END), 6) AS p90 FROM r GROUP BY event_type")
def latency(spark, d):
    e = table(spark, d, "events").select("event_type", "value")
    out = e.groupBy("event_type").agg(R(F.median("value")).alias("median"))
    for name, q in (("p10", 0.1), ("p90", 0.9)):
        out = out.join(M.indexed_quantile(e, "value", q, "event_type").select("event_type", R("q").alias(name)), "event_type")
    return out


@query("o135_probability_margins", f"{_J} SELECT task, count(*) AS n, round(avg(abs(probs[1] - 0.3)), 6) AS margin FROM j WHERE qtype = 'O' GROUP BY task")
def probability_margins(spark, d):
    x = decisions(spark, d).withColumn("threshold", F.when(F.col("qtype") == "O", 0.3))
    return x.where("threshold IS NOT NULL").groupBy("task").agg(F.count("*").alias("n"), R(F.avg(F.abs(F.get("probs", F.lit(0)) - F.col("threshold")))).alias("margin"))


@query("o136_counters", "SELECT source, lang, count(*) AS n, grouping(source, lang)::INT AS level FROM documents GROUP BY CUBE (source, lang)")
def counters(spark, d):
    return table(spark, d, "documents").cube("source", "lang").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


@query("o056_predicate_quality", "SELECT tp, fp, fn, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall FROM (SELECT count_if(t AND g) AS tp, count_if(t AND NOT g) AS fp, count_if(NOT t AND g) AS fn FROM (SELECT contains(lower(text), 'idiot') OR contains(lower(text), 'moron') AS t, toxic = 1 AS g FROM documents JOIN labels USING (doc_id)))")
def predicate_quality(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    t = F.lower("text")
    return M.predicate_quality(x, t.contains("idiot") | t.contains("moron"), F.col("toxic") == 1).withColumns({c: R(c) for c in ("precision", "recall")})


@query("flagship_decisions", f"{_J} SELECT task, {_SUMMARY} FROM j GROUP BY task")
def flagship(spark, d):
    """Scores, answers and judges every decision row, by task."""
    return _rounded(M.summarize(decisions(spark, d), "task"), "task")
