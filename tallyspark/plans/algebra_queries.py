"""Queries of the probability algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, libm, probs as P
from .catalog import query, table, unit_sql
from .fixtures import DECISIONS_SQL, R, decisions, rounded

_W = f"WITH {DECISIONS_SQL}"
_SM = "list_transform(list_transform({z}, lambda x: exp((x - list_max({z})) / {t})), lambda x: x / list_sum(list_transform({z}, lambda y: exp((y - list_max({z})) / {t}))))"


def _sm(z: str, t: str = "1.0") -> str:
    return _SM.format(z=z, t=t)


def _r(xs: str) -> str:
    return f"list_transform({xs}, lambda v: round(v, 6))"


@query("o199_softmax", f"{_W} SELECT row_id, {_r(_sm('logits', '1.7'))} AS warm, {_r(_sm('zb'))} AS shifted FROM (SELECT *, list_concat(logits[:-2], [logits[-1] + 0.5]) AS zb FROM decisions)")
def softmax(spark, d):
    x = decisions(spark, d)
    return x.select("row_id", rounded(P.softmax(F.col("logits"), 1.7)).alias("warm"), rounded(P.softmax(P.with_null_offset(F.col("logits"), 0.5))).alias("shifted"))


@query("o200_factored_null", f"{_W} SELECT row_id, {_r('list_concat(list_transform(s, lambda x: (1 - r) * x), [r])')} AS p FROM (SELECT row_id, {_sm('zc', '2.0')} AS s, 1 / (1 + exp(-n)) AS r FROM (SELECT row_id, logits[:-2] AS zc, logits[-1] - 2 AS n FROM decisions))")
def factored_null(spark, d):
    x = decisions(spark, d)
    return x.select("row_id", rounded(P.factored(P.null_of(F.col("logits")) - 2, P.candidates(F.col("logits")), 2.0)).alias("p"))


@query("o201_over_labels", f"{_W} SELECT row_id, {_r('list_transform(c, lambda x: x / list_sum(c))')} AS p, round(probs[-1], 6) AS p_null FROM (SELECT *, probs[:-2] AS c FROM decisions)")
def over_labels(spark, d):
    x = decisions(spark, d)
    return x.select("row_id", rounded(P.over_labels(F.col("probs"))).alias("p"), R(P.null_of(F.col("probs"))).alias("p_null"))


@query(
    "o202_typed_answers",
    f"{_W}, a AS (SELECT row_id, k, list_transform(c, lambda x: x / list_sum(c)) AS p, probs[-1] AS n FROM (SELECT *, probs[:-2] AS c FROM decisions)) "
    "SELECT row_id, list_position(p, list_max(p)) - 1 AS choice, CASE WHEN k = 2 THEN round(p[1], 6) END AS yes, round(list_sum(list_transform(p, lambda x, i: x * (i - 1))), 6) AS score, round(n, 6) AS p_null FROM a",
)
def typed_answers(spark, d):
    from ..operators.decide import typed_answers as answers

    a = answers(decisions(spark, d), F.col("probs"))
    return a.select("row_id", "choice", R("yes").alias("yes"), R("score").alias("score"), R("p_null").alias("p_null"))


@query("o203_yes_head", f"{_W} SELECT row_id, round(1 / (1 + exp(-(0.5 * logits[1] - 0.25 * logits[2]))), 6) AS yes FROM decisions")
def yes_head(spark, d):
    z = F.col("logits")
    return decisions(spark, d).select("row_id", R(1.0 / (1.0 + F.exp(-(0.5 * F.get(z, F.lit(0)) - 0.25 * F.get(z, F.lit(1)))))).alias("yes"))


@query(
    "o204_cumulative_link",
    f"{_W}, s AS (SELECT row_id, logits[1] AS x, list_transform(logits[2:3], lambda v: ln(1 + exp(v))) AS soft FROM decisions), "
    "b AS (SELECT row_id, list_transform(range(0, 3), lambda i: 1 / (1 + exp(x - (0.1 + coalesce(list_sum(soft[1:i]), 0))))) AS below FROM s) "
    f"SELECT row_id, {_r('[below[1], below[2] - below[1], below[3] - below[2], 1 - below[3]]')} AS p FROM b",
)
def cumulative_link(spark, d):
    z = F.col("logits")
    return decisions(spark, d).select("row_id", rounded(P.cumulative_link(F.get(z, F.lit(0)), F.lit(0.1), F.slice(z, 2, 2))).alias("p"))


@query(
    "o205_set_statistics",
    f"{_W}, s AS (SELECT row_id, logits[:-2] AS c FROM decisions) SELECT row_id, round(list_max(c), 6) AS top, round(list_reverse_sort(c)[1] - list_reverse_sort(c)[2], 6) AS margin, round(list_sum(c) / len(c), 9) AS mean, "
    "round(ln(list_sum(list_transform(c, lambda x: exp(x)))) - ln(len(c)), 6) AS lse FROM s",
)
def set_statistics(spark, d):
    s = decisions(spark, d).select("row_id", P.set_statistics(P.candidates(F.col("logits"))).alias("s"))
    return s.select("row_id", *[R(f"s.{c}", 9 if c == "mean" else 6).alias(c) for c in ("top", "margin", "mean", "lse")])


_NLL = "-list_sum(list_transform(list_zip({p}, target), lambda z: z[2] * ln(least(1.0, greatest(1e-12, z[1])))))"
_BRIER = "list_sum(list_transform(list_zip({p}, target), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


@query(
    "o206_decision_loss",
    f"{_W}, t AS (SELECT *, logits[:-2] AS c, list_transform(range(0, k), lambda j: 0.1 + {unit_sql("'t:' || row_id || ':' || j")}) AS raw FROM decisions), "
    f"u AS (SELECT *, list_transform(raw, lambda x: x / list_sum(raw)) AS teacher FROM t), v AS (SELECT *, {_sm('c', '2.0')} AS student, list_transform(teacher, lambda x: sqrt(x)) AS q FROM u), "
    "w AS (SELECT *, list_transform(q, lambda x: x / list_sum(q)) AS soft FROM v) "
    f"SELECT row_id, round(1.0 * ({_NLL.format(p='probs')}) + 0.5 * ({_BRIER.format(p='probs')}) + 0.3 * 4 * list_sum(list_transform(list_zip(soft, student), lambda z: z[1] * (ln(z[1]) - ln(z[2])))), 6) AS loss FROM w",
)
def decision_loss(spark, d):
    x = decisions(spark, d)
    raw = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: 0.1 + hashing.unit("t", F.col("row_id"), j))
    x = x.withColumn("raw", raw).withColumn("teacher", F.transform("raw", lambda v: v / P.total(F.col("raw"))))
    return x.select("row_id", R(P.decision_loss(F.col("logits"), F.col("target"), F.col("teacher"), 1.0, 0.3, 2.0, 0.5)).alias("loss"))


@query(
    "o207_permutation_kl",
    f"{_W}, a AS (SELECT row_id, {_sm('c')} AS p, {_sm('m')} AS q FROM (SELECT *, list_reverse(list_transform(list_reverse(logits[:-2]), lambda x, i: x + 0.1 * i)) AS m, logits[:-2] AS c FROM decisions)) "
    "SELECT round(avg(list_sum(list_transform(list_zip(p, q), lambda z: z[1] * (ln(z[1]) - ln(z[2]))))), 6) AS kl FROM a",
)
def permutation_kl(spark, d):
    """The scorer of the reversed list adds a tenth of the place to each logit; its answer is put back into the original order."""
    c = P.candidates(F.col("logits"))
    other = F.reverse(F.transform(F.reverse(c), lambda x, i: x + 0.1 * (i + 1)))
    return decisions(spark, d).select(P.kl(P.softmax(c), P.softmax(other)).alias("kl")).agg(R(F.avg("kl")).alias("kl"))


@query("o208_support_gate", f"{_W} SELECT row_id, {_r('list_concat(list_transform(s, lambda x: r * x), [1 - r])')} AS p FROM (SELECT row_id, {_sm('zc')} AS s, 1 - n AS r FROM (SELECT row_id, logits[:-2] AS zc, probs[-1] AS n FROM decisions))")
def support_gate(spark, d):
    x = decisions(spark, d)
    return x.select("row_id", rounded(P.composed(1.0 - P.null_of(F.col("probs")), P.softmax(P.candidates(F.col("logits"))))).alias("p"))


@query(
    "o209_score_fusion",
    f"{_W}, g AS (SELECT unnest([0.0, 0.5, 1.0])::DOUBLE AS g), x AS (SELECT label, logits[:-2] AS a, list_transform(range(0, k), lambda j: 4 * {unit_sql("'b:' || row_id || ':' || j")}) AS b FROM decisions WHERE label >= 0), "
    f"y AS (SELECT g, label, {_sm('f')} AS p FROM (SELECT g, label, list_transform(list_zip(a, b), lambda z: z[1] + g * z[2]) AS f FROM x, g)) SELECT g, count(*) AS n, round(avg((list_position(p, list_max(p)) - 1 = label)::INT), 6) AS acc, round(avg(-ln(p[label + 1])), 6) AS nll FROM y GROUP BY g",
)
def score_fusion(spark, d):
    from ..operators.calibrate import fusion_sweep

    x = decisions(spark, d).where("label >= 0")
    other = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: 4 * hashing.unit("b", F.col("row_id"), j))
    swept = fusion_sweep(x.select(P.candidates(F.col("logits")).alias("a"), other.alias("b"), "label"), [0.0, 0.5, 1.0])
    return swept.select("g", "n", R("acc").alias("acc"), R("nll").alias("nll"))


@query(
    "o210_gate_features",
    f"{_W}, c AS (SELECT row_id, k, probs, probs[:-2] AS p, task FROM decisions) SELECT row_id, round(list_max(p), 6) AS top, round(-list_sum(list_transform(probs, lambda x: x * ln(x))) / ln(len(probs)), 6) AS entropy, "
    "round(list_reverse_sort(p)[1] - list_reverse_sort(p)[2], 6) AS margin, round(probs[-1], 6) AS p_null, round(ln(k), 6) AS log_k, round(ln(length(task)), 6) AS log_chars FROM c",
)
def gate_features(spark, d):
    p = F.col("probs")
    return decisions(spark, d).select(
        "row_id", R(F.array_max(P.candidates(p))).alias("top"), R(P.entropy(p)).alias("entropy"), R(P.margin(P.candidates(p))).alias("margin"),
        R(P.null_of(p)).alias("p_null"), R(F.ln(F.col("k").cast("double"))).alias("log_k"), R(F.ln(F.length("task").cast("double"))).alias("log_chars"),
    )


@query(
    "o212_temperature_grid",
    f"{_W}, t AS (SELECT unnest(range(0, 13)) AS i), g AS (SELECT exp(ln(0.25) + i * (ln(4.0) - ln(0.25)) / 12) AS t, i FROM t), "
    f"n AS (SELECT task, i, count(*) AS rows, avg({_NLL.format(p='p')}) AS nll FROM (SELECT task, i, target, {_sm('logits', 't')} AS p FROM decisions, g WHERE label IS NOT NULL) GROUP BY ALL HAVING count(*) >= 30), "
    "b AS (SELECT task, rows, i, nll, row_number() OVER (PARTITION BY task ORDER BY round(nll, 9), i) AS r FROM n) SELECT task, rows, i AS step, round(nll, 6) AS nll FROM b WHERE r = 1",
)
def temperature_grid(spark, d):
    from ..operators.calibrate import temperature_grid as grid

    best = grid(decisions(spark, d).where("label IS NOT NULL"), "task", 0.25, 4.0, 13, 30)
    return best.select("task", "rows", "step", R("nll").alias("nll"))


@query(
    "o213_tempered",
    f"{_W}, a AS (SELECT row_id, k, list_transform(c, lambda x: pow(x / list_sum(c), 1 / 1.5)) AS q FROM (SELECT *, probs[:-2] AS c FROM decisions)), b AS (SELECT row_id, k, list_transform(q, lambda x: x / list_sum(q)) AS p FROM a) "
    "SELECT row_id, list_transform(p, lambda v: round(v, 6)) AS p, round((list_max(p) - 1.0 / k::DOUBLE) / (1 - 1.0 / k::DOUBLE), 6) AS confidence, round(list_sum(list_transform(p, lambda x, i: x * (i - 1))), 6) AS score FROM b",
)
def tempered(spark, d):
    x = libm.softmax(decisions(spark, d).select("row_id", F.col("logits").alias("probs")), "probs")
    x = libm.tempered(x.select("row_id", P.over_labels(F.col("probs")).alias("p")), "p", 1.5)
    return x.select("row_id", rounded("p").alias("p"), R(P.confidence(F.col("p"))).alias("confidence"), R(P.expected_level(F.col("p"))).alias("score"))


@query(
    "o215_jsd_maps",
    "WITH a AS (SELECT l_returnflag, l_linestatus AS key, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), t AS (SELECT *, n / sum(n) OVER (PARTITION BY l_returnflag) AS p FROM a), "
    "f AS (SELECT x.l_returnflag AS a, y.l_returnflag AS b FROM (SELECT DISTINCT l_returnflag FROM a) x JOIN (SELECT DISTINCT l_returnflag FROM a) y ON x.l_returnflag < y.l_returnflag), "
    "k AS (SELECT DISTINCT key FROM a), v AS (SELECT f.a, f.b, k.key, coalesce(p.p, 0) AS p, coalesce(q.p, 0) AS q FROM f CROSS JOIN k LEFT JOIN t p ON p.l_returnflag = f.a AND p.key = k.key LEFT JOIN t q ON q.l_returnflag = f.b AND q.key = k.key) "
    "SELECT a, b, round(greatest(0, sum(CASE WHEN p > 0 THEN 0.5 * p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(q / ((p + q) / 2)) ELSE 0 END)), 6) AS jsd FROM v GROUP BY a, b",
)
def jsd_maps(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    m = n.groupBy("l_returnflag").agg(F.collect_list(F.struct("l_linestatus", "n")).alias("e"), F.sum("n").alias("t"))  # a row for each flag and status
    m = m.select("l_returnflag", F.map_from_entries(F.transform("e", lambda x: F.struct(x["l_linestatus"].alias("key"), (x["n"] / F.col("t")).alias("value")))).alias("m"))
    a, b = m.select(F.col("l_returnflag").alias("a"), F.col("m").alias("p")), m.select(F.col("l_returnflag").alias("b"), F.col("m").alias("q"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", R(P.jsd_maps(F.col("p"), F.col("q"))).alias("jsd"))


@query("o217_soft_gold_ce", f"{_W} SELECT task, count(*) AS n, round(avg(-list_sum(list_transform(list_zip(probs, soft), lambda z: z[2] * ln(greatest(1e-6, z[1]))))), 6) AS ce FROM (SELECT *, list_transform(target, lambda t: 0.96::DOUBLE * t + 0.04::DOUBLE / len(target)) AS soft FROM decisions) GROUP BY task")
def soft_gold_ce(spark, d):
    x = decisions(spark, d).withColumn("soft", F.transform("target", lambda t: 0.96 * t + 0.04 / F.size("target")))
    return x.groupBy("task").agg(F.count("*").alias("n"), R(F.avg(P.nll(F.col("probs"), F.col("soft"), P.GOLD_CLIP))).alias("ce"))


@query("o211_type_temperature")
def type_temperature(spark, d):
    """Golden-section fit for each task, on logits pre-aggregated to nothing but their rows: one grouped task a type."""
    from ..operators.calibrate import golden_section

    return golden_section(decisions(spark, d).where("label IS NOT NULL"), "task", 0.25, 4.0, 12).select("task", R("t", 4).alias("t"), R("nll", 4).alias("nll"))


@query("o214_isotonic")
def isotonic(spark, d):
    from ..operators.calibrate import isotonic_fit

    x = decisions(spark, d).where("label IS NOT NULL").select("row_id", F.array_max("probs").alias("x"), (P.argmax(F.col("probs")) == F.when(F.col("label") == -1, F.col("k")).otherwise(F.col("label"))).cast("double").alias("y"))
    return isotonic_fit(x, "row_id", "x", "y", 5)
