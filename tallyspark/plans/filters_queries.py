"""Queries of filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, probs as P, text as T
from ..operators import filters as X
from .catalog import query, table, unit_sql
from .fixtures import DECISIONS_SQL, R, decisions, rounded

_W = f"WITH {DECISIONS_SQL}"
_SOFT = f"{_W}, soft AS (SELECT row_id, k, label, probs[:-2] AS t, CASE WHEN label = -1 THEN 1.0 ELSE round(probs[-1], 6) END::DOUBLE AS p_null FROM decisions)"


def _soft(spark, d):
    x = decisions(spark, d)
    return x.select("row_id", "k", "label", P.candidates(F.col("probs")).alias("target"), F.when(F.col("label") == -1, 1.0).otherwise(F.round(P.null_of(F.col("probs")), 6)).alias("p_null"))


@query("o051_hard_targets", f"{_SOFT} SELECT row_id, list_transform(t, lambda x, i: (i = list_position(t, list_max(t)))::INT::DOUBLE) AS target, round_even(p_null, 0) AS p_null FROM soft")
def hard_targets(spark, d):
    return X.hard_targets(_soft(spark, d)).select("row_id", "target", "p_null")


@query("o052_no_null", f"{_SOFT} SELECT row_id, 0.0::DOUBLE AS p_null FROM soft WHERE p_null <> 1")
def no_null(spark, d):
    return X.without_null(_soft(spark, d)).select("row_id", "p_null")


@query("o053_qtype", f"{_W} SELECT row_id, qtype FROM decisions WHERE qtype = 'F'")
def qtype(spark, d):
    return decisions(spark, d).where("qtype = 'F'").select("row_id", "qtype")


@query("o054_truncated", r"SELECT doc_id FROM documents WHERE NOT (length(text) > 3.5 * 500 AND len(regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+')) > 500)")
def truncated(spark, d):
    tokens = F.regexp_count("text", F.lit(r"(?U)\w+"))
    return X.truncated_dropped(table(spark, d, "documents"), "text", tokens, 500).select("doc_id")


@query("o055_semantic_where", r"WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}]{3,}')) AS w FROM documents), p AS (SELECT doc_id, len(list_filter(['the', 'license', 'version'], lambda q: list_contains(w, q))) / 3.0::DOUBLE AS p FROM w) SELECT doc_id, round(p, 6) AS p FROM p WHERE p > 0.5")
def semantic_where(spark, d):
    """Cheap scorer in place of a model: the share of the condition's words that a row has."""
    from ..operators.decide import register

    register(spark)
    table(spark, d, "documents").createOrReplaceTempView("semantic_documents")
    return spark.sql("SELECT doc_id, round(p, 6) AS p FROM (SELECT doc_id, semantic_prob(text, 'The license version') AS p FROM semantic_documents) WHERE p > 0.5")


@query("o057_paraphrase_leak", f"{_W} SELECT row_id FROM decisions WHERE NOT (k = 3 AND list_contains(['1-urgent', '2-high'], lower(trim(task))))")
def paraphrase_leak(spark, d):
    x = decisions(spark, d).withColumn("candidates", F.when(F.col("k") == 3, F.array("task", "qtype")).otherwise(F.array("qtype")))
    return x.where(~F.exists("candidates", lambda c: F.lower(F.trim(c)).isin("1-urgent", "2-high"))).select("row_id")


@query("o058_self_test", f"{_W} SELECT unnest(['lengths', 'sums_to_one', 'p_null_in_range', 'label_is_argmax', 'has_candidates']) AS rule, unnest([count_if(len(target) <> k + 1), count_if(abs(list_sum(target) - 1) > 1e-6), count_if(NOT target[-1] BETWEEN 0 AND 1), count_if(label IS NOT NULL AND list_position(target, list_max(target)) - 1 <> CASE WHEN label = -1 THEN k ELSE label END), count_if(k <= 0)]) AS n FROM decisions")
def self_test(spark, d):
    return X.violations(decisions(spark, d), X.decision_rules())


@query("o059_plan_coverage", "SELECT l_returnflag AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem)::DOUBLE, 6) AS share FROM lineitem WHERE l_returnflag NOT IN ('A') GROUP BY ALL HAVING count(*) >= 0.01 * (SELECT count(*) FROM lineitem)")
def plan_coverage(spark, d):
    """Values of a column that a plan's mapping lacks and that one row in a hundred has."""
    from ..operators.profiles import unmapped_values

    return unmapped_values(table(spark, d, "lineitem"), "l_returnflag", ["A"], 0.01).withColumn("share", R("share"))


@query("o060_extraction_checks", "SELECT doc_id, CASE WHEN source NOT IN ('src0', 'src1', 'src2') THEN 'chosen not an option' WHEN length(substr(text, 1, 20)) < 8 THEN 'evidence too short' WHEN length(text) NOT BETWEEN 60 AND 6000 THEN 'case length' END AS reason FROM documents")
def extraction_checks(spark, d):
    x = table(spark, d, "documents").withColumn("evidence", F.substring("text", 1, 20))
    checks = {
        "chosen not an option": F.col("source").isin("src0", "src1", "src2"),
        "evidence too short": F.length("evidence") >= 8,
        "evidence not verbatim": F.contains("text", "evidence"),
        "case length": F.length("text").between(60, 6000),
    }
    return x.select("doc_id", X.first_failure(checks).alias("reason"))


@query("o061_license_gate", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'N' AND l_linestatus IN ('O')")
def license_gate(spark, d):
    licences = spark.createDataFrame([("O", True), ("F", False)], "status string, commercial boolean")
    rows = table(spark, d, "lineitem").where("l_returnflag <> 'N'")
    return rows.join(F.broadcast(licences.where("commercial")), F.col("l_linestatus") == F.col("status"), "left_semi").select("l_orderkey", "l_linenumber")  # a row for each licence


_ANSWERS = {
    "o_orderstatus": ("o_orderstatus", "o_orderstatus"), "o_orderpriority": ("o_orderpriority", "o_orderpriority"), "same": ("'x'", "'x'"), "after_same": ("o_orderstatus", "o_orderstatus"),
    "lopsided": ("if(o_orderkey % 40 = 0, 'a', 'b')", "CASE WHEN o_orderkey % 40 = 0 THEN 'a' ELSE 'b' END"), "few": ("if(o_orderkey < 20, o_orderstatus, '')", "CASE WHEN o_orderkey < 20 THEN o_orderstatus ELSE '' END"),
    "after_status": ("o_orderpriority", "o_orderpriority"),
}
_NEEDS = {"after_same": "same", "after_status": "o_orderstatus"}


@query(
    "o062_degenerate_columns",
    "WITH u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, {sql} AS v FROM orders" for c, (_, sql) in _ANSWERS.items()) + "), per AS (SELECT c, sum(n) AS n, max(n) AS top FROM (SELECT c, v, count(*) AS n FROM u WHERE v <> '' GROUP BY ALL) GROUP BY c), "
    "bad AS (SELECT c FROM (SELECT DISTINCT c FROM u) LEFT JOIN per USING (c) WHERE coalesce(n, 0) < 30 OR top >= 0.95 * n), needs(c, dep) AS (VALUES " + ", ".join(f"('{c}', '{dep}')" for c, dep in _NEEDS.items()) + ") "
    "SELECT c AS column_name FROM bad UNION SELECT needs.c FROM needs JOIN bad ON dep = bad.c",
)
def degenerate_columns(spark, d):
    x = table(spark, d, "orders").selectExpr(*[f"{e} AS {c}" for c, (e, _) in _ANSWERS.items()])
    return spark.createDataFrame([(c,) for c in X.degenerate_columns(x, list(_ANSWERS), 30, 0.95, _NEEDS)], "column_name string")


@query("o063_cascade", f"{_W} SELECT row_id, CASE WHEN list_position(probs, list_max(probs)) = 1 THEN task END AS shown FROM decisions")
def cascade(spark, d):
    return decisions(spark, d).select("row_id", F.when(P.argmax(F.col("probs")) == 0, F.col("task")).alias("shown"))


@query("o064_panel_gaps", "WITH c AS (SELECT DISTINCT l_suppkey FROM lineitem), g AS (SELECT c.l_suppkey, f, n FROM c CROSS JOIN (VALUES ('A'), ('N'), ('R')) a(f) CROSS JOIN (VALUES (1), (2)) b(n)), h AS (SELECT l_suppkey, l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) SELECT g.l_suppkey, g.f AS l_returnflag, g.n AS l_linenumber, coalesce(h.n, 0) AS n FROM g LEFT JOIN h ON g.l_suppkey = h.l_suppkey AND g.f = h.l_returnflag AND g.n = h.l_linenumber WHERE coalesce(h.n, 0) <> 1")
def panel_gaps(spark, d):
    grid = spark.createDataFrame([(f, n) for f in "ANR" for n in (1, 2)], "l_returnflag string, l_linenumber int")
    return X.grid_gaps(table(spark, d, "lineitem"), "l_suppkey", grid, ["l_returnflag", "l_linenumber"])


@query("o002_valid_rows", r"SELECT doc_id FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 3 OR lang IN ('xx') OR lang LIKE '%\_noev' ESCAPE '\'")
def valid_rows(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.col("text").alias("state"), F.col("lang").alias("task"))
    return X.blanks_dropped(x, ["xx"]).select("doc_id")
