"""Queries of profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import profiles as X
from .catalog import query, table
from .fixtures import R


_PROFILED = {
    "o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority", "o_orderkey": "cast(o_orderkey AS {text})", "o_custkey": "cast(o_custkey AS {text})", "slashed": "concat(1 + o_orderkey % 28, '/7/19', 90 + o_orderkey % 9)",
    "sparse": "CASE WHEN o_orderkey % 10 = 0 THEN o_orderpriority ELSE ' ' END", "mail": "concat('write to user', o_custkey % 7, '@example.com or call +4912345678', 10 + o_custkey % 80)", "one": "'x'",
}
_MAIL, _PHONE = r"[\w.+-]+@[\w-]+(\.[\w-]+)+", r"\+\d{10,15}\b"


@query(
    "o116_column_profile",
    "WITH u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col, trim({e.format(text='VARCHAR')}) AS v FROM orders" for c, e in _PROFILED.items()) + "), a AS (SELECT col, count(*) AS rows, count(*) FILTER (v <> '') AS m, "
    "count(DISTINCT lower(v)) FILTER (v <> '') AS dist, median(length(v)) FILTER (v <> '') AS med, list_sort(list(length(v)) FILTER (v <> '')) AS lens, median(len(regexp_extract_all(v, '\\S+'))) FILTER (v <> '') AS words, "
    "bool_and(regexp_full_match(replace(v, ',', ''), '[-+]?\\d+(\\.\\d+)?')) FILTER (v <> '') AS num, bool_or(contains(v, '.')) FILTER (v <> '') AS pointed, "
    "count(*) FILTER (regexp_full_match(v, '\\d{4}-\\d{2}-\\d{2}([T ]\\d{2}:\\d{2}.*)?|\\d{1,2}[/.]\\d{1,2}[/.]\\d{2,4}( .*)?')) AS dates, "
    f"count(*) FILTER (regexp_matches(v, '{_MAIL}')) AS mails, count(*) FILTER (regexp_matches(v, '{_PHONE}')) AS phones FROM u GROUP BY col) "
    "SELECT col AS \"column\", rows, m AS non_empty, round(1 - m / rows::DOUBLE, 4) AS empty_rate, dist AS \"distinct\", round(dist / m::DOUBLE, 4) AS distinct_ratio, med::DOUBLE AS median_length, lens[floor(0.95 * (m - 1))::INT + 1]::INT AS p95_length, "
    "CASE WHEN dist <= 1 THEN 'constant' WHEN dates >= 0.95 * m THEN 'date' WHEN med > 40 OR words >= 6 THEN 'text' WHEN dist / m::DOUBLE >= 0.9 AND m >= 20 AND words < 3 AND NOT (num AND pointed) THEN 'id-like' "
    "WHEN dist / m::DOUBLE >= 0.9 AND m >= 20 OR (words >= 3 AND dist > 50) THEN 'text' WHEN num AND dist > 20 THEN 'numeric' ELSE 'categorical' END AS kind, "
    "round(mails / m::DOUBLE, 4) AS pii_email, 0::DOUBLE AS pii_iban, 0::DOUBLE AS pii_card, round(phones / m::DOUBLE, 4) AS pii_phone FROM a",
)
def column_profile(spark, d):
    return X.column_profile(table(spark, d, "orders").selectExpr(*[f"{e.format(text='STRING')} AS {c}" for c, e in _PROFILED.items()]), list(_PROFILED))


@query("o116_top_values", "SELECT lower(o_orderstatus) AS value, count(*) AS n, [o_orderstatus, lower(o_orderstatus)] AS raws FROM orders GROUP BY o_orderstatus")
def top_values(spark, d):
    spelled = F.when(F.col("o_orderkey") % 5 == 0, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus"))  # two spellings of each value
    return X.top_values(table(spark, d, "orders").select(spelled.alias("s")), "s", 20)


@query("o117_table_duplicates", r"SELECT trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS key, count(*) AS n FROM conversations GROUP BY ALL HAVING count(*) > 1")
def table_duplicates(spark, d):
    return table(spark, d, "conversations").groupBy(T.norm_text(F.col("text")).alias("key")).agg(F.count("*").alias("n")).where("n > 1")


@query("o118_purity", "WITH p AS (SELECT l_linestatus AS x, l_returnflag AS y, count(*) AS n FROM lineitem GROUP BY ALL), a AS (SELECT sum(b) / sum(n)::DOUBLE AS purity FROM (SELECT max(n) AS b, sum(n) AS n FROM p GROUP BY x)), b AS (SELECT max(n) / sum(n)::DOUBLE AS base FROM (SELECT sum(n) AS n FROM p GROUP BY y)) SELECT round(purity, 6) AS purity, round(base, 6) AS base, purity >= 0.95 AND purity - base >= 0.5 * (1 - base) AS leak FROM a, b")
def purity(spark, d):
    return X.purity(table(spark, d, "lineitem"), "l_linestatus", "l_returnflag").select(R("purity").alias("purity"), R("base").alias("base"), "leak")


@query("o119_conflicts", "WITH n AS (SELECT l_partkey AS k, l_returnflag AS a, count(*) AS n FROM lineitem GROUP BY ALL), g AS (SELECT k, count(*) AS answers, sum(n) AS n, max(n) AS best FROM n GROUP BY k) SELECT sum(CASE WHEN answers > 1 THEN n ELSE 0 END)::BIGINT AS rows, round(sum(CASE WHEN answers > 1 THEN n ELSE 0 END) / sum(n)::DOUBLE, 6) AS share, round(sum(best) / sum(n)::DOUBLE, 6) AS best_accuracy FROM g")
def conflicts(spark, d):
    return X.conflicts(table(spark, d, "lineitem"), "l_partkey", "l_returnflag").select("rows", R("share").alias("share"), R("best_accuracy").alias("best_accuracy"))


@query("o120_corpus_overview", "SELECT count(*) AS n, min(ts) AS first, max(ts) AS last, count(DISTINCT user_id) AS users, round(max(c) / count(*)::DOUBLE, 6) AS top_share FROM events, (SELECT max(n) AS c FROM (SELECT count(*) AS n FROM events GROUP BY event_type))")
def corpus_overview(spark, d):
    e = table(spark, d, "events")
    top = e.groupBy("event_type").agg(F.count("*").alias("c")).agg(F.max("c").alias("c"))
    out = e.agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_distinct("user_id").alias("users")).join(F.broadcast(top))  # one row each
    return out.select("n", "first", "last", "users", R(F.col("c") / F.col("n")).alias("top_share"))


@query("o121_duplicate_matrix", r"WITH n AS (SELECT trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS k, lang, count(*) AS n FROM documents GROUP BY ALL), g AS (SELECT k FROM n GROUP BY k HAVING sum(n) > 1), m AS (SELECT n.* FROM n JOIN g USING (k)) SELECT a.lang AS a, b.lang AS b, count(*) AS groups FROM m a JOIN m b ON a.k = b.k AND (a.lang < b.lang OR (a.lang = b.lang AND a.n > 1)) GROUP BY ALL")
def duplicate_matrix(spark, d):
    return X.duplicate_groups(table(spark, d, "documents"), T.norm_text(F.col("text")), "lang")


@query("o043_ordinal_scales", "SELECT * FROM (VALUES (1, ['low', 'medium', 'high']), (2, ['p 3', 'p 2', 'p 1']), (3, ['step 1', 'step 2']), (4, ['1', '2', '10']), (5, NULL)) v(id, scale)")
def ordinal_scales(spark, d):
    rows = [(1, ["high", "low", "medium"]), (2, ["p 1", "p 2", "p 3"]), (3, ["step 2", "step 1"]), (4, ["10", "1", "2"]), (5, ["red", "blue"])]
    return spark.createDataFrame(rows, "id int, vals array<string>").select("id", X.ordinal_scale(F.col("vals")).alias("scale"))
