"""Queries of rule policies and panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, probs as P
from ..operators import policy as L
from .catalog import query, table, unit_sql
from .fixtures import R

PRIORITY = {
    "fields": ["big", "cheap", "late"], "mode": "priority", "fallback": "keep",
    "rules": [{"when": {"all": [{"field": "big"}, {"not": {"field": "cheap"}}]}, "action": "review"}, {"when": {"field": "late"}, "action": {"name": "chase", "payload": {"days": 3}}}, {"when": {"any": [{"field": "cheap"}, {"const": False}]}, "action": "skip"}],
}
COLLECT = {
    "fields": ["big", "cheap", "late"], "mode": "collect", "fallback": None,
    "rules": [{"when": {"field": "big"}, "action": "review", "primary_rank": 2}, {"when": {"field": "late"}, "action": "chase", "primary_rank": 1}, {"when": {"field": "cheap"}, "action": "skip"}],
}
_F = "(SELECT l_orderkey, l_linenumber, l_quantity > 25 AS big, l_extendedprice < 20000 AS cheap, l_returnflag = 'R' AS late FROM lineitem)"


def _rows(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") > 25).alias("big"), (F.col("l_extendedprice") < 20000).alias("cheap"), (F.col("l_returnflag") == "R").alias("late"))


def _fields(*names):
    return {n: F.col(n) for n in names}


_FIRST = "CASE WHEN big AND NOT cheap THEN 'review({})' WHEN late THEN 'chase({\"days\":3})' WHEN cheap THEN 'skip({})' ELSE 'keep({})' END"


@query("o218_truth_table", "SELECT [big, cheap, late] AS assignment, " + _FIRST + " AS action FROM (VALUES (false), (true)) a(big), (VALUES (false), (true)) b(cheap), (VALUES (false), (true)) c(late)")
def truth_table(spark, d):
    return L.truth_table(spark, L.compile_policy(PRIORITY)).select("assignment", F.col("primary").alias("action"))


@query("o219_priority_policy", f"SELECT l_orderkey, l_linenumber, {_FIRST} AS action FROM {_F}")
def priority_policy(spark, d):
    action, _ = L.executed(L.compile_policy(PRIORITY), _fields("big", "cheap", "late"))
    return _rows(spark, d).select("l_orderkey", "l_linenumber", action.alias("action"))


@query("o219_collect_policy", f"SELECT l_orderkey, l_linenumber, CASE WHEN late THEN 'chase({{}})' WHEN big THEN 'review({{}})' END AS main, list_sort(list_filter([CASE WHEN big THEN 'review({{}})' END, CASE WHEN late THEN 'chase({{}})' END, CASE WHEN cheap THEN 'skip({{}})' END], lambda x: x IS NOT NULL)) AS actions FROM {_F}")
def collect_policy(spark, d):
    main, actions = L.executed(L.compile_policy(COLLECT), _fields("big", "cheap", "late"))
    return _rows(spark, d).select("l_orderkey", "l_linenumber", main.alias("main"), actions.alias("actions"))


_PROB = f"(SELECT o_orderkey, 1 / (1 + exp(-(4 * {unit_sql("'x:' || o_orderkey")} - 2))) AS x, 1 / (1 + exp(-(4 * {unit_sql("'y:' || o_orderkey")} - 2))) AS y, 1 / (1 + exp(-(4 * {unit_sql("'w:' || o_orderkey")} - 2))) AS w FROM orders)"


def _logits(spark, d):
    z = lambda s: 4 * hashing.unit(s, F.col("o_orderkey")) - 2
    return table(spark, d, "orders").select("o_orderkey", F.array(z("x"), z("y"), z("w")).alias("z"))


@query("o220_outcome_distribution", f"SELECT o_orderkey, unnest(['review({{}})', 'chase({{\"days\":3}})', 'skip({{}})', 'keep({{}})']) AS action, unnest([round(x * (1 - y), 6), round((1 - x * (1 - y)) * w, 6), round((1 - w) * y, 6), round((1 - x) * (1 - y) * (1 - w), 6)]) AS p FROM {_PROB}")
def outcome_distribution(spark, d):
    dist = L.outcome_distribution(_logits(spark, d), L.compile_policy(PRIORITY), "z", "o_orderkey")
    return dist.select("o_orderkey", F.col("primary").alias("action"), R(F.exp("logp")).alias("p"))


@query("o221_outcome_losses", f"SELECT o_orderkey, round(-ln(p), 6) AS nll, round(s - 2 * p + 1, 6) AS brier FROM (SELECT o_orderkey, x * (1 - y) AS p, pow(x * (1 - y), 2) + pow((1 - x * (1 - y)) * w, 2) + pow((1 - w) * y, 2) + pow((1 - x) * (1 - y) * (1 - w), 2) AS s FROM {_PROB})")
def outcome_losses(spark, d):
    rows = _logits(spark, d)
    dist = L.outcome_distribution(rows, L.compile_policy(PRIORITY), "z", "o_orderkey")
    gold = rows.select("o_orderkey", F.lit("review({})").alias("gold_primary"), F.array(F.lit("review({})")).alias("gold_actions"))
    return L.outcome_losses(dist, gold, "o_orderkey").select("o_orderkey", R("nll").alias("nll"), R("brier").alias("brier"))


@query("o222_canonical_actions", "SELECT 'a({\"x\":1,\"y\":2})' AS action UNION ALL SELECT 'b({})'")
def canonical_actions(spark, d):
    return spark.createDataFrame([(L.canonical_action({"name": "a", "payload": {"y": 2, "x": 1}}),), (L.canonical_action("b"),)], "action string")


@query("o223_action_rule", f"SELECT l_orderkey, l_linenumber, CASE WHEN late THEN 'deny' WHEN NOT big THEN 'review' WHEN NOT cheap THEN 'escalate' ELSE 'allow' END AS action FROM {_F}")
def action_rule(spark, d):
    a = L.action_rule({"safe": ~F.col("late"), "approved": F.col("big"), "within_limit": F.col("cheap")})
    return _rows(spark, d).select("l_orderkey", "l_linenumber", a.alias("action"))


@query("o224_soft_actions", f"WITH p AS (SELECT o_orderkey, 1 / (1 + exp(-(ln(x / (1 - x)) - ln(0.6::DOUBLE / 0.4::DOUBLE)) / 0.5)) AS s, 1 / (1 + exp(-(ln(y / (1 - y)) - ln(0.6::DOUBLE / 0.4::DOUBLE)) / 0.5)) AS a, 1 / (1 + exp(-(ln(w / (1 - w)) - ln(0.6::DOUBLE / 0.4::DOUBLE)) / 0.5)) AS l FROM {_PROB}) SELECT o_orderkey, round(1 - s, 6) AS deny, round(s * (1 - a), 6) AS review, round(s * a * (1 - l), 6) AS escalate, round(s * a * l, 6) AS allow FROM p")
def soft_actions(spark, d):
    sig = lambda i: 1.0 / (1.0 + F.exp(-F.get("z", F.lit(i))))
    p = L.soft_actions({"safe": sig(0), "approved": sig(1), "within_limit": sig(2)}, 0.6, 0.5)
    return _logits(spark, d).select("o_orderkey", *[R(c).alias(n) for n, c in p.items()])


@query("o225_event_logit", f"WITH z AS (SELECT o_orderkey, 4 * {unit_sql("'x:' || o_orderkey")} - 2 AS a, 4 * {unit_sql("'y:' || o_orderkey")} - 2 AS b, 4 * {unit_sql("'w:' || o_orderkey")} - 2 AS c FROM orders) SELECT o_orderkey, round(ln(exp(a) + exp(c)) - b, 6) AS logit FROM z")
def event_logit(spark, d):
    labels = F.array(F.lit("yes"), F.lit("no"), F.lit("partly"))
    return _logits(spark, d).select("o_orderkey", R(L.event_logit(F.col("z"), labels, ["yes", "partly"])).alias("logit"))


@query("o226_siblings", "SELECT o_custkey, count(*) AS n FROM (SELECT o_custkey, [o_orderstatus, o_orderpriority] AS a FROM orders) x WHERE a = list_reverse(list_reverse(a)) GROUP BY o_custkey")
def sibling_presentations(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.array("o_orderstatus", "o_orderpriority").alias("a"))
    twin = x.select(F.col("o_orderkey").alias("k"), F.reverse("a").alias("b"))
    return x.join(twin, F.col("o_orderkey") == F.col("k")).where(F.col("a") == F.reverse("b")).groupBy("o_custkey").agg(F.count("*").alias("n"))


_STATE = "CASE event_type WHEN 'purchase' THEN 'true' WHEN 'view' THEN 'false' WHEN 'click' THEN 'conflict' ELSE 'missing' END"


@query("o227_three_valued_rules", f"SELECT event_id, CASE WHEN s = 'conflict' THEN 'conflict' WHEN s = 'true' AND value > 50 THEN 'true' WHEN s = 'missing' AND value > 50 THEN 'missing' ELSE 'false' END AS both FROM (SELECT event_id, value, {_STATE} AS s FROM events)".replace("AS both", "AS verdict"))
def three_valued_rules(spark, d):
    s = F.when(F.col("event_type") == "purchase", "true").when(F.col("event_type") == "view", "false").when(F.col("event_type") == "click", "conflict").otherwise("missing")
    rule = {"op": "all", "args": [{"op": "fact", "id": "s"}, {"op": "not", "arg": {"op": "fact", "id": "small"}}]}
    small = F.when(F.col("value") > 50, "false").otherwise("true")
    return table(spark, d, "events").select("event_id", L.boolean_rule(rule, {"s": s, "small": small}).alias("verdict"))


@query("o228_fact_states", "SELECT l_orderkey, l_suppkey % 3 AS fact, CASE WHEN min(l_returnflag) = max(l_returnflag) THEN 'known' ELSE 'conflict' END AS state, CASE WHEN min(l_returnflag) = max(l_returnflag) THEN min(l_returnflag) END AS value FROM lineitem GROUP BY ALL")
def fact_states(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 3).alias("fact"), "l_returnflag")
    return L.fact_states(x, "l_orderkey", "fact", "l_returnflag")


def _resolved():
    v = lambda c: F.when(c, "true").otherwise("false")
    return L.resolution({"a": v(F.col("big")), "b": v(F.col("late"))}), L.resolution({"a": v(F.col("big")), "b": F.when(F.col("late"), "missing").otherwise("false")})


@query("o229_resolution", f"SELECT l_orderkey, l_linenumber, CASE WHEN big AND late THEN 'invalid' WHEN big OR late THEN 'resolved' ELSE 'unresolved' END AS status, CASE WHEN big AND late THEN NULL WHEN big THEN 'a' WHEN late THEN 'b' END AS output FROM {_F}")
def resolution(spark, d):
    (status, output), _ = _resolved()
    return _rows(spark, d).select("l_orderkey", "l_linenumber", status.alias("status"), output.alias("output"))


@query("o230_transition", f"SELECT l_orderkey, l_linenumber, CASE WHEN big AND late THEN 'invalid' WHEN late THEN 'resolution_loss' ELSE 'no_change' END AS what FROM {_F}")
def transition(spark, d):
    full, removed = _resolved()
    return _rows(spark, d).select("l_orderkey", "l_linenumber", L.transition(full, removed).alias("what"))


@query("o231_rule_order", f"SELECT l_orderkey, l_linenumber, CASE WHEN cheap THEN 'c' WHEN big THEN 'b' WHEN late THEN 'l' ELSE 'none' END AS first FROM {_F}")
def rule_order(spark, d):
    return _rows(spark, d).select("l_orderkey", "l_linenumber", L.precedence([(F.col("cheap"), "c"), (F.col("big"), "b"), (F.col("late"), "l")], "none").alias("first"))


@query("o232_micro_program", "SELECT o_orderkey, o_orderstatus = 'O' AS same, o_totalprice <= 100000 AS small, o_orderdate <= TIMESTAMP '1995-06-30' AS early FROM orders")
def micro_program(spark, d):
    return table(spark, d, "orders").select("o_orderkey", L.micro_program("eq", F.col("o_orderstatus"), F.lit("O")).alias("same"), L.micro_program("lte", F.col("o_totalprice"), F.lit(100000)).alias("small"), L.micro_program("before_or_on", F.col("o_orderdate"), F.lit("1995-06-30").cast("timestamp_ntz")).alias("early"))


@query("o233_clauses", "SELECT l_orderkey, l_linenumber, l_linenumber * 2 >= 3 * l_suppkey % 7 AS fraction, round(l_quantity, 2)::DECIMAL(18,2) + round(l_tax, 2)::DECIMAL(18,2) - 1 >= 20 AS money, l_linenumber + 3 >= 5 AS ledger FROM lineitem")
def clauses(spark, d):
    dec = lambda c: F.round(c, 2).cast("decimal(18,2)").cast("decimal(38,6)")
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber",
        L.clause("fraction", {"num": n, "den": F.lit(1), "threshold_num": 3 * F.col("l_suppkey") % 7, "threshold_den": F.lit(2)}).alias("fraction"),
        L.clause("decimal", {"credits": F.array(dec("l_quantity"), dec("l_tax")), "fee": F.lit(1), "threshold": F.lit(20)}).alias("money"),
        L.clause("ledger", {"deltas": F.array(n.cast("long"), F.lit(3).cast("long")), "threshold": F.lit(5)}).alias("ledger"),
    )


@query("o234_partition_signature", "WITH t AS (SELECT row_number() OVER (ORDER BY big, cheap, late) AS i, " + _FIRST + " AS a FROM (VALUES (false), (true)) x(big), (VALUES (false), (true)) y(cheap), (VALUES (false), (true)) z(late)), r AS (SELECT a, row_number() OVER (ORDER BY min(i)) - 1 AS k FROM t GROUP BY a) SELECT string_agg(k::VARCHAR, ',' ORDER BY i) AS signature FROM t JOIN r USING (a)")
def signature(spark, d):
    return spark.createDataFrame([(L.partition_signature(L.compile_policy(PRIORITY)),)], "signature string")


@query("o111_policy_panel", f"WITH g AS (SELECT *, {_FIRST} AS gold, CASE WHEN big AND NOT cheap THEN 'review({{}})' WHEN cheap THEN 'skip({{}})' WHEN late THEN 'chase({{\"days\":3}})' ELSE 'keep({{}})' END AS said FROM {_F}) SELECT count(*) AS n, round(avg((gold = said)::INT), 6) AS exact, count_if(gold <> said AND late AND cheap) AS composition FROM g")
def policy_panel(spark, d):
    """A policy against one with two rules exchanged: exact outcomes and where they differ."""
    a, _ = L.executed(L.compile_policy(PRIORITY), _fields("big", "cheap", "late"))
    other = dict(PRIORITY, rules=[PRIORITY["rules"][0], PRIORITY["rules"][2], PRIORITY["rules"][1]])
    b, _ = L.executed(L.compile_policy(other), _fields("big", "cheap", "late"))
    x = _rows(spark, d).withColumn("gold", a).withColumn("said", b)
    return x.agg(F.count("*").alias("n"), R(F.avg((F.col("gold") == F.col("said")).cast("int"))).alias("exact"), F.count_if((F.col("gold") != F.col("said")) & F.col("late") & F.col("cheap")).alias("composition"))


@query("o109_causal_panel", f"WITH c AS (SELECT l_orderkey, count(*) AS n, bool_and(big = (l_linenumber % 2 = 0)) AS every, avg((big = (l_linenumber % 2 = 0))::INT) AS acc FROM (SELECT *, l_linenumber FROM {_F}) GROUP BY l_orderkey) SELECT count(*) AS views, round(avg(every::INT), 6) AS complete, round(avg(acc), 6) AS clause_acc FROM c".replace("SELECT *, l_linenumber FROM", "SELECT * FROM"))
def causal_panel(spark, d):
    hit = F.col("big") == (F.col("l_linenumber") % 2 == 0)
    views = _rows(spark, d).groupBy("l_orderkey").agg(F.bool_and(hit).alias("every"), F.avg(hit.cast("int")).alias("acc"))
    return views.agg(F.count("*").alias("views"), R(F.avg(F.col("every").cast("int"))).alias("complete"), R(F.avg("acc")).alias("clause_acc"))


@query("o115_control_margins", "WITH m AS (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS a, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS b, max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS c FROM orders GROUP BY o_custkey) SELECT round(avg(a - b), 2) AS shuffled, round(avg(a - c), 2) AS missing, round(avg((a > b)::INT), 6) AS positive FROM m")
def control_margins(spark, d):
    m = table(spark, d, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["O", "F", "P"]).agg(F.max("o_totalprice"))
    return m.agg(F.round(F.avg(F.col("O") - F.col("F")), 2).alias("shuffled"), F.round(F.avg(F.col("O") - F.col("P")), 2).alias("missing"), R(F.avg((F.col("O") > F.col("F")).cast("int"))).alias("positive"))
