"""Rule policies: compiled conditions, truth tables, outcome distributions, three-valued rules."""

from __future__ import annotations

import json
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Limits of a policy.
FIELDS, DEPTH, NODES, ARITY = (2, 12), 32, 1024, 64


def exception(base: Column, but: Column) -> Column:
    return base & ~but


def precedence(rules: list[tuple[Column, str]], default: str) -> Column:
    """The first rule that holds, in the given order."""
    out = None
    for when, then in rules:
        out = F.when(when, then) if out is None else out.when(when, then)
    return F.lit(default) if out is None else out.otherwise(default)


def chain(first: Column, steps: list[tuple[str, Column]]) -> Column:
    """Folded from the left."""
    for op, c in steps:
        first = first & c if op == "and" else first | c
    return first


def canonical_action(action: dict | str | None) -> str | None:
    """Name and compact payload with sorted keys."""
    if action is None:
        return None
    action = {"name": action} if isinstance(action, str) else action
    return action["name"] + "(" + json.dumps(action.get("payload", {}), sort_keys=True, separators=(",", ":"), ensure_ascii=False) + ")"


@dataclass(frozen=True)
class Policy:
    fields: tuple[str, ...]
    mode: str
    rules: tuple[tuple[object, str, int | None], ...]  # condition, action, rank
    fallback: str | None

    def outcome(self, truth: dict[str, bool]) -> tuple[str | None, tuple[str, ...]]:
        """Primary action and all actions under one assignment."""
        held = [(a, r) for c, a, r in self.rules if _holds(c, truth)]
        if self.mode == "priority":
            action = held[0][0] if held else self.fallback
            return action, (action,)
        if not held:
            return (self.fallback, (self.fallback,)) if self.fallback is not None else (None, ())
        ranked = [x for x in held if x[1] is not None]
        return (min(ranked, key=lambda x: x[1])[0] if ranked else None), tuple(sorted({a for a, _ in held}))

    def table(self) -> list[tuple[dict[str, bool], tuple]]:
        """Outcomes of all assignments, at most 4096."""
        return [(t, self.outcome(t)) for bits in product((False, True), repeat=len(self.fields)) for t in [dict(zip(self.fields, bits))]]


def _holds(c, truth: dict[str, bool]) -> bool:
    op, x = c
    return truth[x] if op == "field" else x if op == "const" else not _holds(x, truth) if op == "not" else (all if op == "all" else any)(_holds(y, truth) for y in x)


def compile_policy(program: dict) -> Policy:
    """A checked policy; ValueError for anything out of form, beyond the limits, or with a rule that can never fire."""
    fields = tuple(program["fields"])
    if not FIELDS[0] <= len(fields) <= FIELDS[1] or len(set(fields)) != len(fields):
        raise ValueError("2 to 12 different fields")
    if program["mode"] not in ("priority", "collect"):
        raise ValueError("mode is priority or collect")
    used: set[str] = set()
    nodes = 0

    def condition(value, depth: int = 0):
        nonlocal nodes
        nodes += 1
        if depth > DEPTH or nodes > NODES:
            raise ValueError("conditions beyond the limits")
        if not isinstance(value, dict) or len(value) != 1:
            raise ValueError("a condition has one operator")
        ((op, x),) = value.items()
        if op == "field":
            if x not in fields:
                raise ValueError(f"no field {x!r}")
            used.add(x)
            return op, x
        if op == "const" and isinstance(x, bool):
            return op, x
        if op == "not":
            return op, condition(x, depth + 1)
        if op in ("all", "any") and isinstance(x, list) and 0 < len(x) <= ARITY:
            return op, tuple(condition(y, depth + 1) for y in x)
        raise ValueError(f"no condition {op!r}")

    rules = tuple((condition(r["when"]), canonical_action(r["action"]), r.get("primary_rank")) for r in program["rules"])
    policy = Policy(fields, program["mode"], rules, canonical_action(program.get("fallback")))
    if policy.mode == "priority" and policy.fallback is None:
        raise ValueError("a priority policy has a fallback")
    if used != set(fields):
        raise ValueError("every field is used")
    fired: set[int] = set()
    for truth, _ in policy.table():
        held = [i for i, (c, _, _) in enumerate(rules) if _holds(c, truth)]
        fired.update(held[:1] if policy.mode == "priority" else held)
    if fired != set(range(len(rules))):
        raise ValueError("every rule can fire")
    return policy


def condition_column(c, fields: dict[str, Column]) -> Column:
    op, x = c
    if op == "field":
        return fields[x]
    if op == "const":
        return F.lit(x)
    if op == "not":
        return ~condition_column(x, fields)
    parts = [condition_column(y, fields) for y in x]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if op == "all" else out | p
    return out


def executed(policy: Policy, fields: dict[str, Column]) -> tuple[Column, Column]:
    """Primary action and sorted actions of each row, as expressions."""
    held = [(condition_column(c, fields), a, r) for c, a, r in policy.rules]
    none = F.lit(policy.fallback).cast("string")
    if policy.mode == "priority":
        action = precedence([(c, a) for c, a, _ in held], policy.fallback)
        return action, F.array(action)
    actions = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(c, a) for c, a, _ in held]), lambda x: x.isNotNull())))
    ranked = F.array_min(F.filter(F.array(*[F.when(c, F.struct(F.lit(r).alias("r"), F.lit(a).alias("a"))) for c, a, r in held if r is not None] or [F.lit(None).cast("struct<r:int,a:string>")]), lambda x: x.isNotNull()))["a"]
    back = F.array(none) if policy.fallback is not None else F.array().cast("array<string>")
    return F.when(F.size(actions) == 0, none).otherwise(ranked), F.when(F.size(actions) == 0, back).otherwise(actions)


def truth_table(spark: SparkSession, policy: Policy) -> DataFrame:
    """(assignment, primary, actions): 2**n rows."""
    rows = [([t[f] for f in policy.fields], o[0], list(o[1])) for t, o in policy.table()]
    return spark.createDataFrame(rows, "assignment array<boolean>, primary string, actions array<string>")


def outcome_distribution(rows: DataFrame, policy: Policy, logits: str, key: str) -> DataFrame:
    """(key, primary, actions, logp): exact probabilities of outcomes when field i is true with sigmoid(logits[i]), independently.

    The truth table (at most 4096 assignments) is an array in the plan; log-sum-exp by outcome.
    """
    table = truth_table(rows.sparkSession, policy)
    crossed = rows.select(key, logits).join(F.broadcast(table))  # at most 4096 rows
    log_sigmoid = lambda z: -F.when(z > 0, F.log1p(F.exp(-z))).otherwise(-z + F.log1p(F.exp(z)))
    logp = F.aggregate(F.zip_with(logits, "assignment", lambda z, t: log_sigmoid(F.when(t, z).otherwise(-z))), F.lit(0.0), lambda a, x: a + x)
    parts = crossed.select(key, "primary", "actions", logp.alias("l"))
    top = parts.groupBy(key, "primary", "actions").agg(F.max("l").alias("m"), F.collect_list("l").alias("ls"))  # at most 4096 numbers
    return top.select(key, "primary", "actions", (F.col("m") + F.ln(F.aggregate("ls", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("m"))))).alias("logp"))


def outcome_losses(dist: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """(key, nll, primary_nll, brier) against gold (key, gold_primary, gold_actions); an impossible gold has infinite nll."""
    p = F.exp("logp")
    joined = dist.join(gold, key)
    hit = F.col("primary").eqNullSafe(F.col("gold_primary")) & (F.col("actions") == F.col("gold_actions"))
    out = joined.groupBy(key).agg(F.sum(F.when(hit, p).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("primary").eqNullSafe(F.col("gold_primary")), p).otherwise(0.0)).alias("q"), F.sum(p * p).alias("s"))
    return out.select(key, (-F.ln("p")).alias("nll"), (-F.ln("q")).alias("primary_nll"), (F.col("s") - 2 * F.col("p") + 1).alias("brier"))


def action_rule(fields: dict[str, Column]) -> Column:
    """Unsafe: deny; not approved, or any other field false: review; over the limit: escalate; else allow."""
    others = [c for n, c in fields.items() if n not in ("safe", "approved", "within_limit")]
    review = ~fields["approved"]
    for c in others:
        review = review | ~c
    out = F.when(~fields["safe"], "deny").when(review, "review")
    return (out.when(~fields["within_limit"], "escalate") if "within_limit" in fields else out).otherwise("allow")


def soft_actions(truth: dict[str, Column], threshold: float, temperature: float) -> dict[str, Column]:
    """Probabilities of the four actions of action_rule, with each field's truth probability as a logit against the threshold."""
    base = F.lit(threshold / (1 - threshold))
    p = {n: 1.0 / (1.0 + F.exp(-(F.ln(c / (1 - c)) - F.ln(base)) / temperature)) for n, c in truth.items()}
    good = p["approved"]
    for n, c in p.items():
        if n not in ("safe", "approved", "within_limit"):
            good = good * c
    limit = p.get("within_limit", F.lit(1.0))
    return {"deny": 1 - p["safe"], "review": p["safe"] * (1 - good), "escalate": p["safe"] * good * (1 - limit), "allow": p["safe"] * good * limit}


def event_logit(scores: Column, labels: Column, positive: list[str]) -> Column:
    """log-sum-exp of the positive labels' scores minus that of the others."""
    def lse(want: bool) -> Column:
        some = F.filter(F.zip_with(scores, labels, lambda s, l: F.when(l.isin(positive) == want, s)), lambda s: s.isNotNull())
        return F.array_max(some) + F.ln(F.aggregate(some, F.lit(0.0), lambda a, s: a + F.exp(s - F.array_max(some))))

    return lse(True) - lse(False)


MISSING, CONFLICT = "missing", "conflict"


def three_valued(node: dict, env: dict[str, object]):
    """A rule over typed facts: (type, unit, value), MISSING or CONFLICT. A conflict wins over all, then a decisive operand, then a missing one."""
    op = node["op"]
    truth = lambda v: v if v in (MISSING, CONFLICT) or isinstance(v, bool) else v[2] if v[0] == "boolean" else CONFLICT
    if op == "fact":
        return env.get(node["id"], MISSING)
    if op == "const":
        return node["type"], node.get("unit"), node["value"]
    if op in ("all", "any"):
        values = [truth(three_valued(a, env)) for a in node["args"]]
        decisive = op == "any"
        return CONFLICT if CONFLICT in values else decisive if decisive in values else MISSING if MISSING in values else not decisive
    if op == "not":
        v = truth(three_valued(node["arg"], env))
        return v if v in (MISSING, CONFLICT) else not v
    if op == "count_true":
        values = [truth(three_valued(a, env)) for a in node["args"]]
        return CONFLICT if CONFLICT in values else MISSING if MISSING in values else ("integer", None, Fraction(sum(v is True for v in values)))
    names = ("numerator", "denominator") if op == "ratio" else ("left", "right")
    a, b = (three_valued(node[n], env) for n in names)
    if CONFLICT in (a, b) or isinstance(a, bool) or isinstance(b, bool):
        return CONFLICT
    if MISSING in (a, b):
        return MISSING
    numeric = {a[0], b[0]} <= {"integer", "decimal"}
    if op == "ratio":
        return ("decimal", None, Fraction(a[2]) / Fraction(b[2])) if numeric and a[1] == b[1] and b[2] != 0 else CONFLICT
    if a[1] != b[1] or not (numeric or (op == "eq" and a[0] == b[0])):
        return CONFLICT
    return {"eq": a[2] == b[2], "lt": a[2] < b[2], "le": a[2] <= b[2], "gt": a[2] > b[2], "ge": a[2] >= b[2]}[op]


def boolean_rule(node: dict, facts: dict[str, Column]) -> Column:
    """The same for boolean facts as columns of text ``true``, ``false``, ``missing`` or ``conflict``."""
    op = node["op"]
    if op == "fact":
        return F.coalesce(facts[node["id"]], F.lit(MISSING))
    if op == "not":
        v = boolean_rule(node["arg"], facts)
        return F.when(v == "true", "false").when(v == "false", "true").otherwise(v)
    values = F.array(*[boolean_rule(a, facts) for a in node["args"]])
    decisive = "true" if op == "any" else "false"
    return F.when(F.array_contains(values, CONFLICT), CONFLICT).when(F.array_contains(values, decisive), decisive).when(F.array_contains(values, MISSING), MISSING).otherwise("false" if op == "any" else "true")


def fact_states(observations: DataFrame, case: str, fact: str, value: str) -> DataFrame:
    """(case, fact, state, value): conflict where values differ, else the value; a fact without a row is missing."""
    g = observations.where(F.col(value).isNotNull()).groupBy(case, fact).agg(F.min(value).alias("a"), F.max(value).alias("b"))
    return g.select(case, fact, F.when(F.col("a") == F.col("b"), "known").otherwise(CONFLICT).alias("state"), F.when(F.col("a") == F.col("b"), F.col("a")).alias("value"))


def resolution(outputs: dict[str, Column]) -> tuple[Column, Column]:
    """Status and output of a decision whose rules are four-valued texts."""
    values = F.array(*outputs.values())
    trues = F.size(F.filter(values, lambda v: v == "true"))
    falses = F.size(F.filter(values, lambda v: v == "false"))
    status = F.when(F.array_contains(values, CONFLICT) | (trues > 1), "invalid").when((trues == 1) & (falses == len(outputs) - 1), "resolved").otherwise("unresolved")
    return status, F.when(status == "resolved", precedence([(c == "true", n) for n, c in outputs.items()], ""))


def transition(full: tuple[Column, Column], removed: tuple[Column, Column]) -> Column:
    """What taking evidence away does: nothing, a loss of the resolution, or something invalid."""
    (a, x), (b, y) = full, removed
    return (
        F.when((a == "invalid") | (b == "invalid"), "invalid").when((a == "resolved") & (b == "resolved"), F.when(x == y, "no_change").otherwise("invalid"))
        .when((a == "resolved") & (b == "unresolved"), "resolution_loss").when((a == b) & x.eqNullSafe(y), "no_change").otherwise("invalid")
    )


def clause(kind: str, c: dict[str, Column]) -> Column:
    """Executable clauses over columns; exact decimals and cross-multiplied fractions."""
    if kind == "decimal":
        return F.aggregate(c["credits"], F.lit(Decimal(0)).cast("decimal(38,6)"), lambda a, x: (a + x).cast("decimal(38,6)")) - c["fee"] >= c["threshold"]
    if kind == "ledger":
        return F.aggregate(c["deltas"], F.lit(0).cast("long"), lambda a, x: a + x) >= c["threshold"]
    if kind == "fraction":
        return c["num"] * c["threshold_den"] >= c["threshold_num"] * c["den"]
    if kind == "datetime":
        return F.to_utc_timestamp(c["local"], c["zone"]) <= c["deadline"]
    if kind == "conditional":
        return c["success"] * c["threshold_den"] >= c["threshold_num"] * (c["success"] + c["failure"])
    if kind == "policy":
        best = F.array_max(F.transform(F.filter(c["rules"], lambda r: r["active"]), lambda r: F.struct(r["priority"].alias("p"), (r["effect"] == "deny").alias("d"), r["effect"].alias("e"))))
        return F.coalesce(best["e"] == "allow", F.lit(False))
    raise ValueError(kind)


def micro_program(op: str, a: Column, b: Column) -> Column:
    if op == "eq":
        return a == b
    if op in ("lte", "before_or_on"):
        return a <= b
    if op in ("gte_probability", "gte_rank"):
        return a >= b
    raise ValueError(op)


def partition_signature(policy: Policy) -> str:
    """The truth table's outcomes as numbers in order of first occurrence: names don't matter."""
    seen: dict[tuple, int] = {}
    return ",".join(str(seen.setdefault(o, len(seen))) for _, o in policy.table())
