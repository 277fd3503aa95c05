"""Workflow families: generated cases whose answers follow from a stated rule, by hashed draws of a row's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import hashing

ACTIONS = ("allow", "deny", "review", "escalate")
LEVELS = ("low", "medium", "high", "critical")
FIELDS = (("age", 18, 60), ("monthly income", 1000, 5000), ("years of service", 0, 20))
FORM = ("name", "address", "date of birth", "signature")
DESKS = ("billing", "technical", "sales", "other", "priority")
TOOLS = ("search", "calculator", "calendar", "none")
COLOURS = ("red", "green", "blue", "white", "black")


def _pick(u: Column, n: int) -> Column:
    return F.floor(u * n).cast("int")


def _named(at: Column, names: tuple[str, ...]) -> Column:
    return F.get(F.array(*[F.lit(x) for x in names]), at)


def _joined(*parts: Column | str) -> Column:
    return F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def families(key: Column, seed: str) -> list[tuple[str, str, Column, str, tuple[str, ...], Column]]:
    """(family, question type, state, question, options, place of the right one) for a row's key. What a state doesn't establish counts as unmet."""
    u = lambda tag: hashing.unit(f"{seed}{tag}", key)
    met = [u(f"met{i}") < 0.8 for i in range(3)]
    forbidden, trigger, all_met = u("forbidden") < 0.2, u("trigger") < 0.2, met[0] & met[1] & met[2]
    shown = [F.format_string(f"Requirement {i + 1} is %s.", F.when(m, "shown").otherwise("not shown")) for i, m in enumerate(met)]
    prohibition = F.when(forbidden, "A prohibition applies.").otherwise("No prohibition applies.")
    triggered = F.when(trigger, "An escalation trigger applies.").otherwise("No escalation trigger applies.")
    values = [F.when(u(f"none{i}") < 0.85, low + _pick(u(f"value{i}"), span)) for i, (_, low, span) in enumerate(FIELDS)]
    least = [low + _pick(u(f"least{i}") / 2, span) for i, (_, low, span) in enumerate(FIELDS)]
    known = [F.when(v.isNotNull(), F.concat(F.lit(f"The {name} is "), v.cast("string"), F.lit("."))) for (name, _, _), v in zip(FIELDS, values)]
    needed = [F.concat(F.lit(f"The {name} must be at least "), n.cast("string"), F.lit(".")) for (name, _, _), n in zip(FIELDS, least)]
    eligible = F.lit(True)
    for v, n in zip(values, least):
        eligible = eligible & F.coalesce(v >= n, F.lit(False))
    impact, reach = _pick(u("impact"), 4), _pick(u("reach"), 4)
    hours = _pick(u("hours"), 96)
    filled = [u(f"field{i}") < 0.85 for i in range(len(FORM))]
    present = [F.when(f, name) for f, name in zip(filled, FORM)]
    said, record, unstated = _pick(u("said"), 5), _pick(u("record"), 2), u("unstated") < 0.3
    recorded = F.when(record == 0, said).otherwise((said + 1) % 5)
    topic, vip = _pick(u("topic"), 4), u("vip") < 0.15
    tool, colour = _pick(u("tool"), len(TOOLS)), _pick(u("colour"), len(COLOURS))
    task = _named(tool, ("find a page about tides", "add up three prices", "book a room on Monday", "say hello"))
    yes = ("no", "yes")
    return [
        ("permit", "noul", _joined(*shown, prohibition), "Is the requested action allowed?", yes, (all_met & ~forbidden).cast("int")),
        ("action", "choice", _joined(*shown, prohibition, triggered), "Which action follows?", ACTIONS, F.when(forbidden, 1).when(trigger, 3).when(~all_met, 2).otherwise(0)),
        ("eligibility", "noul", _joined(*needed, *known), "Is the applicant eligible?", yes, eligible.cast("int")),
        ("severity", "score", _joined("Impact", impact.cast("string"), "of 3, reach", reach.cast("string"), "of 3; severity is their mean, rounded down."), "How severe is it?", LEVELS, F.floor((impact + reach) / 2).cast("int")),
        ("urgency", "score", _joined("Due in", hours.cast("string"), "hours; under 4 is critical, under 24 high, under 72 medium."), "How urgent is it?", LEVELS, F.when(hours < 4, 3).when(hours < 24, 2).when(hours < 72, 1).otherwise(0)),
        ("completeness", "noul", _joined("Required: " + ", ".join(FORM) + ". Given:", F.concat_ws(", ", *present)), "Is the form complete?", yes, (filled[0] & filled[1] & filled[2] & filled[3]).cast("int")),
        ("support", "choice", _joined("Claim: the box is", _named(said, COLOURS), F.when(~unstated, F.concat(F.lit("; record: the box is "), _named(recorded, COLOURS)))), "Does the record support the claim?", ("supported", "contradicted", "unstated"), F.when(unstated, 2).when(record == 0, 0).otherwise(1)),
        ("routing", "choice", _joined("A", _named(topic, DESKS), "question", F.when(vip, "from a key account; those go to the priority desk")), "Which desk takes it?", DESKS, F.when(vip, 4).otherwise(topic)),
        ("tool", "choice", _joined("Please", task), "Which tool is needed?", TOOLS, tool),
        ("extract", "choice", _joined("The ordered colour is", _named(colour, COLOURS)), "Which colour was ordered?", COLOURS, colour),
    ]


def generated(rows: DataFrame, key: str, seed: str = "") -> DataFrame:
    """(key, family, qtype, state, question, options, label): for each key a row of each family. A map over keys, without any shuffle."""
    made = [
        F.struct(F.lit(f).alias("family"), F.lit(t).alias("qtype"), state.alias("state"), F.lit(q).alias("question"), F.array(*[F.lit(o) for o in options]).alias("options"), label.cast("int").alias("label"))
        for f, t, state, q, options, label in families(F.col(key), seed)
    ]
    return rows.select(key, F.explode(F.array(*made)).alias("x")).select(key, "x.*")
