"""Queries of row generators and augmentations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, libm, probs as P, text as T
from ..operators import augment as A
from .catalog import query, table, unit_sql
from .fixtures import DECISIONS_SQL, R, decisions, rounded

_W = f"WITH {DECISIONS_SQL}, c AS (SELECT *, list_transform(range(0, k), lambda i: 'c' || i) AS candidates FROM decisions)"


def _candidates(spark, d):
    return decisions(spark, d).withColumn("candidates", F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.concat(F.lit("c"), i.cast("string"))))


@query("o166_option_shuffle", f"{_W}, o AS (SELECT *, list_transform(list_sort(list_transform(range(0, k), lambda i: {{'h': sha256('sh:' || row_id || ':' || i), 'i': i}})), lambda s: s.i) AS ord FROM c) SELECT row_id, list_transform(ord, lambda i: candidates[i + 1]) AS candidates, CASE WHEN label >= 0 THEN list_position(ord, label) - 1 ELSE label END AS label FROM o")
def option_shuffle(spark, d):
    return A.shuffled(_candidates(spark, d), "row_id", ["candidates"], "label", "sh").select("row_id", "candidates", "label")


@query("o167_k_null_scheme", f"SELECT doc_id, CASE WHEN u < 0.4 THEN 3 WHEN u < 0.7 THEN 10 WHEN u < 0.9 THEN 50 ELSE 77 END AS k, v < 0.15 AS absent FROM (SELECT doc_id, {unit_sql("'k:' || doc_id")} AS u, {unit_sql("'n:' || doc_id")} AS v FROM documents)")
def k_null_scheme(spark, d):
    u, v = hashing.unit("k", F.col("doc_id")), hashing.unit("n", F.col("doc_id"))
    return table(spark, d, "documents").select("doc_id", F.when(u < 0.4, 3).when(u < 0.7, 10).when(u < 0.9, 50).otherwise(77).alias("k"), (v < 0.15).alias("absent"))


@query("o168_null_synth", f"{_W}, t AS (SELECT row_id, list_filter(list_transform(range(0, k), lambda i: CASE WHEN i = label THEN NULL ELSE probs[i + 1] END), lambda x: x IS NOT NULL) AS p FROM c WHERE label >= 0 AND k > 2) SELECT row_id, list_transform(p, lambda x: round(x / list_sum(p), 6)) AS target FROM t")
def null_synth(spark, d):
    kept = F.filter(F.transform(P.candidates(F.col("probs")), lambda x, i: F.when(i != F.col("label"), x)), lambda x: x.isNotNull())
    x = libm.softmax(decisions(spark, d).where("label >= 0 AND k > 2").select("row_id", "label", F.col("logits").alias("probs")), "probs").withColumn("kept", kept)
    return x.select("row_id", rounded(P.shares(F.col("kept"))).alias("target"))


@query("o169_siblings", "WITH t AS (SELECT DISTINCT p_type, unnest(string_split(lower(p_type), ' ')) AS w FROM part) SELECT DISTINCT a.p_type AS a, b.p_type AS b FROM t a JOIN t b ON a.w = b.w AND a.p_type <> b.p_type")
def siblings(spark, d):
    t = table(spark, d, "part").select("p_type").distinct().select("p_type", F.explode(F.split(F.lower("p_type"), " ")).alias("w"))
    return t.withColumnRenamed("p_type", "a").join(t.withColumnRenamed("p_type", "b"), "w").where("a <> b").select("a", "b").distinct()


@query("o170_near_miss", f"{_W} SELECT row_id, CASE WHEN row_id % 2 = 0 THEN -1 ELSE k - 1 END AS label, CASE WHEN row_id % 2 = 0 THEN ['sibling', 'c1'] ELSE list_concat(['sibling'], candidates[2:k]) END AS candidates FROM c WHERE label = 0")
def near_miss(spark, d):
    x = _candidates(spark, d).where("label = 0")
    even = F.col("row_id") % 2 == 0
    cands = F.when(even, F.array(F.lit("sibling"), F.lit("c1"))).otherwise(F.concat(F.array(F.lit("sibling")), F.slice("candidates", F.lit(2), F.col("k") - 1)))
    return x.select("row_id", F.when(even, -1).otherwise(F.col("k") - 1).alias("label"), cands.alias("candidates"))


@query("o171_irrelevant_questions", "WITH r AS (SELECT conv_id, turn, lead(conv_id) OVER (PARTITION BY role ORDER BY conv_id, turn) AS other FROM conversations) SELECT conv_id, turn, other FROM r WHERE other <> conv_id")
def irrelevant_questions(spark, d):
    from pyspark.sql import Window as W

    return table(spark, d, "conversations").withColumn("other", F.lead("conv_id").over(W.partitionBy("role").orderBy("conv_id", "turn"))).where("other <> conv_id").select("conv_id", "turn", "other")


_VARIANTS = f"{_W}, g AS (SELECT row_id, label, k, candidates, candidates[1] AS f FROM c WHERE label >= 0), v AS (SELECT row_id, 'base' AS variant, candidates, label FROM g UNION ALL SELECT row_id, 'add_irr', list_append(candidates, 'irr'), label FROM g UNION ALL SELECT row_id, 'remove_gold', list_filter(candidates, lambda x: x <> candidates[label + 1]), -1 FROM g UNION ALL SELECT row_id, 'dup', list_append(candidates, f), label FROM g UNION ALL SELECT row_id, 'reorder', list_reverse(candidates), k - 1 - label FROM g UNION ALL SELECT row_id, 'near_dup', list_append(candidates, f || '.'), label FROM g)"


@query("o172_choice_set_variants", f"{_VARIANTS} SELECT row_id, variant, candidates, label FROM v")
def choice_set_variants(spark, d):
    return A.choice_set_variants(_candidates(spark, d).select("row_id", "candidates", "label"), F.lit("irr")).select("row_id", "variant", "candidates", "label")


_SCORED = f"{_VARIANTS}, z AS (SELECT row_id, variant, label, candidates, list_concat(list_transform(candidates, lambda x: round(3 * {unit_sql("'s:' || row_id || ':' || x")}, 6)), [1.0::DOUBLE]) AS z FROM v), p AS (SELECT * EXCLUDE (z), list_transform(z, lambda x: exp(x) / list_sum(list_transform(z, lambda y: exp(y)))) AS p FROM z)"


def _scored_variants(spark, d):
    x = A.choice_set_variants(_candidates(spark, d).select("row_id", "candidates", "label"), F.lit("irr"))
    z = F.concat(F.transform("candidates", lambda c: F.round(3 * hashing.unit("s", F.col("row_id"), c), 6)), F.array(F.lit(1.0)))
    return x.withColumn("p", P.softmax(z))


@query("o100_choice_set_effects", f"{_SCORED}, w AS (SELECT row_id, max(CASE WHEN variant = 'base' THEN p END) AS b, max(CASE WHEN variant = 'add_irr' THEN p END) AS a, max(CASE WHEN variant = 'remove_gold' THEN p END) AS r, max(CASE WHEN variant = 'dup' THEN p END) AS u, max(CASE WHEN variant = 'reorder' THEN p END) AS o FROM p GROUP BY row_id) SELECT round(avg(a[-2]), 6) AS p_irr, round(avg(r[-1] - b[-1]), 6) AS dp_null, round(avg(abs(u[1] + u[-2] - b[1])), 6) AS mass_err, round(avg(abs(u[1] - u[-2])), 6) AS slot_gap, round(avg(list_max(list_transform(range(1, len(b)), lambda i: abs(b[i] - o[len(b) - i])))), 6) AS max_dp FROM w")
def choice_set_effects(spark, d):
    from ..operators.batteries import choice_set_effects as effects

    return effects(_scored_variants(spark, d), "row_id").select(*[R(c).alias(c) for c in ("p_irr", "dp_null", "mass_err", "slot_gap", "max_dp")])


@query("o101_counterfactual", f"{_SCORED}, j AS (SELECT variant, label, p, list_position(p, list_max(p)) - 1 AS pred, list_position(p[:-2], list_max(p[:-2])) - 1 AS among FROM p WHERE label >= 0) SELECT variant, count(*) AS n, round(avg((pred = label)::INT), 6) AS acc, round(avg((among = label)::INT), 6) AS among_k FROM j GROUP BY variant")
def counterfactual(spark, d):
    x = _scored_variants(spark, d).where("label >= 0")
    hit = lambda p: R(F.avg((P.argmax(p) == F.col("label")).cast("int")))
    return x.groupBy("variant").agg(F.count("*").alias("n"), hit(F.col("p")).alias("acc"), hit(P.candidates(F.col("p"))).alias("among_k"))


@query("o103_rubric_flip", f"{_W}, p AS (SELECT grp, row_id, label, list_position(probs[:-2], list_max(probs[:-2])) - 1 AS pred FROM c WHERE label >= 0), f AS (SELECT a.grp, b.row_id AS a, min(x.row_id) AS b FROM (SELECT grp, min(row_id) AS first FROM p GROUP BY grp) a JOIN p b ON b.row_id = a.first JOIN p x ON x.grp = a.grp AND x.label <> b.label GROUP BY ALL) SELECT count(*) AS pairs, round(avg((x.pred <> y.pred)::INT), 6) AS flip_rate, round(avg((x.pred = x.label AND y.pred = y.label)::INT), 6) AS both_correct FROM f JOIN p x ON f.a = x.row_id JOIN p y ON f.b = y.row_id")
def rubric_flip(spark, d):
    from ..operators.batteries import rubric_flip as flip

    x = decisions(spark, d).where("label >= 0").select("grp", "row_id", "label", P.argmax(P.candidates(F.col("probs"))).alias("pred"))
    return flip(x, "grp", "row_id").select("pairs", R("flip_rate").alias("flip_rate"), R("both_correct").alias("both_correct"))


@query("o173_k_sweep", f"{_W}, g AS (SELECT row_id, candidates[2:k] AS others, candidates[1] AS gold FROM c WHERE k >= 4), s AS (SELECT row_id, kk AS \"K\", present, CASE WHEN present THEN list_append(others[1:kk - 1], gold) ELSE others[1:kk] END AS candidates FROM g, (VALUES (2), (3)) x(kk), (VALUES (true), (false)) y(present)) SELECT row_id, \"K\", present, candidates, CASE WHEN present THEN \"K\" - 1 ELSE -1 END AS label FROM s WHERE len(candidates) = \"K\"")
def k_sweep(spark, d):
    x = _candidates(spark, d).where("k >= 4").select("row_id", F.slice("candidates", F.lit(2), F.col("k") - 1).alias("others"), F.get("candidates", F.lit(0)).alias("gold"))
    return A.k_sweep(x, F.col("others"), F.col("gold"), [2, 3]).select("row_id", "K", "present", "candidates", "label")


@query("o174_counterfactual_sets", f"{_W} SELECT row_id, list_filter(candidates, lambda x: x = candidates[label + 1] OR list_position(candidates, x) % 2 = 0) AS removed, list_concat(candidates, ['u1', 'u2', 'u3']) AS added, list_append(candidates, candidates[label + 1] || '.') AS near FROM c WHERE label >= 0")
def counterfactual_sets(spark, d):
    x = _candidates(spark, d).where("label >= 0").withColumn("gold", F.get("candidates", F.col("label")))
    return x.select("row_id", F.filter("candidates", lambda c, i: (c == F.col("gold")) | (i % 2 == 1)).alias("removed"), F.concat("candidates", F.array(*[F.lit(f"u{i}") for i in (1, 2, 3)])).alias("added"), F.concat("candidates", F.array(F.concat("gold", F.lit(".")))).alias("near"))


@query("o175_multi_set", f"{_W} SELECT row_id, i AS variant, CASE WHEN i = 0 THEN 'orig' WHEN i % 2 = 1 THEN 'invariance' ELSE 'set_context' END AS kind FROM c, range(0, 4) t(i)")
def multi_set(spark, d):
    i = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))
    x = decisions(spark, d).select("row_id", i.alias("variant"))
    return x.withColumn("kind", F.when(F.col("variant") == 0, "orig").when(F.col("variant") % 2 == 1, "invariance").otherwise("set_context"))


@query("o176_delta_targets", f"{_W}, t AS (SELECT row_id, candidates, list_transform(probs[:-2], lambda x: x / list_sum(probs[:-2])) AS o, list_transform(list_reverse(probs[:-2]), lambda x: x / list_sum(probs[:-2])) AS v FROM c), e AS (SELECT row_id, unnest(candidates) AS c, unnest(o) AS o, unnest(v) AS v, generate_subscripts(o, 1) AS i FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY o DESC, i) AS r FROM e) SELECT x.row_id, 'var' AS variant, x.c AS a, y.c AS b, round((ln(x.v) - ln(y.v)) - (ln(x.o) - ln(y.o)), 6) AS delta FROM r x JOIN r y ON x.row_id = y.row_id AND x.r < y.r AND y.r <= 2")
def delta_targets(spark, d):
    x = _candidates(spark, d).withColumn("t", P.over_labels(F.col("probs")))
    orig = x.select("row_id", F.lit("orig").alias("variant"), "candidates", F.col("t").alias("teacher"))
    var = x.select("row_id", F.lit("var").alias("variant"), "candidates", F.reverse("t").alias("teacher"))
    return A.delta_targets(orig.union(var), "row_id", 2).withColumn("delta", R("delta"))


@query("o177_null_copies", f"{_W}, x AS (SELECT row_id, label, candidates, false AS null_aug FROM c), n AS (SELECT row_id, -1 AS label, list_filter(candidates, lambda v: v <> candidates[label + 1] AND v NOT IN ('c4')) AS candidates, true AS null_aug FROM c WHERE label >= 0 AND {unit_sql("'nu:' || row_id")} < 0.3) SELECT * FROM x UNION ALL SELECT * FROM n WHERE len(candidates) >= 2")
def null_copies(spark, d):
    return A.null_copies(_candidates(spark, d).select("row_id", "label", "candidates"), "row_id", 0.3, "nu", ["c4"])


@query("o178_ordinal_smoothing", f"{_W}, e AS (SELECT row_id, list_transform(range(0, k), lambda j: exp(-abs(j - label) / 0.7::DOUBLE)) AS e FROM c WHERE label >= 0) SELECT row_id, list_transform(e, lambda x: round(x / list_sum(e), 6)) AS target FROM e")
def ordinal_smoothing(spark, d):
    return decisions(spark, d).where("label >= 0").select("row_id", rounded(A.ordinal_smoothed(F.col("k"), F.col("label"), 0.7)).alias("target"))


@query("o179_listwise", f"{_W} SELECT row_id, CASE WHEN u < 0.03 THEN list_append(candidates, candidates[1]) WHEN u < 0.08 THEN list_append(candidates, 'foreign') ELSE candidates END AS candidates FROM (SELECT *, {unit_sql("'lw:' || row_id")} AS u FROM c)")
def listwise(spark, d):
    u = hashing.unit("lw", F.col("row_id"))
    c = F.col("candidates")
    return _candidates(spark, d).select("row_id", F.when(u < 0.03, F.concat(c, F.array(F.get(c, F.lit(0))))).when(u < 0.08, F.concat(c, F.array(F.lit("foreign")))).otherwise(c).alias("candidates"))


@query("o180_no_evidence", f"{_W} SELECT row_id, task AS state, false AS blank FROM c UNION ALL SELECT row_id, '.', true FROM c WHERE {unit_sql("'ne:' || row_id")} < 0.03")
def no_evidence(spark, d):
    x = decisions(spark, d)
    return x.select("row_id", F.col("task").alias("state"), F.lit(False).alias("blank")).union(x.where(hashing.unit("ne", F.col("row_id")) < 0.03).select("row_id", F.lit("."), F.lit(True)))


@query("o181_shuffled_rubric", "SELECT conv_id, turn, CASE WHEN count(*) OVER (PARTITION BY conv_id) > 1 THEN coalesce(lead(role) OVER (PARTITION BY conv_id ORDER BY turn), first(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) END AS rotated FROM conversations")
def shuffled_rubric(spark, d):
    return A.rotated(table(spark, d, "conversations"), ["conv_id"], "turn", "role").select("conv_id", "turn", "rotated")


@query("o182_soft_merge", "WITH n AS (SELECT l_partkey AS key, count_if(l_returnflag = 'A')::DOUBLE AS a, count_if(l_returnflag = 'N')::DOUBLE AS n, count_if(l_returnflag = 'R')::DOUBLE AS r FROM lineitem GROUP BY ALL) SELECT key, [round(a / (a + n + r), 6), round(n / (a + n + r), 6), round(r / (a + n + r), 6)] AS target, list_position([a, n, r], greatest(a, n, r)) - 1 AS label FROM n")
def soft_merge(spark, d):
    return A.soft_merged(table(spark, d, "lineitem"), F.col("l_partkey"), "l_returnflag", ["A", "N", "R"]).withColumn("target", rounded("target"))


@query("o183_plan_dataset", r"WITH m AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t, CASE toxic WHEN 1 THEN 'yes' ELSE 'no' END AS answer FROM documents JOIN labels USING (doc_id)), g AS (SELECT t, count_if(answer = 'yes') AS y, count(*) AS n FROM m GROUP BY t) SELECT CASE WHEN ('0x' || substr(sha1('plan|' || t), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2 THEN 'holdout' ELSE 'rest' END AS split, count(*) AS cases, sum(n)::BIGINT AS rows, count_if(y > 0 AND y < n) AS mixed FROM g GROUP BY ALL")
def plan_dataset(spark, d):
    """A plan's steps on documents and labels: map answers, merge equal cases, split by case."""
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(T.norm_text(F.col("text")).alias("t"), F.when(F.col("toxic") == 1, "yes").otherwise("no").alias("answer"))
    g = x.groupBy("t").agg(F.count_if(F.col("answer") == "yes").alias("y"), F.count("*").alias("n"))
    split = F.when(hashing.split_name(F.col("t"), "plan", 0.2) == "holdout", "holdout").otherwise("rest")
    return g.groupBy(split.alias("split")).agg(F.count("*").alias("cases"), F.sum("n").alias("rows"), F.count_if((F.col("y") > 0) & (F.col("y") < F.col("n"))).alias("mixed"))


@query("o184_rubric_groups", f"{_W}, g AS (SELECT grp FROM c WHERE label >= 0 GROUP BY grp HAVING count(DISTINCT label) > 1) SELECT row_id, list_append(candidates, 'something else') AS candidates FROM c JOIN g USING (grp)")
def rubric_groups(spark, d):
    x = _candidates(spark, d)
    g = x.where("label >= 0").groupBy("grp").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("grp")
    return x.join(g, "grp", "left_semi").select("row_id", F.concat("candidates", F.array(F.lit("something else"))).alias("candidates"))


@query("o185_closed_forms", f"WITH u AS (SELECT o_orderkey, {unit_sql("'a:' || o_orderkey")} AS p, 0.6 + 0.4 * {unit_sql("'b:' || o_orderkey")} AS tpr, 0.05 + 0.3 * {unit_sql("'c:' || o_orderkey")} AS fpr FROM orders) SELECT o_orderkey, round(p * tpr / (p * tpr + (1 - p) * fpr), 6) AS posterior, round(p * tpr * fpr, 6) AS conjunction, round(1 / (1 + (1 - p) / p * (1 - tpr) / tpr), 6) AS sources FROM u WHERE p > 0")
def closed_forms(spark, d):
    u = lambda s: hashing.unit(s, F.col("o_orderkey"))
    x = table(spark, d, "orders").select("o_orderkey", u("a").alias("p"), (0.6 + 0.4 * u("b")).alias("tpr"), (0.05 + 0.3 * u("c")).alias("fpr")).where("p > 0")
    p, tpr, fpr = F.col("p"), F.col("tpr"), F.col("fpr")
    product = F.aggregate(F.array(p, tpr, fpr), F.lit(1.0), lambda a, x: a * x)
    return x.select("o_orderkey", R(p * tpr / (p * tpr + (1 - p) * fpr)).alias("posterior"), R(product).alias("conjunction"), R(1 / (1 + (1 - p) / p * (1 - tpr) / tpr)).alias("sources"))


@query("o186_rule_levels", "SELECT l_orderkey, l_linenumber, l_quantity > 25 AS single, l_quantity > 25 AND NOT l_returnflag = 'R' AS exception, CASE WHEN l_returnflag = 'R' THEN 'a' WHEN l_quantity > 40 THEN 'b' ELSE 'c' END AS precedence, (l_quantity > 10 OR l_discount > 0.05) AND l_tax < 0.05 AS chain FROM lineitem")
def rule_levels(spark, d):
    from ..operators.policy import chain, exception, precedence

    q, r = F.col("l_quantity"), F.col("l_returnflag")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (q > 25).alias("single"), exception(q > 25, r == "R").alias("exception"), precedence([(r == "R", "a"), (q > 40, "b")], "c").alias("precedence"),
        chain(q > 10, [("or", F.col("l_discount") > 0.05), ("and", F.col("l_tax") < 0.05)]).alias("chain"),
    )


def _u187(tag: str) -> str:
    return unit_sql(f"'{tag}:' || o_orderkey")


_D187 = ", ".join(
    [f"{_u187(f'met{i}')} < 0.8 AS met{i}" for i in range(3)] + [f"{_u187(t)} < {x} AS {t}" for t, x in (("forbidden", 0.2), ("trigger", 0.2), ("unstated", 0.3), ("vip", 0.15))]
    + [f"CASE WHEN {_u187(f'none{i}')} < 0.85 THEN {low} + floor({_u187(f'value{i}')} * {n})::INT END AS v{i}, {low} + floor({_u187(f'least{i}')} / 2 * {n})::INT AS l{i}" for i, (low, n) in enumerate(((18, 60), (1000, 5000), (0, 20)))]
    + [f"floor({_u187(t)} * {n})::INT AS {t}" for t, n in (("impact", 4), ("reach", 4), ("hours", 96), ("said", 5), ("record", 2), ("topic", 4), ("tool", 4), ("colour", 5))] + [f"{_u187(f'field{i}')} < 0.85 AS f{i}" for i in range(4)]
)
_C187 = "['red', 'green', 'blue', 'white', 'black']"
_REQ187 = " || ' ' || ".join(f"'Requirement {i + 1} is ' || CASE WHEN met{i} THEN 'shown.' ELSE 'not shown.' END" for i in range(3)) + " || CASE WHEN forbidden THEN ' A prohibition applies.' ELSE ' No prohibition applies.' END"
_F187 = [
    ("permit", _REQ187, "(met0 AND met1 AND met2 AND NOT forbidden)::INT"),
    ("action", _REQ187 + " || CASE WHEN trigger THEN ' An' ELSE ' No' END || ' escalation trigger applies.'", "CASE WHEN forbidden THEN 1 WHEN trigger THEN 3 WHEN NOT (met0 AND met1 AND met2) THEN 2 ELSE 0 END"),
    ("eligibility", "concat_ws(' ', " + ", ".join(f"'The {n} must be at least ' || l{i} || '.'" for i, n in enumerate(("age", "monthly income", "years of service"))) + ", " + ", ".join(f"'The {n} is ' || v{i} || '.'" for i, n in enumerate(("age", "monthly income", "years of service"))) + ")", "coalesce(v0 >= l0 AND v1 >= l1 AND v2 >= l2, false)::INT"),
    ("severity", "'Impact ' || impact || ' of 3, reach ' || reach || ' of 3; severity is their mean, rounded down.'", "floor((impact + reach) / 2)::INT"),
    ("urgency", "'Due in ' || hours || ' hours; under 4 is critical, under 24 high, under 72 medium.'", "CASE WHEN hours < 4 THEN 3 WHEN hours < 24 THEN 2 WHEN hours < 72 THEN 1 ELSE 0 END"),
    ("completeness", "'Required: name, address, date of birth, signature. Given: ' || concat_ws(', ', " + ", ".join(f"CASE WHEN f{i} THEN '{n}' END" for i, n in enumerate(("name", "address", "date of birth", "signature"))) + ")", "(f0 AND f1 AND f2 AND f3)::INT"),
    ("support", f"'Claim: the box is ' || {_C187}[said + 1] || CASE WHEN unstated THEN '' ELSE ' ; record: the box is ' || {_C187}[CASE WHEN record = 0 THEN said ELSE (said + 1) % 5 END + 1] END", "CASE WHEN unstated THEN 2 WHEN record = 0 THEN 0 ELSE 1 END"),
    ("routing", "'A ' || ['billing', 'technical', 'sales', 'other'][topic + 1] || ' question' || CASE WHEN vip THEN ' from a key account; those go to the priority desk' ELSE '' END", "CASE WHEN vip THEN 4 ELSE topic END"),
    ("tool", "'Please ' || ['find a page about tides', 'add up three prices', 'book a room on Monday', 'say hello'][tool + 1]", "tool"),
    ("extract", f"'The ordered colour is ' || {_C187}[colour + 1]", "colour"),
]


@query("o187_workflow_families", f"WITH u AS (SELECT o_orderkey, {_D187} FROM orders) " + " UNION ALL ".join(f"SELECT o_orderkey, '{f}' AS family, {state} AS state, {label} AS label FROM u" for f, state, label in _F187))
def workflow_families(spark, d):
    from ..operators.workflows import generated

    return generated(table(spark, d, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", "family", "state", "label")


@query("o188_mcq_nulls", f"{_W} SELECT row_id, CASE WHEN u < 0.05 THEN list_filter(candidates, lambda x: x <> candidates[label + 1]) ELSE candidates END AS candidates, CASE WHEN u < 0.05 THEN -1 ELSE label END AS label FROM (SELECT *, {unit_sql("'mc:' || row_id")} AS u FROM c WHERE label >= 0) WHERE NOT (u < 0.05 AND k < 3)")
def mcq_nulls(spark, d):
    u = hashing.unit("mc", F.col("row_id"))
    x = _candidates(spark, d).where("label >= 0").withColumn("cut", u < 0.05).where("NOT (cut AND k < 3)")
    gold = F.get("candidates", F.col("label"))
    return x.select("row_id", F.when(F.col("cut"), F.filter("candidates", lambda c: c != gold)).otherwise(F.col("candidates")).alias("candidates"), F.when(F.col("cut"), -1).otherwise(F.col("label")).alias("label"))


@query("o189_flatten_questions", "SELECT o_orderkey, i - 1 AS place, q, a FROM (SELECT o_orderkey, unnest(['status', 'priority']) AS q, unnest([o_orderstatus, o_orderpriority]) AS a, unnest([1, 2]) AS i FROM orders)")
def flatten_questions(spark, d):
    entries = F.array(F.struct(F.lit("status").alias("q"), F.col("o_orderstatus").alias("a")), F.struct(F.lit("priority").alias("q"), F.col("o_orderpriority").alias("a")))
    return table(spark, d, "orders").select("o_orderkey", F.posexplode(entries).alias("place", "e")).select("o_orderkey", "place", "e.*")


@query("o190_multi_label", "SELECT doc_id, q, a FROM (SELECT doc_id, unnest(['quality', 'toxic']) AS q, unnest([quality = 1, toxic = 1]) AS a FROM labels)")
def multi_label(spark, d):
    entries = F.array(*[F.struct(F.lit(c).alias("q"), (F.col(c) == 1).alias("a")) for c in ("quality", "toxic")])
    return table(spark, d, "labels").select("doc_id", F.explode(entries).alias("e")).select("doc_id", "e.*")


@query("o191_narrowed", f"{_W}, r AS (SELECT row_id, k, candidates, list_transform(list_sort(list_transform(range(0, k), lambda i: {{'z': i <> coalesce(label, 0), 'h': sha256('nw:' || row_id || ':' || i), 'i': i}})), lambda s: s.i) AS o FROM c) SELECT row_id, CASE WHEN k <= 3 THEN candidates ELSE list_transform(list_sort(o[1:3]), lambda i: candidates[i + 1]) END AS candidates FROM r")
def narrowed(spark, d):
    x = _candidates(spark, d)
    mass = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: (i == F.coalesce("label", F.lit(0))).cast("int"))
    return x.withColumn("mass", mass).select("row_id", A.narrowed(F.col("candidates"), F.col("mass"), F.col("row_id"), 3, "nw").alias("candidates"))


@query("o192_teacher_merge", f"{_W} SELECT row_id, list_transform(target, lambda t: round(0.96::DOUBLE * t + 0.04::DOUBLE / (k + 1), 6)) AS smooth, list_transform(list_zip(probs, target), lambda z: round((z[1] + z[2]) / 2, 6)) AS mean FROM c")
def teacher_merge(spark, d):
    mean = F.zip_with("probs", "target", lambda a, b: (a + b) / 2)
    return decisions(spark, d).select("row_id", F.transform("target", lambda t: F.round(0.96 * t + 0.04 / (F.col("k") + 1), 6)).alias("smooth"), rounded(mean).alias("mean"))


@query("o193_permutation_average", f"{_W} SELECT row_id, list_transform(list_zip(probs[:-2], list_reverse(probs[:-2])), lambda z: round((z[1] + z[2]) / 2, 6)) AS mean FROM c")
def permutation_average(spark, d):
    """Each row scored under two orders; the second scorer's answers stand in the reversed places."""
    x = decisions(spark, d).select("row_id", P.candidates(F.col("probs")).alias("p"))
    n = F.sequence(F.lit(0), F.size("p") - 1)
    both = x.select("row_id", n.alias("order"), "p").union(x.select("row_id", F.reverse(n), "p"))
    return A.permutation_averaged(both, "row_id").select("row_id", rounded("mean").alias("mean"))


@query("o194_orbits", "SELECT r_regionkey, polarity, wording, ord FROM region, (VALUES (true), (false)) a(polarity), (VALUES ('a'), ('b'), ('c')) b(wording), (VALUES (0), (1)) c(ord) WHERE NOT (wording = 'c' AND ord = 1)")
def orbits(spark, d):
    out = A.orbits(table(spark, d, "region").select("r_regionkey"), {"polarity": [True, False], "wording": ["a", "b", "c"], "ord": [0, 1]})
    return out.where("NOT (wording = 'c' AND ord = 1)")


@query("o195_derangement", "SELECT c_custkey, CASE WHEN count(*) OVER (PARTITION BY c_mktsegment) > 1 THEN coalesce(lead(c_custkey) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey), min(c_custkey) OVER (PARTITION BY c_mktsegment)) END AS other FROM customer")
def derangement(spark, d):
    c = table(spark, d, "customer").withColumn("v", F.col("c_custkey"))
    return A.rotated(c, ["c_mktsegment"], "c_custkey", "v").select("c_custkey", F.col("rotated").alias("other"))


@query("o196_length_grid", "SELECT item_id, len, pos, length(CASE pos WHEN 'first' THEN head || repeat('x', len) ELSE repeat('x', len) || head END) AS n FROM (SELECT item_id, substr(text, 1, 50) AS head FROM benchmark), (VALUES (100), (200)) l(len), (VALUES ('first'), ('last')) p(pos)")
def length_grid(spark, d):
    x = A.orbits(table(spark, d, "benchmark").select("item_id", F.substring("text", 1, 50).alias("head")), {"len": [100, 200], "pos": ["first", "last"]})
    pad = F.repeat(F.lit("x"), F.col("len"))
    return x.select("item_id", "len", "pos", F.length(F.when(F.col("pos") == "first", F.concat("head", pad)).otherwise(F.concat(pad, "head"))).alias("n"))


@query("o197_locked_mix", "WITH k AS (SELECT doc_id, lang FROM documents WHERE doc_id % 11 <> 0), r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('mix:' || doc_id)) AS r FROM k) SELECT doc_id, lang FROM r WHERE r <= CASE lang WHEN 'en' THEN 40 WHEN 'fr' THEN 20 ELSE 10 END")
def locked_mix(spark, d):
    from ..operators.ranking import stratified

    docs = table(spark, d, "documents").select("doc_id", "lang")
    locked = docs.where("doc_id % 11 = 0").select("doc_id")
    quotas = docs.select("lang").distinct().withColumn("quota", F.when(F.col("lang") == "en", 40).when(F.col("lang") == "fr", 20).otherwise(10))
    return stratified(docs.join(locked, "doc_id", "left_anti"), "lang", "doc_id", quotas, "mix").select("doc_id", "lang")


@query("o198_regrouped", "WITH g AS (SELECT conv_id, min(role) AS state, count(*) AS n, count(DISTINCT role) AS states, list(turn ORDER BY turn) AS ts FROM conversations WHERE length(text) >= 20 GROUP BY conv_id) SELECT conv_id, state, n FROM g WHERE states = 1 AND n <= 16")
def regrouped(spark, d):
    x = table(spark, d, "conversations")
    return A.regrouped(x, "conv_id", "role", "turn", "text", F.when(F.length("text") < 20, "short"), 16).select("conv_id", "state", F.size("questions").cast("long").alias("n"))


@query("o048_decision_rows", f"{_W} SELECT row_id, to_json({{'task': task, 'k': k}}) AS state, CASE WHEN label IS NULL THEN list_position(probs, list_max(probs)) - 1 ELSE label END AS label FROM c")
def decision_rows(spark, d):
    return decisions(spark, d).select("row_id", F.to_json(F.struct("task", "k")).alias("state"), F.coalesce("label", P.argmax(F.col("probs"))).alias("label"))


@query("o049_wire_questions", "SELECT doc_id, 'yes' AS said, CASE WHEN quality + toxic > 0 THEN round(quality / (quality + toxic)::DOUBLE, 6) END AS p_true, CASE WHEN quality + toxic > 0 THEN round(toxic / (quality + toxic)::DOUBLE, 6) END AS p_false FROM labels")
def wire_questions(spark, d):
    s = F.col("quality") + F.col("toxic")
    criteria = F.transform_keys(F.create_map(F.lit("yes"), F.lit("yes"), F.lit("no"), F.lit("no")), lambda k, v: F.when(k == "yes", "true").otherwise("false"))
    p = F.when(s > 0, F.create_map(F.lit("true"), R(F.try_divide(F.col("quality"), s)), F.lit("false"), R(F.try_divide(F.col("toxic"), s))))
    rows = table(spark, d, "labels").select("doc_id", criteria.alias("criteria"), p.alias("probs"))
    return rows.select("doc_id", F.element_at("criteria", "true").alias("said"), F.element_at("probs", "true").alias("p_true"), F.element_at("probs", "false").alias("p_false"))


@query("o045_consensus", f"{_W}, s AS (SELECT row_id, CASE WHEN label IS NULL THEN 'no consensus' WHEN label = -1 THEN 'not a candidate' END AS reason FROM c) SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM s GROUP BY ALL")
def consensus(spark, d):
    answer = F.when(F.col("label") >= 0, F.get("candidates", F.col("label"))).when(F.col("label") == -1, "other")
    x = _candidates(spark, d).withColumn("answer", answer)
    reason = F.when(F.col("answer").isNull(), "no consensus").when(F.array_position("candidates", F.col("answer")) == 0, "not a candidate").otherwise("kept")
    return x.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
