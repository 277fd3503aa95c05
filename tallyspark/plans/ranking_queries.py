"""Queries of ranking, sampling, splitting and retrieval."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import hashing, probs as P, text as T
from ..operators import joins as J, metrics as M, ranking as K
from ..sources import files as X
from .catalog import query, table, unit_sql
from .fixtures import DECISIONS_SQL, R, decisions

_W = f"WITH {DECISIONS_SQL}"
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+')"
_BM = f"""WITH t AS (SELECT doc_id, lang, unnest({_WORDS}) AS w FROM documents), tf AS (SELECT lang, doc_id, w, count(*) AS tf FROM t GROUP BY ALL), dl AS (SELECT lang, doc_id, len({_WORDS}) AS dl FROM documents),
c AS (SELECT lang, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY lang), df AS (SELECT lang, w, count(*) AS df FROM tf GROUP BY ALL), q AS (SELECT l.lang, b.qid, unnest({_WORDS.replace('text', 'b.text')}) AS w FROM (SELECT DISTINCT lang FROM documents) l, (SELECT item_id AS qid, text FROM benchmark) b),
qq AS (SELECT lang, qid, w, count(*) AS q FROM q GROUP BY ALL), s AS (SELECT lang, qid, doc_id, sum(q * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM qq JOIN tf USING (lang, w) JOIN df USING (lang, w) JOIN dl USING (lang, doc_id) JOIN c USING (lang) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s)"""


def _bm25(spark, d):
    docs = table(spark, d, "documents")
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), J.word_array(F.col("text")).alias("words"))
    q = q.join(F.broadcast(docs.select("lang").distinct()))  # a handful of languages
    s = K.bm25(q, docs.select("lang", "doc_id", J.word_array(F.col("text")).alias("words")), "lang", "qid", "doc_id")
    return s.withColumn("score", F.round("score", 6))


@query("o137_bm25", f"{_BM} SELECT lang, qid, doc_id, rank, round(score, 6) AS score FROM r WHERE rank <= 5")
def bm25(spark, d):
    return K.top_k(_bm25(spark, d), ["lang", "qid"], "score", "doc_id", 5).select("lang", "qid", "doc_id", "rank", "score")


@query("o113_retrieval_metrics", f"{_BM}, g AS (SELECT lang, qid, bool_or(rank <= 5 AND doc_id % 2 = 0) AS hit, count_if(rank <= 5 AND doc_id % 2 = 0) AS good, min(CASE WHEN doc_id % 2 = 0 THEN rank END) AS first, count_if(rank <= 5) AS shown FROM r GROUP BY ALL) SELECT lang, round(avg(hit::INT), 6) AS hit_rate, round(sum(good) / sum(shown)::DOUBLE, 6) AS precision, round(avg(coalesce(1 / first::DOUBLE, 0)), 6) AS mrr FROM g GROUP BY lang")
def retrieval_metrics(spark, d):
    scores = X.stored(_bm25(spark, d), "scores")  # read three times
    better = F.struct("score", (-F.col("doc_id")).alias("m"))
    shown = K.top_k(scores, ["lang", "qid"], "score", "doc_id", 5).groupBy("lang", "qid").agg(F.count("*").alias("shown"), F.count_if(F.col("doc_id") % 2 == 0).alias("good"))
    # the rank of the best good one is the number of those not behind it, without ranking all
    best = X.stored(scores.where("doc_id % 2 = 0").groupBy("lang", "qid").agg(F.max(better).alias("best")), "best")
    first = scores.join(best, ["lang", "qid"]).where(better >= F.col("best")).groupBy("lang", "qid").agg(F.count("*").alias("first"))
    g = shown.join(first, ["lang", "qid"], "left")
    return g.groupBy("lang").agg(R(F.avg((F.col("good") > 0).cast("int"))).alias("hit_rate"), R(F.sum("good") / F.sum("shown")).alias("precision"), R(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0)))).alias("mrr"))


@query("o114_twin_agreement", f"{_BM}, a AS (SELECT lang, qid, doc_id FROM r WHERE rank <= 5), p AS (SELECT lang, qid, count(*) AS shared FROM a x JOIN (SELECT lang, qid - 1 AS qid, doc_id FROM a) y USING (lang, qid, doc_id) GROUP BY ALL), n AS (SELECT lang, qid, count(*) AS n FROM a GROUP BY ALL) SELECT x.lang, round(avg(coalesce(shared, 0) / (x.n + y.n - coalesce(shared, 0))::DOUBLE), 6) AS jaccard FROM n x JOIN n y ON x.lang = y.lang AND y.qid = x.qid + 1 LEFT JOIN p ON p.lang = x.lang AND p.qid = x.qid GROUP BY x.lang")
def twin_agreement(spark, d):
    a = K.top_k(_bm25(spark, d), ["lang", "qid"], "score", "doc_id", 5).groupBy("lang", "qid").agg(F.collect_set("doc_id").alias("s"))  # five ids
    b = a.select("lang", (F.col("qid") - 1).alias("qid"), F.col("s").alias("t"))
    both = F.size(F.array_intersect("s", "t"))
    return a.join(b, ["lang", "qid"]).groupBy("lang").agg(R(F.avg(both / (F.size("s") + F.size("t") - both))).alias("jaccard"))


@query("o141_evidence_union", f"{_BM}, u AS (SELECT lang, qid, doc_id FROM r WHERE rank <= 3 UNION SELECT lang, qid, doc_id FROM (SELECT DISTINCT lang, qid FROM r) JOIN documents USING (lang) WHERE doc_id % 97 = 0) SELECT lang, qid, doc_id, row_number() OVER (PARTITION BY lang, qid ORDER BY doc_id) AS place FROM u")
def evidence_union(spark, d):
    s = _bm25(spark, d)
    top = K.top_k(s, ["lang", "qid"], "score", "doc_id", 3).select("lang", "qid", "doc_id")
    always = s.select("lang", "qid").distinct().join(table(spark, d, "documents").where("doc_id % 97 = 0").select("lang", "doc_id"), "lang").select("lang", "qid", "doc_id")
    return top.union(always).distinct().withColumn("place", F.row_number().over(W.partitionBy("lang", "qid").orderBy("doc_id")))


_NORMED = "list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y))))"
_CENT_OF = """WITH u AS (SELECT vec_id, label, {normed} AS v FROM (SELECT vec_id, label, list_transform(embedding{dims}, lambda x: x::DOUBLE) AS v FROM embeddings)), e AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u),
c AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL) GROUP BY label), s AS (SELECT vec_id, u.label, c.label AS said, round(list_sum(list_transform(list_zip(v, c), lambda z: z[1] * z[2])) / sqrt(list_sum(list_transform(c, lambda x: x * x))), 9) AS score FROM u, c)"""
_CENT, _CENT_WHOLE = (_CENT_OF.format(normed=_NORMED, dims=dims) for dims in ("[1:32]", ""))


def _centroids(u):
    flat = u.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    return flat.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))  # a number for each dimension


@query("o139_truncated_unit", f"{_CENT} SELECT vec_id, round(v[1], 9) AS first, round(list_sum(list_transform(v, lambda x: x * x)), 9) AS length FROM u")
def truncated_unit(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", K.truncated_unit(F.col("embedding"), 32).alias("v"))
    return v.select("vec_id", F.round(F.get("v", F.lit(0)), 9).alias("first"), F.round(K.dot(F.col("v"), F.col("v")), 9).alias("length"))


@query("o138_dense_ranking", f"{_CENT_WHOLE}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, said) AS rank FROM s) SELECT vec_id, said, rank FROM r WHERE rank <= 3")
def dense_ranking(spark, d):
    u = table(spark, d, "embeddings").select("vec_id", "label", K.truncated_unit(F.col("embedding"), F.size("embedding")).alias("v"))
    c = _centroids(u).select(F.col("label").alias("said"), "c")
    s = u.join(F.broadcast(c)).withColumn("score", F.round(K.dot(F.col("v"), F.col("c")) / F.sqrt(K.dot(F.col("c"), F.col("c"))), 9))  # a row for each label
    return K.top_k(s, ["vec_id"], "score", "said", 3).select("vec_id", "said", "rank")


@query("o140_nearest_label", f"{_CENT_WHOLE}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, said) AS rank FROM s) SELECT count(*) AS n, round(avg((said = label)::INT), 6) AS acc FROM r WHERE rank = 1")
def nearest_label(spark, d):
    u = table(spark, d, "embeddings").select("vec_id", "label", K.truncated_unit(F.col("embedding"), F.size("embedding")).alias("v"))
    c = _centroids(u).select(F.col("label").alias("said"), "c")
    score = F.round(K.dot(F.col("v"), F.col("c")) / F.sqrt(K.dot(F.col("c"), F.col("c"))), 9)
    best = u.join(F.broadcast(c)).groupBy("vec_id", "label").agg(F.max_by("said", F.struct(score, -F.col("said"))).alias("said"))
    return best.agg(F.count("*").alias("n"), R(F.avg((F.col("said") == F.col("label")).cast("int"))).alias("acc"))


@query("o142_position_thirds", "SELECT conv_id, turn, CASE least(2, floor(turn * 3 / (m + 1))) WHEN 0 THEN 'early' WHEN 1 THEN 'middle' ELSE 'late' END AS third FROM conversations JOIN (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY ALL) USING (conv_id)")
def position_thirds(spark, d):
    x = table(spark, d, "conversations").withColumn("m", F.max("turn").over(W.partitionBy("conv_id")) + 1)
    return x.select("conv_id", "turn", K.position_third(F.col("turn"), F.col("m")).alias("third"))


@query("o143_tournament", f"{_W}, p AS (SELECT row_id, logits AS z, [logits[1:2], logits[3:4], logits[5:6]][1:ceil(len(logits) / 2)::INT] AS parts FROM decisions), q AS (SELECT *, list_transform(parts, lambda x: list_max(x)) AS w FROM p) SELECT row_id, list_transform(flatten(list_transform(list_zip(parts, w), lambda a: list_transform(a[1], lambda x: x - ln(list_sum(list_transform(a[1], lambda y: exp(y)))) + a[2] - ln(list_sum(list_transform(w, lambda y: exp(y))))))), lambda v: round(v, 6)) AS logp FROM q")
def tournament(spark, d):
    return decisions(spark, d).select("row_id", F.transform(K.tournament(F.col("logits"), 2), lambda v: F.round(v, 6)).alias("logp"))


@query("o144_routing", f"{_W}, s AS (SELECT row_id, round(-list_sum(list_transform(probs, lambda x: x * ln(x))) / ln(len(probs)), 6) AS signal FROM decisions), r AS (SELECT *, row_number() OVER (ORDER BY signal DESC, row_id DESC) AS r, count(*) OVER () AS n FROM s) SELECT row_id, r <= round_even(n * 10 / 100, 0) AS routed FROM r")
def routing(spark, d):
    x = decisions(spark, d).select("row_id", F.round(P.entropy(F.col("probs")), 6).alias("signal"))
    return K.routed(x, "signal", ["row_id"], 10).select("row_id", "routed")


_QUOTA = "s AS (SELECT source, count(*) AS n FROM documents GROUP BY source), f AS (SELECT *, n * 100 / sum(n) OVER ()::DOUBLE AS share FROM s), q AS (SELECT source, n, floor(share) + (row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, source) <= 100 - sum(floor(share)) OVER ())::INT AS quota FROM f)"


@query("o145_apportionment", f"WITH {_QUOTA} SELECT source, n, quota::BIGINT AS quota FROM q")
def apportionment(spark, d):
    return K.apportioned(table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")), "source", "n", 100)


@query("o146_stratified_sample", f"WITH {_QUOTA}, r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('s:' || doc_id)) AS r FROM documents) SELECT doc_id, source FROM r JOIN q USING (source) WHERE r <= quota")
def stratified_sample(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    quotas = K.apportioned(docs.groupBy("source").agg(F.count("*").alias("n")), "source", "n", 100)
    return K.stratified(docs, "source", "doc_id", quotas, "s").select("doc_id", "source")


@query("o148_round_robin", "WITH t AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents) SELECT doc_id, lang, turn FROM t ORDER BY turn, lang LIMIT 50")
def round_robin(spark, d):
    return K.round_robin(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 50)


@query("o152_even_cells", "WITH c AS (SELECT DISTINCT source FROM documents), k AS (SELECT source, 40 // count(*) OVER () + (row_number() OVER (ORDER BY source) <= 40 % count(*) OVER ())::INT AS quota FROM c), r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) SELECT doc_id, source FROM r JOIN k USING (source) WHERE r <= quota")
def even_cells(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    cells = docs.select("source").distinct().withColumn("n", F.count("*").over(W.partitionBy()))  # a row for each cell
    cells = cells.select("source", (F.floor(40 / F.col("n")) + (F.row_number().over(W.orderBy("source")) <= 40 % F.col("n")).cast("int")).alias("quota"))
    r = docs.join(F.broadcast(cells), "source").withColumn("r", F.row_number().over(W.partitionBy("source").orderBy("doc_id")))
    return r.where("r <= quota").select("doc_id", "source")


@query("o153_preview", r"WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), t AS (SELECT doc_id, lang, n, row_number() OVER (PARTITION BY lang ORDER BY sha256('p:' || doc_id)) AS turn FROM documents JOIN c USING (lang)) SELECT doc_id, lang FROM t ORDER BY turn, n, lang LIMIT 12")
def preview(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    n = docs.groupBy("lang").agg(F.count("*").alias("n"))
    t = docs.join(F.broadcast(n), "lang").withColumn("turn", F.row_number().over(W.partitionBy("lang").orderBy(hashing.rank_key("p", F.col("doc_id")))))  # a row for each label
    return t.orderBy("turn", "n", "lang").limit(12).select("doc_id", "lang")


@query("o154_group_split", r"WITH g AS (SELECT trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS g, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT g, coalesce(sum(n) OVER (ORDER BY sha256('v:' || g), g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g) SELECT doc_id, CASE WHEN before < 100 THEN 'val' ELSE 'train' END AS split FROM documents JOIN r ON trim(regexp_replace(lower(text), '\s+', ' ', 'g')) = g")
def group_split(spark, d):
    return K.group_split(table(spark, d, "documents").select("doc_id", "text"), T.norm_text(F.col("text")), 100, "v").select("doc_id", "split")


@query("o155_hash_split", f"SELECT doc_id, CASE WHEN ('0x' || substr(h, 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2 THEN 'holdout' WHEN ('0x' || substr(h, 9, 8))::BIGINT / 4294967296.0::DOUBLE < 0.1 THEN 'val' ELSE 'train' END AS split FROM (SELECT doc_id, sha1('seed|' || trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS h FROM documents)")
def hash_split(spark, d):
    return table(spark, d, "documents").select("doc_id", hashing.split_name(T.norm_text(F.col("text")), "seed", 0.2).alias("split"))


@query("o156_modulo_split", "SELECT doc_id, list_reduce(list_transform(string_split(sha256(doc_id::VARCHAR), ''), lambda c: ('0x' || c)::BIGINT), lambda a, c: (a * 16 + c) % 10) = 0 AS dev FROM documents")
def modulo_split(spark, d):
    return table(spark, d, "documents").select("doc_id", (hashing.digest_mod(F.col("doc_id").cast("string"), 10) == 0).alias("dev"))


@query("o157_hash_rank_sample", "SELECT doc_id FROM documents ORDER BY sha256('r:pool:' || doc_id) LIMIT 25")
def hash_rank_sample(spark, d):
    return table(spark, d, "documents").orderBy(hashing.rank_key("r", "pool", F.col("doc_id"))).limit(25).select("doc_id")


@query("o158_weighted_slots", f"WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents), s AS (SELECT slot, CASE WHEN u < 0.5 THEN 'en' WHEN u < 0.8 THEN 'fr' ELSE 'de' END AS lang FROM (SELECT range AS slot, {unit_sql("'slot:' || range")} AS u FROM range(500))), k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY slot) - 1 AS k FROM s) SELECT slot, k.lang, doc_id FROM k JOIN r ON k.lang = r.lang AND k.k % r.n = r.i")
def weighted_slots(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    w = W.partitionBy("lang")
    r = docs.withColumn("i", F.row_number().over(w.orderBy("doc_id")) - 1).withColumn("n", F.count("*").over(w))
    u = hashing.unit("slot", F.col("slot"))
    s = spark.range(500).select(F.col("id").alias("slot")).withColumn("lang", F.when(u < 0.5, "en").when(u < 0.8, "fr").otherwise("de"))
    k = s.withColumn("k", F.row_number().over(w.orderBy("slot")) - 1).join(r.select("lang", "n").distinct(), "lang").withColumn("i", F.col("k") % F.col("n"))
    return k.join(r.select("lang", "i", "doc_id"), ["lang", "i"]).select("slot", "lang", "doc_id")


@query("o159_exact_slots", "SELECT * FROM (VALUES ('a', 48), ('b', 32), ('c', 16)) v(stratum, slots)")
def exact_slots(spark, d):
    from fractions import Fraction

    weights = {"a": Fraction(1, 2), "b": Fraction(1, 3), "c": Fraction(1, 6)}
    slots = {k: w * 96 for k, w in weights.items()}
    if any(v.denominator != 1 for v in slots.values()):
        raise ValueError("weights don't give whole slots")
    return spark.createDataFrame([(k, int(v)) for k, v in slots.items()], "stratum string, slots int")


@query("o161_oversampled", "WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), m AS (SELECT max(n) AS m FROM c) SELECT lang, greatest(n, ceil(m / 3.0::DOUBLE))::BIGINT AS rows FROM c, m")
def oversampled(spark, d):
    return K.oversampled(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id").groupBy("lang").agg(F.count("*").alias("rows"))


@query("o162_gap_threads", "WITH g AS (SELECT event_id, user_id, ts, (lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOURS < ts)::INT AS n FROM events) SELECT user_id, max(s) + 1 AS sessions FROM (SELECT user_id, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS s FROM g) GROUP BY user_id")
def gap_threads(spark, d):
    s = K.gap_sessions(table(spark, d, "events"), "user_id", "ts", "12 HOURS")
    return s.groupBy("user_id").agg((F.max("session") + 1).alias("sessions"))


@query("o163_time_buckets", "WITH g AS (SELECT epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS s FROM events), c AS (SELECT count_if(s <= 3600) AS hour, count_if(s > 3600 AND s <= 86400) AS day, count_if(s > 86400) AS rest FROM g WHERE s IS NOT NULL) SELECT 'hour' AS bucket, hour AS n FROM c UNION ALL SELECT 'day', day FROM c UNION ALL SELECT 'rest', rest FROM c")
def time_buckets(spark, d):
    s = F.timestamp_diff("MICROSECOND", F.lag("ts").over(W.partitionBy("user_id").orderBy("ts")), F.col("ts")) / 1000000
    x = table(spark, d, "events").select(s.alias("s")).where("s IS NOT NULL")
    b = F.when(F.col("s") <= 3600, "hour").when(F.col("s") <= 86400, "day").otherwise("rest")
    return x.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


@query("o164_owner", "WITH c AS (SELECT role, count(*) AS n FROM conversations GROUP BY role) SELECT role, round(n / (SELECT max(n) FROM c)::DOUBLE, 6) AS share, n >= 0.01 * (SELECT max(n) FROM c) AS alias_ok FROM c")
def owner(spark, d):
    c = table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n")).withColumn("m", F.max("n").over(W.partitionBy()))  # a row for each sender
    return c.select("role", R(F.col("n") / F.col("m")).alias("share"), (F.col("n") >= 0.01 * F.col("m")).alias("alias_ok"))


@query("o165_message_dedup", "SELECT min(conv_id * 100 + turn) AS id, list_sort(list(DISTINCT role)) AS folders, count(*) AS copies FROM conversations GROUP BY substr(text, 1, 200)")
def message_dedup(spark, d):
    x = table(spark, d, "conversations").withColumn("id", F.col("conv_id") * 100 + F.col("turn"))
    return K.deduplicated_messages(x, [F.substring("text", 1, 200)], "id", "role", [])


@query("o247_bounded_spend", "SELECT event_id FROM (SELECT event_id, sum(abs(value)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events) WHERE spent <= 500")
def bounded_spend(spark, d):
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, d, "events").withColumn("spent", F.sum(F.abs("value")).over(w)).where("spent <= 500").select("event_id")


@query("o242_matches_first", r"SELECT doc_id, round(length(text) / 1000.0::DOUBLE, 3) AS p FROM documents ORDER BY p DESC, doc_id LIMIT 12")
def matches_first(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(F.length("text") / 1000, 3).alias("p")).orderBy(F.desc("p"), "doc_id").limit(12)


@query("o160_length_batches")
def length_batches(spark, d):
    """Batches of groups that stay together, sorted by length inside chunks: sequential by nature, so chunk by chunk."""
    from ..operators.packing import group_batches

    x = table(spark, d, "conversations").select("conv_id", F.length("text").alias("n"))
    return group_batches(x, "conv_id", "n", 16, 50, "b")


@query("o151_case_quota")
def case_quota(spark, d):
    from ..operators.packing import case_quota as quota

    x = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("flow", F.col("conv_id") % 4)
    return quota(x, "flow", "conv_id", "n", 60, "q")


@query("o147_atomic_limit")
def atomic_limit(spark, d):
    from ..operators.packing import case_quota as quota

    x = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderpriority").alias("stratum"))
    return quota(x, "stratum", "o_custkey", "n", 200, "a")


@query("o149_capped_round_robin")
def capped_round_robin(spark, d):
    from ..operators.packing import capped_round_robin as pick

    x = decisions(spark, d).select("qtype", "task", "row_id", F.col("label").isNull().cast("int").alias("soft"))
    return pick(x, "qtype", "task", "row_id", "soft", 60, 15, "rr")


@query("o150_hard_then_even")
def hard_then_even(spark, d):
    from ..operators.packing import hard_then_even as pick

    x = decisions(spark, d).where("label IS NOT NULL").select("task", "k", "row_id", F.round(P.nll(F.col("probs"), F.col("target")), 6).alias("loss"))
    return pick(x, "task", "k", "row_id", "loss", 20, 20, 80)
