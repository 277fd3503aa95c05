"""Queries of set operations, dedup and ordering."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import hashing, text as T
from ..operators import joins as J
from .catalog import query, table

_NORM = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


@query("o235_union", "SELECT 'documents/' || doc_id AS grp, length(text) AS n FROM documents UNION ALL SELECT 'benchmark/' || item_id, length(text) FROM benchmark")
def union(spark, d):
    a = table(spark, d, "documents").select(F.concat(F.lit("documents/"), "doc_id").alias("grp"), F.length("text").cast("long").alias("n"), F.lit(1).alias("extra"))
    b = table(spark, d, "benchmark").select(F.concat(F.lit("benchmark/"), "item_id").alias("grp"), F.length("text").cast("long").alias("n"))
    return a.unionByName(b, allowMissingColumns=True).select("grp", "n")


@query("o236_set_difference", "(SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL (SELECT -o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT -o_custkey FROM orders WHERE o_orderstatus = 'F')")
def set_difference(spark, d):
    k = lambda s: table(spark, d, "orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return k("O").subtract(k("P")).union(k("O").intersect(k("F")).select((-F.col("k")).alias("k")))


@query("o237_keep_first", f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {_NORM}")
def keep_first(spark, d):
    return table(spark, d, "documents").groupBy(T.norm_text(F.col("text")).alias("t")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("o238_distinct_by_id", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def distinct_by_id(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return J.first_of(o.union(o), ["o_custkey"], ["o_orderkey"])


@query("o239_evidence_key", "SELECT min(conv_id * 100 + turn) AS id, count(*) - 1 AS duplicates FROM conversations GROUP BY lower(text)")
def evidence_key(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy(F.lower("text").alias("e")).agg(F.min(F.col("conv_id") * 100 + F.col("turn")).alias("id"), (F.count("*") - 1).alias("duplicates")).select("id", "duplicates")


@query("o240_recurring_types", "SELECT user_id, count_if(event_type = 'click') AS click, count_if(event_type = 'purchase') AS purchase, count_if(event_type = 'view') AS \"view\" FROM events WHERE event_type IN ('click', 'purchase', 'view') GROUP BY user_id")
def recurring_types(spark, d):
    e = table(spark, d, "events")
    often = e.groupBy("event_type").agg(F.count("*").alias("n")).where("n >= 25").select("event_type")
    kept = e.join(F.broadcast(often), "event_type", "left_semi")  # a row for each type
    return kept.where(F.col("event_type").isin("click", "purchase", "view")).groupBy("user_id").pivot("event_type", ["click", "purchase", "view"]).count().na.fill(0)


@query("o241_pair_shuffle", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place, sha256('ps:' || o_custkey) AS unit FROM orders")
def pair_shuffle(spark, d):
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(w).alias("place"), hashing.rank_key("ps", F.col("o_custkey")).alias("unit")).repartitionByRange("unit").sortWithinPartitions("unit", "place")


@query("o243_head_cap", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 5")
def head_cap(spark, d):
    return table(spark, d, "documents").withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("doc_id"))).where("r <= 5").select("lang", "doc_id")


@query("o246_resumed_labels", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resumed_labels(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("o250_milestones", "SELECT user_id, event_type, min(ts) AS first, arg_max(value, event_id) AS latest FROM events GROUP BY ALL")
def milestones(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first"), F.max_by("value", "event_id").alias("latest"))


@query("o254_new_texts", f"SELECT DISTINCT md5(text) AS key FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE lang = 'en')")
def new_texts(spark, d):
    docs = table(spark, d, "documents").select(F.md5("text").alias("key"), "lang")
    return docs.select("key").distinct().join(docs.where("lang = 'en'").select("key"), "key", "left_anti")
