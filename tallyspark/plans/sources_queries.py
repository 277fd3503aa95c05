"""Queries of scans, sinks, streams and scorers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, probs as P, text as T
from ..operators import scoring as Z
from ..sources import files as X
from ..streaming import ingest as I
from .catalog import query, table, unit_sql
from .fixtures import DECISIONS_SQL, R, decisions


@query("o001_jsonl_scan", "SELECT doc_id, lang, n_chars FROM documents")
def jsonl_scan(spark, d):
    path = X.scratch(spark, "jsonl")
    table(spark, d, "documents").select("doc_id", "lang", "n_chars").write.json(path)
    return X.read_jsonl(spark, path, "doc_id long, lang string, n_chars long").select("doc_id", "lang", "n_chars")


@query("o003_split_scan", "SELECT lang AS eval_set, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 7")
def split_scan(spark, d):
    path = X.scratch(spark, "splits")
    docs = table(spark, d, "documents").select("doc_id", "lang")
    for lang in ("de", "en", "es", "fr"):
        docs.where(F.col("lang") == lang).select("doc_id").write.json(f"{path}/{lang}")
    return X.read_splits(spark, path, "doc_id long", 7, "doc_id").select("eval_set", "doc_id")


@query("o004_csv_scan", "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer ORDER BY c_custkey")
def csv_scan(spark, d):
    path = X.scratch(spark, "csv")
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("  "), "c_name").alias(" c_name "), "c_mktsegment")
    # quotes as the scan reads them; an empty text is a blank there, as an empty cell reads as null
    c.write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, escape='"', emptyValue=" ").csv(path)
    return X.read_records_csv(spark, path, order=F.col("c_custkey"))


@query("o006_dispatched_sample", "SELECT p_partkey::VARCHAR AS p_partkey, p_brand FROM part ORDER BY sha256('sample:' || p_partkey) LIMIT 50")
def dispatched_sample(spark, d):
    return X.load_records(spark, {"kind": "sample", "path": f"{d}/part.parquet", "key": "p_partkey", "n": 50}).select("p_partkey", "p_brand")


@query("o007_parquet_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def parquet_scan(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query("o008_vote_shares", "WITH n AS (SELECT l_partkey, count_if(l_returnflag = 'A')::DOUBLE AS a, count_if(l_returnflag = 'N')::DOUBLE AS b, count_if(l_returnflag = 'R')::DOUBLE AS c FROM lineitem GROUP BY ALL) SELECT l_partkey, [round(a / (a + b + c), 6), round(b / (a + b + c), 6), round(c / (a + b + c), 6)] AS dist FROM n")
def vote_shares(spark, d):
    v = X.vote_shares(table(spark, d, "lineitem"), ["l_partkey"], "l_returnflag", ["A", "N", "R"])
    return v.withColumn("dist", F.transform("dist", lambda x: F.round(x, 6)))


@query("o010_incremental_ingest", "SELECT user_id, event_type, count(*) AS copies FROM events GROUP BY ALL")
def incremental_ingest(spark, d):
    """The events as files that a stream takes one by one; a second run finds nothing new."""
    path = X.scratch(spark, "units")
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    e.repartition(4).write.parquet(f"{path}/in")
    for _ in range(2):
        I.ingested(spark, I.file_stream(spark, f"{path}/in", "user_id long, event_type string, event_id long", files_a_trigger=2), f"{path}/out", f"{path}/state", ["user_id", "event_type"])
    return I.ingested_table(spark, f"{path}/out", ["user_id", "event_type"]).select("user_id", "event_type", "copies")


@query("o011_inverted_index", r"SELECT DISTINCT w, conv_id FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+')) AS w FROM conversations)")
def inverted_index(spark, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0))
    return table(spark, d, "conversations").select(F.explode(words).alias("w"), "conv_id").distinct()


@query("o012_logit_dump", f"WITH {DECISIONS_SQL} SELECT row_id, k, label, logits FROM decisions")
def logit_dump(spark, d):
    path = X.scratch(spark, "dump")
    decisions(spark, d).select("row_id", "k", "label", "logits").write.parquet(path)
    return spark.read.parquet(path)


@query("o013_teacher_files", f"WITH {DECISIONS_SQL} SELECT row_id AS qid, round(probs[1], 6) AS first, k + 1 AS n FROM decisions")
def teacher_files(spark, d):
    x = decisions(spark, d).select(F.col("row_id").alias("qid"), F.transform("probs", lambda p, i: F.struct(F.concat(F.lit("c"), i.cast("string")).alias("candidate"), p.alias("prob"))).alias("e"))
    wide = x.where("qid % 2 = 0").select("qid", F.map_from_entries("e").alias("probs"))
    long = x.where("qid % 2 <> 0").select("qid", F.explode("e").alias("r")).select("qid", "r.*")
    return X.teacher_rows(wide, long).select("qid", R(F.element_at("probs", "c0")).alias("first"), F.size("probs").alias("n"))


@query("o014_published", "SELECT r_regionkey, r_name FROM region")
def published(spark, d):
    path = X.scratch(spark, "published")
    X.publish(table(spark, d, "region"), path)
    return spark.read.parquet(path)


@query("o015_sealed", "WITH h AS (SELECT sha256('{\"r_name\":\"' || r_name || '\",\"r_regionkey\":' || r_regionkey || '}') AS h FROM region), p AS (SELECT substr(h, 1, 4) AS p, sha256(string_agg(h, '' ORDER BY h)) AS d, count(*) AS n FROM h GROUP BY ALL) SELECT sum(n)::BIGINT AS rows, sha256(string_agg(p || d, '' ORDER BY p || d)) AS sha256 FROM p")
def sealed(spark, d):
    return X.sealed(table(spark, d, "region"), ["r_regionkey", "r_name"])


@query("o017_adapted_sources", "SELECT 'docs' AS source, lang AS label, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'talk', role, count(*) FROM conversations GROUP BY ALL")
def adapted_sources(spark, d):
    specs = [{"name": "docs", "rows": table(spark, d, "documents"), "text": "text", "label": "lang"}, {"name": "talk", "rows": table(spark, d, "conversations"), "text": "text", "label": "role"}]
    return X.adapted(spark, specs).groupBy("source", "label").agg(F.count("*").alias("n"))


@query("o018_capped_specs", "SELECT 'docs' AS source, text AS state FROM documents ORDER BY sha256(text) LIMIT 20")
def capped_specs(spark, d):
    return X.adapted(spark, [{"name": "docs", "rows": table(spark, d, "documents"), "text": "text", "label": "lang", "cap": 20}]).select("source", "state")


@query("o019_flat_results", "SELECT lang AS run, metric, n FROM (SELECT lang, unnest(['docs', 'chars']) AS metric, unnest([count(*), sum(n_chars)::BIGINT]) AS n FROM documents GROUP BY lang)")
def flat_results(spark, d):
    path = X.scratch(spark, "results")
    g = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
    g.select(F.col("lang").alias("run"), F.create_map(F.lit("docs"), "docs", F.lit("chars"), "chars").alias("metrics")).write.json(path)
    return spark.read.schema("run string, metrics map<string,long>").json(path).select("run", F.explode("metrics").alias("metric", "n"))


@query("o023_nfkc_casefold")
def nfkc(spark, d):
    return table(spark, d, "documents").select("doc_id", X.nfkc_casefold("text").alias("tokens"))


@query(
    "o033_clean_body",
    r"WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text || E'\n  > quoted\nown again\nOn Monday X wrote:\nold text' ELSE E'> before\n' || text END AS s FROM conversations), "
    r"l AS (SELECT conv_id, turn, list_filter(string_split(s, chr(10)), lambda x: NOT starts_with(ltrim(x), '>')) AS l FROM t), "
    r"c AS (SELECT *, list_position(list_transform(l, lambda x: regexp_matches(trim(x), '(?i)^(-{2,} ?(original message|forwarded).*|on .* wrote:|--|_{5,})\s*$')), true) AS cut FROM l), "
    r"o AS (SELECT conv_id, turn, array_to_string(CASE WHEN cut > 0 THEN list_slice(l, 1, cut - 1) ELSE l END, chr(10)) AS s FROM c) "
    r"SELECT conv_id, turn, substr(regexp_replace(regexp_replace(regexp_replace(s, '[ \t]+', ' ', 'g'), E'\n{3,}', E'\n\n', 'g'), '^\s+|\s+$', '', 'g'), 1, 1500) AS body FROM o",
)
def clean_body(spark, d):
    quoted = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit("\n  > quoted\nown again\nOn Monday X wrote:\nold text"))).otherwise(F.concat(F.lit("> before\n"), "text"))
    return table(spark, d, "conversations").select("conv_id", "turn", X.clean_body(quoted).alias("body"))


@query("o038_near_dup_names", "SELECT p_partkey, string_split(p_name, ' ')[1] AS dropped FROM part")
def near_dup_names(spark, d):
    words = F.split("p_name", " ")
    return table(spark, d, "part").select("p_partkey", F.array_join(F.slice(words, F.lit(1), F.greatest(F.lit(1), F.size(words) - 1)), " ").alias("w"), words.alias("all")).select("p_partkey", F.get(F.split("w", " "), F.lit(0)).alias("dropped"))


@query(
    "o040_string_leaves",
    "SELECT event_id, unnest(['a.type', 'a.list[0]', 'a.list[2].user', 'top']) AS path, unnest([event_type, 'x', 'u' || user_id, 'text of ' || event_id]) AS text FROM events",
)
def string_leaves(spark, d):
    nested = F.concat(
        F.lit('{"a": {"type": "'), "event_type", F.lit('", "list": ["x", '), F.col("user_id").cast("string"), F.lit(', {"user": "u'), F.col("user_id").cast("string"), F.lit('"}]}, "provenance": {"by": "nobody"}, "n": 1, "none": null, "top": "text of '),
        F.col("event_id").cast("string"), F.lit('"}'),
    )
    return X.string_leaves(table(spark, d, "events").select("event_id", nested.alias("props")), "event_id", "props", ["provenance"])


@query("o016_batch_decide", f"WITH {DECISIONS_SQL}, z AS (SELECT row_id, k, list_transform(range(0, k + 1), lambda j: 4 * {unit_sql("'serve:' || row_id || ':' || j")}) AS z FROM decisions) SELECT row_id, list_position(z, list_max(z)) - 1 AS pred FROM z")
def batch_decide(spark, d):
    x = decisions(spark, d).select("row_id", "k", F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: i.cast("string")).alias("candidates"))
    return Z.decide(x, Z.pseudo("serve", "row_id")).select("row_id", "pred")


@query("o251_precomputed_scores", f"WITH {DECISIONS_SQL} SELECT row_id, list_position(probs, list_max(probs)) - 1 AS pred FROM decisions")
def precomputed_scores(spark, d):
    x = decisions(spark, d)
    return Z.decide(x.select("row_id", "k"), Z.precomputed(x.select("row_id", "logits"), "row_id")).select("row_id", "pred")


@query("o252_score_fn")
def score_fn(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("state"), F.lit("who?").alias("query"), F.array(F.lit("user"), F.lit("assistant")).alias("candidates"))
    fn = lambda states, queries, cands: [[float(len(s) % 7), float(len(s) % 5), 1.0] for s in states]
    return Z.decide(rows, Z.batched(fn)).select("conv_id", "turn", "pred")


@query("o253_state_once", "SELECT conv_id, turn, length(text) % 10 AS answer FROM conversations")
def state_once(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return Z.once_a_state(rows, lambda s: len(s) % 10, lambda e, part: part.assign(answer=e)[["conv_id", "turn", "answer"]], "text", "conv_id long, turn long, answer long")


@query("o257_heuristic_plan", "SELECT * FROM (VALUES ('o_orderpriority', 'decision'), ('o_orderkey', 'excluded'), ('o_custkey', 'fact'), ('o_orderstatus', 'decision')) v(column_name, role)")
def heuristic_plan(spark, d):
    from ..operators.profiles import column_profile

    p = column_profile(table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])
    role = F.when(F.col("kind").isin("constant", "date", "id-like"), "excluded").when((F.col("kind") == "categorical") & (F.col("distinct") <= 20), "decision").when(F.col("kind") == "text", "body").otherwise("fact")
    return p.select(F.col("column").alias("column_name"), role.alias("role"))


@query("o244_ticker", "SELECT event_id, CASE WHEN value > 50 THEN 'act' ELSE 'wait' END AS decision FROM events")
def ticker(spark, d):
    path = X.scratch(spark, "ticker")
    table(spark, d, "events").select("event_id", "value").repartition(2).write.parquet(f"{path}/in")
    stream = I.decided(I.file_stream(spark, f"{path}/in", "event_id long, value double"), F.when(F.col("value") > 50, "act").otherwise("wait"))
    out = f"{path}/out"
    stream.select("event_id", "decision").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("o249_thread_gap")
def thread_gap(spark, d):
    """Sessions by inactivity as a stream with a watermark: what it has closed by the end."""
    path = X.scratch(spark, "gaps")
    table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.parquet(f"{path}/in")
    s = I.sessions(I.file_stream(spark, f"{path}/in", "user_id long, ts timestamp"), "user_id", "ts", "12 hours", "1 hour")
    s.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id long, start timestamp, stop timestamp, n long").parquet(f"{path}/out")
