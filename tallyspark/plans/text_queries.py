"""Queries of projections, normalisers and text scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, text as T
from .catalog import query, table, unit_sql

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_NORM = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
_VALUE = (
    r"CASE WHEN regexp_matches(s, '^[-+]?[0-9]+(\.[0-9]+)?$') THEN regexp_replace(s, '^\++', '') "
    r"WHEN trim(regexp_replace(lower(s), '[^\p{L}\p{N}\p{M}]+', ' ', 'g')) = '' THEN lower(s) "
    r"ELSE trim(regexp_replace(lower(s), '[^\p{L}\p{N}\p{M}]+', ' ', 'g')) END"
)


@query("o020_trunc", f"SELECT doc_id, substr({_STRIP.format('text')}, 1, 120) AS head FROM documents")
def trunc(spark, d):
    return table(spark, d, "documents").select("doc_id", T.trunc(F.col("text"), 120).alias("head"))


@query("o021_norm_text", f"SELECT doc_id, md5({_NORM.format('text')}) AS norm FROM documents")
def norm_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.norm_text(F.col("text"))).alias("norm"))


_STRICT = r"regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}\p{Pc}\s]', ' ', 'g')"


@query(
    "o022_strict_norm",
    rf"SELECT item_id, trim(regexp_replace({_STRICT}, '\s+', ' ', 'g')) AS plain, trim(regexp_replace(regexp_replace({_STRICT}, '[0-9]+', '#', 'g'), '\s+', ' ', 'g')) AS numbers FROM benchmark",
)
def strict_norm(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.strict_norm(F.col("text")).alias("plain"), T.strict_norm(F.col("text"), True).alias("numbers"))


@query("o024_value_norm", f"SELECT p_partkey, {_VALUE} AS value FROM (SELECT p_partkey, {_STRIP.format('p_type')} AS s FROM part)")
def value_norm(spark, d):
    return table(spark, d, "part").select("p_partkey", T.value_norm(F.col("p_type")).alias("value"))


@query(
    "o025_number_erased",
    r"SELECT event_id, array_to_string(regexp_extract_all(regexp_replace(lower(props), '[0-9]+(\.[0-9]+)?', '<number>', 'g'), '[\p{L}\p{N}\p{M}_<>]+'), ' ') AS erased FROM events",
)
def number_erased(spark, d):
    return table(spark, d, "events").select("event_id", T.number_erased(F.col("props")).alias("erased"))


@query(
    "o026_identifier_words",
    r"SELECT DISTINCT event_type, replace(event_type, '_', ' ') AS words, lower(trim(regexp_replace(camel, '([A-Z])', ' \1', 'g'))) AS camel_words "
    r"FROM (SELECT event_type, upper(substr(event_type, 1, 1)) || replace(substr(event_type, 2), '_', '') || 'EventType' AS camel FROM events)",
)
def identifier_words(spark, d):
    camel = F.concat(F.upper(F.substring("event_type", 1, 1)), F.regexp_replace(F.expr("substring(event_type, 2)"), "_", ""), F.lit("EventType"))
    return table(spark, d, "events").select("event_type").distinct().select("event_type", T.identifier_words(F.col("event_type")).alias("words"), T.identifier_words(camel).alias("camel_words"))


@query(
    "o027_render_templates",
    "SELECT conv_id, turn, replace(replace(t.tpl, '{hyp}', role), '{q}', substr(text, 1, 40)) AS rendered FROM conversations, (VALUES (0, 'Is it true that {hyp} said: {q}?'), (1, '{q} Does {hyp} agree?')) t(i, tpl) WHERE turn % 2 = t.i",
)
def render_templates(spark, d):
    templates = spark.createDataFrame([(0, "Is it true that {hyp} said: {q}?"), (1, "{q} Does {hyp} agree?")], "i int, tpl string")
    rows = table(spark, d, "conversations").join(F.broadcast(templates), F.col("turn") % 2 == F.col("i"))  # the template table is fixed
    return rows.select("conv_id", "turn", T.render(F.col("tpl"), hyp=F.col("role"), q=F.substring("text", 1, 40)).alias("rendered"))


@query(
    "o028_question_text",
    "SELECT p_partkey, 'Which brand?' || chr(10) || 'brand: ' || p_brand || '  other: other' AS choice, "
    "'Is it big?' || chr(10) || 'yes: ' || p_type || '  no: No' AS noul, 'Rate it' || chr(10) || '0: low  1: ' || p_brand AS score FROM part",
)
def question_text(spark, d):
    p = table(spark, d, "part")
    empty = F.array().cast("array<string>")
    return p.select(
        "p_partkey",
        T.question_text(F.lit("Which brand?"), F.lit("choice"), F.array(F.lit("brand"), F.lit("other")), F.array("p_brand", F.lit(None).cast("string"))).alias("choice"),
        T.question_text(F.lit("Is it big?"), F.lit("noul"), F.array(F.lit("true")), F.array("p_type")).alias("noul"),
        T.question_text(F.lit("Rate it"), F.lit("score"), empty, F.array(F.lit("low"), F.col("p_brand"))).alias("score"),
    )


@query(
    "o029_case_text",
    "SELECT o_orderkey, 'status: ' || o_orderstatus || '.' || chr(10) || 'priority: ' || o_orderpriority || '.' || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || chr(10) || 'even order' ELSE '' END AS case_text FROM orders",
)
def case_text(spark, d):
    facts = F.array(F.concat(F.lit("status: "), "o_orderstatus", F.lit(".")), F.lit(""), F.concat(F.lit("priority: "), "o_orderpriority", F.lit(".")))
    body = F.when(F.col("o_orderkey") % 2 == 0, "even order").otherwise("")
    return table(spark, d, "orders").select("o_orderkey", T.case_text(facts, body).alias("case_text"))


@query(
    "o030_mapped_answers",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'final' END AS answer FROM orders",
)
def mapped_answers(spark, d):
    mapping = spark.createDataFrame([("o", "open"), ("f", "final")], "value string, label string")
    o = table(spark, d, "orders").withColumn("v", T.value_norm(F.col("o_orderstatus")))
    return o.join(F.broadcast(mapping), F.col("v") == F.col("value"), "left").select("o_orderkey", F.col("label").alias("answer"))  # the mapping is a plan's, fixed


_MAIL = r"[\p{L}\p{N}\p{M}_.+-]+@[\p{L}\p{N}\p{M}_-]+(?:\.[\p{L}\p{N}\p{M}_-]+)+"
_CARD = r"\b\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}\b"


@query(
    "o031_pii_counts",
    rf"SELECT doc_id, len(regexp_extract_all(text, '{_MAIL}')) AS mails, len(regexp_extract_all(regexp_replace(text, '{_MAIL}', '[email]', 'g'), '{_CARD}')) AS cards FROM documents",
)
def pii_counts(spark, d):
    """Before the masks that need look-behind; masked() itself is tested in Python."""
    mail = F.regexp_count("text", F.lit("(?U)" + T.EMAIL))
    cards = F.regexp_count(F.regexp_replace("text", "(?U)" + T.EMAIL, "[email]"), F.lit(T.CARD))
    return table(spark, d, "documents").select("doc_id", mail.cast("long").alias("mails"), cards.cast("long").alias("cards"))


@query("o031_masked")
def masked(spark, d):
    return table(spark, d, "documents").select("doc_id", T.masked(F.col("text")).alias("masked"))


def _language_sql() -> str:
    hits = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(s) for s in words.split())}))) AS {code}_" for code, words in T.STOPWORDS.items())
    best = "greatest(en_, es_, fr_, de_)"
    return f"""SELECT doc_id, CASE WHEN len(w) = 0 THEN 'und' WHEN {best} < 2 THEN 'und' WHEN en_ = {best} THEN 'en' WHEN es_ = {best} THEN 'es' WHEN fr_ = {best} THEN 'fr' ELSE 'de' END AS guessed
FROM (SELECT *, {hits} FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}]+') AS w FROM documents))"""


@query("o032_guess_lang", _language_sql())
def guess_lang(spark, d):
    return table(spark, d, "documents").select("doc_id", T.guessed_language(F.col("text")).alias("guessed"))


@query(
    "o034_subject_key",
    r"SELECT conv_id, turn, lower(trim(regexp_replace(regexp_replace(s, '^\s*((re|fw|fwd|aw|sv|tr|wg)\s*(\[\d+\])?\s*:\s*)+', '', 'i'), '\s+', ' ', 'g'))) AS skey FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Re: FW: ' WHEN 1 THEN 'AW[2]:  ' ELSE '' END || substr(text, 1, 60) AS s FROM conversations)",
)
def subject_key(spark, d):
    prefix = F.when(F.col("turn") % 3 == 0, "Re: FW: ").when(F.col("turn") % 3 == 1, "AW[2]:  ").otherwise("")
    return table(spark, d, "conversations").select("conv_id", "turn", T.subject_key(F.concat(prefix, F.substring("text", 1, 60))).alias("skey"))


@query("o035_account_redaction", r"SELECT doc_id, md5(regexp_replace(text, '\d(-?\d){7,}', '[number]', 'g')) AS redacted FROM documents")
def account_redaction(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.accounts_redacted(F.col("text"))).alias("redacted"))


@query("o036_strip_prefix", r"SELECT p_partkey, p_type AS kept, p_type || ' (b)' AS other FROM part")
def strip_prefix(spark, d):
    return table(spark, d, "part").select("p_partkey", T.option_prefix_stripped(F.concat(F.lit("(a) "), "p_type")).alias("kept"), T.option_prefix_stripped(F.concat(F.lit("B. "), "p_type", F.lit(" (b)"))).alias("other"))


@query(
    "o037_near_dup_text",
    "SELECT p_partkey, CASE WHEN p_name LIKE '%.' THEN substr(p_name, 1, length(p_name) - 1) ELSE p_name || '.' END AS variant, 'The ' || lower(substr(p_name, 1, 1)) || substr(p_name, 2) AS article FROM part",
)
def near_dup_text(spark, d):
    return table(spark, d, "part").select("p_partkey", T.near_variants(F.col("p_name")).alias("variant"), T.article_variant(F.col("p_name")).alias("article"))


@query(
    "o039_style_names",
    f"SELECT c_custkey, CASE WHEN u < 0.5 THEN seg WHEN u < 0.7 THEN upper(substr(seg, 1, 1)) || substr(seg, 2) ELSE seg || ' group' END AS styled FROM (SELECT c_custkey, lower(c_mktsegment) AS seg, {unit_sql("'style:' || c_custkey")} AS u FROM customer)",
)
def style_names(spark, d):
    seg, u = F.lower("c_mktsegment"), hashing.unit("style", F.col("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", F.when(u < 0.5, seg).when(u < 0.7, F.initcap(seg)).otherwise(F.concat(seg, F.lit(" group"))).alias("styled"))


@query(
    "o041_id_tokens",
    r"""SELECT page_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(lower(url), '[\w.@\\/:-]+'), lambda t: regexp_replace(t, '^[.:/-]+|[.:/-]+$', '', 'g')),
 lambda t: length(t) >= 8 AND ((regexp_matches(t, '[a-z]') AND regexp_matches(t, '\d')) OR contains(t, '@') OR regexp_matches(t, '[a-z]\.[a-z]')) AND NOT regexp_matches(t, '^\d{4}-\d{2}-\d{2}')))) AS tokens FROM pages""",
)
def id_tokens(spark, d):
    return table(spark, d, "pages").select("page_id", T.id_tokens(F.col("url")).alias("tokens"))


def _stems_sql() -> str:
    known = ", ".join(repr(w) for w in T.QUESTION_WORDS.split())
    return rf"""SELECT item_id, list_sort(list_distinct(list_transform(list_filter(regexp_extract_all({_VALUE}, '[\p{{L}}\p{{M}}]{{3,}}'), lambda w: w NOT IN ({known})), lambda w: substr(w, 1, 5)))) AS stems
FROM (SELECT item_id, {_STRIP.format('text')} AS s FROM benchmark)"""


@query("o042_stems", _stems_sql())
def stems(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.stems(F.col("text")).alias("stems"))


@query(
    "o044_question_kind",
    "SELECT DISTINCT q, k AS kind FROM (VALUES ('Is it late?', 'noul'), ('How urgent is it?', 'score'), ('Which team: sales, support', 'choice'), ('rate the tone', 'score'), ('red or blue?', 'choice')) v(q, k)",
)
def question_kind(spark, d):
    qs = spark.createDataFrame([(q,) for q in ("Is it late?", "How urgent is it?", "Which team: sales, support", "rate the tone", "red or blue?")], "q string")
    return qs.select("q", T.question_kind(F.col("q")).alias("kind"))


@query(
    "o046_option_lists",
    "SELECT p_partkey, 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || 'C. none' AS listed, [0, length(p_brand) + 4, length(p_brand) + length(p_type) + 8] AS spans FROM part",
)
def option_lists(spark, d):
    options = F.array("p_brand", "p_type", F.lit("none"))
    return table(spark, d, "part").select("p_partkey", T.lettered_options(options).alias("listed"), T.option_spans(options).alias("spans"))


@query(
    "o047_yes_no_rows",
    "SELECT o_orderkey, o_orderstatus <> 'P' OR o_orderkey % 3 = 0 AS yes_no, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END::BIGINT AS yes_at FROM orders",
)
def yes_no_rows(spark, d):
    s = F.col("o_orderstatus")
    options = F.when(s == "F", F.array(F.lit("No"), F.lit(" Yes "))).when(s == "O", F.array(F.lit("yes"), F.lit("no"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    qtype = F.when(F.col("o_orderkey") % 3 == 0, "noul").otherwise("choice")
    return table(spark, d, "orders").select("o_orderkey", T.is_yes_no(options, qtype).alias("yes_no"), T.first_yes(options).alias("yes_at"))


@query(
    "o050_translation_digits",
    r"""WITH s AS (SELECT event_id, unnest(regexp_extract_all(props, '\d+')) AS run FROM events), a AS (SELECT event_id, run, count(*) AS n FROM s GROUP BY ALL),
t AS (SELECT event_id, unnest(regexp_extract_all(replace(props, '1', 'x'), '\d+')) AS run FROM events), b AS (SELECT event_id, run, count(*) AS n FROM t GROUP BY ALL)
SELECT a.event_id, a.run, a.n - coalesce(b.n, 0) AS missing FROM a LEFT JOIN b ON a.event_id = b.event_id AND a.run = b.run WHERE a.n > coalesce(b.n, 0)""",
)
def translation_digits(spark, d):
    """Digit runs of a source that its translation (here one without ones) lacks, as multisets."""
    from ..operators.quality import missing_runs

    e = table(spark, d, "events")
    return missing_runs(e.select("event_id", "props"), e.select("event_id", F.regexp_replace("props", "1", "x").alias("props")), "event_id", "props")
