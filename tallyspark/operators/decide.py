"""Typed answers from probability vectors, and the semantic predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import probs as P


def typed_answers(rows: DataFrame, p: Column) -> DataFrame:
    """choice (the first best label), yes (first label's probability of two), score (expected place) and p_null, after the null is split off."""
    rows = rows.withColumn("labels_p", P.over_labels(p)).withColumn("p_null", P.null_of(p))
    yes = F.when(F.size("labels_p") == 2, F.get("labels_p", F.lit(0)))
    return rows.withColumns({"choice": P.argmax(F.col("labels_p")), "yes": yes, "score": P.expected_level(F.col("labels_p"))})


def overlap_probability(text: Column, question: Column) -> Column:
    """A lexical scorer: the share of the question's words that the text has, as P(yes). It stands where a model's scorer would."""
    words = lambda s: F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit(r"(?U)[^\W_]{3,}"), F.lit(0)))
    asked = words(question)
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(words(text), asked)) / F.size(asked)).otherwise(0.0)


def register(spark: SparkSession) -> None:
    """``semantic_prob(text, question)`` for SQL: ``WHERE semantic_prob(body, 'late delivery') > 0.5``."""
    words = r"array_distinct(regexp_extract_all(lower({0}), '(?U)[^\\W_]{{3,}}', 0))"
    a, b = words.format("body"), words.format("asked")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION semantic_prob(body STRING, asked STRING) RETURNS DOUBLE RETURN CASE WHEN size({b}) > 0 THEN size(array_intersect({a}, {b})) / size({b}) ELSE 0D END")


def semantic_where(rows: DataFrame, text: Column, condition: str, scorer=overlap_probability, threshold: float = 0.5) -> DataFrame:
    """Rows with P(yes) above the threshold, with p."""
    return rows.withColumn("p", scorer(text, F.lit(condition)).cast("double")).where(F.col("p") > threshold)
