"""Checks of rows against what they came from."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def missing_runs(source: DataFrame, translated: DataFrame, key: str, text: str, pattern: str = r"\d+") -> DataFrame:
    """(key, run, missing): matches that the source has more often than its translation."""

    def counts(df: DataFrame, n: str) -> DataFrame:
        return df.select(key, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("run")).groupBy(key, "run").agg(F.count("*").alias(n))

    both = counts(source, "n").join(counts(translated, "m"), [key, "run"], "left").withColumn("m", F.coalesce("m", F.lit(0)))
    return both.where("n > m").select(key, "run", (F.col("n") - F.col("m")).alias("missing"))
