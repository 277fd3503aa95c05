"""One thin query for each operator: it applies the operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    from . import mixing, storage

    sizes, _ = storage.written(mixing.counted(_documents(spark, sf_dir), ["doc_id", "source"]), "mix-sizes")
    mix = mixing.placed(sizes)
    taken = F.aggregate("placements", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return mix.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.size("placements").alias("copies"), F.get("placements", F.lit(0))["position"].alias("position"))


URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import url_filter

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    judged = url_filter.judge(pages, [url_filter.Rule(*r) for r in URL_RULES], keep=["page_id"])
    return judged.withColumn("purity", F.round("purity", 9))


def op2_oracle() -> str:
    from . import url_filter

    return url_filter.oracle([url_filter.Rule(*r) for r in URL_RULES])


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import license_scan

    return license_scan.scan(_documents(spark, sf_dir), keep=["doc_id"]).drop("expressions")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import media

    return media.described(media.stored(_documents(spark, sf_dir)))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring_dedup

    found = substring_dedup.deduplicated(_documents(spark, sf_dir), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash_dedup

    groups = simhash_dedup.grouped(_documents(spark, sf_dir))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = _documents(spark, sf_dir)
    net = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = toxicity.scored(docs, net, keep=["doc_id"])
    return found.select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import packing

    return packing.packed(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secret_scan

    found = secret_scan.scan(_documents(spark, sf_dir), keep=["doc_id"])
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scan.joined(base).cast("binary"), 256).alias("base_sha256"), secret_scan.joined(F.col("secrets")).alias("spans"),
    )


def op10_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import embedding_dedup

    return embedding_dedup.grouped(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_url_filter, op3_license_scan, op4_media, op5_substring, op6_simhash, op7_toxicity, op8_packing, op9_secret_scan, op10_embedding)}

ORACLES: dict[str, str] = {"op2_url_filter": op2_oracle()}
