"""The corpus pipeline: toxicity, near copies, secrets, mixture, packing. Each stage takes what its predecessor kept; run() applies them to ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyspark.llm import mixing, packing, secret_scan, simhash_dedup, storage, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, fitted on ``labels``, scores below a half.

    Null and empty texts are scored like others (one empty window); repeated rows are judged alike; without labels of both kinds nothing is
    learnt and all documents stay.
    """
    net = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.accepted(docs, net)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): that with the smallest doc_id.

    Candidates come from the pivot tables of fingerprints and from shared least hashes; all of them are verified by the sets of shingles.

    Null and empty texts are copies of each other; repeated rows count once; rows without doc_id stay, but for equal texts among them.
    """
    return simhash_dedup.deduplicated(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in their texts replaced; n_chars follows where the table has it. Null texts stay null."""
    if "n_chars" not in docs.columns:
        return secret_scan.redacted(docs)
    return secret_scan.redacted(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in training order. Null and empty texts have no words and aren't taken; repeated rows each have places of their own."""
    return mixing.ordered_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 tokens. A null or empty text is the end id alone."""
    import public_tokenizers

    # an eighth of the usual cache: the executor's JVM has grown in earlier stages; rows are the same with any cache
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), cache=packing.CACHE // 8)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack),
]

#: A network, connected components and a packing plan aren't expressed in SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = storage.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
