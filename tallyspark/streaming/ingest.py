"""Streams: resumable ingest, decision tickers, sessions by inactivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def file_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files_a_trigger: int = 1) -> DataFrame:
    """Files of a folder as they come; the checkpoint remembers those done."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).format(kind).load(path)


def ingested(spark: SparkSession, stream: DataFrame, table: str, checkpoint: str, keys: list[str]) -> None:
    """Runs the stream over what there is and stops: each batch's rows by key with the number of copies, in a folder of its own (a batch that runs again replaces itself)."""

    def keep(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        once = batch.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r"), F.count("*").alias("copies"))
        once.select(*keys, "r.*", "copies").write.mode("overwrite").parquet(f"{table}/batch={number}")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def ingested_table(spark: SparkSession, table: str, keys: list[str]) -> DataFrame:
    """The first row of each key over all batches, copies summed."""
    rows = spark.read.parquet(table)
    rest = [c for c in rows.columns if c not in (*keys, "copies", "batch")]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), "batch").alias("r"), F.sum("copies").alias("copies")).select(*keys, "r.*", "copies")


def decided(stream: DataFrame, decision: Column) -> DataFrame:
    """A stateless decision for each item."""
    return stream.withColumn("decision", decision)


def sessions(stream: DataFrame, by: str, ts: str, gap: str, late: str) -> DataFrame:
    """(by, start, stop, n) of sessions that end after ``gap`` without an event; events later than ``late`` are dropped."""
    windowed = stream.withWatermark(ts, late).groupBy(by, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return windowed.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def to_memory(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs the stream to the end of what there is, into a table in memory (for small results)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
