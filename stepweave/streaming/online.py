"""Structured Streaming forms of the operators: counts kept up to date, windows, sessions, repeated deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ngram


def stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """New parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def timed(df: DataFrame, column: str, delay: str) -> DataFrame:
    """df with its event time as a timestamp and a watermark; a time without zone is read as of the session's."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def once(df: DataFrame, keys: list[str], column: str, delay: str) -> DataFrame:
    """Each delivery once, as far as repeats come within the delay."""
    return timed(df, column, delay).dropDuplicatesWithinWatermark(keys)


def tumbling(df: DataFrame, column: str, delay: str, size: str, *by: str) -> DataFrame:
    """(start, by..., n) per closed window."""
    return timed(df, column, delay).groupBy(F.window(column, size), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def sessions(df: DataFrame, column: str, delay: str, gap: str, *by: str) -> DataFrame:
    """(start, end, by..., n) per closed session."""
    return timed(df, column, delay).groupBy(F.session_window(column, gap), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def online_counts(sequences: DataFrame, vocabulary: DataFrame, folder: str, checkpoint: str, config: ngram.Config = ngram.Config()) -> StreamingQuery:
    """Keeps n-gram counts of a stream of sequences (domain, tokens, sign, weight, bad_idx): each micro-batch adds its own
    counts as the folder batch=<id>, which a repeated batch overwrites; read_online() adds them up."""

    def add(batch: DataFrame, batch_id: int) -> None:
        ngram.count(batch, vocabulary, config).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return sequences.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_online(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).groupBy("domain", "sign", "ctx", "token").agg(F.sum("w").alias("w"))


def run_to_table(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that a stream has now, as a table of folder: in mode append each batch is a part of its own, which a repeated batch
    overwrites, in mode complete the last batch is the table. Nothing goes through the driver. The stream's checkpoint
    stands in the same folder, so that a later run goes on where this one ended."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={0 if mode == 'complete' else batch_id}")

    q = df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    try:
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/table").select(*df.columns)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):  # no batch came
            return df.sparkSession.createDataFrame([], df.schema)
        raise
