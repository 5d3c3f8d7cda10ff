"""Edges kept up to date as files of raw references arrive (an extension).

Every micro-batch replaces the references of the sources that it names, so a file
scanned again counts once; the edges are then accumulated from the latest state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from causeway.operators.edges import accumulate


def keep_latest(spark: SparkSession, stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append each batch to ``folder``, numbered, exactly once: a batch that runs again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/n={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Accumulated edges of the newest batch of every source."""
    rows = spark.read.parquet(folder).drop("n")
    newest = rows.groupBy("src").agg(F.max("batch").alias("batch"))
    return accumulate(rows.join(newest, ["src", "batch"], "left_semi"))


def replaced(spark: SparkSession, folder: str) -> DataFrame:
    """(src, versions): how often a source was scanned."""
    order = Window.partitionBy("src").orderBy("batch")
    return spark.read.parquet(folder).select("src", "batch").distinct().withColumn("version", F.row_number().over(order)).groupBy("src").agg(F.max("version").alias("versions"))
