"""Activity logs as streams: visits by window, sessions, running totals."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.plans.lineage import shared_folder


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream, with a timestamp that can carry a watermark."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str = "1 day") -> DataFrame:
    w = F.window(F.col("ts").cast("timestamp"), width)
    return events.groupBy(w.start.alias("start"), "event_type").agg(F.count("*").alias("n")).select(F.unix_timestamp("start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    w = F.session_window(F.col("ts").cast("timestamp"), gap)
    out = events.groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


def visit_totals(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.round(F.col("value") * 100).cast("long")) / 100, 2).alias("value"))


def run_complete(totals: DataFrame) -> DataFrame:
    """Run a streaming aggregation over all there is; its last state is a table in the shared folder."""
    spark = totals.sparkSession
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}"

    def store(state: DataFrame, batch: int) -> None:
        state.write.mode("overwrite").parquet(f"{root}/state")

    query = totals.writeStream.outputMode("complete").foreachBatch(store).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(totals.schema).parquet(f"{root}/state")


def run_feed(changes: DataFrame, table: str, keys: list[str], order: str) -> None:
    """Keep a table of the newest row of each key from a stream of changes; a batch that runs again changes nothing.

    Tables are numbered by batch under `table`, and each batch reads the one before it.
    """
    spark = changes.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        old = spark.read.schema(batch.schema).parquet(f"{table}/{number - 1}") if number else batch.limit(0)
        rank = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc(F.to_json(F.struct(*batch.columns))))
        newest = old.unionByName(batch).withColumn("_i", F.row_number().over(rank)).where("_i = 1").drop("_i")
        newest.write.mode("overwrite").parquet(f"{table}/{number}")

    query = changes.writeStream.foreachBatch(merge).option("checkpointLocation", f"{table}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def late_counts(events: DataFrame, width: str, wait: str) -> DataFrame:
    """Counts of tumbling windows of a stream; rows later than `wait` behind the newest are left out."""
    w = F.window("ts", width)
    return events.withWatermark("ts", wait).groupBy(w, "event_type").agg(F.count("*").alias("n")).select(F.unix_timestamp("window.start").alias("start"), "event_type", "n")
