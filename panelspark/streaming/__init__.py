"""Incremental event-time aggregation and tables that late data may change: an extension, as the panel operators are batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.sources import artifacts, lake


def window_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their sum of values per type and tumbling window; batch or stream. Rows later than `late` behind the newest are dropped by a stream."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n_events"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n_events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Events per user and session, a session ending after a gap."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n_events")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def drained(spark: SparkSession, source: str, out: str, size: str = "1 hour") -> DataFrame:
    """Reads a folder of events (or a glob of files) as a stream until it is drained and returns the windows.

    Offsets and state are checkpointed below out, so a run that is stopped goes on where it was;
    each trigger replaces the result table by the state's whole content.
    """
    schema = spark.read.parquet(source).schema
    events = spark.readStream.schema(schema).parquet(source).withColumn("ts", F.col("ts").cast("timestamp"))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/windows")

    stream = window_counts(events, size).writeStream.outputMode("complete").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    stream.awaitTermination()
    return spark.read.parquet(f"{out}/windows")


def newest_day(spark: SparkSession, out: str):
    """The business-date watermark: the newest day that a batch has had so far, or None."""
    at = f"{out}/watermark"
    return spark.read.schema("day date, batch long").parquet(at).agg(F.max("day")).first()[0] if artifacts.exists(spark, at) else None


def rebuilt(spark: SparkSession, source: str, out: str, time: str = "ts", keys: tuple[str, ...] = ("event_id",), overlap_days: int = 7, files: int = 1, summary=None) -> DataFrame:
    """Drains a folder of files into a table of rows by day that late and repeated rows may change, and gives a table made of each day.

    A batch's rows go into `rows`, a dataset by day in which equal keys of a day are one row, so a
    batch that is worked off again changes nothing. Days older than overlap_days behind the stored business-date watermark are closed: their rows go to
    `late` instead. Then the days that the batch touched are made anew from `rows` by `summary` (rows to rows with a
    `day`) and replaced in `days`. The watermark is stored last; a run that is stopped goes on with the batch it was at.
    """
    summary = summary or (lambda rows: rows.groupBy("day").agg(F.count("*").alias("n_events"), F.sum("value").alias("total")))
    schema = spark.read.parquet(source).schema

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.where(F.col(time).isNotNull()).withColumn("day", F.col(time).cast("date"))
        days = [r.day for r in rows.select("day").distinct().collect()]  # a batch's days
        if not days:
            return
        mark = newest_day(spark, out)
        closed = F.lit(False) if mark is None else F.col("day") < F.date_sub(F.lit(mark), overlap_days)
        rows.where(closed).write.mode("overwrite").parquet(f"{out}/late/batch={number}")
        open_ = rows.where(~closed)
        if not open_.isEmpty():
            lake.upsert(open_, f"{out}/rows", "day", list(keys))
            touched = spark.read.schema(rows.schema).parquet(f"{out}/rows").join(open_.select("day").distinct(), "day", "left_semi")
            lake.publish(summary(touched), f"{out}/days", "day")
        spark.createDataFrame([(max(d for d in [*days, mark] if d is not None), number)], "day date, batch long").write.mode("append").parquet(f"{out}/watermark")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    stream.writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.parquet(f"{out}/days")
