"""Break flags and event counts as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def current_flags(log: DataFrame) -> DataFrame:
    """Flags that stand after a log of (id, action, at, ...): the last action of each id, unless it deletes."""
    last = Window.partitionBy("id").orderBy(F.desc("at"), F.desc("action"))
    return log.withColumn("__n", F.row_number().over(last)).where("__n = 1 and action <> 'delete'").drop("__n")


def upsert_flags(stream: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Append the stream of flag actions to a log, each micro-batch once.

    A batch that is retried writes its own folder again and nothing else;
    ``current_flags`` reads the log's state."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by tumbling window, for streams and tables alike."""
    out = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), key, "n", F.round("total", 3).alias("total"))
