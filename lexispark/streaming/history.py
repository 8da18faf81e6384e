"""The two time-stamped logs as streams; results equal the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def history_calendar_stream(hist: DataFrame, ts: str = "dt") -> DataFrame:
    """G1: history rows per day (y, m, d, cnt), for output mode `complete`.

    The state is one counter per day, so every day stays open and no late row is lost.
    """
    rows = hist.select(F.col(ts).cast("timestamp").alias("_ts"))
    day = rows.groupBy(F.window("_ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("cnt"))
    start = F.col("w.start")
    return day.select(F.year(start).alias("y"), F.month(start).alias("m"), F.day(start).alias("d"), "cnt")


def idle_sessions_stream(
    events: DataFrame, user: str = "user_id", ts: str = "ts", max_idle: str = "240 minutes", late: str = "1 day", closing: DataFrame | None = None
) -> DataFrame:
    """Sessions that ended because their user was idle for `max_idle`.

    (user, first, last, n); a session is emitted when the watermark passes its end.
    `closing` is a second stream, of single times: a row far in the future, added once the
    events have ended, moves the watermark past the last sessions too (`close_stream`).
    Its own session stays open. Rows later than `late` are counted by Spark's progress
    report (numRowsDroppedByWatermark).
    """
    rows = events.select(F.col(user).alias("user"), F.col(ts).cast("timestamp").alias("_ts"))
    if closing is not None:
        rows = rows.unionByName(closing.select(F.lit(None).cast(rows.schema["user"].dataType).alias("user"), F.col(closing.columns[0]).cast("timestamp").alias("_ts")))
    rows = rows.withWatermark("_ts", late)
    s = rows.groupBy("user", F.session_window("_ts", max_idle).alias("w")).agg(
        F.min("_ts").alias("first"), F.max("_ts").alias("last"), F.count(F.lit(1)).alias("n")
    )
    return s.select("user", "first", "last", "n")


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, into parquet, and read the result back.

    In mode `complete` each batch replaces the table. `append` emits a window only after
    the watermark has passed it; see `close_stream` for the last ones.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "complete":
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
    else:
        writer = writer.format("parquet").option("path", path)
    writer.start().awaitTermination()
    return stream.sparkSession.read.parquet(path)


CLOSING = "ts TIMESTAMP"


def closing_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of closing rows in a folder, empty until `close_stream`."""
    spark.createDataFrame([], CLOSING).write.mode("ignore").parquet(folder)
    return spark.readStream.schema(CLOSING).parquet(folder)


def close_stream(stream: DataFrame, folder: str, path: str, checkpoint: str) -> DataFrame:
    """After `run_to_end`: add a closing row and run once more, so that all is emitted."""
    spark = stream.sparkSession
    spark.sql("SELECT TIMESTAMP'9999-01-01 00:00:00' AS ts").write.mode("append").parquet(folder)
    return run_to_end(stream, path, checkpoint)
