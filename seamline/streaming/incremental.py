"""The two incremental operators as streams: daily means of arrays, and copying of rows that a target lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_means(stream: DataFrame, keys: list[str], at: str, value: str, late: str = "1 day") -> DataFrame:
    """Mean and count of each key's values by day. A day is emitted once it is ``late`` behind the newest row; later rows for it are dropped."""
    timed = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    sums = timed.groupBy(F.window("_at", "1 day").alias("day"), *keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return sums.select(*keys, F.col("day.start").alias("day"), "mean", "n")


def first_seen(stream: DataFrame, hash: str, at: str, late: str = "1 day") -> DataFrame:
    """Rows whose hash has not come within the watermark before; state is kept no longer than that."""
    return stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark([hash]).drop("_at")


def sync_to(stream: DataFrame, path: str, hash: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's rows that the Parquet table at ``path`` lacks by hash. A batch that is run again after a failure adds nothing twice."""

    def add(batch: DataFrame, _: int) -> None:
        rows = batch.filter(F.col(hash).isNotNull()).dropDuplicates([hash])
        session = batch.sparkSession
        there = session._jvm.org.apache.hadoop.fs.Path(path)
        if there.getFileSystem(session._jsc.hadoopConfiguration()).exists(there):
            rows = rows.join(session.read.parquet(path).select(hash), hash, "left_anti").select(*batch.columns)
        rows.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
