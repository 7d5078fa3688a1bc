"""Streams of readings: deduplicated appends, hourly state, refresh of touched hours, log classification."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from corridor.operators.timeseries import DARK, STALE_S
from corridor.sources.sinks import write_versioned
from corridor.streaming.store import append_once


def readings_stream(spark: SparkSession, path: str, schema: str, key: list[str], time: str = "time", late: str = "1 hour") -> DataFrame:
    """Files that arrive in a folder as rows, each key once within the watermark."""
    return spark.readStream.schema(schema).parquet(path).withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def continuous_hourly(stream: DataFrame, key: str, maxima: list[str], time: str = "time") -> DataFrame:
    """Hourly maxima and counts of a stream that carries a watermark."""
    out = stream.groupBy(F.window(time, "1 hour"), key).agg(*[F.max(c).alias(f"max_{c}") for c in maxima], F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))
    return out.withColumn("bucket", F.col("window.start")).drop("window")


def refresh_touched(raw: Callable[[], DataFrame], target: str, summary: Callable[[DataFrame], DataFrame], time: str = "time") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the days that a batch touches are summed again from the raw rows and overwritten.

    Late rows so count whatever the watermark. The target is partitioned by day; other days stay as they are.
    """

    def run(batch: DataFrame, _: int) -> None:
        days = batch.select(F.to_date(time).alias("day")).distinct()
        again = raw().withColumn("day", F.to_date(time)).join(F.broadcast(days), "day", "left_semi")  # a row a day
        out = summary(again).withColumn("day", F.to_date("bucket"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(target)

    return run


def clear_replay(rows: DataFrame, summaries: DataFrame, summary: Callable[[DataFrame], DataFrame], time: str = "time") -> tuple[DataFrame, DataFrame]:
    """The rows that are no replay, and the summaries (bucket) with the hours that replays touched summed again from those.

    An hour that replays alone had is gone. Both can be written as new versions; other hours stay as they are.
    """
    hours = rows.where("replay_of is not null").select(F.date_trunc("hour", time).alias("bucket")).distinct()
    kept = rows.where("replay_of is null")
    again = kept.withColumn("_h", F.date_trunc("hour", time)).join(hours.withColumnRenamed("bucket", "_h"), "_h", "left_semi").drop("_h")
    return kept, summaries.join(hours, "bucket", "left_anti").unionByName(summary(again))


def compact(spark: SparkSession, path: str, day: str, root: str, key: str, time: str = "time") -> str:
    """A past day's small files as few sorted ones: a new version behind the manifest, the old files untouched.

    Readers of past days take the last complete version (``read_versioned``), so none sees half of one.
    """
    old = spark.read.parquet(f"{path}/day={day}")
    return write_versioned(old.repartition(F.col(key)).sortWithinPartitions(key, F.desc(time)), root, f"day={day}")


def still_status_stream(stream: DataFrame) -> DataFrame:
    """Classification of a still log as it arrives, with the last good hash of each camera as state.

    Rows of a camera come in rounds; within a batch they are taken in order of round.
    """
    import pandas as pd

    def classify(key, batches, state):
        (last,) = state.get if state.exists else (None,)
        rows = pd.concat(list(batches)).sort_values("round")
        said = []
        for r in rows.itertuples():
            if r.http != 200:
                said.append("http_error")
            elif not r.is_image:
                said.append("not_image")
            elif r.age_s > STALE_S:
                said.append("stale")
            else:
                said.append("duplicate" if r.sha1 == last else "dark" if r.luma < DARK else "ok")
                last = r.sha1
        state.update((last,))
        yield pd.DataFrame({"camera_id": key[0], "round": rows["round"].to_numpy(), "status": said})

    return stream.groupBy("camera_id").applyInPandasWithState(classify, "camera_id string, round long, status string", "last string", "append", "NoTimeout")


def store_stream(stream: DataFrame, root: str, schema: str, key: list[str], checkpoint: str, time: str = "time") -> DataStreamWriter:
    """A writer that adds a stream to a store of timed rows (``streaming.store``), each key once for ever."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(append_once(stream.sparkSession, root, schema, key, time))
