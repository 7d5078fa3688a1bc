"""A store of timed rows by day: appends that stay unique, packed past days, and hourly summaries with a live tail.

Under the root of a store:
live/batch=<id>/day=<date>    rows as batches brought them; a batch that comes again is there already
packed/version=<n>/day=<date> past days in few sorted files
packs/                        which version a day has, and up to which batch it holds the day's live rows
hourly/day=<date>, marks/     summaries of closed hours, and up to when hours are closed
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corridor.common import Refused, checkpointed

PACKS, MARKS = "day date, version long, upto long", "n long, upto timestamp"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reaches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _noted(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def _packs(spark: SparkSession, root: str) -> DataFrame:
    """day, version and upto of the newest pack of each packed day: a row a day."""
    notes = _noted(spark, f"{root}/packs", PACKS)
    return notes.groupBy("day").agg(F.max(F.struct("version", "upto")).alias("p")).select("day", "p.version", "p.upto")


def rows_of(spark: SparkSession, root: str, schema: str, days: Column | None = None) -> DataFrame:
    """The rows of a store with their day: packed days from their newest version, with what came later, and others live.

    ``days`` is a condition on day alone, and becomes a filter on the folders that are read; so does one that a caller
    puts on the result. Which versions and batches count is joined from a row a day.
    """
    parts = []
    packs = F.broadcast(_packs(spark, root).withColumnRenamed("day", "_day"))  # a row a day
    columns = ", ".join([schema, "day date"])
    if exists(spark, f"{root}/packed"):
        packed = spark.read.schema(f"{columns}, version long").parquet(f"{root}/packed")
        packed = packed if days is None else packed.where(days)
        parts.append(packed.join(packs, (packed["day"] == F.col("_day")) & (packed["version"] == packs["version"]), "left_semi").drop("version"))
    if exists(spark, f"{root}/live"):
        live = spark.read.schema(f"{columns}, batch long").parquet(f"{root}/live")
        live = live if days is None else live.where(days)
        held = (live["day"] == F.col("_day")) & (live["batch"] <= F.col("upto"))
        parts.append(live.join(packs, held, "left_anti").drop("batch"))
    if not parts:
        return spark.createDataFrame([], columns)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def append_once(spark: SparkSession, root: str, schema: str, key: list[str], time: str = "time") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows whose key the store does not hold yet are added, however late they come.

    A key holds the time, so a row can only repeat one of its own day: the days that the batch touches are read, no others.
    A batch that is there whole already is left as it is; one that failed half-way is put in its own place again, and does
    not see its first attempt. So ids must come from one checkpoint for as long as the store lives. Rows without a time
    are refused.
    """
    if time not in key:
        raise Refused(f"a key without {time} would have to be looked for in every day")

    def run(batch: DataFrame, batch_id: int) -> None:
        if exists(spark, f"{root}/live/batch={batch_id}/_SUCCESS"):
            return
        new = batch.select(*spark.createDataFrame([], schema).columns).withColumn("day", F.to_date(time)).dropDuplicates(key).persist()
        days = [r["day"] for r in new.select("day").distinct().collect()]  # the days of one batch
        if None in days:
            raise Refused(f"a row without {time}")
        if days:
            there = rows_of(spark, root, schema, F.col("day").isin(days))
            if exists(spark, f"{root}/live/batch={batch_id}"):
                there = _without_batch(spark, root, schema, batch_id, days)
            there = there.select(*[F.col(c).alias(f"_{c}") for c in (*key, "day")])
            same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*key, "day")]
            new.join(there, same, "left_anti").write.mode("overwrite").partitionBy("day").parquet(f"{root}/live/batch={batch_id}")
        new.unpersist()

    return run


def _without_batch(spark: SparkSession, root: str, schema: str, batch_id: int, days: list) -> DataFrame:
    """The rows of some days but for those that a batch brought, settled so that the batch may be overwritten."""
    live = spark.read.schema(f"{schema}, day date, batch long").parquet(f"{root}/live").where(F.col("day").isin(days) & (F.col("batch") != batch_id))
    if not exists(spark, f"{root}/packed"):
        return checkpointed(live.drop("batch"))
    packs = F.broadcast(_packs(spark, root).where(F.col("upto") < batch_id).select(F.col("day").alias("_day"), F.col("version").alias("_version")))  # a row a day
    packed = spark.read.schema(f"{schema}, day date, version long").parquet(f"{root}/packed").where(F.col("day").isin(days))
    packed = packed.join(packs, (F.col("day") == F.col("_day")) & (F.col("version") == F.col("_version")), "left_semi").drop("version")
    return checkpointed(live.drop("batch").unionByName(packed))


def pack(spark: SparkSession, root: str, schema: str, sort: list[str], before: Column) -> list:
    """Past days (``before``: a condition on day) that have live rows are rewritten as one file each, sorted; their list.

    Which live batches a pack holds is noted with it: rows that come for a packed day later stay visible beside it, and the
    next pack takes them in. Readers see the old rows until the note is written, and the new ones after; nothing is deleted.
    """
    if not exists(spark, f"{root}/live"):
        return []
    packs = F.broadcast(_packs(spark, root).select(F.col("day").alias("_day"), "upto"))  # a row a day
    live = spark.read.schema("day date, batch long").parquet(f"{root}/live").where(before)
    open_days = live.join(packs, (F.col("day") == F.col("_day")) & (F.col("batch") <= F.col("upto")), "left_anti").groupBy("day").agg(F.max("batch").alias("upto"))
    found = sorted(open_days.collect())  # a row a day
    if not found:
        return []
    days = [r["day"] for r in found]
    last = _noted(spark, f"{root}/packs", PACKS).agg(F.max("version")).first()[0]
    version = 0 if last is None else last + 1
    rows = rows_of(spark, root, schema, F.col("day").isin(days))
    rows.repartition(len(days), "day").sortWithinPartitions("day", *sort).write.partitionBy("day").parquet(f"{root}/packed/version={version}")
    spark.createDataFrame([(r["day"], version, r["upto"]) for r in found], PACKS).coalesce(1).write.mode("append").parquet(f"{root}/packs")
    return days


def closed_upto(spark: SparkSession, root: str):
    """Up to when hours are closed; null before the first."""
    return _noted(spark, f"{root}/marks", MARKS).agg(F.max_by("upto", "n")).first()[0]


def close_hours(spark: SparkSession, root: str, schema: str, summary: Callable[[DataFrame], DataFrame], upto) -> None:
    """Hours before ``upto`` (a timestamp, a full hour) are summed into the stored summaries; ``upto`` is then noted.

    Only days from the last mark's on are read and rewritten, late rows of that day included; a failure between the two
    steps leaves the old mark, and the summaries beyond it unread.
    """
    marks = _noted(spark, f"{root}/marks", MARKS)
    n, low = marks.agg(F.coalesce(F.max("n"), F.lit(-1)), F.max_by("upto", "n")).first()
    if low is not None and upto < low:
        raise Refused("hours that are closed stay closed: refresh them instead")
    span = F.col("day") <= F.to_date(F.lit(upto))
    span = span if low is None else span & (F.col("day") >= F.to_date(F.lit(low)))
    out = summary(rows_of(spark, root, schema, span).drop("day")).where(F.col("bucket") < F.lit(upto)).withColumn("day", F.to_date("bucket"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{root}/hourly")
    spark.createDataFrame([(n + 1, upto)], MARKS).coalesce(1).write.mode("append").parquet(f"{root}/marks")


def hours_of(spark: SparkSession, root: str, schema: str, summary: Callable[[DataFrame], DataFrame], time: str = "time") -> DataFrame:
    """Summaries of all hours: the closed ones as stored, and the hours from the mark on summed from the rows as they are.

    An hour is on one side of the mark alone. A row that comes late for a closed hour counts once that hour is refreshed.
    """
    upto = closed_upto(spark, root)
    if upto is None:
        return summary(rows_of(spark, root, schema).drop("day"))
    rows = rows_of(spark, root, schema, F.col("day") >= F.to_date(F.lit(upto))).where(F.col(time) >= F.lit(upto))
    closed = spark.read.parquet(f"{root}/hourly").where(F.col("bucket") < F.lit(upto)).drop("day")
    return closed.unionByName(summary(rows.drop("day")))


def refresh_hours(spark: SparkSession, root: str, schema: str, summary: Callable[[DataFrame], DataFrame], days: list) -> None:
    """The closed hours of some days are summed again from all rows, late ones too."""
    upto = closed_upto(spark, root)
    if upto is None:
        return
    rows = rows_of(spark, root, schema, F.col("day").isin(days))
    out = summary(rows.drop("day")).where(F.col("bucket") < F.lit(upto)).withColumn("day", F.to_date("bucket"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{root}/hourly")
