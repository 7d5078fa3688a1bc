"""Readings of cameras and sensors: hourly summaries, neighbours in time, alerts, log classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corridor.common import Refused

# Flag threshold in thousandths, flooded depth in centimetres, oldest still in seconds, darkest usable luma.
FLAG, FLOODED_CM, STALE_S, DARK = 500, 2, 900, 40


def hourly(df: DataFrame, key: str, maxima: list[str], time: str = "time", unit: str = "hour", means: tuple[str, ...] = ()) -> DataFrame:
    """Per key and hour (UTC): maxima, means, count, first and last time."""
    out = [F.max(c).alias(f"max_{c}") for c in maxima] + [F.avg(c).alias(f"mean_{c}") for c in means]
    return df.groupBy(key, F.date_trunc(unit, time).alias("bucket")).agg(*out, F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))


def asof_nearest(left: DataFrame, right: DataFrame, key: str, left_id: str, tol_s: int) -> DataFrame:
    """Each row of ``left`` (ltime) with the value of ``right`` (rtime, value) nearest in time, the earlier at equal gaps.

    Null beyond the tolerance. Time is cut into slots of the tolerance, so that a key's history is many join keys.
    """
    slot = lambda c: F.floor(F.unix_micros(c) / (tol_s * 1_000_000))
    a = left.select(left_id, key, "ltime", F.explode(F.array(*[slot("ltime") + k for k in (-1, 0, 1)])).alias("_slot"))
    b = right.select(key, "rtime", "value", slot("rtime").alias("_slot"))
    gap = F.abs(F.unix_micros("ltime") - F.unix_micros("rtime"))
    near = a.join(b, [key, "_slot"]).where(gap <= tol_s * 1_000_000)
    best = near.groupBy(left_id).agg(F.min(F.struct(gap.alias("gap"), "rtime", "value")).alias("m"))
    return left.select(left_id).join(best.select(left_id, "m.rtime", "m.value"), left_id, "left")


def _around_the_day(sums: DataFrame, key: list[str], minutes: int) -> DataFrame:
    """``sums`` (key, m, n, s, f) with n, s and f of the key's rows within so many minutes of each row's own minute of the day.

    The day is a ring: minutes near midnight stand past its other end too. A window holds a day's minutes at most.
    """
    m = F.col("m")
    turns = F.array_compact(F.array(F.lit(0), F.when(m < minutes, 1440), F.when(m >= 1440 - minutes, -1440)))
    w = Window.partitionBy(*key).orderBy("m").rangeBetween(-minutes, minutes)
    out = sums.withColumn("_t", F.explode(turns)).withColumn("m", m + F.col("_t")).withColumns({c: F.sum(c).over(w) for c in "nsf"})
    return out.where("_t = 0").drop("_t")


def by_time_of_day(target: DataFrame, pool: DataFrame, minutes: int) -> DataFrame:
    """Per target (id, camera_id, time): rows, mean depth and flooded share of its own camera within so many minutes of the
    same time of day, on other days; null where there are none.

    The day is a ring: 23:50 is near 00:10. The pool is first summed by camera, day and minute; a target's minute is among
    them, with nothing, so that its window is there. Sums of all days, less the own day's, are merged to the targets: they
    grow with the readings, so no side goes to every executor.
    """
    if not 0 <= minutes < 720:
        raise ValueError("minutes must be less than half a day")
    day, minute = F.to_date("time").alias("day"), (F.floor(F.unix_seconds("time") / 60) % 1440).alias("m")
    sums, zero = [F.sum(c).alias(c) for c in "nsf"], F.lit(0).cast("long")
    own = pool.groupBy("camera_id", day, minute).agg(F.count("*").alias("n"), F.sum("depth_cm").alias("s"), F.count_if(F.col("depth_cm") >= FLOODED_CM).alias("f"))
    t = target.select("id", "camera_id", day, minute)
    days = own.unionByName(t.select("camera_id", "day", "m", *[zero.alias(c) for c in "nsf"])).groupBy("camera_id", "day", "m").agg(*sums)
    every = _around_the_day(days.groupBy("camera_id", "m").agg(*sums), ["camera_id"], minutes)
    same = _around_the_day(days, ["camera_id", "day"], minutes).select("camera_id", "day", "m", *[F.col(c).alias(f"_{c}") for c in "nsf"])
    other = same.join(every.hint("merge"), ["camera_id", "m"]).select("camera_id", "day", "m", *[(F.col(c) - F.coalesce(F.col(f"_{c}"), zero)).alias(c) for c in "nsf"])
    n = F.nullif(F.col("n"), F.lit(0))
    return t.join(other.hint("merge"), ["camera_id", "day", "m"], "left").select("id", F.coalesce("n", zero).alias("n_near"), (F.col("s") / n).alias("mean_depth"), (F.col("f") / n).alias("flooded_share"))


#: Minutes of a block in which sums around a minute are taken.
BLOCK = 1440


def _around(sums: DataFrame, key: list[str], minutes: int) -> DataFrame:
    """``sums`` (key, m, n, s, f) with n, s and f of the rows within so many minutes of each row's own minute m.

    Minutes are dealt in blocks, each with those of its neighbours that its windows reach into: no row is repeated for
    every minute around it, and no window runs over a whole history.
    """
    blocks = F.array_distinct(F.array(*[F.floor((F.col("m") + k) / BLOCK) for k in (-minutes, 0, minutes)]))
    w = Window.partitionBy(*key, "_b").orderBy("m").rangeBetween(-minutes, minutes)
    out = sums.withColumn("_b", F.explode(blocks)).withColumns({c: F.sum(c).over(w) for c in "nsf"})
    return out.where(F.col("_b") == F.floor(F.col("m") / BLOCK)).drop("_b")


def neighbourhood(target: DataFrame, pool: DataFrame, minutes: int) -> DataFrame:
    """Per target (id, camera_id, time): rows, mean depth and flooded share of other cameras within so many minutes.

    Falls back to the pool's mean and share where nobody is near. The pool is first summed by camera and minute; a
    target's minute is among them, with nothing, so that its window is there.
    """
    minute = F.floor(F.unix_seconds("time") / 60).alias("m")
    zero = F.lit(0).cast("long")
    own = pool.groupBy("camera_id", minute).agg(F.count("*").alias("n"), F.sum("depth_cm").alias("s"), F.count_if(F.col("depth_cm") >= FLOODED_CM).alias("f"))
    t = target.select("id", "camera_id", minute)
    asked = t.select("camera_id", "m").distinct().select("camera_id", "m", *[zero.alias(c) for c in "nsf"])
    every = own.unionByName(asked).groupBy("camera_id", "m").agg(*[F.sum(c).alias(c) for c in "nsf"])
    same = _around(every, ["camera_id"], minutes).select("camera_id", "m", *[F.col(c).alias(f"_{c}") for c in "nsf"])
    whole = _around(every.groupBy("m").agg(*[F.sum(c).alias(c) for c in "nsf"]), [], minutes)
    near = t.join(whole, "m").join(same, ["camera_id", "m"]).select("id", *[(F.col(c) - F.col(f"_{c}")).alias(c) for c in "nsf"])
    total = own.agg(*[F.sum(c).alias(f"all_{c}") for c in "nsf"])
    out = target.select("id").join(near.where("n > 0"), "id", "left").crossJoin(F.broadcast(total))  # one row
    n = F.coalesce(F.col("n"), F.col("all_n"))
    pick = lambda c: F.when(F.col("n").isNotNull(), F.col(c)).otherwise(F.col(f"all_{c}"))
    return out.select("id", F.coalesce("n", zero).alias("n_near"), (pick("s") / n).alias("mean_depth"), (pick("f") / n).alias("flooded_share"))


def latest_per_key(df: DataFrame, key: str, time: str, *columns: str) -> DataFrame:
    """The newest row of each key; the greater columns at equal times."""
    return df.groupBy(key).agg(F.max(F.struct(time, *columns)).alias("m")).select(key, "m.*")


def alert_window(as_of: Column, hours: int) -> tuple[Column, Column]:
    """From the start of the clock hour of ``as_of``, or of one so many hours earlier, to ``as_of``."""
    if hours not in (1, 2):
        raise ValueError("hours must be 1 or 2")
    return F.date_trunc("hour", as_of) - F.make_interval(hours=F.lit(hours - 1)), as_of


def _worst_and_latest(df: DataFrame, key: str, value: str, least: float, as_of: Column, hours: int, columns: list[str], hourly: DataFrame | None) -> DataFrame:
    """Per key, replays apart: the row of the greatest value (the earliest of several) and the newest row, if the value is enough.

    ``hourly`` (key, bucket, is_replay, max_<value>) names the keys worth reading, so that other raw rows are not.
    """
    start, end = alert_window(as_of, hours)
    rows = df.where((F.col("time") >= start) & (F.col("time") <= end)).withColumn("is_replay", F.col("replay_of").isNotNull())
    if hourly is not None:
        some = hourly.where((F.col("bucket") >= start) & (F.col("bucket") <= end) & (F.col(f"max_{value}") >= least)).select(key, "is_replay").distinct()
        rows = rows.join(some, [key, "is_replay"], "left_semi")
    row = F.struct("time", *columns)
    # nulls of the value are less than any number; an earlier time is more where values are equal
    worst = F.max_by(F.struct(*row_fields("time", columns), "replay_of"), F.struct(F.col(value), -F.unix_micros("time")))
    got = rows.groupBy(key, "is_replay").agg(worst.alias("worst"), F.max_by(row, F.struct("time", value)).alias("latest"))
    return got.where(F.col(f"worst.{value}") >= least)


def row_fields(time: str, columns: list[str]) -> list[Column]:
    return [F.col(c) for c in (time, *columns)]


def camera_alerts(readings: DataFrame, cameras: DataFrame, roads: DataFrame, as_of: Column, hours: int = 2, hourly: DataFrame | None = None) -> DataFrame:
    """Cameras flagged up to ``as_of``: worst and latest reading, camera and road, known-dry cameras last, highest first.

    readings: camera_id, time, p_mil, depth_cm, replay_of. A reading without a camera row stays, as not known dry; a
    flag after ``as_of`` does not count. Roads are joined where the camera has one.
    """
    got = _worst_and_latest(readings, "camera_id", "p_mil", FLAG, as_of, hours, ["p_mil", "depth_cm"], hourly)
    out = got.join(cameras, "camera_id", "left").withColumn("known_dry", F.coalesce("known_dry", F.lit(False))).join(roads, "seg_id", "left")
    return out.orderBy("known_dry", F.desc("worst.p_mil"), "camera_id", "is_replay")


def sensor_alerts(levels: DataFrame, as_of: Column, hours: int = 2, hourly: DataFrame | None = None) -> DataFrame:
    """Stations with water on the road up to ``as_of``: worst and latest level, deepest first."""
    got = _worst_and_latest(levels, "station", "depth_on_road_cm", FLOODED_CM, as_of, hours, ["depth_on_road_cm", "level_m"], hourly)
    return got.orderBy(F.desc("worst.depth_on_road_cm"), "station", "is_replay")


def alert_peaks(readings: DataFrame) -> DataFrame:
    """Hours by flagged cameras and flooded sensors, known-dry cameras apart; hours of either kind count, missing is 0."""
    hour = F.date_trunc("hour", "time").alias("bucket")
    flags = readings.where(F.col("p_mil") >= FLAG).groupBy(hour).agg(
        F.count_distinct(F.when(~F.col("known_dry"), F.col("camera_id"))).alias("flagged"), F.count_distinct(F.when(F.col("known_dry"), F.col("camera_id"))).alias("dry_flagged")
    )
    wet = readings.where((F.col("depth_cm") >= FLOODED_CM) & ~F.col("known_dry")).groupBy(hour).agg(F.count_distinct("camera_id").alias("wet"))
    both = flags.join(wet, "bucket", "full")
    return both.select("bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("flagged", "dry_flagged", "wet")])


def still_log_status(log: DataFrame) -> DataFrame:
    """Per camera in time order: http_error, not_image, stale, duplicate of the last good still, dark, ok.

    log: camera_id, round, http, is_image, age_s, sha1, luma.
    """
    w = Window.partitionBy("camera_id").orderBy("round")
    fresh = F.when(F.col("http") != 200, "http_error").when(~F.col("is_image"), "not_image").when(F.col("age_s") > STALE_S, "stale")
    good = log.withColumn("_bad", fresh).withColumn("_sha", F.when(F.col("_bad").isNull(), F.col("sha1")))
    before = F.last("_sha", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    status = F.coalesce(F.col("_bad"), F.when(F.col("_sha").eqNullSafe(before), "duplicate").when(F.col("luma") < DARK, "dark").otherwise("ok"))
    return good.withColumn("status", status).drop("_bad", "_sha")


def placeholder_cards(log: DataFrame, cameras: int = 3) -> DataFrame:
    """Stills that as many cameras or more sent in one round."""
    many = log.where("sha1 is not null").select("round", "sha1", "camera_id").distinct().groupBy("round", "sha1").count().where(F.col("count") >= cameras)
    return log.join(many.select("round", "sha1"), ["round", "sha1"], "left_semi")


def circuit_check(log: DataFrame, least: int = 40, share: float = 0.5) -> DataFrame:
    """Per round the first attempt at which more than ``share`` of at least ``least`` attempts had failed, else null."""
    w = Window.partitionBy("round").orderBy("attempt")
    run = log.withColumn("_n", F.row_number().over(w)).withColumn("_f", F.sum(F.col("failed").cast("int")).over(w))
    return run.groupBy("round").agg(F.min(F.when((F.col("_n") >= least) & (F.col("_f") > share * F.col("_n")), F.col("attempt"))).alias("stop_at"))


def _shifted(df: DataFrame, start: Column, end: Column, to: Column, time: str) -> DataFrame:
    """The rows of a time range, both ends in it, that are no replay, shifted so that the range ends at ``to``; replay_of is their own time."""
    real = df.where("replay_of is null") if "replay_of" in df.columns else df
    moved = real.where((F.col(time) >= start) & (F.col(time) <= end)).withColumn("replay_of", F.col(time))
    return moved.withColumn(time, F.timestamp_micros(F.unix_micros(time) + F.unix_micros(to) - F.unix_micros(end)))


def replay(df: DataFrame, start: Column, end: Column, to: Column, key: list[str], time: str = "time", complete: bool = True) -> DataFrame:
    """The rows that a replay adds: those of a time range shifted so that it ends at ``to``, each with its own time as replay_of.

    Replayed rows are not replayed again. A row whose key is there already is left out and never written over the other.
    Nothing is replayed from a load that is not ``complete`` (the status of the last load, ``sinks.last_status``).
    """
    if not complete:
        raise Refused("the last load is not complete: load first, then replay")
    return _shifted(df, start, end, to, time).join(df.select(key), key, "left_anti").select(*[c for c in df.columns if c != "replay_of"], "replay_of")


def replay_counts(df: DataFrame, start: Column, end: Column, to: Column, key: list[str], time: str = "time") -> DataFrame:
    """One row: how many rows a replay moves, and how many it skips because their key is there already.

    ``key`` may hold ``hour``, the hour of a row's time, which moves with it.
    """
    moved = _shifted(df, start, end, to, time)
    moved = moved.withColumn("hour", F.date_trunc("hour", time)) if "hour" in key else moved
    out = moved.join(df.select(*key).distinct().withColumn("_there", F.lit(True)), key, "left")
    return out.agg(F.count_if(F.col("_there").isNull()).alias("moved"), F.count("_there").alias("skipped"))


def replay_batches(moved: DataFrame, n: int, start: Column, end: Column) -> DataFrame:
    """``moved`` (with replay_of) with batch, 1 to n: the range cut in n spans of like length, each with its end, the first
    with its start too. Rows of a busy span are one batch, as they would have come."""
    if n < 1:
        raise ValueError("n must be at least 1")
    begin, length = F.unix_micros(start), F.unix_micros(end) - F.unix_micros(start)
    at = F.ceil((F.unix_micros("replay_of") - begin) * n / F.nullif(length, F.lit(0))).cast("int")
    return moved.withColumn("batch", F.least(F.greatest(F.coalesce(at, F.lit(1)), F.lit(1)), F.lit(n)))


def build_labels(frames: DataFrame, stills: DataFrame, twins: dict[str, str]) -> DataFrame:
    """time, site, role and depth_cm: measured frames (role cv) and known-dry stills (role extra, depth 0, never trained on).

    frames: station, time, depth_on_road_cm (null where not known: left out). Cameras at one place share a site
    (``twins``, station to the one it shares with), so that they are held out together; every still's camera has its own.
    """
    site = F.col("station")
    for a, b in twins.items():
        site = F.when(F.col("station") == a, b).otherwise(site)
    measured = frames.where("depth_on_road_cm is not null").select("time", site.alias("site"), F.lit("cv").alias("role"), F.col("depth_on_road_cm").cast("double").alias("depth_cm"))
    dry = stills.select("time", F.concat(F.lit("NCDOT_"), F.col("camera_id").cast("string")).alias("site"), F.lit("extra").alias("role"), F.lit(0.0).alias("depth_cm"))
    return measured.unionByName(dry)
